"""From raw documents to token ids, in stages.

Each stage reads all that its predecessor kept. Languages, copies, benchmark passages
and secrets are decided on whole texts; the last stage turns what is left into ids. Stages are
given files, which they may read more than once.

Defined cases, for every stage: rows are judged one by one, whatever their ids, so a null doc_id is
judged like any other; a null or empty text has no language and goes in the first stage, and passes the
others as it is; texts of any length are read whole; of repeated rows one passes near_duplicates, and all
pass the others; ties of near copies go to the smallest doc_id, then to the first row; an empty table gives
an empty table; columns of the input keep their names, order and types, whatever they are called, but for the
last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import bpe, decontaminate, langid, secrets, simhash
from sedimark.llm.common import bound_batches, settled, table
from sedimark.llm.queries import vocabulary

#: Least score of a predicted language. Texts without letters have score 0.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    bound_batches(spark)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id"), 4, 2))
    return langid.identified(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    bound_batches(spark)
    return simhash.one_of_each(docs, stable=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), stable=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret, and n_chars to match."""
    bound_batches(spark)
    masked = secrets.redact_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of them and of what they decode to."""
    bound_batches(spark)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = bpe.decode(bpe.encode(docs, path), path)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("token_ids", token_ids),
]

#: The language model and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return settled(STAGES[-1][1](spark, docs, sf_dir))
