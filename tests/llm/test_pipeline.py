import hashlib

import numpy as np
import pytest

import corpus_pipeline
from sedimark.llm import bpe, queries
from sedimark.llm.common import settled


def test_stages_equal_their_operators_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(settled(stage(spark, kept[-1], sf)))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    assert all(d.columns == columns for d in kept[1:-1])
    groups = {}
    for r in queries.op2_simhash(spark, sf).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert ids[1] - ids[2] == {d for g in groups.values() for d in (g & ids[1]) - {min(g & ids[1], default=None)}}
    leaks = {r.doc_id for r in queries.op10_decontaminate(spark, sf).collect()}
    assert ids[3] == ids[2] - leaks
    assert ids[5] == ids[4] == ids[3]
    texts = {r.doc_id: r for r in kept[4].collect()}
    assert all(len(r.text) == r.n_chars for r in texts.values()) and not any('token = "' in r.text for r in texts.values())
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    for r in kept[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest()
        assert bpe.decoded([bytes(r.ids)], path) == [texts[r.doc_id].text.encode()] and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))


@pytest.mark.parametrize("place", range(5))
def test_stages_take_empty_tables_and_nulls(spark, sf, place):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "le chat et les chiens", "fr", "s", 21), (1, "le chat et les chiens", "fr", "s", 21)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = corpus_pipeline.STAGES[place][1]
    assert stage(spark, docs.limit(0), sf).count() == 0
    assert stage(spark, docs, sf).count() == [2, 2, 3, 3, 3][place]
