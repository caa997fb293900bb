"""Blobs as rows (file_name, content), from files, text columns and upload forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIENT_LIMIT = 100 << 20
SERVER_LIMIT = 64 << 20


def from_files(spark: SparkSession, path: str, pattern: str | None = None, limit: int = CLIENT_LIMIT) -> DataFrame:
    """(path, file_name, length, content) of the files at a path up to a size, which the scan itself applies."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).where(F.col("length") <= limit)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), "length", "content")


def from_text(df: DataFrame, name: Column, text: str) -> DataFrame:
    """(file_name, content) of a text column; null texts have no blob."""
    return df.where(F.col(text).isNotNull()).select(name.cast("string").alias("file_name"), F.encode(F.col(text), "UTF-8").alias("content"))


def single_uploads(fields: DataFrame) -> DataFrame:
    """(request, file_name, content, error) of forms with one file.

    Fields are (request, pos, name, filename, content). Any file name seen becomes the
    request's, the last one; a field has the file if it is not empty and is named file or
    binary, has a file name, or is longer than ten bytes; the last such field wins.
    """
    size = F.length("content")
    fits = (size > 0) & (F.coalesce(F.col("name").isin("file", "binary"), F.lit(False)) | F.col("filename").isNotNull() | (size > 10))
    found = fields.groupBy("request").agg(
        F.max_by("filename", F.when(F.col("filename").isNotNull(), F.col("pos"))).alias("file_name"),
        F.max_by("content", F.when(fits, F.col("pos"))).alias("content"),
    )
    return found.select("request", F.coalesce("file_name", F.lit("uploaded_file")).alias("file_name"), "content", F.when(F.col("content").isNull(), "empty_file").alias("error"))


def pair_uploads(fields: DataFrame) -> DataFrame:
    """(request, first, second, error): the two files of forms that have exactly two fields."""
    files = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("filename", F.lit("unknown")).alias("file_name"), "content")))
    found = fields.groupBy("request").agg(files.alias("files"))
    two = F.size("files") == 2
    return found.select("request", F.when(two, F.get("files", F.lit(0))).alias("first"), F.when(two, F.get("files", F.lit(1))).alias("second"), F.when(~two, "invalid_input").alias("error"))


def field_profile(fields: DataFrame) -> DataFrame:
    """Name, type, size and preview of each form field, with the number of its request's fields.

    A preview is the first 100 bytes as UTF-8, with a replacement character for what is none. Fields without a
    column content_type have none.
    """
    text = F.make_valid_utf8(F.substring("content", 1, 100).cast("string"))
    preview = F.when(F.length("content") <= 100, text).otherwise(F.concat(text, F.lit("... (truncated)")))
    total = fields.groupBy("request").agg(F.count(F.lit(1)).alias("total_fields"))
    kind = F.col("content_type") if "content_type" in fields.columns else F.lit(None).cast("string")
    own = fields.select("request", "pos", F.coalesce("name", F.lit("unknown")).alias("name"), "filename", kind.alias("content_type"), F.length("content").alias("size"), preview.alias("preview"))
    return own.join(total, "request")


def health(spark: SparkSession, service: str = "sedimark", version: str = "1.0") -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit(service).alias("service"), F.lit(version).alias("version"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)
