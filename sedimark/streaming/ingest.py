"""Blobs that arrive: files are analysed once, as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimark.functions import blobs as B
from sedimark.functions import metadata as M
from sedimark.operators import sniff

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, limit: int, late: str = "1 hour") -> DataFrame:
    """New files below a path, each content once within the watermark."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limit)
    named = files.select("modificationTime", F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), "content", F.sha2("content", 256).alias("hash_sha256"))
    return named.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["hash_sha256"])


def described(files: DataFrame) -> DataFrame:
    """Kind, strings, versions and licences of streamed files: all that needs no second pass."""
    named = files.select("file_name", "hash_sha256", F.length("content").cast("bigint").alias("size_bytes"), sniff.kind(F.col("content")).alias("kind"), B.extract_strings(F.col("content")).alias("strings"))
    return M.with_license_info(M.with_version_info(named, "strings"), "strings")


def write(described_files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until all that is there is done."""
    return described_files.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
