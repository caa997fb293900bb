"""What the operators share: reading tables, files in shared folders, Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.session import settled, shared_dir

__all__ = ["bound_batches", "forget", "get_file", "open_file", "put_file", "settled", "shared_dir", "struct_column", "structs", "table", "table_bytes", "trim", "unlink", "with_columns"]

#: Rows and bytes of one Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that long texts do not swell; queries and stages call it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unlink(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by settled()."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        unlink(df.sparkSession, name)


def _uri(folder: str) -> str:
    """file:/x and /x as file:///x, which Arrow's file systems read."""
    return re.sub(r"^(?:file:)?/(?!/)", "file:///", folder)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of a shared folder aside and rename it, so that a repeated task leaves the same file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(folder))
    system.create_dir(path, recursive=True)
    own = f"{path}/_writing-{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")


def get_file(folder: str, name: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(folder))
    with system.open_input_stream(f"{path}/{name}") as found:
        return found.read()


def open_file(folder: str, name: str) -> pa.NativeFile:
    """A file of a shared folder, to be read from any place."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(folder))
    return system.open_input_file(f"{path}/{name}")


def trim() -> None:
    """Give freed memory back to the system, as workers stay while other stages and operators run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def struct_column(rows: Callable[[list], Iterable[tuple]], schema: str, column: Column) -> Column:
    """A struct column from a function of a list of values (texts, None for null), by Arrow batches."""
    def run(values: pa.Array) -> pa.Array:
        found = structs(list(rows(values.to_pylist())), schema)
        trim()
        return found

    return F.arrow_udf(run, f"struct<{schema}>")(column)


def structs(rows: list[tuple], schema: str) -> pa.StructArray:
    """Rows as structs of a schema like ``a:bigint,b:array<string>``."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    fields = [pa.field(n, kind(t)) for n, t in (f.split(":") for f in schema.split(","))]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.StructArray.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)


def with_columns(df: DataFrame, rows: Callable[[list], Iterable[tuple]], schema: str, column: str) -> DataFrame:
    """df and the fields of schema, made from one column. Columns of df with the same names are replaced."""
    names = [f.split(":")[0] for f in schema.split(",")]
    made = f"_made_{uuid.uuid4().hex[:8]}"
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    return df.select(*(F.col(f"`{c}`") for c in keep), struct_column(rows, schema, F.col(f"`{column}`")).alias(made)).select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"{made}.{n}").alias(n) for n in names))


def table_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, all rows."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
