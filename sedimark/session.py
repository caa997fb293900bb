"""Sessions and what the executors need to run this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the same path as the driver.

    Where executors have another file system, install the package on them or
    pass it with ``--py-files``; the entry added here then does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and measurements on one machine."""
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("sedimark")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share.

    Where none is set, a session of one process gets a temporary one.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sedimark-"))
        top = context.getCheckpointDir()
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top.rstrip('/')}/sedimark-{uuid.uuid4().hex}"


def settled(df: DataFrame, codec: str = "lz4") -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
