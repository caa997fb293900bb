"""Settings and providers as small keyed tables, from logs of changes: the last change of a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settings(changes: DataFrame) -> DataFrame:
    """(key, value), by key, of changes (pos, key, value); a null value removes its key."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), "pos").alias("last"))
    return last.select("key", "last.value").where("value is not null").orderBy("key")


def providers(changes: DataFrame) -> DataFrame:
    """(name, base_url, is_default), by name, of changes (pos, action, name, base_url, is_default).

    ``add`` sets a provider, ``remove`` drops it, ``default`` makes it the only default, as
    adding one as default does.
    """
    own = F.col("action").isin("add", "remove")
    last = changes.groupBy("name").agg(
        F.max_by(F.struct("action", "base_url"), F.when(own, F.col("pos"))).alias("last"),
        F.max(F.when(own, F.col("pos"))).alias("set_at"),
        F.max(F.when((F.col("action") == "default") | ((F.col("action") == "add") & F.col("is_default")), F.col("pos"))).alias("default_at"),
    )
    there = last.where("last.action = 'add'").withColumn("default_at", F.when(F.col("default_at") >= F.col("set_at"), F.col("default_at")))
    newest = changes.where("action = 'default' or (action = 'add' and is_default)").agg(F.max("pos")).first()[0]
    return there.select("name", "last.base_url", F.coalesce(F.col("default_at") == F.lit(newest), F.lit(False)).alias("is_default")).orderBy("name")
