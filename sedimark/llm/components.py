"""Connected components by alternating star contraction (Kiveris et al., 2014).

Each round replaces every link by links to the smallest neighbour, first towards the
larger and then towards the smaller neighbours, until every component is a star. The
rounds use joins and aggregates only; each is cut from the last through the shared
folder, so a lost executor costs a part of one round. Nodes with many links are split
by adaptive skew joins; their minima are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import forget, settled


def _pointed(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b: bigint): label is the smallest node that it reaches.

    Links from a node to itself and repeated links change nothing; no links, no rows.
    """
    now = settled(_pointed(links))
    state = _state(now)
    while state[0]:
        following = settled(_pointed(_small_star(_pointed(_large_star(now)))))
        forget(now)
        before, state, now = state, _state(following), following
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
