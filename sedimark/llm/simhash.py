"""SimHash near-duplicates through covering locality-sensitive hashing (Pagh, 2016).

A fingerprint has a bit for each bit of the shingles' 64-bit hashes, set if most
hashes set it. Two fingerprints within RADIUS bits are linked; components of links are
groups of near copies.

Candidates come from 2**(RADIUS + 1) - 1 = 15 tables. Bit i carries a non-zero vector
p(i) of four bits, and table v keys a fingerprint by its bits with <p(i), v> = 1. The
vectors of at most three differing bits leave some v orthogonal to all of them, so in
that table the two keys are equal: every pair within the radius meets, by construction.

Fingerprints are made distinct first, so copies cost one row. A bucket of two is
compared where it is counted. Larger ones are compared by blocks of at most
MAX_BUCKET; a larger bucket is covered again over the bits that its key leaves free,
in 15 tables that pin half of them. Two such levels leave eight free bits, hence at
most 256 fingerprints: no bucket is capped, and none is compared whole in one task
beyond MAX_BUCKET. From a bucket come links to the smallest fingerprint of each of its
groups, not all pairs.

Defined cases: texts of any length are read whole, a stretch of shingles at a time; a null, empty or blank text has no words and fingerprint zero, linked
like any other; repeated rows stay and share a component; a document with a null id
gets the component of its fingerprint but names none; an empty table gives an empty
table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import forget, settled, trim
from sedimark.llm.components import components

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
#: Largest bucket that is compared at once; at least the 256 that the last level can hold.
MAX_BUCKET = 512
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
CHUNK = 1 << 15

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, the highest bit first."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate(([0], ends[:-1])), ends - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[len(ends) - n :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hexadecimal digits) for each row of docs."""

    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([fingerprint(t).hex() for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        trim()
        return found

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.arrow_udf(run, "string")(F.col(f"`{text}`")).alias("fingerprint"))


def masks(free: tuple[int, ...], radius: int = RADIUS) -> list[int]:
    """The covering masks over the free bits: for any radius of them, some mask has none."""
    vectors = (1 << (radius + 1)) - 1
    carried = {bit: 1 + i % vectors for i, bit in enumerate(free)}
    return [sum(1 << b for b, p in carried.items() if (p & v).bit_count() % 2) for v in range(1, vectors + 1)]


def levels() -> list[dict[int, list[int]]]:
    """At each level, for each pinned mask of the level before, the masks of its tables."""
    found, pinned = [], [0]
    for _ in range(3):
        level = {p: [p | m for m in masks(tuple(b for b in range(BITS) if not p >> b & 1))] for p in pinned}
        found.append(level)
        pinned = sorted({m for covered in level.values() for m in covered})
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(rows: DataFrame, free: Column) -> DataFrame:
    """(f, pinned, key) for each of the masks in the array free, of rows with f."""
    return rows.select("f", F.explode(free).alias("pinned")).select("f", "pinned", F.col("f").bitwiseAND(F.col("pinned")).alias("key"))


def _covered(pinned: Column) -> Column:
    """The 15 masks below a pinned mask: masks() over its free bits, in column expressions."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(pinned, b) == 0)
    vectors = (1 << (RADIUS + 1)) - 1

    def mask(v: int) -> Column:
        def joined(i: Column, m: Column) -> Column:
            p = (i % vectors + 1).bitwiseAND(F.lit(v))
            return F.when(F.bit_count(p) % 2 == 1, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.element_at(bits, i + 1)))).otherwise(m)

        return F.aggregate(F.sequence(F.lit(0), F.size(bits) - 1), pinned, lambda m, i: joined(i, m))

    return F.array(*(mask(v) for v in range(1, vectors + 1)))


def _near(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: each fingerprint that reaches a smaller one, and the smallest it reaches within the bucket."""
    f = np.sort(n)
    linked = np.bitwise_count(f[:, None] ^ f[None, :]) <= RADIUS
    labels = np.arange(len(f))
    while True:
        least = np.where(linked, labels[None, :], len(f)).min(axis=1)
        least = least[least]
        if (least == labels).all():
            break
        labels = least
    moved = labels != np.arange(len(f))
    return f[moved], f[labels[moved]]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (pinned, key); the rows come sorted by them."""
    pinned = key = f = np.empty(0, np.int64)
    ended = object()
    for batch in _and_last(batches, ended):
        last = batch is ended
        if not last:
            pinned, key, f = (np.concatenate((old, batch.column(c).to_numpy())) for old, c in ((pinned, "pinned"), (key, "key"), (f, "f")))
        if not len(f):
            continue
        cuts = np.flatnonzero((pinned[1:] != pinned[:-1]) | (key[1:] != key[:-1])) + 1
        cuts = [0, *cuts.tolist(), *([len(f)] if last else [])]
        found = [_near(f[a:b].view(np.uint64)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
        pinned, key, f = pinned[cuts[-1] :], key[cuts[-1] :], f[cuts[-1] :]
        if found:
            a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
            yield pa.record_batch({"a": a, "b": b})


def _and_last(batches: Iterator, ended: object) -> Iterator:
    yield from batches
    yield ended


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints f (bigint): enough links to join all that chains within the radius join."""
    found: list[DataFrame] = []
    rows = _tables(distinct, F.array(*(F.lit(_signed(m)).cast("bigint") for m in levels()[0][0])))
    for level in range(3):
        counted = rows.groupBy("pinned", "key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1")
        buckets = settled(counted)
        found.append(buckets.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b"))
        members = rows.join(buckets.where("n > 2").select("pinned", "key", "n"), ["pinned", "key"])
        if level < 2 and buckets.where(F.col("n") > MAX_BUCKET).limit(1).count():
            members = settled(members)
            rows = _tables(members.where(F.col("n") > MAX_BUCKET).select("f", _covered(F.col("pinned")).alias("c")), F.col("c")).distinct()
            small = members.where(F.col("n") <= MAX_BUCKET)
        else:
            rows, small = None, members
        dealt = small.select("pinned", "key", "f").repartition("pinned", "key").sortWithinPartitions("pinned", "key")
        found.append(dealt.mapInArrow(_bucket_links, "a bigint, b bigint"))
        if rows is None:
            break
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; component_id is the smallest doc_id of its group."""
    prints = settled(fingerprints(docs, doc_id, text).withColumn("f", F.conv("fingerprint", 16, -10).cast("bigint")))
    distinct = settled(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("f")))
    linked = settled(distinct.join(labels.withColumnRenamed("node", "f"), "f"))
    smallest = linked.groupBy("label").agg(F.min("least").alias("component"))
    moved = linked.join(smallest, "label").select("f", "component")
    classes = distinct.join(moved, "f", "left").select("f", F.coalesce("component", "least").alias("component_id"))
    return prints.join(classes, "f").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stable: bool = False) -> DataFrame:
    """docs without all but one row of each group: that of the smallest doc_id (a null id only where there is no other), the first of equal ones.

    stable says that docs come from files, so that they are read alike twice; others are written first. Texts are shuffled once.
    """
    row = f"_row_{uuid.uuid4().hex[:8]}"
    numbered = (docs if stable else settled(docs, "zstd")).withColumn(row, F.monotonically_increasing_id())
    groups = near_duplicates(numbered, row, text)
    named = numbered.select(row, F.col(f"`{doc_id}`").alias("name")).join(groups.select(F.col("doc_id").alias(row), "component_id"), row)
    first = named.groupBy("component_id").agg(F.min_by(row, F.struct(F.col("name").isNull(), "name", row)).alias(row))
    return numbered.join(first.select(row), row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
