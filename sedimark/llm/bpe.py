"""Byte-level BPE by a global distinct-word shuffle, and its inverse.

Documents are dealt into blocks of some BLOCK_BYTES by a hash of the row. Each block is split into
pre-tokens, and its distinct ones are dealt on, packed, by a hash of the word: one row
for each (block, word bucket). A bucket encodes each distinct word of the whole corpus
once and answers every block in the order of its question. The answers go back to the
blocks, where each document is reassembled by the positions of its pre-tokens.

Packing keeps the exploded rows, (block, word) and back, at a few bytes each. Every
word costs a block one entry, however often it occurs, so frequent words do not gather
rows. Numbers of blocks and buckets follow the bytes of text.

Decoding looks each id up in the table of token bytes, whose size is the vocabulary's.

Defined cases: a null or empty text has no ids; rows with a null id are encoded like any other; repeated rows stay, spread over the
blocks; a text of any length is one of its block, whole; an empty table gives
an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import table_bytes, trim

BLOCK_BYTES = 8 << 20
BLOCKS_A_BUCKET = 4

#: White space of Unicode, which the engines' \\s differ on.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled(pattern: str) -> str:
    """A pattern of pre-tokens with its white space spelled out, inside and outside of brackets."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def default_pattern() -> str:
    import public_tokenizers

    return spelled(public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    # Words come split already, so each is one match.
    return tiktoken.Encoding("bpe", pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    found = ranks(path)
    table = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        table[i] = token
    return table


def _narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def pack(values: np.ndarray, lengths: list[int]) -> bytes:
    """Lists of unsigned integers as one: their joined values, and the length of each; compressed."""
    import zstandard

    joined, sizes = _narrow(values), _narrow(np.array(lengths, np.uint32))
    head = np.array([len(sizes), sizes.itemsize, joined.itemsize], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + sizes.tobytes() + joined.tobytes())


def unpack(packed: bytes, kind: str) -> list[bytes]:
    """The lists, each as the bytes of its values in the kind given."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    n, size, width = np.frombuffer(data, "<u4", 3).tolist()
    sizes = np.frombuffer(data, f"<u{size}", n, 12).astype(np.int64)
    joined = np.frombuffer(data, f"<u{width}", -1, 12 + n * size).astype(kind)
    raw, ends = joined.tobytes(), np.cumsum(sizes) * joined.itemsize
    return [raw[a:b] for a, b in zip((ends - sizes * joined.itemsize).tolist(), ends.tolist(), strict=True)]


def _squeezed(texts: pa.Array) -> pa.Array:
    """Compressed texts, which are what is shuffled."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.array([squeeze(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _texts(squeezed: pa.ChunkedArray) -> Iterator[str]:
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    return (loosen(s.as_py()).decode() for s in squeezed)


def _questions(distinct: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The distinct pre-tokens of a block by bucket, in order: neighbours share their beginnings, which packs well."""
    asked: dict[int, list[str]] = {}
    for word in distinct:
        asked.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    for words in asked.values():
        words.sort()
    return asked


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs: the ids as little-endian unsigned 32-bit integers."""
    spark, pattern = docs.sparkSession, pattern or default_pattern()
    some = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parallel = spark.sparkContext.defaultParallelism
    blocks = max(2 * parallel, -(-table_bytes(some, "text") // BLOCK_BYTES))
    buckets = max(parallel, blocks // BLOCKS_A_BUCKET)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    # The place of a row spreads rows that are repeated with one id and text.
    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = some.select("doc_id", block.alias("block"), F.arrow_udf(_squeezed, "binary")("text").alias("text")).repartition(parts, "block")

    def ask(block: pa.Table) -> pa.Table:
        distinct: dict[str, None] = {}
        split = splitter(pattern)
        for text in _texts(block["text"]):
            distinct.update(dict.fromkeys(split(text)))
        asked = _questions(distinct, buckets)
        packed = []
        for words in asked.values():
            encoded = [w.encode() for w in words]
            packed.append(pack(np.frombuffer(b"".join(encoded), np.uint8), [len(w) for w in encoded]))
        del distinct
        trim()
        return pa.table({"bucket": pa.array(list(asked), pa.int32()), "block": pa.array([block["block"][0].as_py()] * len(asked), pa.int32()), "words": pa.array(packed, pa.binary())})

    def answer(bucket: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        one, whole, answers = encoder(vocabulary), ranks(vocabulary).get, []
        for words in bucket["words"]:
            ids = []
            for word in unpack(words.as_py(), "u1"):
                found = known.get(word)
                if found is None:
                    # A word that is a token is that token.
                    token = whole(word)
                    found = known[word] = [token] if token is not None else one(word.decode())
                ids.append(found)
            joined = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
            answers.append(pack(joined, [len(x) for x in ids]))
        known.clear()
        trim()
        return pa.table({"bucket": bucket["bucket"], "block": bucket["block"], "ids": pa.array(answers, pa.binary())})

    def assemble(block: pa.Table, answers: pa.Table) -> pa.Table:
        # Each text as its pre-tokens; equal ones are one object, so a place costs a pointer.
        split, distinct = splitter(pattern), {}
        placed = [list(map(distinct.setdefault, words := split(t), words)) for t in _texts(block["text"])]
        asked = _questions(distinct, buckets)
        ids: dict[str, bytes] = {}
        for bucket, packed in zip(answers["bucket"].to_pylist(), answers["ids"], strict=True):
            ids.update(zip(asked[bucket], unpack(packed.as_py(), "<u4"), strict=True))
        of = ids.__getitem__
        found = pa.table({"doc_id": block["doc_id"], "ids": pa.array([b"".join(map(of, words)) for words in placed], pa.binary())})
        del placed, asked, ids, of, distinct
        trim()
        return found

    kind = some.schema["doc_id"].dataType.simpleString()
    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, words binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "bucket int, block int, ids binary")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, ids binary")


def decoded(values: Iterator[bytes | None], vocabulary: str) -> list[bytes | None]:
    of = token_bytes(vocabulary).__getitem__
    return [v if v is None else b"".join(map(of, np.frombuffer(v, "<u4").tolist())) for v in values]


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for; null ids give null."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array(decoded(values.to_pylist(), vocabulary), pa.binary())

    return encoded.withColumn(into, F.arrow_udf(run, "binary")(F.col(f"`{ids}`")))
