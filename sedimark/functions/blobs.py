"""Columns over blob bytes: views, integers, printable strings, histograms, digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings kept of each extraction.
STRINGS = 50


def latin1(content: Column) -> Column:
    """Bytes as text, one character for each, so that regular expressions see raw bytes."""
    return F.decode(content, "ISO-8859-1")


def le_u32(content: Column, offset: int | Column) -> Column:
    """The unsigned 32-bit little-endian integer at an offset; null beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    part = F.hex(F.substring(content, at + 1, F.lit(4)))
    swapped = F.regexp_replace(part, "^(..)(..)(..)(..)$", "$4$3$2$1")
    return F.when(F.length(part) == 8, F.conv(swapped, 16, 10).cast("bigint"))


def has(content: Column, *patterns: bytes) -> Column:
    """Whether any of the byte patterns occurs."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(content, F.lit(p))
    return found


def begins(content: Column, *patterns: bytes) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.startswith(content, F.lit(p))
    return found


def extract_strings(content: Column, limit: int = STRINGS) -> Column:
    """The first ``limit`` distinct printable strings in byte order.

    A string is a maximal run of at least three printable ASCII characters, spaces and
    tabs, trimmed of the latter two. Runs of over 200 characters, and runs of white space
    or of punctuation alone, are left out.
    """
    runs = F.regexp_extract_all(latin1(content), F.lit(r"[\x20-\x7E\t]{3,}"), F.lit(0))
    sound = F.filter(runs, lambda s: (F.length(s) <= 200) & ~s.rlike(r"^[ \t]+$") & ~s.rlike(r"^[!-/:-@\[-`{-~]+$"))
    return F.slice(F.array_sort(F.array_distinct(F.transform(sound, lambda s: F.btrim(s, F.lit(" \t"))))), 1, limit)


def text_ratio(content: Column) -> Column:
    """Share of graphic and white-space ASCII bytes; null for an empty blob."""
    kept = F.length(F.regexp_replace(latin1(content), r"[^\x21-\x7E \t\n\x0C\r]", ""))
    return F.try_divide(kept.cast("double"), F.length(content).cast("double"))


def _histogram(blobs: pa.Array) -> pa.Array:
    return pa.array([None if b is None else np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in blobs.to_pylist()], pa.list_(pa.int64()))


def byte_histogram(content: Column) -> Column:
    """Counts of the 256 byte values, in one pass over each blob and without a shuffle."""
    return F.arrow_udf(_histogram, "array<bigint>")(content)


def _entropy(blobs: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> float | None:
        if data is None:
            return None
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        share = n[n > 0] / max(1, len(data))
        return max(0.0, float(-(share * np.log2(share)).sum()))

    return pa.array([one(b) for b in blobs.to_pylist()], pa.float64())


def entropy(content: Column) -> Column:
    """Shannon entropy in bits of the bytes; 0 for an empty blob."""
    return F.arrow_udf(_entropy, "double")(content)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


# BLAKE3, from its published specification. Initial words and word order.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression function over many inputs at once: columns of uint32."""
    n = chain.shape[1]
    iv = np.repeat(np.array(_IV[:4], np.uint32)[:, None], n, axis=1)
    tail = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)])
    v, m = np.concatenate([chain, iv, tail]), words

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x >> np.uint32(by)) | (x << np.uint32(32 - by))

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] += v[b] + word
            v[d] = turned(v[d] ^ v[a], first)
            v[c] += v[d]
            v[b] = turned(v[b] ^ v[c], second)

    for turn in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = m[list(_ORDER)]
    return v[:8] ^ v[8:]


def blake3_hexes(blobs: list[bytes]) -> list[str]:
    """BLAKE3 of blobs: the chunks of 1,024 bytes of all of them are hashed together, then their trees level by level."""
    if not blobs:
        return []
    sizes = np.array([len(b) for b in blobs])
    chunks = np.maximum(1, -(-sizes // 1024))
    begin, owner = np.cumsum(chunks) - chunks, np.repeat(np.arange(len(blobs)), chunks)
    place = np.arange(chunks.sum()) - begin[owner]
    padded = np.zeros(int(chunks.sum()) * 1024, np.uint8)
    for at, data in zip((begin * 1024).tolist(), blobs, strict=True):
        padded[at : at + len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(-1, 16, 16)
    size = np.minimum(1024, np.maximum(0, sizes[owner] - 1024 * place))
    chain = np.repeat(np.array(_IV, np.uint32)[:, None], len(owner), axis=1)
    last = np.maximum(1, -(-size // 64)) - 1
    for block in range(16):
        live = np.flatnonzero(last >= block)
        if not len(live):
            break
        ends = last[live] == block
        flags = (_START if block == 0 else 0) + _END * ends + _ROOT * (ends & (chunks[owner[live]] == 1))
        chain[:, live] = _compress(chain[:, live], words[live, block].T.astype(np.uint32), place[live], np.clip(size[live] - 64 * block, 0, 64), flags)
    counts = chunks
    while (counts > 1).any():
        # Subtrees to the left are whole, so pairing level by level builds the trees; an odd node waits.
        begin, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(blobs)), counts)
        place = np.arange(len(owner)) - begin[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        keys = np.repeat(np.array(_IV, np.uint32)[:, None], len(left), axis=1)
        root = _ROOT * (counts[owner[left]] == 2)
        chain[:, left] = _compress(keys, np.concatenate([chain[:, left], chain[:, left + 1]]), np.zeros(len(left), np.int64), np.full(len(left), 64), _PARENT | root)
        chain, counts = chain[:, place % 2 == 0], (counts + 1) // 2
    return [row.tobytes().hex() for row in np.ascontiguousarray(chain.T).astype("<u4")]


def blake3_hex(data: bytes) -> str:
    return blake3_hexes([data])[0]


def _blake3(blobs: pa.Array) -> pa.Array:
    found = blobs.to_pylist()
    hexes = iter(blake3_hexes([b for b in found if b is not None]))
    return pa.array([None if b is None else next(hexes) for b in found], pa.string())


def blake3(content: Column) -> Column:
    return F.arrow_udf(_blake3, "string")(content)
