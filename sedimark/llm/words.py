"""Perplexity of texts under a modified Kneser-Ney model of the words of all other documents.

The model (Chen and Goodman, 1998) has n-grams of ORDER words for each language. Its highest order
counts n-grams, each lower one the kinds of words that stand before them; three discounts an
order come from the numbers of n-grams seen once to four times, in all languages together. Words are
lower-cased; marks are words, as is each character of scripts that do not space words. Before a text
is scored, all that it alone brought is taken out again: its counts, the n-grams that no other
text has, and their places in the lower orders. So a text does not vouch for itself.

What is gathered grows with the documents, and no model is sent to the executors. Documents are taken
in blocks of some BLOCK_BYTES. A block's distinct n-grams are hashes, sorted, cut into buckets by
range, and packed as differences with what the block has counted. A bucket adds up a range of the model, a
sorted array of hashes with their numbers, and answers each block in the order of its question. The
first block that asks for an n-gram owns it, and counts it once for the order below. Answers
are saved, a file for each block and order, in the shared folder; texts are never shuffled but read
again, once for each order. Numbers of blocks and buckets follow the bytes of text, and so do the
bits of a hash: the chance that an n-gram meets another's hash stays under one in three hundred.

Blocks are known by the task and place in which they are read, so the documents must be read alike
each time, as files are; a block that is read otherwise is an error, not a wrong score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimark.llm.common import forget, get_file, put_file, settled, shared_dir, structs, table_bytes, trim, unlink

#: Words of the longest n-grams. With 3 the sorted arrays and answers take 2.4 times the documents' Parquet files on disk, with 2 some 0.9 times.
ORDER = 2
#: Probability of a word that nothing is known of.
RARE = 2.0**-20
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Characters whose words are found at a time; a word without any space in so many characters is cut.
STRETCH = 1 << 20
#: Hashes of what stands before and behind a text.
BEFORE, BEHIND = 1, 2
SPREAD = np.uint64(0x9E3779B97F4A7C15)

SPACE, WORD, SINGLE = range(3)
#: Thai and Lao, Myanmar, Khmer, Japanese, Chinese.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x10FFFF))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * SPREAD
    x ^= x >> np.uint64(29)
    x *= SPREAD
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """By code point: between words, in a word, or a word of its own."""

    def kind(c: int) -> int:
        name = unicodedata.category(chr(c))
        return SPACE if name[0] in "ZC" or chr(c).isspace() else WORD if name[0] in "LNM" or c == ord("_") else SINGLE

    found = np.full(0x110000, SINGLE, np.uint8)
    found[:0x20000] = np.fromiter(map(kind, range(0x20000)), np.uint8, 0x20000)
    for a, b in UNSPACED:
        found[a : b + 1] = np.where(found[a : b + 1] == WORD, SINGLE, found[a : b + 1])
    return found


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Odd numbers by place in a word."""
    return mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-case texts, and the text of each."""
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes()[points]
    begins = kind == SINGLE
    begins[1:] |= (kind[1:] == WORD) & (kind[:-1] != WORD)
    begins[:1] |= kind[:1] == WORD
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # A word and what stands between it and the next, which adds nothing.
    place = np.arange(len(points))
    place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(points)))
    place &= 1023
    value = weights()[place]
    value *= points + np.uint64(1)
    value[kind == SPACE] = 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(ends, starts, "right")


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """_hashed() of texts as they are, a stretch at a time."""
    found, held, owners, chars = [], [], [], 0

    def close() -> None:
        nonlocal held, owners, chars
        if held:
            h, at = _hashed(held)
            found.append((h, np.array(owners, np.int64)[at]))
        held, owners, chars = [], [], 0

    for i, text in enumerate(texts):
        low, at = (text or "").lower(), 0
        while at < len(low):
            end = len(low) if len(low) - at <= STRETCH else max(low.rfind(" ", at + 1, at + STRETCH), low.rfind("\n", at + 1, at + STRETCH))
            end = at + STRETCH if end < 0 else end
            held.append(low[at:end])
            owners.append(i)
            chars += end - at
            at = end
            if chars >= STRETCH:
                close()
    close()
    return tuple(np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, t in ((0, np.uint64), (1, np.int64)))


def seed(lang: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("" if lang is None else f"={lang}")


def ranked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of at most so many bits in ascending order, and the places where they were; equal ones in the order of their places."""
    low = len(keys).bit_length()
    if bits + low > 64:
        places = np.argsort(keys, kind="stable")
        return keys[places], places
    # A key and its place in one number: numbers are sorted several times faster than places by their numbers.
    both = np.sort(keys << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
    return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)


class Level(NamedTuple):
    """The distinct n-grams of an order, the first place of each, and the number of each place's (-1 where an n-gram of the highest order does not end); the places in an order that has those of a text and n-gram side by side."""

    keys: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    ranked: np.ndarray


class Block:
    """N-grams of the texts of a block, at each place of (before, before, *words, behind) from the last ``before`` on.

    doc has the text of each place, scored whether it is a word or the end.
    """

    def __init__(self, texts: list[str | None], langs: list[str | None], bits: int, order: int = ORDER):
        self.order, self.bits = order, bits
        found, owner = words(texts)
        n = np.bincount(owner, minlength=len(texts))
        size = np.where(n > 0, n + order, 0)
        end = np.cumsum(size)
        path = np.full(int(size.sum()), BEFORE, np.uint64)
        path[(end - size)[owner] + order - 1 + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]] = found
        path[end[n > 0] - 1] = BEHIND
        doc = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(path)) - (end - size)[doc]
        used = place >= order - 2
        known = {lang: seed(lang) for lang in set(langs)}
        gram = np.array([known[lang] for lang in langs], np.uint64)[doc]
        self.texts, self.doc, self.scored = len(texts), doc[used], place[used] >= order - 1
        self.grams = [gram[used] >> np.uint64(64 - bits)]
        for k in range(1, order + 1):
            longer = np.zeros(len(path), np.uint64)
            longer[1:] = gram[:-1]
            longer[:1] = gram[:1]
            if k == 1:
                longer = gram
            gram = mixed((longer + np.uint64(k)) ^ path)
            self.grams.append(gram[used] >> np.uint64(64 - bits))

    def level(self, k: int) -> Level:
        if k == 0:  # a text has one language
            heads = np.flatnonzero(np.diff(self.doc, prepend=-1))
            keys, first, of = np.unique(self.grams[0][heads], return_index=True, return_inverse=True)
            return Level(keys, heads[first], np.repeat(of, np.diff(heads, append=len(self.doc))), np.arange(len(self.doc)))
        keys, places = ranked(self.grams[k][self.scored] if k == self.order else self.grams[k], self.bits)
        if k == self.order:
            places = np.flatnonzero(self.scored)[places]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        ids = np.full(len(self.doc), -1)
        ids[places] = np.cumsum(new) - 1
        return Level(keys[new], places[new], ids, places)


def pack(columns: list[np.ndarray]) -> bytes:
    """Unsigned integers of equal length, by planes of their bytes, compressed."""
    import zstandard

    planes, widths = [], []
    for c in columns:
        widths.append((int(c.max(initial=0)).bit_length() + 7) // 8)
        raw = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)
        planes += [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(widths[-1])]
    head = np.array([len(columns), len(columns[0]), *widths], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *planes]))


def unpack(packed: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    m, n = map(int, np.frombuffer(data, "<u8", 2))
    found, at = [], 16 + 8 * m
    for width in np.frombuffer(data, "<u8", m, 16).tolist():
        raw = np.zeros((n, 8), np.uint8)
        for i in range(width):
            raw[:, i] = np.frombuffer(data, np.uint8, n, at)
            at += n
        found.append(raw.view("<u8").ravel())
    return found


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows in blocks that end where their texts reach BLOCK_BYTES, with their numbers."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        at = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), 1):
            size += n
            if size >= BLOCK_BYTES:
                yield number, pa.Table.from_batches([*held, batch.slice(at, i - at)])
                number, held, size, at = number + 1, [], 0, i
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield number, pa.Table.from_batches(held)


def _read(block: pa.Table, text: str, lang: str, bits: int, order: int) -> Block:
    return Block(block[text].to_pylist(), block[lang].to_pylist(), bits, order)


def _kind(values: np.ndarray) -> np.ndarray:
    """0 to 3: which discount a count has."""
    return np.minimum(values, 3)


def counted(block: Block, k: int, folder: str, number: int) -> tuple[Level, list[np.ndarray]]:
    """The distinct n-grams of k words, and by n-gram what the block counts.

    Of the highest order that is how often it occurs. Of a lower order: how many of the owned n-grams of k + 1
    words end in it, and of those that begin with it the total and how many of them count once, twice, and more.
    """
    own = block.level(k)
    if k == block.order:
        return own, [np.bincount(own.ids[own.ranked], minlength=len(own.keys))]
    above = block.level(k + 1)
    found = answers(folder, k + 1, number, above.keys)
    owned = (found[-1] > 0) & (found[0] > 0)  # what stands before texts is no n-gram, only begins some
    at = above.first[owned]
    return own, [np.bincount(own.ids[at], minlength=len(own.keys)), *_begun(own.ids[at - 1], found[0][owned], len(own.keys))]


def _begun(begins: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Of what n-grams begin with: the total of their values, and how many of them are one, two, and more."""
    kinds = np.bincount(begins * 4 + _kind(value).astype(np.int64), minlength=4 * n).reshape(n, 4)
    return [np.bincount(begins, value, n).astype(np.int64), *kinds.T[1:]]


def answers(folder: str, k: int, number: int, keys: np.ndarray) -> list[np.ndarray]:
    check, *columns = unpack(get_file(folder, f"{k}-{number}"))
    if len(check) != len(keys) or (len(keys) and check[0] != keys.sum(dtype=np.uint64)):
        raise ValueError("a block of texts was not read again in the same way")
    return columns


def _questions(k: int, buckets: int, bits: int, order: int, folder: str):
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << bits) // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, "text"):
            own = _read(block, "text", "lang", bits, order)
            if not len(own.doc):
                continue
            level, values = counted(own, k, folder, number)
            keys = level.keys
            if k == 1:
                languages = own.level(0)
                put_file(folder, f"languages-{number}", pack([languages.ids[level.first], _headed(languages.keys, len(keys))]))
                del languages
            ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows = [(b, pack([np.diff(keys[i:j], prepend=np.uint64(0)), *(v[i:j] for v in values)])) for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
            asked = pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([number] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})
            del own, level, keys, values, rows, block
            trim()
            yield asked

    return run


def _answers(group: pa.Table) -> pa.Table:
    """A range of the model: the sums of what all blocks have counted, in the order of each question, and whether the block owns the n-gram."""
    blocks, data = group["block"].to_pylist(), group["data"].to_pylist()
    order = np.argsort(blocks).tolist()  # the same owners whenever a task is repeated
    asked = [unpack(data[i]) for i in order]
    for one in asked:
        one[0] = np.cumsum(one[0], dtype=np.uint64)
    keys, first, places = np.unique(np.concatenate([one[0] for one in asked]), return_index=True, return_inverse=True)
    sums = [np.bincount(places, np.concatenate([one[c] for one in asked]), len(keys)).astype(np.uint64) for c in range(1, len(asked[0]))]
    owned = np.zeros(len(places), np.uint64)
    owned[first] = 1
    ends = np.cumsum([0, *(len(one[0]) for one in asked)]).tolist()
    rows = []
    for i, one, a, b in zip(order, asked, ends, ends[1:], strict=False):
        check = np.array([one[0].sum(dtype=np.uint64)], np.uint64)
        rows.append((blocks[i], check[0], pack([*(s[places[a:b]] for s in sums), owned[a:b]])))
    del asked, keys, places, owned, first
    trim()
    ones = [[int((sums[0] == i).sum()) for i in (1, 2, 3, 4)]] + [[0] * 4] * (len(rows) - 1)
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(rows), pa.int32()), "sum": pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
        "data": pa.array([r[2] for r in rows], pa.binary()), **{f"n{i}": pa.array([o[i - 1] for o in ones], pa.int64()) for i in (1, 2, 3, 4)},
    })


def _headed(values: np.ndarray, n: int) -> np.ndarray:
    """A column of n numbers that begins with values."""
    return np.concatenate([values, np.zeros(n - len(values), np.uint64)])


SAVED = "block bigint, key bigint, total bigint, t1 bigint, t2 bigint, t3 bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _save(k: int, folder: str):
    """Saves a block's answers. Returns how many n-grams are seen once to four times and, of single words, a row for each language of the block: what the words that the block owns add up to."""

    def run(group: pa.Table) -> pa.Table:
        order, block = np.argsort(group["bucket"].to_numpy()).tolist(), group["block"][0].as_py()
        parts = [unpack(group["data"][i].as_py()) for i in order]
        columns = [np.concatenate([p[c] for p in parts]) for c in range(len(parts[0]))]
        check = _headed(group["sum"].to_numpy().view(np.uint64).sum(dtype=np.uint64, keepdims=True), len(columns[0]))
        put_file(folder, f"{k}-{block}", pack([check, *columns]))
        keys, sums = np.zeros(1, np.uint64), [np.zeros(1, np.int64)] * 4
        if k == 1:
            of, keys = unpack(get_file(folder, f"languages-{block}"))
            keys = keys[: int(of.max()) + 1]
            owned = (columns[-1] > 0) & (columns[0] > 0)
            sums = _begun(of[owned].astype(np.int64), columns[0][owned], len(keys))
        del parts, columns, check
        trim()
        ones = {f"n{i}": pa.array([pc.sum(group[f"n{i}"]).as_py()] + [0] * (len(keys) - 1), pa.int64()) for i in (1, 2, 3, 4)}
        found = {c: pa.array(v, pa.int64()) for c, v in zip(("key", "total", "t1", "t2", "t3"), (keys.view(np.int64), *sums), strict=True)}
        return pa.table({"block": pa.array([block] * len(keys), pa.int64()), **found, **ones})

    return run


def _save_roots(folder: str):
    """The counts of single words in all, by language: few rows a block."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys = group["key"].to_numpy().view(np.uint64)
        check = _headed(keys.sum(dtype=np.uint64, keepdims=True), len(keys))
        columns = [group[c].to_numpy().astype(np.uint64) for c in ("total", "t1", "t2", "t3")]
        put_file(folder, f"0-{group['block'][0].as_py()}", pack([check, np.zeros(len(keys), np.uint64), *columns, np.zeros(len(keys), np.uint64)]))
        return pa.table({"saved": pa.array([1], pa.int64())})

    return run


def discounts(n: list[int]) -> list[float]:
    """Of counts of none, one, two and more, from the numbers of n-grams seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [0.0, *(min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3))]


def logs(block: Block, answered: Callable[[int, np.ndarray], list[np.ndarray]], cuts: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: words and the end; the sums of the logs of their probabilities by all orders and by single words.

    answered gives the answers of an order for its n-grams; cuts has the discounts by order.
    """
    # By order, the distinct (text, n-gram): a place of each, and the number of each place's.
    places, numbers, n_gram, found = [], [], [], []
    for k in range(block.order + 1):
        level = block.level(k)
        found.append(answered(k, level.keys))
        doc, ids = block.doc[level.ranked], level.ids[level.ranked]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
        number = np.full(len(level.ids), -1)
        number[level.ranked] = np.cumsum(new) - 1
        places.append(level.ranked[new])
        numbers.append(number)
        n_gram.append(ids[new])
        own = np.diff(np.flatnonzero(new), append=len(new))
        del level, doc, ids, new, number
    order = block.order
    steps: list[tuple] = [()] * (order + 1)
    for k in range(order, 0, -1):
        # own: what the text alone has brought to each of its n-grams.
        live = np.flatnonzero(block.scored[places[k]])
        at = places[k][live]
        value = found[k][0][n_gram[k][live]].view(np.int64)
        own = own[live]
        rest = value - own
        begins, ends, m = numbers[k - 1][at - 1], numbers[k - 1][at], len(places[k - 1])
        if k == 1:
            begins = ends
        _, total, *kinds, _ = (c[n_gram[k - 1]].view(np.int64) for c in found[k - 1])
        total = total - np.bincount(begins, own, m)
        before, after = _kind(value), _kind(rest)
        moved = before != after
        kinds = [n - np.bincount(begins[moved & (before == j)], minlength=m) + np.bincount(begins[moved & (after == j)], minlength=m) for j, n in enumerate(kinds, 1)]
        steps[k] = live, begins, ends, rest, after, total, kinds
        own = np.bincount(ends[(rest == 0) & (value > 0)], minlength=m)
    p = np.full(len(places[0]), RARE)
    single = p
    for k in range(1, order + 1):
        live, begins, ends, rest, kind, total, kinds = steps[k]
        cut = np.array(cuts[k])
        left = np.divide(sum(c * n for c, n in zip(cut[1:], kinds, strict=True)), total, out=np.ones(len(total)), where=total > 0)
        share = np.divide(rest - cut[kind], total[begins], out=np.zeros(len(rest)), where=total[begins] > 0)
        longer = np.full(len(places[k]), RARE)
        longer[live] = share + left[begins] * p[ends]
        p = longer
        single = p if k == 1 else single
    doc = block.doc[block.scored]
    sums = [np.bincount(doc, np.log(q)[numbers[k][block.scored]], block.texts) for k, q in ((order, p), (1, single))]
    return np.bincount(doc, minlength=block.texts), *sums


def scored(docs: DataFrame, text: str, lang: str, rows: Callable[[list], Iterable[tuple]], schema: str, order: int = ORDER) -> DataFrame:
    """docs without its texts, with the columns that rows makes of them, n_tokens, log_perplexity and single (by single words).

    docs are read alike each time. Columns of docs with the same names are replaced.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    size = table_bytes(docs, text)
    buckets = 1 << (max(1, size // BUCKET_BYTES) - 1).bit_length()
    bits = min(60, max(32, size.bit_length() + 6))
    some = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    cuts: list[list[float]] = []
    for k in range(order, 0, -1):
        asked = some.mapInArrow(_questions(k, buckets, bits, order, folder), "bucket int, block bigint, data binary")
        answered = asked.groupBy("bucket").applyInArrow(_answers, "block bigint, bucket int, sum bigint, data binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint")
        saved = answered.groupBy("block").applyInArrow(_save(k, folder), SAVED)
        saved = settled(saved) if k == 1 else saved
        cuts.insert(0, discounts([n or 0 for n in saved.agg(*(F.sum(f"n{i}") for i in (1, 2, 3, 4))).first()]))
    cuts.insert(0, [])
    # A language has a row for each block: summed in the JVM before and after the shuffle, and joined, with adaptive splits.
    roots = saved.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("total", "t1", "t2", "t3")))
    saved.select("block", "key").join(roots.hint("merge"), "key").groupBy("block").applyInArrow(_save_roots(folder), "saved bigint").agg(F.sum("saved")).first()
    forget(saved)

    made = [f.split(":")[0] for f in schema.split(",")]
    replaced = {c.lower() for c in (*made, "n_tokens", "log_perplexity", "single", "_text", "_lang")} | ({text.lower()} if text != lang else set())
    keep = [c for c in docs.columns if c.lower() not in replaced]
    of = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(schema.replace(":", " ")).fields + T._parse_datatype_string("n_tokens bigint, log_perplexity double, single double").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _blocks(batches, "_text"):
            own_columns = structs(list(rows(part["_text"].to_pylist())), schema)
            own = _read(part, "_text", "_lang", bits, order)
            n, whole, single = np.zeros(own.texts, np.int64), np.zeros(own.texts), np.zeros(own.texts)
            if len(own.doc):
                n, whole, single = logs(own, lambda k, keys, number=number: answers(folder, k, number, keys), cuts)
            means = [pa.array(-x / np.maximum(n, 1), pa.float64(), mask=n == 0) for x in (whole, single)]
            columns = [*(part[c] for c in keep), *own_columns.flatten(), pa.array(n), *means]
            found = pa.table(columns, names=[f.name for f in of]).combine_chunks().to_batches()
            del part, own, own_columns, columns, means, whole, single, n
            trim()
            yield from found

    texts = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang"))
    result = settled(texts.mapInArrow(run, of))
    unlink(spark, folder)
    return result
