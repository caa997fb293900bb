"""Token ids in binary shards, packed by patched frames of reference.

A shard is a file of documents in ascending doc_id order, little-endian throughout:

    8 bytes   magic, then u64: documents, ids, blocks
    i64       for each document: its id; then u8: 1 where the id is null
    u64       for each document: the number of its ids
    u64       for each block: where it starts in the file (the block index), and the end
    blocks    u32 least id, u8 width, u16 exceptions, u16 ids;
              the ids less the least, ``width`` bits each, lowest bit first;
              u16 places and u32 values of the exceptions

A block has BLOCK ids, the last one fewer. Its width is what the PERCENTILE of its ids
needs; ids that need more bits are exceptions. With the index, ids n to m are read from
blocks n // BLOCK to m // BLOCK alone.

Executors write shards under a name of their own and then rename them, so a repeated
task leaves the same files. A manifest, a Parquet table beside them, has the ids of each
shard; its running sum places the shards in the whole sequence.

Ids are packed as texts are encoded, and workers read a shard some documents at a time, so
that neither they nor the JVM hold a shard's ids at once; only a document's are held whole.

Defined cases: a null or empty text has the end id alone; rows with a null doc_id come
first; rows with equal ids are ordered by their texts, so repeated rows are as good as
ordered; a text of any length is encoded whole, by its chunks; an empty table gives no shards and an empty result; only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.llm.common import open_file, put_file, table_bytes, trim

MAGIC = b"SEDIDS01"
BLOCK = 1024
PERCENTILE = 0.9
#: A shard is closed when it has so many ids or documents.
SHARD_IDS, SHARD_DOCS = 8 << 20, 1 << 20
#: Ids packed at once by a writer; ids and documents read at once, one document at least.
PACK_IDS, READ_IDS, READ_DOCS = 256 * BLOCK, 256 * BLOCK, 2048
#: Bytes of text sorted by one task.
PART_BYTES = 32 << 20
#: Entries of one generation of a cache, of which two are kept, and the longest key that is kept.
CACHE, LONGEST = 300_000, 64
#: Longer texts are split into chunks some of these characters at a time.
SLICE = 1 << 20

HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("out", "<u2"), ("n", "<u2")])


def pack_bits(values: np.ndarray, width: int) -> list[bytes]:
    """Each row of values (uint32), width bits each."""
    if width in (8, 16, 32):
        return [row.tobytes() for row in values.astype(f"<u{width // 8}")]
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return [row.tobytes() for row in np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")]


def unpack_bits(packed: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a sequence of ids (uint32)."""
    found: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for part in (ids[a : min(a + 256 * BLOCK, whole)].reshape(-1, BLOCK) for a in range(0, whole, 256 * BLOCK)):
        found += _encode_rows(part)
    if whole < len(ids):
        found += _encode_rows(ids[whole:].reshape(1, -1))
    return found


def _encode_rows(rows: np.ndarray) -> list[bytes]:
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    n = rows.shape[1]
    at = min(n - 1, int(PERCENTILE * n))
    widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]
    found: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        high = rest[chosen].astype(np.uint64) >> np.uint64(width) != 0
        low = rest[chosen] & np.uint32((1 << width) - 1)
        for i, packed, out in zip(chosen.tolist(), pack_bits(low, width), high, strict=True):
            places = np.flatnonzero(out).astype("<u2")
            head = np.array((least[i], width, len(places), n), HEAD)
            found[i] = head.tobytes() + packed + places.tobytes() + rest[i][places].astype("<u4").tobytes()
    return found


def decode_block(data: memoryview) -> np.ndarray:
    head = np.frombuffer(data, HEAD, 1)[0]
    width, n, out = int(head["width"]), int(head["n"]), int(head["out"])
    end = HEAD.itemsize + (n * width + 7) // 8
    ids = unpack_bits(data[HEAD.itemsize : end], width, n)
    if out:
        ids[np.frombuffer(data, "<u2", out, end)] = np.frombuffer(data, "<u4", out, end + 2 * out)
    return ids + head["least"]


class Shard:
    """A shard in the making, of which few ids are held unpacked."""

    def __init__(self):
        self.names, self.missing, self.lengths = array("q"), array("B"), array("q")
        self.ids, self.blocks, self.rest, self.waiting = 0, [], [], 0

    def add(self, name: int | None, ids: bytes) -> None:
        """A document and its ids, little-endian unsigned 32-bit integers."""
        n = len(ids) // 4
        self.names.append(name or 0)
        self.missing.append(name is None)
        self.lengths.append(n)
        self.rest.append(ids)
        self.ids, self.waiting = self.ids + n, self.waiting + n
        if self.waiting >= PACK_IDS:
            self._pack(self.waiting // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        self.blocks += encode_blocks(ids[:n])
        self.rest, self.waiting = [ids[n:].tobytes()], len(ids) - n

    def data(self) -> bytes:
        self._pack(self.waiting)
        counts = np.array([len(self.names), self.ids, len(self.blocks)], "<u8")
        start = len(MAGIC) + 24 + 17 * len(self.names) + 8 * (len(self.blocks) + 1)
        index = start + np.concatenate(([0], np.cumsum([len(b) for b in self.blocks], dtype=np.int64)))
        names, missing, lengths = np.array(self.names, "<i8"), np.array(self.missing, "u1"), np.array(self.lengths, "<u8")
        return b"".join([MAGIC, counts.tobytes(), names.tobytes(), missing.tobytes(), lengths.tobytes(), index.astype("<u8").tobytes(), *self.blocks])


def shard_parts(file: BinaryIO) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents of a shard at a time: their ids, where each starts in the shard, the numbers of its token ids, and these."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a shard of token ids")
    docs, n, blocks = map(int, np.frombuffer(file.read(24), "<u8", 3))
    names, missing, lengths = (np.frombuffer(file.read(docs * np.dtype(kind).itemsize), kind, docs) for kind in ("<i8", "u1", "<u8"))
    index = np.frombuffer(file.read(8 * (blocks + 1)), "<u8", blocks + 1).tolist()
    ends = np.cumsum(lengths.astype(np.int64))
    if blocks != -(-n // BLOCK) or n != (ends[-1] if docs else 0):
        raise ValueError("a shard of token ids is damaged")
    a = at = 0
    while a < docs:
        b = max(a + 1, min(a + READ_DOCS, int(np.searchsorted(ends, at + READ_IDS, "right"))))
        end = int(ends[b - 1])
        first = at // BLOCK
        last = -(-end // BLOCK) if end > at else first
        file.seek(index[first])
        view = memoryview(file.read(index[last] - index[first]))
        cuts = [x - index[first] for x in index[first : last + 1]]
        ids = np.concatenate([np.empty(0, np.uint32), *(decode_block(view[x:y]) for x, y in zip(cuts, cuts[1:], strict=False))])
        if len(ids) != min(last * BLOCK, n) - first * BLOCK:
            raise ValueError("a shard of token ids is damaged")
        some = [None if m else d for d, m in zip(names[a:b].tolist(), missing[a:b].tolist(), strict=True)]
        counts = np.diff(ends[a:b], prepend=at)
        yield some, ends[a:b] - counts, counts, ids[at - first * BLOCK :][: end - at]
        a, at = b, end


def decode_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, the numbers of their ids, and all ids."""
    parts = list(shard_parts(io.BytesIO(data)))
    lengths = np.concatenate([np.empty(0, np.int64), *(p[2] for p in parts)])
    return [name for p in parts for name in p[0]], lengths, np.concatenate([np.empty(0, np.uint32), *(p[3] for p in parts)])


class Cache(dict):
    """Made values by key, of bounded size: of two generations, the older goes when the younger is full. Long keys are made each time."""

    def __init__(self, make: Callable[[str], bytes], size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Tokenizer:
    """The tokenizers library's encoding of a text, by white-space chunks that are encoded once.

    The vocabulary's pre-tokens end at white space, so a text's ids are those of its
    chunks. Chunks of ASCII and Latin-1 letters are in normal form already: they are
    lower-cased and split here and their pieces, chunks themselves, go to the library's model. Other chunks, those that may hold
    the name of a special token (which the library reads as that token),
    and texts with controls that Python alone takes for white space, go through the
    library's whole pipeline.
    """

    PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+\Z")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    ODD = re.compile(r"[\x1c-\x1f]")
    BLANK = re.compile(r"\s")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_file(path)
        self.model = self.library.model
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {b: alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(0x80) if chr(b).strip()}
        self.bytes |= {b"\xc3"[0]: alphabet.pre_tokenize_str("é")[0][0][0]} | {0x80 + i: alphabet.pre_tokenize_str(chr(0xC0 + i))[0][0][1] for i in range(64)}
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values()))]
        self.chunks = Cache(self._chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk) if chunk.islower() else self.chunks[chunk.lower()]
        if not self.PLAIN.match(chunk) or "<|" in chunk:
            return self._whole(chunk)
        pieces = self.PIECES.findall(chunk.lower())
        return self._piece(chunk) if pieces[0] == chunk else b"".join(map(self.chunks.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._whole(text)
        if len(text) <= SLICE:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return b"".join(b"".join(map(self.chunks.__getitem__, part.split())) for part in self._slices(text))

    def _slices(self, text: str) -> Iterator[str]:
        """A long text in parts that end at white space."""
        at = 0
        while at < len(text):
            blank = self.BLANK.search(text, at + SLICE)
            end = blank.start() if blank else len(text)
            yield text[at:end]
            at = end


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Shards and manifest of docs in a new folder that driver and executors share."""
    some = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes(some, "text") // PART_BYTES))
    order = ["doc_id", "h", "text"]
    placed = some.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions(*order)
    end = np.uint32(end_id).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, shard, seq = TaskContext.get().partitionId(), tokenizer(vocabulary).encode, Shard(), 0

        def closed() -> pa.RecordBatch:
            nonlocal shard, seq
            name = f"shard-{part:07d}-{seq:05d}.ids"
            put_file(folder, name, shard.data())
            row = pa.record_batch({"shard": [name], "docs": [len(shard.names)], "ids": [shard.ids]})
            shard, seq = Shard(), seq + 1
            trim()
            return row

        for batch in batches:
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard.add(name, encode(value or "") + end)
                if shard.ids >= SHARD_IDS or len(shard.names) >= SHARD_DOCS:
                    yield closed()
        if shard.names:
            yield closed()

    placed.select("doc_id", "text").mapInArrow(write, "shard string, docs bigint, ids bigint").write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) for each document of the shards; ids as little-endian unsigned 32-bit integers."""
    manifest = spark.read.schema("shard string, docs bigint, ids bigint").parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with open_file(folder, shard) as file:
                    for names, at, counts, ids in shard_parts(file):
                        offsets = np.append(at, at[-1] + counts[-1]) - at[0]
                        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(4 * offsets), pa.py_buffer(ids.astype("<u4"))])
                        yield pa.record_batch({"shard": pa.array([shard] * len(names), pa.string()), "doc_id": pa.array(names, pa.int64()), "at": at, "n_tokens": counts, "ids": parts.cast(pa.binary())})
                trim()

    read_back = manifest.select("shard").mapInArrow(read, "shard string, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return read_back.join(F.broadcast(starts), "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")
