import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from sedimark.functions import blobs as B
from sedimark.operators import signatures as G
from sedimark.operators import sniff


def plain_strings(data: bytes) -> list[str]:
    found = set()
    for run in re.findall(rb"[\x20-\x7e\t]{3,}", data):
        text = run.decode()
        if len(text) <= 200 and text.strip(" \t") and any(c.isalnum() or c in " \t" for c in text):
            found.add(text.strip(" \t"))
    return sorted(found)[:50]


def random_blobs(n: int = 200) -> list[bytes]:
    r = random.Random(5)
    alphabet = b"ab1 .\t!\x00\xff\xc3\x27\xbd\n"
    return [b"", b"   ", b"!!!!", b"x" * 201, b"y" * 200, *(bytes(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(n))]


def test_strings_ratio_and_entropy_match_byte_loops(spark):
    blobs = random_blobs()
    df = spark.createDataFrame(list(enumerate(blobs)), "i int, content binary")
    c = F.col("content")
    for row in df.select("i", B.extract_strings(c).alias("s"), B.text_ratio(c).alias("r"), B.entropy(c).alias("e"), B.byte_histogram(c).alias("h"), B.sha256(c).alias("d")).collect():
        data = blobs[row.i]
        assert row.s == plain_strings(data)
        texty = sum(33 <= b <= 126 or b in b" \t\n\x0c\r" for b in data)
        assert row.r == (texty / len(data) if data else None)
        counts = [data.count(b) for b in range(256)]
        assert row.h == counts
        assert math.isclose(row.e, -sum(n / len(data) * math.log2(n / len(data)) for n in counts if n), abs_tol=1e-9)
        assert row.d == hashlib.sha256(data).hexdigest()


def test_blake3_of_published_inputs(spark):
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    }
    rows = [(n, bytes(i % 251 for i in range(n))) for n in known]
    for row in spark.createDataFrame(rows, "n int, content binary").select("n", B.blake3(F.col("content")).alias("h")).collect():
        assert row.h == known[row.n]


def test_kinds(spark):
    cases = {
        "tiny": b"hello",
        "compressed": b"\x1f\x8b\x08" + bytes(60),
        "elf": b"\x7fELF" + bytes(60),
        "pe": b"MZ" + bytes(60),
        "wasm": b"\0asm" + bytes(60),
        "archive": b"!<arch>\n" + bytes(60),
        "dicom": bytes(128) + b"DICM" + bytes(10),
        "intel-hex": b":10000000" + b"0" * 34 + b"\n:00000001FF\n",
        "srec": b"S00F000068656C6C6F202020202000003C\nS9030000FC\n" + b"\n" * 10,
        "macho": b"\xcf\xfa\xed\xfe" + bytes(60),
        "macho-fat": b"\xca\xfe\xba\xbe" + bytes(60),
        "cortex-m": (0x20002000).to_bytes(4, "little") + (0x08000101).to_bytes(4, "little") + bytes(60),
        "raw": b"plain text that is long enough to be no tiny blob at all",
    }
    lookalikes = [b"some text\n:not hex at all!\nmore text that goes on and on", b"Some line\nSecond line\n" + b"x" * 40, b"!<not_really an archive but long enough to be parsed>"]
    rows = [*cases.items(), *(("raw", b) for b in lookalikes)]
    for row in spark.createDataFrame(rows, "kind string, content binary").select("kind", sniff.kind(F.col("content")).alias("found")).collect():
        assert row.found == row.kind


def test_byte_signatures(spark):
    rows = [(b"\x55\x89\xe5..", ["x86"]), (b"xx\x27\xbd\n\n", ["MIPS"]), (b"\x94\x21\x00\x00\x00\xbf", ["ARM Thumb", "PowerPC"]), (b"\xeb\xfe", None)]
    df = spark.createDataFrame(rows, "content binary, labels array<string>")
    for row in df.select("labels", G.architecture_hints(F.col("content")).alias("found")).collect():
        assert row.found == (row.labels or [])


def test_blake3_of_many_blobs_at_once():
    sizes = [0, 1, 64, 65, 1024, 1025, 3000, 2048, 9 * 1024 + 1, 31 * 1024]
    made = [bytes((i * n + 7) % 251 for i in range(n)) for n in sizes]
    assert B.blake3_hexes(made) == [B.blake3_hex(b) for b in made] and B.blake3_hexes([]) == []


def test_mime_by_offset(spark):
    cases = {"application/x-tar": bytes(257) + b"ustar\0", "image/webp": b"RIFF1234WEBP", "video/mp4": b"\0\0\0\x18ftypmp42", "application/vnd.rar": b"Rar!\x1a\x07\0", "application/octet-stream": b"nothing known", "text/xml": b"<?xml version", "application/font-sfnt": b"OTTO\0"}
    from sedimark.operators import sniff

    rows = spark.createDataFrame([(k, bytes(v)) for k, v in cases.items()], "mime string, content binary")
    assert all(r.mime == r.found for r in rows.select("mime", sniff.mime(F.lit("x.txt"), F.col("content")).alias("found")).collect())
