import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedimark.llm import tokens as K
from sedimark.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abc dÉé ñ'stre\n\t\x1c\x85\xa0\u0301ﬁΣİ<|endoftext|>12.,²µ中😀KÅ×÷ß"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_library_s_ids(library):
    own = K.Tokenizer(PATH)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.text(alphabet=ALPHABET, max_size=40)))
    def same(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(library, text)

    same()
    special = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "é", "a", " ", "\n", "中", "'s"]

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(special), max_size=8))
    def same_with_names_of_special_tokens(parts):
        text = "".join(parts)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(library, text)

    same_with_names_of_special_tokens()
    assert ids(library, "a <|endoftext|> b")[1] == 49407


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_blocks_come_back(n):
    r = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32):
        values = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        values[::50] = 2**32 - 1
        found = [K.decode_block(memoryview(b)) for b in K.encode_blocks(values)]
        assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *found]), values)


def test_outliers_are_exceptions():
    values = np.full(1024, 7, np.uint32)
    values[3] = 2**31
    (block,) = K.encode_blocks(values)
    head = np.frombuffer(block, K.HEAD, 1)[0]
    assert (head["width"], head["out"], len(block)) == (0, 1, K.HEAD.itemsize + 6)
    with pytest.raises(ValueError):
        K.decode_shard(b"not a shard")


def test_shards_hold_all_documents_in_order(spark, library, monkeypatch):
    rows = [(5, "Hello, World"), (2, None), (None, "nameless"), (9, ""), (3, "x y " * 5000), (5, "again five"), (5, "again five")]
    folder = shared_dir(spark)
    K.write_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, shard int"), folder, PATH, end_id=1)
    out = sorted(K.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in out] == [None, 2, 3, 5, 5, 5, 9]
    by_id = {i: sorted(ids(library, t) + [1] for j, t in rows if i == j) for i, _ in rows}
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        by_id[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
        at += r.n_tokens
    assert not any(by_id.values())


class Watched(io.BytesIO):
    """A file that tells the most bytes that were read at once."""

    most = 0

    def read(self, n=-1):
        found = super().read(n)
        self.most = max(self.most, len(found))
        return found


def test_a_shard_is_packed_and_read_in_parts(monkeypatch):
    monkeypatch.setattr(K, "PACK_IDS", 3 * K.BLOCK)
    monkeypatch.setattr(K, "READ_IDS", 4 * K.BLOCK)
    monkeypatch.setattr(K, "READ_DOCS", 7)
    r = np.random.default_rng(0)
    counts = [0, 0, 5, 9000, *r.integers(0, 900, 300).tolist(), 0, 1, 0, 1024, 1024, 0]
    wanted = [r.integers(0, 50_000, n).astype("<u4") for n in counts]
    names = [None if i % 50 == 0 else 1000 - i for i in range(len(counts))]
    shard = K.Shard()
    for name, ids in zip(names, wanted, strict=True):
        shard.add(name, ids.tobytes())
        assert shard.waiting < K.PACK_IDS
    file = Watched(shard.data())
    parts = list(K.shard_parts(file))
    assert max(len(p[0]) for p in parts) <= 7 and sum(len(p[3]) > K.READ_IDS for p in parts) == 1
    assert file.most < 9 * K.BLOCK * 3
    found = [(name, p[3][a - p[1][0] :][:n].tolist(), int(a)) for p in parts for name, a, n in zip(p[0], p[1].tolist(), p[2].tolist(), strict=True)]
    starts = (np.cumsum(counts) - counts).tolist()
    assert found == [(name, ids.tolist(), at) for name, ids, at in zip(names, wanted, starts, strict=True)]
    again, lengths, ids = K.decode_shard(shard.data())
    assert (again, lengths.tolist(), ids.tolist()) == (names, counts, np.concatenate(wanted).tolist())
    assert K.decode_shard(K.Shard().data())[0] == []
    for cut in (20, 100, len(shard.data()) - 1):
        with pytest.raises(ValueError):
            K.decode_shard(shard.data()[:cut])


def test_caches_stay_small(library):
    own = K.Tokenizer(PATH)
    own.chunks = K.Cache(own._chunk, 50)
    words = [f"{w}{mark}" for w in ("Word", "été", "ÉTÉ", "don't", "x" * 300, "A1b2" * 100, "中" * 200) for mark in ("", ",", "!'s", "<|", *map(str, range(40)))]
    text = " ".join(words * 2)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(library, text)
    kept = [*own.chunks, *own.chunks.old]
    assert 50 < len(kept) <= 100 and max(map(len, kept)) <= K.LONGEST


def test_long_texts_are_split_in_parts(library, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 20)
    own = K.Tokenizer(PATH)
    for text in ("", "a" * 19, "x" * 50, "  one, two\n" * 30, "É" * 21 + "\u2003b\xa0" * 40, " " * 60, "don't " * 3 + "<|endoftext|>" * 9 + " end"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(library, text)
        parts = list(own._slices(text))
        assert "".join(parts) == text and all(len(p) <= 20 + max(map(len, text.split()), default=0) for p in parts)


def test_workers_read_shards_and_no_ids_are_joined_by_shuffling(spark):
    folder = shared_dir(spark)
    K.write_tokens(spark.createDataFrame([(i, "some words " * i) for i in range(50)], "doc_id bigint, text string"), folder, PATH, end_id=1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = K.read_tokens(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "binaryFile" not in plan and "SortMergeJoin" not in plan


def test_empty_table(spark):
    folder = shared_dir(spark)
    K.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, PATH, end_id=1)
    assert K.read_tokens(spark, folder).count() == 0


def test_query_equals_the_library(spark, sf, library):
    from sedimark.llm import queries

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at = 0
    for (name, text), row in zip(docs, sorted(queries.op5_tokens(spark, sf).collect()), strict=True):
        wanted = [*ids(library, text), 1]
        assert tuple(row) == (name, at, len(wanted), zlib.crc32(np.array(wanted, "<u4").tobytes()))
        at += len(wanted)
