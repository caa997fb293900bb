import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_pattern_splits_as_the_library_does(library):
    one, split = bpe.encoder(PATH), bpe.splitter(bpe.default_pattern())

    @settings(max_examples=500, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.text(alphabet="a 1'st\n\t\x1c\x85\u2028é!中", max_size=40)))
    def same(text):
        assert [i for w in split(text) for i in one(w)] == library.encode_ordinary(text)

    same()


def test_documents_of_all_kinds(spark, library):
    texts = [None, "", " ", "a  b\n\n c", "don't stop 123 !!", "é中😀", "x " * 20_000, "a" * 3000, "same", "same"]
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    wanted = [(i // 2, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows) == sorted(wanted)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_packing():
    for lists in ([], [b""], [b"ab", b"", b"c" * 300]):
        assert bpe.unpack(bpe.pack(np.frombuffer(b"".join(lists), np.uint8), [len(x) for x in lists]), "u1") == lists


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())


def test_null_ids_and_repeated_rows_are_spread(spark, library):
    docs = spark.createDataFrame([(None, "a b")] * 3 + [(7, "c d e")] * 500, "doc_id bigint, text string").repartition(4)
    rows = bpe.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in rows) == sorted((i, np.array(library.encode_ordinary(t), "<u4").tobytes()) for i, t in [(0, "a b")] * 3 + [(7, "c d e")] * 500)
