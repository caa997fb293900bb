import collections

import numpy as np

from sedimark.llm import decontaminate as D
from sedimark.llm import queries

ITEM = "A train leaves Paris at 30 km per hour and reaches the far town of Lyon after 4 hours, how far did it go?"
OTHER = "which of the following organs produces the hormone that regulates blood sugar in a healthy adult body"


def found(spark, docs, items):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, caught string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.caught for r in D.contaminated(d, b).collect()}


def test_exact_and_reparameterised_copies(spark):
    docs = [
        (1, f"some words before. {ITEM} and after"),
        (2, "before. " + ITEM.replace("30", "55").replace("Paris", "Berlin").replace("4 hours", "7 hours").replace("Lyon", "Madrid")),
        (3, ITEM.upper()),
        (4, "nothing of the kind is in this text, which only goes on for a while at 30 km per hour"),
        (5, None), (6, ""), (None, ITEM),
        (7, OTHER), (7, OTHER), (8, f"{ITEM} {ITEM.replace('30', '80')}"),
        (9, "word " * 30_000 + OTHER),
        (10, " ".join(OTHER.split()[:9]) + " but then it is another question"),
    ]
    result = found(spark, docs, [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "12 34 56")])
    assert {k: v for k, v in result.items() if k[0] != 3} == {(1, 1): "exact", (2, 1): "reparameterised", (7, 2): "exact", (8, 1): "exact", (9, 2): "exact"}


def test_slots_must_be_consistent(spark):
    item = "add 5 to the number that you find and take 5 from what is then left of the number"
    docs = [(1, item.replace("5", "9")), (2, item.replace("5", "9", 1).replace(" 5 ", " 8 "))]
    assert found(spark, docs, [(1, item)]).keys() >= {(1, 1)}
    windows = D.Canonical()
    h, kind, _, _ = windows(item)
    assert (kind == D.NUM).sum() == 2 and len(h) == len(item.split())


def test_clean_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, OTHER, "a"), (2, "fine text", "b"), (None, OTHER, "c")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, OTHER)], "item_id bigint, text string")
    out = D.clean(docs, items)
    assert out.columns == docs.columns and sorted(r.item_id for r in out.collect()) == ["b"]
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0


def test_query_finds_what_brute_force_does(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    windows = collections.defaultdict(set)
    for i, text in items:
        words = text.lower().split()
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].add(i)
    wanted = {(d, i) for d, text in docs for w in [text.lower().split()] for k in range(len(w) - 7) for i in windows.get(tuple(w[k : k + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()} == wanted and wanted


def test_filter_passes_every_window(spark):
    items = D._windows(spark.createDataFrame([(1, OTHER)], "item_id bigint, text string"), "item_id", "text", None, None)
    data, lengths = D._filter(items)
    bits = np.frombuffer(data, np.uint8)
    for row in items.collect():
        spot = row.h & (D.FILTER_BITS - 1)
        assert bits[spot >> 3] >> (spot & 7) & 1
    assert lengths == [8]


def test_names_that_begin_sentences_and_values_that_become_one(spark):
    asked = "Mary has 12 apples. Tom gives her 7 more apples. How many apples does Mary have?"
    pens = "on the table in the hall lie 3 pens and 5 books that somebody has left there last night"
    docs = [
        (1, asked.replace("Mary", "Anna").replace("Tom", "Ben").replace("12", "15").replace("7", "9")),
        (2, pens.replace("3", "4").replace("5", "4")),
    ]
    assert found(spark, docs, [(1, asked), (2, pens)]) == {(1, 1): "reparameterised", (2, 2): "reparameterised"}


def test_items_of_few_plain_words_are_found(spark):
    items = [(1, "What is 17 * 23 + 4 ?"), (2, "Who won in 1998, 2002, 2006, 2010 and 2014?"), (3, "What is the capital city of Peru?")]
    docs = [(i, f"it was asked before {text} and answered") for i, text in items] + [(4, "What is 18 * 23 + 4 ?")]
    assert found(spark, docs, items) == {(i, i): "exact" for i in (1, 2, 3)} | {(4, 1): "reparameterised"}


def test_sums_and_sentences_of_values_asked_with_others(spark):
    items = [(1, "What is 3 + 5 * 7 ?"), (2, "Compute 12 * 7 + 9 ."), (3, "Tom paid 12 dollars and Ann paid 15 dollars on 3 May 2020 in Rome"), (4, "What is 7 ?")]
    docs = [
        (1, "First. What is 8 + 2 * 9 ? It is hard."), (2, "Compute 1 * 4 + 30 . Then rest."), (3, "So Bob paid 40 dollars and Eve paid 2 dollars on 9 June 1999 in Oslo as they say."),
        (4, "What is 3 + 5 * 7 ?"), (5, "Tom paid 12 dollars and Ann left"), (6, "What is 9 ? What is 3 + 4 now ?"), (7, "Bob paid 12 dollars and Eve paid 12 dollars on 3 May 2020 in Rome"),
    ]
    result = found(spark, docs, items)
    assert result == {(1, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "reparameterised", (4, 1): "exact", (7, 3): "reparameterised"}


def test_common_windows_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "COMMON", 2)
    r = np.random.default_rng(4)
    shared = " ".join(f"w{chr(97 + i)}" for i in range(12))
    said = lambda n: " ".join("".join(map(chr, r.integers(97, 123, 5))) for _ in range(n))
    items = [(i, f"{shared} {said(20)}") for i in range(6)] + [(10 + i, f"{shared} {said(2)}") for i in range(4)] + [(20, shared), (21, shared), (22, shared)]
    texts = dict(items)
    docs = [(i, f"so {said(5)} {t} {said(5)}") for i, t in items] + [(100, f"{said(9)} {shared} {said(9)}"), (101, " ".join(texts[0].split()[6:])), (102, said(40)), (103, " ".join(texts[10].split()[:13]))]
    few = found(spark, docs, items)
    monkeypatch.setattr(D, "COMMON", 10**6)
    assert few == found(spark, docs, items)
    assert all((i, i) in few for i in texts) and (101, 0) in few and (100, 20) in few and not any(d == 102 for d, _ in few)


def test_repeated_items_and_equal_rows(spark):
    docs = [(1, OTHER), (1, OTHER), (2, OTHER)]
    assert found(spark, docs, [(1, OTHER), (1, OTHER), (2, OTHER)]) == {(d, i): "exact" for d in (1, 2) for i in (1, 2)}


def test_excerpts_of_long_items(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    docs = [(1, "so " + " ".join(words[100:113]) + " it went"), (2, "so " + " ".join(words[100:112]) + " it went")]
    assert found(spark, docs, [(1, " ".join(words))]) == {(1, 1): "exact"}
