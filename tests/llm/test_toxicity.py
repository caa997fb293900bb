import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.llm import queries
from sedimark.llm import toxicity as T

MILD = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"]


def texts(n: int, seed: int):
    r = random.Random(seed)
    found = []
    for i in range(n):
        words = [r.choice(MILD) for _ in range(r.randint(5, 80))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = "vile" + r.choice("abcdefghijklmnop")
        found.append((" ".join(words), i % 3 == 0))
    return found


@pytest.fixture(scope="module")
def network():
    rows = texts(240, 1)
    return T.train([t for t, _ in rows], [y for _, y in rows], first=2, rounds=8)


def test_unseen_inflections_are_found(network):
    rows = texts(90, 2) + [("wordak " * 5000 + "vilezz", True), ("wordak " * 5000, False)]
    scores = network.scorer().scores([t for t, _ in rows])
    right = [(s >= 0.5) == y for s, (_, y) in zip(scores, rows, strict=True)]
    assert sum(right) >= 0.95 * len(right) and right[-2] and right[-1]
    assert all(s < 0.5 for s in network.scorer().scores([None, "", "..."]))


def test_gradients_equal_differences(network):
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, index = r.normal(0, 0.5, (9, T.WORD + T.CHAR)), r.integers(0, 10, (4, T.WINDOW))
    index[:, 0], target, share = 1, np.array([1.0, 0, 1, 0]), np.full(4, 0.25)
    g, by_x, _ = T.gradients(p, x, index, target, share)

    def loss():
        logits = T.forward(p, T.gates(p, x), index)
        return float((share * (np.logaddexp(0, logits) - target * logits)).sum())

    for name, at in (("recurrent", (0, 3, 7)), ("recurrent", (1, 2, 40)), ("input", (1, 4, 9)), ("attention", (3,)), ("out", (20,)), ("shift", (0, 17))):
        old = p[name][at]
        p[name][at] = old + 1e-3
        up = loss()
        p[name][at] = old - 1e-3
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3


def test_windows_reach_the_end():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        found = T.window_rows(np.arange(1, n + 1))
        assert set(found.ravel()) - {0} == set(range(1, n + 1)) and found.shape[1] == T.WINDOW


def test_one_kind_of_label_and_odd_tables(spark, network):
    docs = spark.createDataFrame([(1, "a b", 0.1), (1, "a b", 0.1), (None, None, 0.2), (2, "", 0.3)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    only = T.fit(docs, labels, F.lit(True))
    assert only.p is None and {r.score for r in T.score_toxicity(docs, only).collect()} == {1.0}
    assert {r.score for r in T.score_toxicity(docs, T.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}
    assert T.train(["", "!"], [True, False]).p is None
    assert T.score_toxicity(docs, network).count() == 4 and T.score_toxicity(docs.limit(0), network).count() == 0


def test_whole_texts_are_learned_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, toxic: seen.append((texts, toxic)) or T.Network({}, None, 0.5))
    long = "mild " * 20_000 + "vile"
    rows = [(i, long if i % 10 == 0 else f"short {i}") for i in range(60)] + [(1, "short 1")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(2, 1)] * 40, "doc_id bigint, toxic int")
    T.fit(docs, labels, F.lit(True))
    texts, toxic = seen[-1]
    assert sorted(texts) == sorted(t for _, t in rows[:60]) and dict(zip(texts, toxic, strict=True))["short 2"] is True
    T.fit(docs, labels, F.lit(True), max_windows=3000)
    texts, toxic = seen[-1]
    windows = {k: sum(len(T.window_rows(np.zeros(len(t.split()), np.int32))) for t, y in zip(texts, toxic, strict=True) if y == k) for k in (True, False)}
    assert windows[True] <= 1000 and windows[False] <= 2001 and set(texts) <= {t for _, t in rows} and len(texts) > 50
    T.fit(docs, labels, F.lit(True), max_rows=9)
    assert len(seen[-1][0]) == 9 and sum(seen[-1][1]) == 3


def test_scores_equal_a_second_implementation(network):
    def one(words):
        """The network over one window, a number at a time."""
        p, places = network.p, T.Inputs(network.vocabulary).places(words)
        hashes, starts = T.grams(words)
        ends = [*starts[1:].tolist(), len(hashes)]
        x = [np.concatenate([p["words"][w], p["grams"][hashes[a:b]].mean(axis=0)]) for w, a, b in zip(places, starts.tolist(), ends, strict=True)]
        states = []
        for d in range(2):
            h, run = np.zeros(T.HIDDEN), []
            for v in x if d == 0 else reversed(x):
                gate = v @ p["input"][d] + p["shift"][d]
                back = h @ p["recurrent"][d]
                z, r = (1 / (1 + np.exp(-(gate[a : a + T.HIDDEN] + back[a : a + T.HIDDEN]))) for a in (0, T.HIDDEN))
                new = np.tanh(gate[2 * T.HIDDEN :] + r * back[2 * T.HIDDEN :])
                h = z * h + (1 - z) * new
                run.append(h)
            states.append(run if d == 0 else run[::-1])
        states = np.hstack(states)
        e = np.exp(states @ p["attention"])
        return (e / e.sum()) @ states @ p["out"] + p["bias"][0]

    for text, _ in texts(12, 9):
        words = text.split()
        logits = [one(words[a : a + T.WINDOW]) for a in range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE)]
        assert abs(1 / (1 + np.exp(-max(logits))) - network.scorer().scores([text])[0]) < 1e-4


def test_held_out_toxic_documents_are_found(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in queries.op7_toxicity(spark, small).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in rows) >= 0.95 * len(rows)


def test_query_covers_all_documents(spark, sf):
    rows = queries.op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
