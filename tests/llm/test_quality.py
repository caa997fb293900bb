import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimark.llm import quality as Q
from sedimark.llm import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    within = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(within)


def test_counts_equal_brute_force():
    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="ab  \n#\x1cé", max_size=150))
    def same(text):
        assert Q.base(text) == brute(text)

    same()
    assert Q.base(None) == (0, 0, 0, 0, 0)


def test_strange_texts_are_rejected_and_others_kept(spark):
    r = np.random.default_rng(3)
    syllables = ["ba", "de", "li", "mo", "nu", "sa", "te"]
    say = lambda: " ".join("".join(r.choice(syllables, 3)) for _ in range(80))
    rows = [(i, say(), "x" if i % 2 else None) for i in range(80)] + [(100, "".join(map(chr, r.integers(97, 123, 300))) + " q" * 25 + " z1 %x" * 20, "x"), (101, "short text", "x"), (102, None, None), (103, "same words " * 60, "x"), (103, "same words " * 60, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kept", F.lit("clash"))
    found = Q.judge_quality(docs).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in (100, 101, 102, 103))
    assert Q.judge_quality(docs.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = brute(docs[r.doc_id])
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*own, failed) and not (failed and r.kept)


def test_bands_equal_medians_of_all_texts(spark):
    r = np.random.default_rng(7)
    rows = [(g, m, float(np.floor(v / Q.BIN) + 0.5)) for g, n in (("a", 101), ("b", 40), ("c", 1)) for m in Q.MEASURES for v in r.gamma(3, 1.5, n)]
    counts = spark.createDataFrame(rows, "tongue string, measure string, bin double").groupBy("tongue", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))

    def edge(values, m):
        middle = np.median(values)
        apart = Q.MEASURES[m] * (values - middle)
        return middle + Q.MEASURES[m] * Q.BOUNDS[m] * max(np.median(apart[apart >= 0]), Q.LEAST_SPREAD / Q.BIN)

    of = lambda keep: {m: np.array([b for g, x, b in rows if x == m and keep(g)]) for m in Q.MEASURES}
    found = {r.tongue: r for r in Q._edges(counts, "tongue").collect()}
    assert {g: f.n for g, f in found.items()} == {"a": 101, "b": 40, "c": 1}
    for g, f in found.items():
        for m, values in of(lambda x, g=g: x == g).items():
            assert abs(f[m] - edge(values, m)) < 1e-9
    every = Q._edges(counts).first()
    assert every.n == 142 and all(abs(every[m] - edge(values, m)) < 1e-9 for m, values in of(lambda x: True).items())


def test_counts_of_many_texts_equal_brute_force_and_windows_are_named_only_where_one_may_repeat(monkeypatch):
    r = np.random.default_rng(11)
    letters = ["a", "b", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "#", "é", "中", "😀", "\x00", "|"]
    say = lambda n, known: " ".join(map(str, r.integers(0, known, n)))
    same = say(8, 10**9)
    texts = ["".join(r.choice(letters, 200)) for _ in range(60)] + [say(int(n), known) for n in (0, 1, 7, 8, 9, 60) for known in (1, 2, 10**9)]
    texts += [None, "", same, same, f"x {same}", f"{same} y {same}", say(5000, 10**9)]
    named, plain = [], Q.repeated_words
    monkeypatch.setattr(Q, "repeated_words", lambda words, size=8: named.append(words) or plain(words, size))
    found = list(Q._rules(texts))
    expected = [brute(t) for t in texts]
    assert found == expected
    assert len(named) == sum(e[4] > 0 for e in expected)
