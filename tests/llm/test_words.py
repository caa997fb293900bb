import collections
import math
import unicodedata

import numpy as np
import pytest

from sedimark.llm import quality as Q
from sedimark.llm import words as W

ROWS = [
    (0, "a b c", "x"), (1, "A b d!", "x"), (2, "a b c d e f", None), (3, None, "x"), (4, " ", "x"), (5, "a b c", "x"), (6, "b b b b a b", "x"), (7, "中文字 a b_1 नमस्ते", "x"),
    (8, "a b d e f a b c", None), (9, "zz", "y"), (10, "\x00\x01", "x"), (11, "d! a b d! e a b", "x"),
]


def tokens(text):
    """The words of a text, one character after the other."""
    found, inside = [], False
    for c in (text or "").lower():
        word = (unicodedata.category(c)[0] in "LNM" or c == "_") and not any(a <= ord(c) <= b for a, b in W.UNSPACED)
        if word and inside:
            found[-1] += c
        elif word or not (unicodedata.category(c)[0] in "ZC" or c.isspace()):
            found.append(c)
        inside = word
    return found


def model(paths, order):
    """Values of n-grams by order: counts, and below them the kinds of words before."""
    values = {order: collections.Counter()}
    for lang, path in paths:
        for at in range(order - 1, len(path)):
            values[order][lang, tuple(path[at - order + 1 : at + 1])] += 1
    for k in range(order - 1, 0, -1):
        values[k] = collections.Counter((lang, gram[1:]) for lang, gram in values[k + 1])
    return values


def probability(values, cuts, lang, gram):
    if not gram:
        return W.RARE
    k = len(gram)
    after = {g: n for (tongue, g), n in values[k].items() if tongue == lang and g[:-1] == gram[:-1]}
    total, below = sum(after.values()), probability(values, cuts, lang, gram[1:])
    if not total:
        return below
    cut = lambda n: cuts[k][min(n, 3)]
    n = after.get(gram, 0)
    return (n - cut(n)) / total + sum(cut(x) for x in after.values()) / total * below


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(spark, order):
    paths = {i: (lang, ["^"] * (order - 1) + tokens(t) + ["$"]) for i, t, lang in ROWS if tokens(t)}
    ones = {k: collections.Counter(v.values()) for k, v in model(paths.values(), order).items()}
    cuts = {k: W.discounts([c[i] for i in (1, 2, 3, 4)]) for k, c in ones.items()}
    docs = spark.createDataFrame(ROWS, "row bigint, text string, lang string").repartition(3, "row").sortWithinPartitions("row")
    found = W.scored(Q.settled(docs), "text", "lang", Q._rules, Q.RULES, order).collect()
    assert len(found) == len(ROWS) and {r.row for r in found} == set(range(len(ROWS)))
    for r in found:
        assert (r.log_perplexity is None) == (r.row not in paths)
        if r.row in paths:
            lang, path = paths[r.row]
            others = model([p for i, p in paths.items() if i != r.row], order)
            places = range(order - 1, len(path))
            whole, single = ([math.log(probability(others, cuts, lang, tuple(path[at - k + 1 : at + 1]))) for at in places] for k in (order, 1))
            assert r.n_tokens == len(places)
            assert r.log_perplexity == pytest.approx(-sum(whole) / len(whole), abs=1e-9) and r.single == pytest.approx(-sum(single) / len(single), abs=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    paths = [(lang, ["^"] * (W.ORDER - 1) + tokens(t) + ["$"]) for _, t, lang in ROWS if tokens(t)]
    values = model(paths, W.ORDER)
    cuts = {k: W.discounts([sum(n == i for n in v.values()) for i in (1, 2, 3, 4)]) for k, v in values.items()}
    known = {g[-1] for (lang, g) in values[1] if lang == "x"}
    rest = (sum(cuts[1][min(n, 3)] for (lang, _), n in values[1].items() if lang == "x") / sum(n for (lang, _), n in values[1].items() if lang == "x")) * (1 - W.RARE * len(known))
    assert sum(probability(values, cuts, "x", (w,)) for w in known) + rest == pytest.approx(1)


def test_words_of_long_texts_are_those_of_their_stretches(monkeypatch):
    text = "Ab cd, éf 中文 " * 40
    whole = W.words([text, None, text])
    monkeypatch.setattr(W, "STRETCH", 64)
    parts = W.words([text, None, text])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and set(whole[1].tolist()) == {0, 2}


def test_packed_columns_come_back():
    r = np.random.default_rng(1)
    columns = [r.integers(0, top, 1000, dtype=np.uint64) for top in (1, 2, 300, 2**40, 2**64 - 1)]
    assert all(np.array_equal(a, b) for a, b in zip(columns, W.unpack(W.pack(columns)), strict=True))
    assert [len(c) for c in W.unpack(W.pack([np.empty(0, np.uint64)]))] == [0]


def cyrillic(r, n):
    return "".join(map(chr, r.integers(0x430, 0x450, n)))


def test_word_salad_and_junk_in_other_scripts_are_rejected(spark):
    r = np.random.default_rng(5)
    known = [cyrillic(r, 5) for _ in range(60)]
    follows = {w: r.choice(known, 8, replace=False) for w in known}

    def say(n=120):
        out = [str(r.choice(known))]
        while len(out) < n:
            out.append(str(r.choice(follows[out[-1]])))
        return out

    rows = [(i, " ".join(say()), "x") for i in range(60)]
    rows += [(100, " ".join(r.permutation(say())), "x"), (101, " ".join(cyrillic(r, 5) for _ in range(120)), "x")]
    kept = {d.doc_id: d.kept for d in Q.judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101]


@pytest.mark.parametrize("order", [2, 3])
def test_texts_are_read_once_for_each_order_and_once_to_be_scored(spark, monkeypatch, order):
    asked, plain = [], W._questions
    monkeypatch.setattr(W, "_questions", lambda k, *rest: asked.append(k) or plain(k, *rest))
    docs = spark.createDataFrame(ROWS, "row bigint, text string, lang string")
    assert W.scored(Q.settled(docs), "text", "lang", Q._rules, Q.RULES, order).count() == len(ROWS)
    assert asked == list(range(order, 0, -1))


@pytest.mark.parametrize("bits", [3, 40, 60])
def test_keys_are_ranked_with_equal_ones_by_place(bits):
    r = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys = r.integers(0, 1 << bits, n, dtype=np.uint64)
        keys[n // 2 :] = keys[: n - n // 2]
        found, places = W.ranked(keys, bits)
        assert np.array_equal(places, np.argsort(keys, kind="stable")) and np.array_equal(found, np.sort(keys))
