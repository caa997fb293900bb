"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector, if the training sample knows the word, and the mean
of the vectors of its hashed character n-grams, which carries to inflections never seen.
The network reads windows of WINDOW words, a new one every STRIDE words to the end of
the text; attention pools the states of a window, and the text's score is the highest of
its windows'.

It is trained on the driver on a bounded sample: at most ``max_rows`` labelled ids, a
third of them toxic where there are as many, in the order of a hash of doc_id, as far as their texts, which are
read whole, have ``max_windows`` windows together (a text that goes beyond is left out, a later one may fit). Labels say that a text is toxic, not where: after a first pass
over windows of all texts, each text is learned by its highest window of all it has.

Defined cases: a null or empty text, or one without words, gets the network's score of an
empty window; texts of any length are scored whole, a stretch at a time; repeated rows
each get their score; without labels of both kinds, or words in their texts, the score is the share of toxic labels,
0 without any; an empty table gives an empty table; input columns named like an output
column are replaced; labels with a null id or label are left out; an id with several labels is toxic if one of them
says so, and of several texts of an id the least is learned from; of equally high windows the first is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import forget, settled, with_columns

WINDOW, STRIDE = 32, 16
HIDDEN, WORD, CHAR = 16, 12, 20
GRAMS, GRAM_ORDERS = 1 << 14, (3, 4, 5)
VOCABULARY = 4096
MAX_ROWS = 2000
MAX_WINDOWS = 300_000
#: Words whose inputs a task keeps; windows scored at a time; words of texts gathered before scoring; words made into inputs at a time.
KEPT, AT_ONCE, GATHERED, MADE = 120_000, 1024, 40_000, 8192

WORDS = re.compile(r"\w+").findall
Parameters = dict[str, np.ndarray]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and where each word's begin; every word has one at least."""
    raw = np.frombuffer("".join(f"\x02{w}\x03\x00\x00\x00" for w in words).encode(), np.uint8).astype(np.uint32)
    size = np.array([len(w.encode()) + 5 for w in words])
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(ends - 3, size) - np.arange(len(raw))  # bytes to the word's end, this one included
    found = []
    for n in GRAM_ORDERS:
        at = np.flatnonzero((left >= n) | ((left == np.repeat(size - 3, size)) & (n == GRAM_ORDERS[0])))
        h = np.full(len(at), 2166136261 + n, np.uint32)
        for i in range(n):
            h = (h ^ raw[at + i]) * np.uint32(16777619)
        found.append((word[at], (h ^ (h >> np.uint32(15))) % np.uint32(GRAMS)))
    words_of, hashes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(words_of, kind="stable")
    return hashes[order].astype(np.int64), np.searchsorted(words_of[order], np.arange(len(words)))


class Inputs:
    """Word vectors: places in the vocabulary (0: unknown) and n-grams."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def places(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    @staticmethod
    def vectors(p: Parameters, places: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(p["grams"][hashes], starts, axis=0) / np.diff(np.append(starts, len(hashes)))[:, None]
        return np.hstack([p["words"][places], chars]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: Parameters, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
    """Logits of windows (index: windows x WINDOW rows of inputs, 0 where there is no word).

    inputs are the words' shares of the gates, directions x words x 3 HIDDEN, with row 0 for no word.
    """
    n, u = len(index), p["recurrent"]
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
    there = (index > 0).astype(np.float32)
    steps = []
    for t in range(WINDOW):
        back = WINDOW - 1 - t
        a = np.stack([inputs[0][index[:, t]], inputs[1][index[:, back]]])
        m = np.stack([there[:, t], there[:, back]])[:, :, None]
        r = h @ u
        zr = sigmoid(a[:, :, : 2 * HIDDEN] + r[:, :, : 2 * HIDDEN])
        z, reset, own = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:], r[:, :, 2 * HIDDEN :]
        new = np.tanh(a[:, :, 2 * HIDDEN :] + reset * own)
        move = m * (1 - z)
        if keep:
            steps.append((h, z, reset, own, new, m))
        h = h + move * (new - h)
        states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
    e = states @ p["attention"] - 1e4 * (1 - there.T)
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", weight, states)
    logits = pooled @ p["out"] + p["bias"][0]
    return (logits, states, weight, pooled, steps) if keep else logits


def gradients(p: Parameters, x: np.ndarray, index: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[Parameters, np.ndarray, float]:
    """Of the weighted logistic loss: by parameter, and by row of x."""
    inputs = gates(p, x)
    logits, states, weight, pooled, steps = forward(p, inputs, index, keep=True)
    chance = sigmoid(logits)
    loss = float((share * (np.logaddexp(0, logits) - target * logits)).sum())
    by = share * (chance - target)
    g = {"out": pooled.T @ by, "bias": np.array([by.sum()], np.float32)}
    by_pooled = by[:, None] * p["out"]
    by_weight = np.einsum("nk,tnk->tn", by_pooled, states)
    by_e = weight * (by_weight - (weight * by_weight).sum(axis=0))
    g["attention"] = np.einsum("tn,tnk->k", by_e, states)
    by_states = weight[:, :, None] * by_pooled + by_e[:, :, None] * p["attention"]
    u, by_h = p["recurrent"], np.zeros((2, len(index), HIDDEN), np.float32)
    g["recurrent"], by_gates = np.zeros_like(u), np.empty((2, WINDOW, len(index), 3 * HIDDEN), np.float32)
    for t in reversed(range(WINDOW)):
        back = WINDOW - 1 - t
        h, z, reset, own, new, m = steps[t]
        by_h = by_h + np.stack([by_states[t, :, :HIDDEN], by_states[back, :, HIDDEN:]])
        by_new = by_h * m * (1 - z) * (1 - new * new)
        by_z = -by_h * m * (new - h) * z * (1 - z)
        by_reset = by_new * own * reset * (1 - reset)
        by_r = np.concatenate([by_z, by_reset, by_new * reset], axis=2)
        by_a = np.concatenate([by_z, by_reset, by_new], axis=2)
        by_gates[0, t], by_gates[1, back] = by_a
        g["recurrent"] += h.transpose(0, 2, 1) @ by_r
        by_h = by_h * (1 - m * (1 - z)) + by_r @ u.transpose(0, 2, 1)
    by_inputs = np.stack([summed(index.T.ravel(), by.reshape(-1, 3 * HIDDEN), len(x) + 1) for by in by_gates])[:, 1:]
    g["input"] = np.einsum("vi,dvg->dig", x, by_inputs)
    g["shift"] = by_inputs.sum(axis=1)
    return g, np.einsum("dvg,dig->vi", by_inputs, p["input"]), loss


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values (one row for each of rows) by row, of n rows."""
    order = np.argsort(rows, kind="stable")
    some, starts = np.unique(rows[order], return_index=True)
    found = np.zeros((n, values.shape[1]), np.float32)
    found[some] = np.add.reduceat(values[order], starts, axis=0)
    return found


def gates(p: Parameters, x: np.ndarray) -> np.ndarray:
    """Inputs for forward() of word vectors."""
    found = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
    for d in range(2):
        found[d, 1:] = x @ p["input"][d] + p["shift"][d]
    return found


def window_rows(rows: np.ndarray) -> np.ndarray:
    """Windows over a text's rows, every STRIDE words to the end; an empty one for a text without words."""
    n = max(1, -(-(len(rows) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, rows.dtype)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Adam:
    def __init__(self, p: Parameters, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: Parameters) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


class Network:
    """Parameters with the vocabulary; or only a share of toxic labels."""

    def __init__(self, vocabulary: dict[str, int], p: Parameters | None, prior: float):
        self.vocabulary, self.p, self.prior = vocabulary, p, prior

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; keeps the inputs of a bounded number of words."""

    def __init__(self, network: Network):
        self.network, self.make = network, Inputs(network.vocabulary)
        self.rows: dict[str, int] = {}
        self.inputs = np.zeros((2, KEPT + 1, 3 * HIDDEN), np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        """Rows of the words; all of them are kept at once."""
        new = list({w for w in words if w not in self.rows})
        if len(self.rows) + len(new) > KEPT:
            self.rows, new = {}, list(set(words))
        if new:
            at, p = len(self.rows) + 1, self.network.p
            for a in range(0, len(new), MADE):
                part = new[a : a + MADE]
                self.inputs[:, at + a : at + a + len(part)] = gates(p, Inputs.vectors(p, self.make.places(part), *grams(part)))[:, 1:]
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def _windows(self, parts: list[list[str]]) -> np.ndarray:
        """The highest logit of each part."""
        rows = self._known([w for part in parts for w in part])
        ends = np.cumsum([len(p) for p in parts])
        found = [window_rows(rows[b - len(p) : b]) for p, b in zip(parts, ends.tolist(), strict=True)]
        index = np.concatenate(found)
        logits = np.concatenate([forward(self.network.p, self.inputs, index[a : a + AT_ONCE]) for a in range(0, len(index), AT_ONCE)])
        return np.maximum.reduceat(logits, np.cumsum([0, *(len(f) for f in found[:-1])]))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.network.p is None:
            return [self.network.prior] * len(texts)
        best = np.full(len(texts), -np.inf)
        parts: list[list[str]] = []
        owners: list[int] = []
        gathered = 0

        def score() -> None:
            nonlocal parts, owners, gathered
            np.maximum.at(best, owners, self._windows(parts))
            parts, owners, gathered = [], [], 0

        for i, text in enumerate(texts):
            words = WORDS((text or "").lower())
            # Stretches of a long text overlap as its windows do.
            for a in range(0, max(1, len(words) - (WINDOW - STRIDE)), GATHERED):
                parts.append(words[a : a + GATHERED + WINDOW - STRIDE])
                owners.append(i)
                gathered += len(parts[-1])
                if gathered >= GATHERED:
                    score()
        if parts:
            score()
        return sigmoid(best).tolist()


def _steps(n: int, batch: int) -> int:
    """Steps over n windows by batches; of few windows 24, if that leaves four for each."""
    return max(1, n // batch, min(n // 4, 24))


def train(texts: list[str], toxic: list[bool], first: int = 1, rounds: int = 10, seed: int = 7) -> Network:
    prior = sum(toxic) / len(toxic) if toxic else 0.0
    if not 0 < prior < 1:
        return Network({}, None, prior)
    texts, toxic = [*texts, *[""] * (len(texts) // 50 + 1)], [*toxic, *[False] * (len(texts) // 50 + 1)]  # no words, no harm
    split = [WORDS(t.lower()) for t in texts]
    counts = Counter(w for words in split for w in set(words))
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(((w, n) for w, n in counts.items() if n >= 3), key=lambda x: (-x[1], x[0]))[:VOCABULARY], 1)}
    names = sorted(counts)
    if not names:
        return Network({}, None, prior)
    row = {w: i for i, w in enumerate(names, 1)}
    places = Inputs(vocabulary).places(names)
    parts = [grams(names[a : a + MADE]) for a in range(0, len(names), MADE)]
    sizes = [np.diff(np.append(s, len(h))) for h, s in parts]
    hashes, ends = np.concatenate([h.astype(np.uint16) for h, _ in parts]), np.cumsum(np.concatenate(sizes))
    starts = ends - np.concatenate(sizes)
    windows = [window_rows(np.fromiter((row[w] for w in words), np.int32, len(words))) for words in split]
    random, width = np.random.default_rng(seed), WORD + CHAR
    p: Parameters = {
        "words": random.normal(0, 0.1, (VOCABULARY + 1, WORD)).astype(np.float32),
        "grams": random.normal(0, 0.3, (GRAMS, CHAR)).astype(np.float32),
        "input": random.normal(0, width**-0.5, (2, width, 3 * HIDDEN)).astype(np.float32),
        "shift": np.zeros((2, 3 * HIDDEN), np.float32),
        "recurrent": random.normal(0, HIDDEN**-0.5, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "attention": random.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
        "out": random.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    adam = Adam(p, 5e-3)
    target = np.array(toxic, np.float32)
    half = np.where(target > 0, 0.5 / target.sum(), 0.5 / (1 - target).sum()).astype(np.float32) * len(target)

    def learn(index: np.ndarray, targets: np.ndarray, share: np.ndarray) -> None:
        used, flat = np.unique(index, return_inverse=True)
        used = used[used > 0]
        index = flat.reshape(index.shape) + (0 if (index == 0).any() else 1)
        spans = [np.arange(starts[i - 1], ends[i - 1]) for i in used]
        lengths = np.array([len(s) for s in spans])
        some, begin = hashes[np.concatenate(spans)], np.cumsum(lengths) - lengths
        known = np.where(random.random(len(used)) < 0.3, 0, places[used - 1])  # unknown now and then, so that characters must do
        x = Inputs.vectors(p, known, some, begin)
        g, by_x, _ = gradients(p, x, index, targets, share / share.sum())
        g["words"] = summed(known, by_x[:, :WORD], VOCABULARY + 1)
        g["grams"] = summed(some, np.repeat(by_x[:, WORD:] / lengths[:, None], lengths, axis=0), GRAMS)
        adam.step(g)

    owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    every = np.concatenate(windows)
    even = half[owner] / np.array([len(w) for w in windows])[owner]
    for _ in range(first):
        # As many draws as there are windows, each text as often as any other.
        chosen = random.choice(len(every), max(len(every), min(16_000, 4 * len(every))), p=even / even.sum())
        for part in np.array_split(chosen, _steps(len(chosen), 256)):
            learn(every[part], target[owner[part]], np.ones(len(part), np.float32))
    size = np.array([len(w) for w in windows])
    begin = np.cumsum(size) - size
    for turn in range(rounds):
        adam.rate = 5e-3 * (1 - turn / rounds) + 3e-4
        x = np.zeros((2, len(names) + 1, 3 * HIDDEN), np.float32)
        for a in range(0, len(names), MADE):
            b = min(len(names), a + MADE)
            x[:, a + 1 : b + 1] = gates(p, Inputs.vectors(p, places[a:b], hashes[starts[a] : ends[b - 1]], starts[a:b] - starts[a]))[:, 1:]
        logits = np.concatenate([forward(p, x, every[a : a + AT_ONCE]) for a in range(0, len(every), AT_ONCE)])
        highest = np.array([a + int(logits[a : a + n].argmax()) for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
        more = random.choice(np.flatnonzero(target[owner] == 0), len(highest) // 2)
        for part in np.array_split(random.permutation(np.concatenate([highest, more])), _steps(len(highest), 64)):
            learn(every[part], target[owner[part]], half[owner[part]])
    return Network(vocabulary, p, prior)


def _n_windows(texts: pa.Array) -> pa.Array:
    return pa.array([max(1, -(-(len(WORDS((t or "").lower())) - WINDOW) // STRIDE) + 1) for t in texts.to_pylist()], pa.int64())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS) -> Network:
    """A network from the labels (of doc_id) where learn holds."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), (F.col(label) == 1).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.approx_count_distinct("i", 0.02)).collect()}
    share, places = {True: max_rows // 3, False: max_rows - max_rows // 3}, 1 << 30
    place = F.pmod(F.xxhash64("i"), F.lit(places))
    limit = {k: int(places * min(1.0, 1.2 * share[k] / n)) for k, n in counts.items()}
    thinned = known.where(place < F.when(F.col("toxic"), limit.get(True, 0)).otherwise(limit.get(False, 0)))
    # Some 1.2 * max_rows ids, whatever the table's size and however often an id is repeated; the limit makes it a proof.
    chosen = {r["i"]: r["toxic"] for r in thinned.groupBy("i").agg(F.max("toxic").alias("toxic")).orderBy(place, "i").limit(2 * max_rows).collect()}
    texts = docs.where(F.col(doc_id).isin(list(chosen))).select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = settled(texts.groupBy("i").agg(F.min("text").alias("text")))
    sizes = one.select("i", place.alias("place"), F.arrow_udf(_n_windows, "bigint")("text").alias("n")).collect()
    taken: dict[bool, list] = {True: [], False: []}
    room = {k: max_windows * share[k] // max_rows for k in share}
    for row in sorted(sizes, key=lambda r: (r["place"], r["i"])):
        toxic = chosen[row["i"]]
        if len(taken[toxic]) < share[toxic] and row["n"] <= room[toxic]:
            taken[toxic].append(row["i"])
            room[toxic] -= row["n"]
    found = dict(map(tuple, one.where(F.col("i").isin(taken[True] + taken[False])).collect()))
    forget(one)
    network = train([found[i] for k in (True, False) for i in taken[k]], [True] * len(taken[True]) + [False] * len(taken[False]))
    if network.p is None:
        network.prior = known.agg(F.coalesce(F.avg(F.col("toxic").cast("double")), F.lit(0.0))).first()[0]
    return network


def score_toxicity(docs: DataFrame, network: Network, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    network = docs.sparkSession.sparkContext.broadcast(network)  # its size follows the constants above, not the rows
    held: list[Scorer] = []

    def rows(texts: list[str | None]) -> Iterator[tuple[float, int]]:
        if not held:
            held.append(network.value.scorer())
        return ((s, int(s >= threshold)) for s in held[0].scores(texts))

    return with_columns(docs, rows, "score:double,predicted:int", text)
