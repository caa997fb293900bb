"""Quality rules: counts that show junk, and n-gram perplexity within bands of its language.

The model is one of word n-grams of all other documents (words.py), modified Kneser-Ney; it grows with the
corpus. Of each text it gives the log-perplexity by all orders and by single words. A text is
rejected if

- its log-perplexity is more than HIGH spreads above the median: words or characters that its language does not know;
- by single words it is more than LOW spreads below the median: a few common words again and again;
- the order of its words helps to foresee them less than the median by more than LESS spreads: a salad of words.

The lower band is one of single words since a copied text is foreseen well, and copies are near_duplicates' to judge.
Medians, and spreads (the median distance of what lies on that side of the median), are of all texts of a
language and a size, by powers of two of words, in bins of BIN; where there are fewer than ENOUGH such texts, of all texts
of the language, or else of all texts. Every text with a word is judged, whatever its length.

Defined cases: a null, empty or blank text has no words, so it fails the base rules; a text whose
words have no letter, digit or mark (controls alone) is rejected; texts
of any length are read whole; documents with a null language are a group of their own;
repeated rows each get their result; an empty table gives an empty table; input columns
named like an output column are replaced; ties (equal perplexities) are judged alike. The text column is not returned.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm import words
from sedimark.llm.common import settled

HIGH, LOW, LESS = 6.0, 8.0, 5.0
BIN, LEAST_SPREAD, ENOUGH = 0.02, 0.1, 30

#: What lies between words, and the marks that are counted. UTF-8 has no other bytes like these, and bytes.split() and bytes.strip() know the same six.
BLANKS, MARKS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
WINDOW = 8


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, len(words))
    # Names of windows of 1, 2, 4, 8 words, each from two of half the length: equal names, equal windows.
    names, length = ids, 1
    while length < size:
        step = min(length, size - length)
        pairs = (names[: len(names) - step] << np.uint64(32)) | names[step:]
        names, length = np.unique(pairs, return_inverse=True)[1].astype(np.uint64), length + step
    again = np.bincount(names.astype(np.int64))[names.astype(np.int64)] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def suspects(hashes: list[np.ndarray], size: int = WINDOW) -> list[int]:
    """Texts, given as hashes of their words, that may have a window twice: all that have, and hardly any others."""
    longer = [i for i, one in enumerate(hashes) if len(one) > size]
    if not longer:
        return []
    joined = np.concatenate([hashes[i] for i in longer])
    n = len(joined) - size + 1
    windows = np.zeros(n, np.uint64)
    for at, weight in enumerate(words.weights()[:size]):
        windows += joined[at : at + n] * weight
    text = np.repeat(np.arange(len(longer), dtype=np.uint64), [len(hashes[i]) for i in longer])
    within = text[:n] == text[size - 1 :]
    low = np.uint64(len(longer).bit_length())
    keys = np.sort((words.mixed(windows[within]) >> low << low) | text[:n][within])
    twice = keys[1:][keys[1:] == keys[:-1]] & ((np.uint64(1) << low) - np.uint64(1))
    return [longer[i] for i in np.unique(twice).tolist()]


def _rules(texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """Of each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found, hashes = [], []
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        lines = list(filter(bytes.strip, raw.split(b"\n")))
        blanks = len(raw) - len(raw.translate(None, BLANKS))
        found.append((len(own), len(text) - blanks, len(raw) - len(raw.translate(None, MARKS)), len(lines) - len(set(lines))))
        hashes.append(np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64))
    repeated = {i: repeated_words((texts[i] or "").encode("utf-8", "surrogatepass").split()) for i in suspects(hashes)}
    return [(*counts, repeated.get(i, 0)) for i, counts in enumerate(found)]


def base(text: str | None) -> tuple[int, int, int, int, int]:
    return _rules([text])[0]


RULES = "n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint"
#: Measures of a text, and the side of the median on which they are bounded.
MEASURES = {"log_perplexity": 1, "single": -1, "gain": -1}
BOUNDS = {"log_perplexity": HIGH, "single": LOW, "gain": LESS}
#: Groups of languages and sizes that are sent to every executor.
BROADCAST_ROWS = 10_000


def _edges(counts: DataFrame, *keys: str) -> DataFrame:
    """By group: its number of texts, and of each measure the bound beyond which a text is rejected, in bins.

    Of (measure, bin, n) histograms: whatever a group's texts, its rows are its bins.
    """
    pick = lambda values: F.coalesce(*(F.when(F.col("measure") == m, F.lit(float(v))) for m, v in values.items()))
    side, bound = pick(MEASURES), pick(BOUNDS)
    own = counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    middle = own.groupBy(*keys, "measure").agg(F.percentile("bin", 0.5, F.col("n")).alias("middle"), F.sum("n").alias("texts"))
    apart = own.join(middle, [*keys, "measure"]).withColumn("distance", side * (F.col("bin") - F.col("middle"))).where("distance >= 0")
    spread = apart.groupBy(*keys, "measure", "middle", "texts").agg(F.greatest(F.percentile("distance", 0.5, F.col("n")), F.lit(LEAST_SPREAD / BIN)).alias("spread"))
    edges = spread.select(*keys, "measure", "texts", (F.col("middle") + side * bound * F.col("spread")).alias("edge"))
    return edges.groupBy(*keys).agg(F.max("texts").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col("edge"))).alias(m) for m in MEASURES))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; joins of a larger one are shuffled, with adaptive splits."""
    kept = settled(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", stable: bool = False) -> DataFrame:
    """docs without texts, with the counts of base(), base_failed, log_perplexity by words (null for texts without any) and kept.

    stable says that docs come from files, so that they are read alike each time; others are written first.
    """
    docs = docs if stable else settled(docs, "zstd")
    judged = words.scored(docs.drop("kept", "base_failed"), text, lang, _rules, RULES)
    row, tongue = (f"_{name}_{uuid.uuid4().hex[:8]}" for name in ("row", "lang"))
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`").cast("string")), F.lit(""))
    judged = judged.withColumn("gain", F.col("single") - F.col("log_perplexity")).withColumn(tongue, group)
    binned = {m: F.floor(F.col(m) / BIN) + 0.5 for m in MEASURES}
    measured = judged.where("log_perplexity is not null").select(F.col(tongue).alias("tongue"), F.floor(F.log2("n_tokens")).cast("int").alias("size"), F.explode(F.create_map(*(x for m in MEASURES for x in (F.lit(m), binned[m])))).alias("measure", "bin"))
    counts = settled(measured.groupBy("tongue", "size", "measure", "bin").agg(F.count(F.lit(1)).alias("n")))
    every = _edges(counts).first()
    every = {m: 0.0 for m in MEASURES} if every is None or every["n"] is None else every.asDict()
    by_size, by_lang = _small(_edges(counts, "tongue", "size")), _small(_edges(counts, "tongue"))
    renamed = lambda df, end: df.select(F.col("tongue").alias(f"{tongue}{end}"), *([F.col("size").alias("_size")] if end == "_s" else []), *(F.col(c).alias(f"{c}{end}") for c in ("n", *MEASURES)))
    sized = judged.withColumn(row, F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    joined = sized.join(renamed(by_size, "_s"), (F.col(tongue) == F.col(f"{tongue}_s")) & (F.col(row) == F.col("_size")), "left").join(renamed(by_lang, "_l"), F.col(tongue) == F.col(f"{tongue}_l"), "left")
    inside = F.lit(True)
    for m, side in MEASURES.items():
        edge = F.when(F.col("n_s") >= ENOUGH, F.col(f"{m}_s")).when(F.col("n_l") >= ENOUGH, F.col(f"{m}_l")).otherwise(F.lit(every[m]))
        inside = inside & (side * binned[m] <= side * edge)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = [c for c in judged.columns if c not in ("n_tokens", "single", "gain", tongue)]
    return joined.withColumns({"base_failed": failed}).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*(F.col(f"`{c}`") for c in names), "base_failed", "kept")
