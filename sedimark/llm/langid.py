"""Language identification in two steps: the family, then the language within it.

A text is a vector of hashed byte n-grams. Linear support vector machines tell each
family from the rest; within the chosen family, one machine for each pair of languages
votes. Languages come from the labels; FAMILIES only groups those it knows, and any
other language is a family of its own.

The machines are fitted on the driver on a bounded sample: at most ``max_rows`` labelled
rows, one for each id, shared equally by the languages and chosen by a hash of doc_id, so every size of
table is sampled alike. Each language's share is thinned, and its texts become vectors, before it is collected; so what reaches
the driver is bounded in bytes too. Of more than ``max_langs`` labels the most frequent are learned.

Defined cases: a text that is null or has no letter is ``und`` with score 0; texts of any
length are read whole, a stretch at a time; repeated rows each get their result; without
labels every text is ``und``, with one language every text with letters is that one,
with score 1; an empty table gives an empty table; input columns named like an output
column are replaced; a null doc_id is not held out and not learned from; equal margins or votes go to the
first family or language in the alphabet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import struct_column, with_columns

#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb", "yi", "sv", "da", "no", "nb", "nn", "is", "fo"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)
MAX_ROWS, MAX_LANGS = 2000, 200
UNKNOWN = "und"
#: Bytes of a text whose n-grams are counted at a time.
STRETCH = 1 << 20
#: How steeply a margin turns into a confidence.
SLOPE = 4.0


def counted(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw), STRETCH):
        part = raw[at : at + STRETCH + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            starts = min(STRETCH, len(part) - n + 1)
            if starts > 0:
                code = part[:starts].copy()
                for i in range(1, n):
                    code = (code << 8) | part[i : i + starts]
                code = (code + np.uint32(n)) * np.uint32(2654435761)
                counts += np.bincount(code >> np.uint32(19), minlength=DIMENSIONS)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Unit vector of the square roots of the counts."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.linalg.norm(x)


def vector(text: str | None) -> np.ndarray | None:
    counts = counted(text)
    return None if counts is None else unit(counts)


def machine(x: np.ndarray, positive: np.ndarray, rounds: int = 30, cost: float = 10.0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate ascent; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, len(y) / (2 * max(1, positive.sum())), len(y) / (2 * max(1, (~positive).sum())))
    soft = 1 / (2 * cost * share)
    square = (x * x).sum(axis=1) + soft
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float32)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)).tolist():
            gradient = y[i] * float(x[i] @ w) - 1 + soft[i] * alpha[i]
            step = max(alpha[i] - gradient / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families in order, their machines, and for each family its languages and a machine for each pair of them."""

    families: list[str]
    family_weights: np.ndarray | None
    languages: dict[str, list[str]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, np.float32(1))
        best, sure = 0, 1.0
        if self.family_weights is not None:
            margins = SLOPE * (self.family_weights @ x).astype(np.float64)
            best = int(margins.argmax())
            sure = float(1 / np.exp(margins - margins[best]).sum())
        family = self.families[best]
        names = self.languages[family]
        if len(names) == 1:
            return names[0], sure
        duels = 1 / (1 + np.exp(-SLOPE * (self.pair_weights[family] @ x).astype(np.float64)))
        votes, least = np.zeros(len(names)), np.ones(len(names))
        pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
        for (i, j), p in zip(pairs, duels.tolist(), strict=True):
            votes[i] += (p >= 0.5) + p / len(pairs) / 2
            votes[j] += (p < 0.5) + (1 - p) / len(pairs) / 2
            least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
        won = int(votes.argmax())
        return names[won], min(1.0, sure * float(least[won]))


def fit_rows(texts: list[str], langs: list[str]) -> Model:
    rows = [(v, lang) for t, lang in zip(texts, langs, strict=True) if (v := vector(t)) is not None]
    return fit_matrix(np.array([v for v, _ in rows], np.float32).reshape(len(rows), DIMENSIONS), [lang for _, lang in rows])


def fit_matrix(x: np.ndarray, langs: list[str]) -> Model:
    labels = np.array(langs, object)
    languages: dict[str, list[str]] = defaultdict(list)
    for lang in sorted(set(labels)):
        languages[FAMILY.get(lang, lang)].append(lang)
    families = sorted(languages)
    of = np.array([FAMILY.get(lang, lang) for lang in labels], object)
    family_weights = np.array([machine(x, of == f) for f in families]) if len(families) > 1 else None
    pair_weights = {}
    for family, names in languages.items():
        duels = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                chosen = (labels == a) | (labels == b)
                duels.append(machine(x[chosen], labels[chosen] == a))
        pair_weights[family] = np.array(duels)
    return Model(families, family_weights, dict(languages), pair_weights)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _packed(texts: pa.Array) -> pa.Array:
    """Compressed counts, most of which are none: some KB a text."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    found = (counted(t) for t in texts.to_pylist())
    return pa.array([None if v is None else squeeze(np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes()) for v in found], pa.binary())


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """A model of the labelled rows where learn holds, from at most max_rows of them in at most max_langs languages."""
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    counted = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(doc_id, 0.02).alias("ids"))
    counts = {r[0]: max(1, r["ids"]) for r in counted.orderBy(F.desc("rows"), lang).limit(max_langs).collect()}
    if not counts:
        return fit_rows([], [])
    share = max(2, max_rows // len(counts))
    places = 1 << 30
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(places))
    limit = F.lit(0)
    for code, n in sorted(counts.items()):
        limit = F.when(F.col(lang) == code, int(places * min(1.0, 1.2 * share / n))).otherwise(limit)
    thinned = labelled.where(place < limit).select(place.alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # One row for each id, however often it is repeated: the least text.
    single = thinned.groupBy("place", "lang").agg(F.min("text").alias("text"))
    rows = single.select("place", "lang", F.arrow_udf(_packed, "binary")("text").alias("v")).where("v is not null")
    best: dict[str, list[bytes]] = defaultdict(list)
    for row in sorted(rows.collect(), key=lambda r: (r["lang"], r["place"])):
        if len(best[row["lang"]]) < share:
            best[row["lang"]].append(bytes(row["v"]))
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    x = np.empty((sum(map(len, best.values())), DIMENSIONS), np.float32)
    for i, packed in enumerate(p for found in best.values() for p in found):
        x[i] = unit(np.frombuffer(loosen(packed), "<u4"))
    return fit_matrix(x, [code for code, found in best.items() for _ in found])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(model)  # its size follows DIMENSIONS and the languages, not the rows

    def rows(texts: list[str | None]) -> Iterator[tuple[str, float]]:
        return map(model.value.predict, texts)

    return with_columns(docs, rows, "lang_pred:string,score:double", text)


def identified(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """docs whose language is known with a score of at least ``least``, with the columns of docs."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str | None]) -> Iterator[tuple[float]]:
        return ((model.value.predict(t)[1],) for t in texts)

    return docs.where(struct_column(rows, "score:double", F.col(f"`{text}`"))["score"] >= least)
