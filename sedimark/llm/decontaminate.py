"""Benchmark decontamination by canonical templates.

Words are canonical: lower-cased and stripped of punctuation, with numbers, names and
units replaced by the placeholders <num>, <name> and <unit>, so that a question asked
again with other values has the same template. A name is a capitalised word; names in a row are one.
A capitalised word that begins a sentence may be either, so a text is read both ways, and each
reading is matched by itself. A third reading has no placeholders: it finds exact copies of whatever words. Templates are cut into windows of WINDOW
words (an item with fewer words is one window), each with at least LITERAL of its words
kept as they are, or all of them. Windows of fewer literals, WEAK at least, count where the whole template of
an item of SHORTEST words or more is met in one piece: sums asked with other numbers, and sentences full of names and dates.

A Bloom filter of fixed size, made from the benchmark's windows, leaves the documents'
windows that may match; those are joined with the benchmark's by hash. Of the matches of
a document and an item, COVERED of the item's windows must be in the document, or RUN of its words in a row, and the
slots must be consistent: no value of the item may stand for two values in the document (two
may become one). The result names how it was caught: ``exact`` if all slots are equal, else
``reparameterised``.

Window hashes are hash-joined with adaptive skew splitting, so a passage that very many
documents share is dealt over tasks. Only documents' windows that pass the filter are
shuffled; texts are not. A window that more than COMMON items hold does not bring up all of them: items are
brought up by their rarer windows, and what is brought up is then joined with its common ones. Items that could be
found by common windows alone (half of their windows, a run, or a weak template) are brought up by these too, so none is lost.

Defined cases: a null or empty text matches nothing, nor does an item without words of
its own; repeated documents each count, with one row for each doc_id; repeated items each
get their rows; empty tables give an empty result; texts of any length are read whole; only ids and texts are read, so other
columns cannot clash; contaminated() leaves out rows with a null id on either side, as nothing names
them, clean() judges each row by itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import settled, trim

WINDOW = 8
LITERAL = 5
COVERED = 0.5
#: Words in a row that show an excerpt of an item of any length.
RUN = 13
#: Literals of a window that counts as a part of a whole template, and the least words of such a template.
WEAK, SHORTEST = 2, 5
#: Items that hold a window before it is common.
COMMON = 16
#: Texts that are read together.
TOGETHER = 64
#: Bits of the filter: 4 MB whatever the benchmark's size. Beyond some million windows it passes more, which the join removes.
FILTER_BITS = 1 << 25

#: Units of measure that follow a number.
UNITS = frozenset(
    "mm cm m km mg g kg t ml cl l ms s min h hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal pa bar k "
    "inch inches foot feet ft yard yards mile miles ounce ounces oz pound pounds lb lbs gallon gallons "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees".split()
)
NUMBER = re.compile(r"[+-]?[$€£¥]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?[%$€£¥]?\Z")
NUMBER_UNIT = re.compile(r"[+-]?[0-9][0-9.,]*([a-z]{1,4})\Z")
EDGES = " \t\"'`()[]{}<>.,;:!?¡¿«»“”‘’*_~|#"

PLAIN, NUM, NAME, UNIT, NONE = range(5)
#: Readings of a text: capitalised words that begin sentences are plain, or names; or all words as they are.
READINGS = FIRST_PLAIN, FIRST_NAME, VERBATIM = 0, 1, 2
#: Values of the placeholders, far from those of words only by chance.
HASHES = {NUM: 0x9E3779B97F4A7C15, NAME: 0xC2B2AE3D27D4EB4F, UNIT: 0x165667B19E3779F9}
STEP = np.uint64(0x100000001B3)


class Words:
    """Hash and kind of each distinct word, in arrays that hold LIMIT of them."""

    LIMIT = 150_000

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hash = np.empty(self.LIMIT, np.uint64)
        self.kind = np.empty(self.LIMIT, np.int8)
        self.ends = np.empty(self.LIMIT, bool)

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words are, after adding the new ones; what is kept is dropped when there is no room."""
        get = self.place.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            new = set(words).difference(self.place)
            if len(self.place) + len(new) > self.LIMIT:
                self.place.clear()
                new = set(words)
                if len(new) > len(self.hash):
                    self.hash, self.kind, self.ends = np.empty(len(new), np.uint64), np.empty(len(new), np.int8), np.empty(len(new), bool)
            for word in new:
                self.add(word)
            found = [get(w) for w in words]
        return np.array(found, np.int64)

    def add(self, word: str) -> None:
        import xxhash

        bare = word.strip(EDGES)
        low = bare.lower()
        if not bare:
            kind = NONE
        elif not bare.isalpha() and NUMBER.match(bare):
            kind = NUM
        elif not bare.isalpha() and (m := NUMBER_UNIT.match(low)) and m[1] in UNITS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif bare[0].isupper() and bare[1:].lower() == bare[1:]:
            kind = NAME
        else:
            kind = PLAIN
        at = self.place[word] = len(self.place)
        self.hash[at] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.kind[at] = kind
        self.ends[at] = word.rstrip("\"'”’)»")[-1:] in ".!?:|" or not bare


class Canonical:
    """Templates of texts: for each word kept, its hash as literal or placeholder, its kind, and its place among all words."""

    def __init__(self) -> None:
        self.words = Words()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        _, h, kind, kept, _, split, _ = next(self.readings([text], (FIRST_PLAIN,)))
        return h, kind, kept, split

    def readings(self, texts: list[str], wanted: tuple[int, ...] = READINGS) -> Iterator[tuple]:
        """For each reading: hashes, kinds and places of the words kept and the text of each; all words, and where each text's end."""
        parts = [t.split() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        split = [w for part in parts for w in part]
        owner, stops = np.repeat(np.arange(len(parts)), sizes), np.cumsum(sizes)
        at = self.words.places(split)
        hashes, kinds, ends = self.words.hash[at], self.words.kind[at], self.words.ends[at]
        within = np.zeros(len(at), bool)
        within[1:] = owner[1:] == owner[:-1]
        for reading in wanted:
            kind = kinds if reading != VERBATIM else np.where(kinds == NONE, NONE, PLAIN)
            if reading == FIRST_PLAIN:
                first = ~within
                first[1:] |= ends[:-1]
                kind = np.where((kind == NAME) & first, PLAIN, kind)
            if reading != VERBATIM:
                # A unit is one only behind a number; names in a row are one.
                behind, again = np.zeros(len(at), bool), np.zeros(len(at), bool)
                behind[1:] = kind[:-1] == NUM
                kind = np.where((kind == UNIT) & ~(behind & within), PLAIN, kind)
                again[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
                kept = np.flatnonzero((kind != NONE) & ~(again & within))
            else:
                kept = np.flatnonzero(kind != NONE)
            kind, h = kind[kept], hashes[kept]
            if reading != VERBATIM:
                for k, value in HASHES.items():
                    h[kind == k] = value
            yield reading, h, kind, kept, owner[kept], split, stops


def windows(h: np.ndarray, lengths: list[int], reading: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the hashes of its windows, by where they start; one pass makes those of all lengths."""
    value = np.zeros(len(h), np.uint64)
    for i in range(min(max(lengths), len(h))):
        value = (value[: len(h) - i] ^ h[i:]) * STEP
        value ^= value >> np.uint64(29)
        if i + 1 in lengths:
            yield i + 1, value ^ np.uint64((i + 1 + WINDOW * reading) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def slots(start: int, length: int, kind: np.ndarray, kept: np.ndarray, split: list[str], stop: int) -> list[str]:
    """Values in the placeholders of a window, with their kinds; stop is where the text's words end."""
    found = []
    for i in range(start, start + length):
        if kind[i] != PLAIN:
            end = kept[i] + 1
            if kind[i] == NAME:
                end = min(kept[i + 1], stop) if i + 1 < len(kept) else stop
                names = [w.strip(EDGES) for w in split[kept[i] : end]]
                found.append("n:" + " ".join(w for w in names if w[:1].isupper()))
            else:
                found.append("#:" + split[kept[i]].strip(EDGES).lower())
    return found


def _rows(ids: list, texts: list, lengths: list[int] | None, bits: np.ndarray | None, canonical: Canonical) -> Iterator[tuple]:
    """(id, reading, length, window hash, place, strong windows of the text, all of its windows, strong, slots) of each window; with bits, only of those in the filter."""
    for reading, h, kind, kept, owner, split, stops in canonical.readings([t or "" for t in texts]):
        own = lengths if lengths is not None else [min(WINDOW, len(h))]
        if not len(h) or not own:
            continue
        plain = np.concatenate(([0], np.cumsum(kind == PLAIN)))
        begin = np.searchsorted(owner, np.arange(len(texts)))
        for length, values in windows(h, own, reading):
            if bits is None:
                starts = np.arange(len(values))
            else:
                spot = values & np.uint64(FILTER_BITS - 1)
                starts = np.flatnonzero((bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                starts = starts[owner[starts] == owner[starts + (length - 1)]]
            literals = plain[starts + length] - plain[starts]
            strong = literals >= min(LITERAL, length)
            used = strong | ((literals >= WEAK) & (bits is not None or len(h) >= SHORTEST))
            every, n = len(values), int(strong.sum())
            starts, strong = starts[used], strong[used]
            for start, value, sound in zip(starts.tolist(), values[starts].view(np.int64).tolist(), strong.tolist(), strict=True):
                of = int(owner[start])
                yield ids[of], reading, length, value, start - int(begin[of]), n, every, sound, slots(start, length, kind, kept, split, int(stops[of]))


def _windows(df: DataFrame, name: str, text: str, lengths: list[int] | None, bits) -> DataFrame:
    kind = df.schema[name].dataType.simpleString()
    arrow = pa.schema([("id", pa.string() if kind == "string" else pa.int64()), ("reading", pa.int32()), ("length", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("every", pa.int32()), ("strong", pa.bool_()), ("slots", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, filtered = Canonical(), None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # An item's windows follow its own length, so items are read one by one; documents together.
            step = TOGETHER if bits is not None else 1
            parts = [(ids[a : a + step], texts[a : a + step]) for a in range(0, len(ids), step)]
            rows = [row for part in parts for row in _rows(*part, lengths, filtered, canonical)]
            del ids, texts, parts
            trim()
            if rows:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    id_kind = "string" if kind == "string" else "bigint"
    some = df.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").cast(id_kind).alias("id"), F.col(f"`{text}`").alias("text"))
    return some.mapInArrow(run, f"id {id_kind}, reading int, length int, h bigint, at int, windows int, every int, strong boolean, slots array<string>")


def _filter(items: DataFrame) -> tuple[bytes, list[int]]:
    """The filter over the items' window hashes, and the lengths of their windows (at most WINDOW of them)."""
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    spot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))
    # At most FILTER_BITS / 64 rows, some 8 MB.
    words = items.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, "<i8")
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.tobytes(), lengths


def _longest(places: Column) -> Column:
    """Of distinct places: the most that follow each other."""
    order = F.array_sort(places)
    step = lambda a, x: F.struct(x.alias("at"), F.when(x - a["at"] == 1, a["row"] + 1).otherwise(1).alias("row"), F.greatest(a["most"], F.when(x - a["at"] == 1, a["row"] + 1).otherwise(1)).alias("most"))
    return F.aggregate(order, F.struct(F.lit(-2).alias("at"), F.lit(0).alias("row"), F.lit(0).alias("most")), step)["most"]


def _met(found: DataFrame, known: DataFrame) -> DataFrame:
    """Windows of documents with the equal ones of items, without bringing up all items of a common window."""
    key = ["reading", "length", "h"]
    often = known.groupBy(*key).agg(F.count_distinct("item_id").alias("items")).where(F.col("items") > COMMON).select(*key, F.lit(True).alias("common"))
    rated = settled(known.join(often, key, "left").withColumn("common", F.coalesce("common", F.lit(False))))
    if not rated.where("common").limit(1).count():
        return found.join(known, key)
    in_common = F.filter(F.collect_set(F.when(F.col("common"), F.col("item_at"))), lambda x: x.isNotNull())
    whole = (F.max("every") == F.size(F.collect_set("item_at"))) & (F.max("every") > F.max("n"))
    alone = (2 * F.size(in_common) >= F.max("n")) | (_longest(in_common) > RUN - WINDOW) | whole
    kinds = rated.groupBy("item_id", "reading").agg(alone.alias("alone"), F.max("common").alias("some"))
    marked = settled(rated.join(kinds, ["item_id", "reading"]))
    first = settled(found.join(marked.where("alone or not common").drop("alone", "common"), key))
    brought = first.where("some").select("id", "item_id", "reading").distinct()
    rest = brought.join(marked.where("common and not alone").drop("alone", "common", "some"), ["item_id", "reading"])
    second = found.join(rest, ["id", *key])
    names = [c for c in first.columns if c != "some"]
    return first.select(*names).unionByName(second.select(*names))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, windows, matched, caught) for each document that holds an item."""
    items = settled(_windows(benchmark, item_id, item_text, None, None))
    data, lengths = _filter(items)
    bits = docs.sparkSession.sparkContext.broadcast(data)
    found = settled(_windows(docs, doc_id, text, lengths, bits).select("id", "reading", "length", "h", "at", "slots"))
    known = items.select(F.col("id").alias("item_id"), "reading", "length", "h", F.col("at").alias("item_at"), F.col("windows").alias("n"), "every", "strong", F.col("slots").alias("item_slots"))
    zipped = F.transform(F.arrays_zip("item_slots", "slots"), lambda s: F.struct(s["item_slots"].alias("a"), s["slots"].alias("b")))
    pairs = _met(found, known).select(F.col("id").alias("doc_id"), "item_id", "reading", "n", "every", "strong", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", zipped.alias("slots"))
    # Matches at one offset are one copy of the item; its slots must agree among themselves.
    copies = pairs.groupBy("doc_id", "item_id", "reading", "n", "every", "offset").agg(
        F.collect_set(F.struct("item_at", F.forall("slots", lambda s: s["a"] == s["b"]).alias("same"), "strong")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    one_value = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    ats = lambda w: F.array_distinct(F.transform(w, lambda x: x["item_at"]))
    strong, alike = F.filter("windows", lambda w: w["strong"]), lambda w: F.filter(w, lambda x: x["same"])
    # RUN words in a row are RUN - WINDOW + 1 windows in a row; a whole template is all windows, the weak ones too.
    row = lambda w: _longest(ats(w)) > RUN - WINDOW
    all_of = lambda w: (F.size(ats(w)) == F.col("every")) & (F.col("every") > F.col("n"))
    copies = copies.withColumns({"strong": strong, "fits": one_value})
    copies = copies.withColumns({"same_run": row(alike(F.col("strong"))) | all_of(alike(F.col("windows"))), "run": F.col("fits") & (row(F.col("strong")) | all_of(F.col("windows")))})
    places = copies.select("doc_id", "item_id", "reading", "n", "fits", "same_run", (F.col("same_run") | F.col("run")).alias("run"), F.explode_outer("strong").alias("w"))
    each = places.groupBy("doc_id", "item_id", "reading", "n", "w.item_at").agg(F.max("w.same").alias("same"), F.max(F.col("w.same") | F.col("fits")).alias("fits"), F.max("same_run").alias("same_run"), F.max("run").alias("run"))
    there = F.col("item_at").isNotNull()
    counted = each.groupBy("doc_id", "item_id", "reading", F.col("n").cast("bigint").alias("windows")).agg(F.count_if(there & F.col("same")).alias("same"), F.count_if(there & F.col("fits")).alias("matched"), F.max("same_run").alias("same_run"), F.max("run").alias("run"))
    enough = lambda c: (F.col(c) >= F.col("windows") * covered) & (F.col("windows") > 0)
    counted = counted.where(enough("matched") | F.col("run"))
    # Of the readings that find a pair, the first is reported.
    first = counted.groupBy("doc_id", "item_id").agg(
        F.min_by(F.struct("windows", "matched"), "reading").alias("first"),
        F.max(enough("same") | F.col("same_run")).alias("exact"),
    )
    return first.select("doc_id", "item_id", "first.windows", "first.matched", F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("caught"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", stable: bool = False) -> DataFrame:
    """docs without the rows that hold an item, whatever their ids. stable says that docs come from files, so that they are read alike twice; others are written first."""
    row = f"_row_{uuid.uuid4().hex[:8]}"
    numbered = (docs if stable else settled(docs, "zstd")).withColumn(row, F.monotonically_increasing_id())
    found = contaminated(numbered, benchmark, row, text, item_id, item_text).select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(found, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
