"""Chat formatting: heterogeneous layouts to canonical turns, turns to one template and back.

A record's layout is known by its fingerprint, the hash of its sorted nested field
paths. A fingerprint selects a declarative mapping: one of MAPPINGS whose required paths
the record has, the one with most of them. Canonical turns are rows (conv_id, turn,
role, text).

The template writes a turn as ``### role: text</turn>`` and a line end. Inside roles and
texts a backslash, ``###`` and ``</turn>`` are escaped, each to a backslash and a letter,
so any text comes back as it was and none can open or close a turn. The loss mask covers
the escaped text of each assistant turn.

Turns are formatted where they are. To be written, the turns of TURNS numbers in a row are sorted
and joined into segments of some SEGMENT characters, so a conversation of any length is dealt over
tasks and takes bounded memory, but for its longest turn. A digest of it is one of a sequence, and so one task's.

Defined cases: a null text or role is an empty one; a conversation without turns has no
row; turns with equal numbers are ordered by role and text, and repeated rows stay;
empty tables give an empty result; only the mapped fields are read, so other columns
cannot clash. A record that no mapping fits, or that has something else than an object in its list of messages, gives no
turns; unmapped() lists it. Of mappings that fit and need equally many paths the alphabetically last is taken.
A missing, null or empty field of a turn is left out; 0 and false are text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 1 << 16
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
PLAIN = {code: text for text, code in ROLE_ESCAPES}
END = "</turn>\n"
#: Turn numbers that one task formats in a row.
TURNS = 256

#: Layouts: paths that a record must have, and the turns that it has, as (role, path) or as a list of messages.
MAPPINGS = {
    "rows": {"needs": ("conv_id", "turn", "role", "text"), "row": True},
    "messages": {"needs": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    "conversations": {"needs": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "instruction-input": {"needs": ("instruction", "input", "output"), "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction": {"needs": ("instruction", "output"), "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction-response": {"needs": ("instruction", "response"), "turns": (("user", ("instruction", "context")), ("assistant", ("response",)))},
    "system-prompt": {"needs": ("system", "prompt", "response"), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "prompt-response": {"needs": ("prompt", "response"), "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "prompt-completion": {"needs": ("prompt", "completion"), "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "question-answer": {"needs": ("question", "answer"), "turns": (("user", ("question",)), ("assistant", ("answer",)))},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, with [] for the items of a list."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(paths(v, f"{at}[]") for v in value))
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """paths() of a Spark schema."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


class Registry:
    """Mappings by fingerprint; a new fingerprint is resolved once."""

    def __init__(self, mappings: dict[str, dict]):
        self.mappings = mappings
        self.known = {fingerprint(set(m["needs"])): name for name, m in mappings.items()}

    def select(self, found: set[str]) -> str | None:
        key = fingerprint(found)
        if key not in self.known:
            fit = [(len(m["needs"]), name) for name, m in self.mappings.items() if set(m["needs"]) <= found]
            self.known[key] = max(fit, default=(0, None))[1]
        return self.known[key]

    def turns(self, record: object) -> list[tuple[str, str]] | None:
        """(role, text) of each turn; None if no mapping fits."""
        name = self.select(paths(record))
        if name is None:
            return None
        mapping = self.mappings[name]
        if "list" in mapping:
            field, role, text = mapping["list"]
            if not all(isinstance(m, dict) for m in record[field]):
                return None
            found = [(m.get(role), m.get(text)) for m in record[field]]
        elif "row" in mapping:
            found = [(record["role"], record["text"])]
        else:
            found = [(role, "\n\n".join(_text(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in mapping["turns"]]
        return [(ROLES.get(r := str(role or ""), r), _text(text)) for role, text in found]


def from_records(records: DataFrame, conv_id: str = "conv_id", record: str = "record", mappings: dict[str, dict] | None = None) -> DataFrame:
    """Canonical turns of JSON records, each of any layout that the mappings know."""
    parsed = _parsed(records, conv_id, record, mappings)
    return parsed.where("turns is not null").select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")


def unmapped(records: DataFrame, conv_id: str = "conv_id", record: str = "record", mappings: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, fingerprint) of the records that no mapping fits; the fingerprint is null for what is no JSON."""
    return _parsed(records, conv_id, record, mappings).where("turns is null").select("conv_id", "fingerprint")


def _parsed(records: DataFrame, conv_id: str, record: str, mappings: dict[str, dict] | None) -> DataFrame:
    kind = pa.struct([("fingerprint", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def run(values: pa.Array) -> pa.Array:
        registry, rows = Registry(mappings or MAPPINGS), []
        for value in values.to_pylist():
            try:
                parsed = json.loads(value or "")
            except ValueError:
                rows.append({"fingerprint": None, "turns": None})
                continue
            turns = registry.turns(parsed)
            rows.append({"fingerprint": fingerprint(paths(parsed)), "turns": turns if turns is None else [{"role": r, "text": t} for r, t in turns]})
        return pa.array(rows, kind)

    made = F.arrow_udf(run, "struct<fingerprint: string, turns: array<struct<role: string, text: string>>>")(F.col(f"`{record}`"))
    return records.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), made.alias("m")).select("conv_id", "m.*")


def from_rows(rows: DataFrame) -> DataFrame:
    """Canonical turns of a table with a row for each turn; its schema's fingerprint must select such a mapping."""
    found = schema_paths(rows.schema)
    name = Registry(MAPPINGS).select(found)
    if name is None or "row" not in MAPPINGS[name]:
        raise ValueError(f"no row mapping for the layout {fingerprint(found)}: {sorted(found)}")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _escaped(text: Column, escapes: tuple) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\[bhtcn]", lambda m: PLAIN[m[0]], text)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, part, segment, text, loss): loss has the [start, end) of each masked stretch in the segment's text. Parts and their segments are in order."""
    head = F.concat(F.lit("### "), _escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = _escaped(F.col("text"), ESCAPES)
    part = F.coalesce(F.floor(F.col("turn") / TURNS).cast("bigint"), F.lit(-(1 << 62)))
    pieces = turns.select("conv_id", part.alias("part"), "turn", "role", "text", F.length(head).alias("start"), F.concat(head, body, F.lit("</turn>\n")).alias("piece"))
    dealt = pieces.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "role", "start", "piece")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, held, chars, loss = (None, None), 0, [], 0, []

        def closed() -> pa.RecordBatch:
            return pa.record_batch({"conv_id": pa.array(now[:1], pa.int64()), "part": pa.array(now[1:], pa.int64()), "segment": pa.array([segment], pa.int64()), "text": pa.array(["".join(held)], pa.string()), "loss": pa.array([loss], pa.list_(span))})

        for batch in batches:
            for conv, part, role, start, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "start", "piece")), strict=True):
                own = (conv, part)
                if held and (own != now or chars >= SEGMENT):
                    yield closed()
                    segment, held, chars, loss = segment + 1, [], 0, []
                if own != now:
                    now, segment = own, 0
                if role == "assistant":
                    loss.append({"start": chars + start, "end": chars + len(piece) - len("</turn>\n")})
                held.append(piece)
                chars += len(piece)
        if held:
            yield closed()

    return dealt.mapInArrow(join, "conv_id bigint, part bigint, segment bigint, text string, loss array<struct<start: bigint, end: bigint>>")


def digests(segments: DataFrame) -> DataFrame:
    """What the written segments hold, parsed and unescaped: numbers and digests of turns and masked text."""
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if state and conv != now:
                    yield _digest_row(now, state)
                    state = None
                now, state = conv, state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(text):
                    head, end = text.find(": ", at), text.find(END, at)
                    if not text.startswith("### ", at) or not at < head < end:
                        raise ValueError(f"conversation {conv}: text outside its turns, or a turn that does not end")
                    state[0] += 1
                    state[1].update(f"{unescaped(text[at + 4 : head])}\n{unescaped(text[head + 2 : end])}\n".encode())
                    at = end + len(END)
                for span in loss:
                    masked = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
        if state:
            yield _digest_row(now, state)

    return dealt.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest_row(conv: int | None, state: list) -> pa.RecordBatch:
    turns, turn_hash, chars, loss_hash, total = state
    return pa.record_batch({"conv_id": pa.array([conv], pa.int64()), "n_turns": [turns], "turns_sha256": [turn_hash.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss_hash.hexdigest()], "formatted_chars": [total]})


def records_of(spark: SparkSession, records: list[tuple[int, object]]) -> DataFrame:
    """A table for from_records() of a few (conv_id, JSON value)."""
    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in records], "conv_id bigint, record string")
