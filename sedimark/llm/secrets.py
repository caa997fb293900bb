"""Secret scans: pattern spans, and random strings that a tokenizer's vocabulary exposes.

A vocabulary holds the pieces that are frequent in text and code, so ordinary
strings need few tokens and random ones many: a candidate run whose characters per
token fall below a threshold is reported, or the stretches of it that do, unless it is a known kind of digest or
identifier: a name is one of words that the vocabulary knows. Runs of LEAST characters are candidates, and those
of LEAST_MIXED that have small and capital letters and digits. Spans are in code points, end exclusive.

Defined cases: a null text is an empty one; a text of any length is scanned whole;
repeated rows each get their own result; an empty table gives an empty table; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from sedimark.llm.common import with_columns

#: Order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "ratio")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")

#: Runs that may be random strings, and what is left out of them.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z|(?:sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*)\Z", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.IGNORECASE)
#: Words and numbers between separators; words in camel case.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[/_=+-]+)+\Z")
#: A label and a number: dates, ISBNs, article and account numbers.
NUMBERED = re.compile(r"([A-Za-z]*)[-_/+=]*[0-9][0-9_/-]*[A-Za-z]?\Z")
#: What separators leave of a run; characters of the least candidate, of the least one of three kinds of characters, and of the
#: least word that the vocabulary must know; tokens of a window within a piece.
PIECE = re.compile(r"[A-Za-z0-9]+")
LEAST, LEAST_MIXED, LEAST_WORD, TOKENS = 16, 10, 4, 10
SEGMENTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

SCHEMA = "n_assign:bigint,n_access:bigint,n_hex:bigint,n_ratio:bigint,base_sha256:string,spans:string"


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def low(run: str, chars_per_token: float, vocabulary: str) -> bool:
    return len(run) < chars_per_token * len(encoding(vocabulary).encode_ordinary(run))


def mixed(run: str) -> bool:
    return any(map(str.islower, run)) and any(map(str.isupper, run)) and any(map(str.isdigit, run))


def _form(run: str, chars_per_token: float, vocabulary: str) -> bool:
    """Digests, UUIDs, and numbers with or without a label."""
    if DIGEST.match(run) or UUID.match(run):
        return True
    numbered = NUMBERED.match(run)
    return bool(numbered) and (len(numbered[1]) < LEAST_WORD or not low(numbered[1], chars_per_token, vocabulary))


def known(run: str, chars_per_token: float, vocabulary: str) -> bool:
    """Digests, UUIDs, labelled numbers, and names made of words: their kind says that they are no secrets."""
    if _form(run, chars_per_token, vocabulary):
        return True
    parts = SEGMENTS.findall(run)
    # In a name, words are long for the number of places where letters, cases and digits meet, and the vocabulary knows them.
    name = len(parts) > 1 and bool(IDENTIFIER.match(run)) and len(run) >= 4 * len(parts)
    return name and not any(len(p) >= LEAST_WORD and not p.isdigit() and low(p, chars_per_token, vocabulary) for p in parts)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(w in low for w in WORDS) else [],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def stretches(run: str, chars_per_token: float, vocabulary: str) -> Iterator[tuple[int, int]]:
    """Parts of a run that are below the ratio: pieces between separators, in a row, or within a piece windows of tokens."""
    pieces = [m.span() for m in PIECE.finditer(run)]
    below = [not run[a:b].isdigit() and low(run[a:b], chars_per_token, vocabulary) for a, b in pieces]
    at = 0
    while at < len(pieces):
        start, end = pieces[at]
        if below[at]:
            while at + 1 < len(pieces) and below[at + 1]:
                at += 1
            end = pieces[at][1]
            yield start, end
        elif end - start > LEAST:
            tokens = encoding(vocabulary).encode_ordinary(run[start:end])
            ends = [0]
            for token in tokens:
                ends.append(ends[-1] + len(encoding(vocabulary).decode_single_token_bytes(token)))
            first = last = None
            for i in range(len(tokens) - TOKENS + 1):
                if ends[i + TOKENS] - ends[i] < chars_per_token * TOKENS:
                    if last is not None and i > last:
                        yield start + ends[first], start + ends[last]
                        first = None
                    first, last = i if first is None else first, i + TOKENS
            if last is not None:
                yield start + ends[first], start + ends[last]
        at += 1


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def random_spans(text: str, taken: list[tuple[int, int]], chars_per_token: float, vocabulary: str) -> Iterator[tuple[int, int]]:
    """Runs below the ratio, or else their parts that are, that meet no span already taken."""
    starts, ends = merged(taken)
    for m in RUN.finditer(text):
        run, offset = m[0], m.start()
        if len(run) < LEAST and not mixed(run) or _form(run, chars_per_token, vocabulary):
            continue
        whole = not known(run, chars_per_token, vocabulary) and low(run, chars_per_token, vocabulary)
        for a, b in [(0, len(run))] if whole else stretches(run, chars_per_token, vocabulary):
            start, end = offset + a, offset + b
            at = bisect_left(starts, end)
            if (b - a >= LEAST or whole) and (whole or not known(run[a:b], chars_per_token, vocabulary)) and (at == 0 or ends[at - 1] <= start):
                yield start, end


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    order = sorted((s, KINDS.index(k), e) for k, found in spans.items() for s, e in found)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in order)


def scan(text: str | None, chars_per_token: float, vocabulary: str) -> dict[str, list[tuple[int, int]]]:
    spans = base_spans(text or "")
    taken = [s for found in spans.values() for s in found]
    return spans | {"ratio": list(random_spans(text or "", taken, chars_per_token, vocabulary))}


def redacted(text: str, spans: Iterable[tuple[int, int]], mark: str) -> str:
    """The text with each stretch of touching spans replaced by the mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, vocabulary: str, text: str = "text", chars_per_token: float = 2.0) -> DataFrame:
    """docs with the counts, digest and list of the secrets in each whole text."""

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        for value in texts:
            spans = scan(value, chars_per_token, vocabulary)
            base = listed({k: v for k, v in spans.items() if k != "ratio"})
            yield (*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(spans))

    return with_columns(docs, rows, SCHEMA, text)


def redact_secrets(docs: DataFrame, vocabulary: str, text: str = "text", chars_per_token: float = 2.0, mark: str = "<SECRET>") -> DataFrame:
    """docs whose texts have the mark in place of each secret; a null text stays null. Columns keep their names, order and types."""

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        for value in texts:
            yield (value if value is None else redacted(value, [s for found in scan(value, chars_per_token, vocabulary).values() for s in found], mark),)

    return with_columns(docs, rows, f"{text}:string", text).select(*(f"`{c}`" for c in docs.columns))
