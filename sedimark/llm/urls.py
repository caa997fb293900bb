"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is (verdict, host, path prefix). It fits its host and every subdomain, on URLs
whose path starts with the rule's. Among the rules that fit, the one with the longest
``host + path`` wins; among equal ones the longer host, and then block over allow. A
URL that no rule fits gets the default verdict.

The rules are broadcast, and each worker makes the trie of them once, up to MAX_BROADCAST_RULES
rules of MAX_BROADCAST_BYTES together; beyond either the same matches come from an equi-join of the rules with the host
suffixes and path prefixes that their lengths allow, which shuffles the rules too. Rules are a list or a table.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets
the default verdict; URLs of any length are read whole; repeated rows and repeated rules change nothing; rules with a null field are left out;
an empty table gives an empty table, and no rules the default verdict; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import with_columns

Rule = tuple[str, str, str]

#: Largest rule table that is sent to every executor: some 30 MB as a trie.
MAX_BROADCAST_RULES, MAX_BROADCAST_BYTES = 100_000, 8 << 20

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class Node:
    """One host label or one path segment."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: Rules whose path ends within the segment after this node: (prefix, rule).
    ends: list[tuple[str, Rule]] = field(default_factory=list)


def trie(rules: Iterable[Rule]) -> Node:
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.ends.append((last, (verdict, host, path)))
    return root


def rank(rule: Rule) -> tuple:
    return len(rule[1]) + len(rule[2]), len(rule[1]), rule[0] == "block"


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(LOWER), slash + path


def best(root: Node, host: str, path: str) -> Rule | None:
    """The longest rule that fits: down the labels, and from each node down the segments."""
    found: Rule | None = None
    segments, node = path.split("/"), root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        below = node
        for segment in segments:
            for prefix, rule in below.ends:
                if segment.startswith(prefix) and (found is None or rank(rule) > rank(found)):
                    found = rule
            below = below.segments.get(segment)
            if below is None:
                break
    return found


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; rules are (verdict, host, path)."""
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path").dropna()
        size = F.octet_length("verdict") + F.octet_length("host") + F.octet_length("path")
        n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if n > MAX_BROADCAST_RULES or total > MAX_BROADCAST_BYTES:
            return judge_urls_by_join(pages, table, url, default)
        rules = [tuple(r) for r in table.collect()]
    elif len(rules) > MAX_BROADCAST_RULES or sum(len("".join(r)) for r in rules) > MAX_BROADCAST_BYTES:
        return judge_urls_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), url, default)
    sent = spark.sparkContext.broadcast(rules)
    made: list[Node] = []

    def rows(urls: list[str | None]) -> Iterator[tuple]:
        if not made:
            made.append(trie(sent.value))
        for value in urls:
            host, path = parts(value)
            rule = best(made[0], host, path) if host else None
            yield (host, path, None, default) if rule is None else (host, path, rule[1] + rule[2], rule[0])

    return with_columns(pages, rows, "host:string,path:string,rule:string,verdict:string", url)


def url_parts(url: Column) -> tuple[Column, Column]:
    """parts() as column expressions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)\A[^?#]*", 0)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)/.*\z", 0), F.lit(""))


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls() for rule tables of any size.

    Distinct (host, path) pairs are joined, so a hot host costs its distinct paths once;
    each brings a row for each host suffix and path prefix that ends where a rule's may.
    """
    made = ("host", "path", "rule", "verdict")
    host, path = url_parts(F.col(f"`{url}`"))
    key = f"_row_{uuid.uuid4().hex[:8]}"
    keep = [c for c in pages.columns if c not in made]
    split = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"))
    urls = split.select("host", "path").distinct()
    # As many numbers as rule paths have lengths.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    tries = (
        urls.where("host <> ''").withColumn("lengths", F.array(*map(F.lit, lengths)).cast("array<int>"))
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")))
    )
    fit = tries.select("host", "path", "suffix", "prefix").join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict"), ["suffix", "prefix"])
    order = F.struct(F.length("suffix") + F.length("prefix"), F.length("suffix"), F.col("verdict") == "block")
    won = fit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), order).alias(key))
    joined = split.join(won, ["host", "path"], "left")
    return joined.select(*(F.col(f"`{c}`") for c in keep), "host", "path", F.col(f"{key}.rule").alias("rule"), F.coalesce(F.col(f"{key}.verdict"), F.lit(default)).alias("verdict"))
