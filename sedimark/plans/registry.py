"""Queries of the blob engine over the driver's tables, and their SQL twins.

Documents, pages, benchmark items and conversations are blobs by their UTF-8 bytes;
events' properties are blobs below the smallest size that is parsed. Operators on bytes
that no table has run over small images made here.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import blobs as B
from sedimark.functions import guards, signing
from sedimark.functions import metadata as M
from sedimark.operators import firmware as W
from sedimark.operators import objects as O
from sedimark.operators import signatures as G
from sedimark.operators import sniff
from sedimark.plans import analysis as A
from sedimark.sources import blobs as S
from sedimark.sources import settings as C

Query = Callable[[SparkSession, str], DataFrame]

#: Tables with texts: table, key and text.
TEXTS = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "benchmark": ("item_id", "text")}


def blobs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """(file_name, content) of a table's texts; the name is the key and .txt."""
    key, text = TEXTS[table]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, text)
    return S.from_text(rows, F.concat(F.col(key).cast("string"), F.lit(".txt")), text)


def strings(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return blobs(spark, sf_dir, table).select("file_name", B.extract_strings(F.col("content")).alias("strings"))


# SQL over the same rows. X1 is the extraction of strings; its output is ASCII, where both engines' patterns agree.
def sql_blobs(table: str = "documents") -> str:
    key, text = TEXTS[table]
    return f"b AS (SELECT {key}::VARCHAR || '.txt' AS file_name, {text} AS t FROM {table} WHERE {text} IS NOT NULL)"


def sql_strings(table: str = "documents", rows: str | None = None) -> str:
    """CTEs b and s of a table's blobs, or of rows given as ``b AS (SELECT file_name, t ...)``."""
    runs = r"regexp_extract_all(t, '[\x20-\x7E\t]{3,}')"
    sound = r"len(x) <= 200 AND NOT regexp_matches(x, '^[ \t]+$') AND NOT regexp_matches(x, '^[!-/:-@\[-`{-~]+$')"
    return f"""{rows or sql_blobs(table)}, s AS (
    SELECT file_name, t, list_slice(list_sort(list_distinct(list_transform(list_filter({runs}, lambda x: {sound}), lambda x: trim(x, ' ' || chr(9))))), 1, 50) AS strings FROM b
)"""


def _strings_query(column: Callable[[], dict], sql: dict[str, str], table: str = "documents") -> tuple[Query, str]:
    """A query of columns over (file_name, strings), and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strings(spark, sf_dir, table).select("file_name", *(c.alias(n) for n, c in column().items()))

    return run, f"WITH {sql_strings(table)} SELECT file_name, " + ", ".join(f"{q} AS {n}" for n, q in sql.items()) + " FROM s"


def _blob_query(column: Callable[[], dict], sql: dict[str, str], table: str = "documents") -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return blobs(spark, sf_dir, table).select("file_name", *(c.alias(n) for n, c in column().items()))

    return run, f"WITH {sql_blobs(table)} SELECT file_name, " + ", ".join(f"{q} AS {n}" for n, q in sql.items()) + " FROM b"


def _joined(column) -> object:
    return F.array_join(column, "|")


FOUND: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, made: tuple[Query, str | None] | Query) -> None:
    FOUND[name] = made if isinstance(made, tuple) else (made, None)


CONTENT = lambda: F.col("content")

# Strings.
for _table in TEXTS:
    _add(
        f"strings_{_table}",
        (
            lambda spark, sf_dir, t=_table: strings(spark, sf_dir, t).select("file_name", F.posexplode("strings").alias("pos", "string")),
            f"WITH {sql_strings(_table)} SELECT file_name, (unnest(range(len(strings))))::INT AS pos, unnest(strings) AS string FROM s",
        ),
    )
_add("strings_counts", _strings_query(lambda: {"n_strings": F.size("strings").cast("bigint"), "first": F.get("strings", F.lit(0))}, {"n_strings": "len(strings)", "first": "strings[1]"}))

# Digests, ratios, entropy.
_add("blob_hashes", _blob_query(lambda: {"sha256": B.sha256(CONTENT()), "size_bytes": F.length("content").cast("bigint")}, {"sha256": "sha256(t)", "size_bytes": "strlen(t)"}))
_add("text_ratio", _blob_query(lambda: {"ratio": F.round(B.text_ratio(CONTENT()), 9)}, {"ratio": r"CASE WHEN strlen(t) = 0 THEN NULL ELSE round(len(regexp_replace(t, '[^\x21-\x7E \t\n\x0C\r]', '', 'g'))::DOUBLE / strlen(t), 9) END"}))
_HISTOGRAM = f"WITH {sql_blobs()}, h AS (SELECT file_name, unnest(range(0, strlen(t))) AS i, hex(encode(t)) AS x FROM b), c AS (SELECT file_name, ('0x' || x[2 * i + 1:2 * i + 2])::INT AS byte, count(*) AS n FROM h GROUP BY ALL)"
_add(
    "byte_histogram",
    (
        lambda spark, sf_dir: blobs(spark, sf_dir).select("file_name", F.posexplode(B.byte_histogram(CONTENT())).alias("byte", "n")).where("n > 0"),
        f"{_HISTOGRAM} SELECT file_name, byte, n FROM c",
    ),
)
_add(
    "byte_entropy",
    (
        lambda spark, sf_dir: blobs(spark, sf_dir).select("file_name", F.round(B.entropy(CONTENT()), 6).alias("entropy")),
        f"{_HISTOGRAM}, w AS (SELECT file_name, n / sum(n) OVER (PARTITION BY file_name) AS p FROM c), e AS (SELECT file_name, -sum(p * log2(p)) AS e FROM w GROUP BY file_name) SELECT b.file_name, round(greatest(coalesce(e, 0.0), 0.0), 6) AS entropy FROM b LEFT JOIN e USING (file_name)",
    ),
)
_add("blake3_hashes", lambda spark, sf_dir: blobs(spark, sf_dir).select("file_name", B.blake3(CONTENT()).alias("blake3")))

# Sniffing.
_LINES = "list_transform(string_split(t, chr(10))[1:5], lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))"
_IHEX = f"(len(list_filter({_LINES}, lambda s: starts_with(s, ':'))) > 0 AND len(list_filter({_LINES}, lambda s: NOT (s = '' OR starts_with(s, ':') OR regexp_matches(s, '^[0-9A-Fa-f:]+$')))) = 0)"
_SREC = f"(len(list_filter({_LINES}, lambda s: starts_with(s, 'S'))) > 0 AND len(list_filter({_LINES}, lambda s: NOT (s = '' OR regexp_matches(s, '^S[0-9A-Fa-f]{{3,}}$')))) = 0)"
_KIND = f"CASE WHEN strlen(t) < 50 THEN 'tiny' WHEN starts_with(t, 'BZh') OR starts_with(t, 'COMP') THEN 'compressed' WHEN starts_with(t, 'MZ') THEN 'pe' WHEN starts_with(t, '!<arch>' || chr(10)) THEN 'archive' WHEN {_IHEX} THEN 'intel-hex' WHEN {_SREC} THEN 'srec' ELSE 'raw' END"
_add("dispatch_kind", _blob_query(lambda: {"kind": sniff.kind(CONTENT())}, {"kind": _KIND}))
_add("mime_fallback", _blob_query(lambda: {"mime": sniff.fallback_mime(F.regexp_replace("file_name", "([05])[.]txt$", "$1.dll"), CONTENT())}, {"mime": "CASE WHEN starts_with(t, 'MZ') THEN 'application/x-msdownload' WHEN regexp_matches(file_name, '[05][.]txt$') THEN 'application/x-msdownload' ELSE 'application/octet-stream' END"}))
_add("mime_sniff", _blob_query(lambda: {"mime": sniff.mime(F.col("file_name"), CONTENT())}, {"mime": r"CASE WHEN starts_with(t, '#!') THEN 'text/x-shellscript' WHEN regexp_matches(upper(ltrim(t)), '^<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--)[ >]') THEN 'text/html' ELSE 'application/octet-stream' END"}, "pages"))


def tiny_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as blobs that are too small to be parsed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    blob = F.encode(F.coalesce("props", F.lit("")), "UTF-8")
    return events.select("event_id", W.small_format(blob).alias("format"), F.array_join(W.small_languages(blob), "|").alias("languages"), F.length(blob).cast("bigint").alias("size"))


_add(
    "small_formats",
    (
        tiny_blobs,
        r"""WITH p AS (SELECT event_id, coalesce(props, '') AS t FROM events), q AS (SELECT *, CASE WHEN strlen(t) = 0 THEN NULL ELSE len(regexp_replace(t, '[^\x21-\x7E \t\n\x0C\r]', '', 'g'))::DOUBLE / strlen(t) END AS r FROM p)
SELECT event_id, CASE WHEN coalesce(r > 0.8, false) THEN CASE WHEN starts_with(t, '#!') THEN 'script' ELSE 'text/small' END WHEN regexp_matches(lower(t), 'u-boot|grub|boot|loader|spl|mlo') THEN 'firmware-blob' ELSE 'micro-binary' END AS format,
CASE WHEN coalesce(r > 0.8, false) THEN array_to_string(list_filter([CASE WHEN starts_with(t, '#!') THEN 'script' END, CASE WHEN contains(t, 'function') OR contains(t, 'def ') THEN 'script' END, CASE WHEN contains(t, '#include') OR contains(t, 'int main') THEN 'C/C++' END, CASE WHEN contains(t, 'pub fn') OR contains(t, 'fn main') THEN 'Rust' END], lambda x: x IS NOT NULL), '|') WHEN regexp_matches(lower(t), 'u-boot|grub|boot|loader|spl|mlo') THEN 'Firmware' ELSE '' END AS languages, strlen(t) AS size FROM q""",
    ),
)

# Versions and licences.
_VALID = "len(v) BETWEEN 3 AND 20 AND contains(v, '.') AND len(string_split(v, '.')) <= 5 AND len(list_filter(string_split(v, '.'), lambda p: regexp_matches(p, '^[0-9]+$') AND coalesce(try_cast(p AS HUGEINT) BETWEEN 10000 AND 4294967295, false))) = 0"
_VERSIONS = "list_sort(list_distinct(list_filter(flatten([" + ", ".join(f"flatten(list_transform(strings, lambda s: regexp_extract_all(s, '{p}', 1)))" for p in M.VERSION_PATTERNS) + f"]), lambda v: {_VALID})))"
_BEST = f"(list_sort(list_transform({_VERSIONS}, lambda v: {{'d': len(v) - len(replace(v, '.', '')), 'v': v}}), 'DESC'))[1].v"
_add("version_strings", _strings_query(lambda: {"versions": _joined(M.version_strings(F.col("strings")))}, {"versions": f"array_to_string({_VERSIONS}, '|')"}))
_add("file_version", _strings_query(lambda: {"file_version": M.most_dotted(M.version_strings(F.col("strings")))}, {"file_version": _BEST}))


def version_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.with_version_info(strings(spark, sf_dir), "strings")
    return found.select("file_name", F.round("version_info.confidence", 9).alias("confidence"), "version_info.company", "version_info.product_name")


def _sql_name(patterns: tuple[str, ...]) -> str:
    tries = ", ".join(f"(CASE WHEN len(trim(regexp_extract(s, '{p}', 1))) BETWEEN 3 AND 99 THEN trim(regexp_extract(s, '{p}', 1)) END)" for p in patterns)
    return f"(list_filter(list_transform(strings, lambda s: coalesce({tries})), lambda x: x IS NOT NULL))[1]"


_add(
    "version_confidence",
    (
        version_confidences,
        f"WITH {sql_strings()}, v AS (SELECT file_name, strings, len({_VERSIONS}) AS n FROM s) SELECT file_name, round(CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN n = 1 THEN 1.0 ELSE 0.8 END, 9)::DOUBLE AS confidence, {_sql_name(M.COMPANY_PATTERNS)} AS company, {_sql_name(M.PRODUCT_PATTERNS)} AS product_name FROM v",
    ),
)
_NORMAL = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.LICENSE_NAMES.items()) + " ELSE lower(x) END"
_NAMED = "list_transform(flatten([" + ", ".join(f"flatten(list_transform(list_filter(strings, lambda s: len(s) >= 10), lambda s: regexp_extract_all(s, '{p}', 1)))" for p in M.LICENSE_PATTERNS) + f"]), lambda x: {_NORMAL})"
_TEXTS = "flatten(list_transform(list_filter(strings, lambda s: len(s) > 100), lambda s: list_filter([" + ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN s END" for p in M.LICENSE_TEXT_PATTERNS) + "], lambda x: x IS NOT NULL)))"
_INFER = "CASE WHEN contains(lower(x), 'permission is hereby granted') AND contains(lower(x), 'mit') THEN 'MIT' WHEN contains(lower(x), 'redistribution and use in source and binary forms') THEN 'BSD' WHEN contains(lower(x), 'apache license') THEN 'Apache-2.0' WHEN contains(lower(x), 'gnu general public license') THEN 'GPL' END"
_LICENSES = f"list_sort(list_distinct(list_filter(list_concat({_NAMED}, list_filter(list_transform({_TEXTS}, lambda x: {_INFER}), lambda x: x IS NOT NULL)), lambda x: x <> '')))"


def license_reports(table: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = "license_info"
        found = M.with_license_info(strings(spark, sf_dir, table), "strings")
        return found.select("file_name", _joined(f"{i}.licenses").alias("licenses"), _joined(f"{i}.spdx_identifiers").alias("spdx"), F.size(f"{i}.copyright_notices").cast("bigint").alias("notices"), F.size(f"{i}.license_texts").cast("bigint").alias("texts"), F.round(f"{i}.confidence", 9).alias("confidence"))

    long = "list_filter(strings, lambda s: len(s) >= 10)"
    spdx = f"list_sort(list_distinct(flatten(list_transform({long}, lambda s: regexp_extract_all(s, '{M.SPDX_PATTERN}', 1)))))"
    sql = f"""WITH {sql_strings(table)}, l AS (SELECT file_name, {_LICENSES} AS li, {spdx} AS sp, len(flatten(list_transform({long}, lambda s: regexp_extract_all(s, '{M.COPYRIGHT_PATTERN}')))) AS notices, len({_TEXTS}) AS texts FROM s)
SELECT file_name, array_to_string(li, '|') AS licenses, array_to_string(sp, '|') AS spdx, notices, texts, round((CASE WHEN len(sp) > 0 THEN 0.5 ELSE 0 END + CASE WHEN len(li) > 0 THEN 0.3 ELSE 0 END + CASE WHEN texts > 0 THEN 0.2 ELSE 0 END)::DOUBLE, 9) AS confidence FROM l"""
    return run, sql


_add("license_info_documents", license_reports("documents"))
_add("license_info_pages", license_reports("pages"))
_CPE_NAME = "CASE WHEN contains(lower(x), 'openssl') OR contains(lower(x), 'libcrypto') OR contains(lower(x), 'libssl') THEN 'cpe:2.3:a:openssl:openssl:' || coalesce(list_filter(string_split(x, '.'), lambda p: regexp_matches(p, '^[0-9]*$'))[1], '*') || ':*:*:*:*:*:*:*' END"
_LIBRARIES = ("libcrypto.1.1.dylib", "libssl.so.3", "zlib.1.dll", "libz.so.1", "libcurl.4.dylib", "curl", "OpenSSL", "libfoo.2.so", "a..b")


def library_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPE names and versions of library names, one by one."""
    names = spark.createDataFrame([(n,) for n in _LIBRARIES], "name string")
    return names.select("name", M.library_version(F.col("name")).alias("version"), _joined(M.cpe_candidates(F.array("name"))).alias("cpes"))


_VER = "list_filter(string_split(x, '.'), lambda p: regexp_matches(p, '^[0-9]*$'))[1]"
_add(
    "cpe_candidates",
    (
        library_names,
        f"WITH n(x) AS (VALUES {', '.join(f'({n!r})' for n in _LIBRARIES)}) SELECT x AS name, {_VER} AS version, coalesce({_CPE_NAME}, CASE WHEN contains(lower(x), 'zlib') AND {_VER} IS NOT NULL THEN 'cpe:2.3:a:zlib:zlib:' || {_VER} || ':*:*:*:*:*:*:*' WHEN contains(lower(x), 'curl') AND {_VER} IS NOT NULL THEN 'cpe:2.3:a:curl:curl:' || {_VER} || ':*:*:*:*:*:*:*' END, '') AS cpes FROM n",
    ),
)

# Signatures.
_sql_bytes = lambda table: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{v.decode()}') THEN '{k}' END" for k, v in table.items()) + "], lambda x: x IS NOT NULL), '|')"
_add("crypto_indicators", _blob_query(lambda: {"labels": _joined(G.byte_labels(CONTENT(), G.CRYPTO))}, {"labels": _sql_bytes(G.CRYPTO)}))
_add("device_indicators", _blob_query(lambda: {"labels": _joined(G.byte_labels(CONTENT(), G.DEVICES))}, {"labels": _sql_bytes(G.DEVICES)}))
_add("bootloader_indicator", _blob_query(lambda: {"bootloader": G.bootloader(CONTENT())}, {"bootloader": "regexp_matches(lower(t), 'u-boot|grub|boot|loader|spl|mlo')"}))
_add("manufacturers", _blob_query(lambda: {"labels": _joined(G.manufacturers(CONTENT()))}, {"labels": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){v}') THEN '{k}' END" for k, v in G.MANUFACTURERS.items()) + "], lambda x: x IS NOT NULL), '|')"}))
_add("version_hints", _strings_query(lambda: {"hints": _joined(G.version_hints(F.col("strings")))}, {"hints": "array_to_string(list_filter(strings, lambda s: len(s) BETWEEN 3 AND 19 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[.vV]')), '|')"}))
_HINTS = "CASE WHEN strlen(t) < 4 THEN [] ELSE list_filter([" + ", ".join(f"CASE WHEN regexp_matches(hex(encode(t)), '^(..)*({p})') THEN '{n}' END" for n, p in (("ARM Thumb", "00BF|7047|0868"), ("x86", "5589E5|4889E5|EBFE"), ("MIPS", "27BD....|....BD27"), ("PowerPC", "9421....|....2194"))) + "], lambda x: x IS NOT NULL) END"
_add("architecture_hints", _blob_query(lambda: {"labels": _joined(G.architecture_hints(CONTENT()))}, {"labels": f"array_to_string({_HINTS}, '|')"}))


def _sql_set(table: G.Table) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{n}')" for n in needles) + f" THEN '{label}' END" for label, needles in sorted(table))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|')"


def _label_query(table: G.Table) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strings(spark, sf_dir, "pages").select("file_name", _joined(G.label_set(F.col("strings"), table)).alias("labels"))

    return run, f"WITH {sql_strings('pages')}, l AS (SELECT file_name, lower(array_to_string(strings, chr(10))) AS low FROM s) SELECT file_name, {_sql_set(table)} AS labels FROM l"


for _name, _labels in {"rtos": G.RTOS, "compliance": G.COMPLIANCE, "medical_protocols": G.PROTOCOLS, "medical_components": G.COMPONENTS, "security_features": G.SECURITY}.items():
    _add(f"labels_{_name}", _label_query(_labels))


def _hint_query(table: G.Table, architectures: dict[str, str]) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hinted = strings(spark, sf_dir).withColumn("h", G.string_labels(F.col("strings"), table))
        return hinted.select("file_name", _joined("h").alias("hints"), G.last_architecture(F.col("h"), architectures, "embedded").alias("architecture"))

    cases = []
    for label, needles in table:
        test = " OR ".join(f"contains(lower(s), '{n}')" for n in needles)
        test = f"({test}) AND (contains(s, '16') OR contains(s, '18'))" if label == "pic_microcontroller" else test
        cases.append(f"CASE WHEN {test} THEN '{label}' END")
    known = ", ".join(f"'{a}'" for a in architectures)
    names = " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in architectures.items())
    return run, f"""WITH {sql_strings()}, h AS (SELECT file_name, flatten(list_transform(strings, lambda s: list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))) AS h FROM s)
SELECT file_name, array_to_string(h, '|') AS hints, coalesce(CASE (list_filter(h, lambda x: x IN ({known})))[-1] {names} END, 'embedded') AS architecture FROM h"""


_add("intel_hex_hints", _hint_query(G.INTEL_HEX, G.INTEL_HEX_ARCHITECTURES))
_add("srec_hints", _hint_query(G.SREC, G.SREC_ARCHITECTURES))


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = blobs(spark, sf_dir).withColumn("strings", B.extract_strings(CONTENT()))
    r = W.with_raw_report(named, F.col("strings"))
    return r.select("file_name", F.round("r.entropy", 6).alias("entropy"), "r.likely_encrypted", "r.likely_compressed", "r.static_linked", "r.architecture", "r.firmware_confidence", "r.format_confidence", _joined("r.firmware_indicators").alias("indicators"))


_RATIO = r"CASE WHEN strlen(t) = 0 THEN NULL ELSE len(regexp_replace(t, '[^\x21-\x7E \t\n\x0C\r]', '', 'g'))::DOUBLE / strlen(t) END"
_FIRMWARE = "list_filter([CASE WHEN regexp_matches(lower(t), 'u-boot|grub|boot|loader|spl|mlo') THEN 'bootloader' END, " + ", ".join(f"CASE WHEN contains(t, '{v.decode()}') THEN '{k}' END" for k, v in G.DEVICES.items()) + "], lambda x: x IS NOT NULL)"
_add(
    "raw_reports",
    (
        raw_reports,
        f"""{_HISTOGRAM}, w AS (SELECT file_name, n / sum(n) OVER (PARTITION BY file_name) AS p FROM c), e AS (SELECT file_name, -sum(p * log2(p)) AS e FROM w GROUP BY file_name),
r AS (SELECT file_name, t, greatest(coalesce(e, 0.0), 0.0) AS bits, {_RATIO} AS ratio, {_FIRMWARE} AS found, {_HINTS} AS hints FROM b LEFT JOIN e USING (file_name))
SELECT file_name, round(bits, 6) AS entropy, bits > 7.5 AS likely_encrypted, bits > 7.0 AND NOT (strlen(t) >= 4 AND starts_with(t, 'BZh')) AS likely_compressed, len(found) > 0 OR coalesce(ratio < 0.1, false) AS static_linked, CASE WHEN len(hints) > 0 THEN array_to_string(hints, ', ') ELSE 'unknown' END AS architecture,
CASE WHEN len(found) > 0 THEN 'high' ELSE 'low' END AS firmware_confidence, CASE WHEN coalesce(ratio > 0.8, false) THEN 'high' WHEN len(found) > 0 THEN 'medium' ELSE 'low' END AS format_confidence, array_to_string(found, '|') AS indicators FROM r""",
    ),
)


# Firmware lines, made from documents: each document gives one image of a few records.
def hex_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intel HEX images: bases of both kinds, data, start, a wrong line, an end, and a record after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    record = lambda n, at, kind, data: F.concat(F.lit(":"), F.lpad(F.hex(F.lit(n)), 2, "0"), F.lpad(F.hex(at), 4, "0"), F.lit(f"{kind:02d}"), data, F.lit("00"))
    at = F.pmod(i * 37, F.lit(60_000))
    lines = F.array(
        record(2, F.lit(0), 4, F.lpad(F.hex(F.pmod(i, F.lit(4096))), 4, "0")), record(4, at, 0, F.lpad(F.hex(i), 8, "0")), F.lit(":04"),
        record(2, F.lit(0), 2, F.lpad(F.hex(F.pmod(i * 3, F.lit(4096))), 4, "0")), record(2, at + 4, 0, F.lit("4142")), record(4, F.lit(0), 5, F.lpad(F.hex(i + 7), 8, "0")), F.lit(":00000001FF"), record(1, at, 0, F.lit("FF")),
    )
    return docs.select(F.concat(i.cast("string"), F.lit(".hex")).alias("file_name"), F.encode(F.array_join(lines, "\r\n"), "UTF-8").alias("content"))


def ihex_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.ihex_summary(hex_images(spark, sf_dir))
    return s.select(F.col("key").alias("file_name"), "total_data_bytes", F.size("memory_segments").cast("bigint").alias("segments"), "memory_range.min_address", "memory_range.max_address", F.col("memory_range.span_bytes").alias("span_bytes"), "start_address", "entry_point", F.hex("data").alias("data"))


_add(
    "ihex_memory_range",
    (
        ihex_ranges,
        """WITH d AS (SELECT doc_id AS i, (doc_id * 37) % 60000 AS base FROM documents), a AS (SELECT i, (i % 4096) * 65536 + base AS one, (i % 4096) * 65536 + ((i * 3) % 4096) * 16 + base + 4 AS two FROM d)
SELECT i || '.hex' AS file_name, 6::BIGINT AS total_data_bytes, 2::BIGINT AS segments, printf('0x%08X', least(one, two)) AS min_address, printf('0x%08X', greatest(one + 4, two + 2)) AS max_address, greatest(one + 4, two + 2) - least(one, two) AS span_bytes, printf('0x%08X', i + 7) AS start_address, printf('0x%08X', i + 7) AS entry_point, printf('%08X', i) || '4142' AS data FROM a""",
    ),
)
_add(
    "ihex_segments",
    (
        lambda spark, sf_dir: W.ihex_records(hex_images(spark, sf_dir)).where("address is not null").select(F.col("key").alias("file_name"), "address", "size"),
        """WITH d AS (SELECT doc_id AS i, (doc_id * 37) % 60000 AS base FROM documents)
SELECT i || '.hex' AS file_name, (i % 4096) * 65536 + base AS address, 4::BIGINT AS size FROM d UNION ALL SELECT i || '.hex', (i % 4096) * 65536 + ((i * 3) % 4096) * 16 + base + 4, 2 FROM d""",
    ),
)


def srec_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    lines = F.array(
        F.lit("S0060000484452FF"), F.concat(F.lit("S107"), F.lpad(F.hex(F.pmod(i * 5, F.lit(60_000))), 4, "0"), F.lpad(F.hex(i), 8, "0"), F.lit("00")), F.lit("S10"), F.lit("S2140000000000"),
        F.concat(F.lit("S107"), F.lpad(F.hex(F.pmod(i * 5, F.lit(60_000)) + 16), 4, "0"), F.lit("41")), F.concat(F.lit("S903"), F.lpad(F.hex(F.pmod(i, F.lit(65_536))), 4, "0"), F.lit("FC")),
    )
    return docs.select(F.concat(i.cast("string"), F.lit(".srec")).alias("file_name"), F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content"))


def srec_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.srec_summary(srec_images(spark, sf_dir))
    return s.select(F.col("key").alias("file_name"), "total_data_bytes", "memory_range.min_address", "memory_range.max_address", F.col("memory_range.span_bytes").alias("span_bytes"), "start_address", "entry_point", "header", F.hex("data").alias("data"))


_add(
    "srec_memory_range",
    (
        srec_ranges,
        """WITH d AS (SELECT doc_id AS i, (doc_id * 5) % 60000 AS base FROM documents) SELECT i || '.srec' AS file_name, 8::BIGINT AS total_data_bytes, printf('0x%08X', base) AS min_address, printf('0x%08X', base + 20) AS max_address, 20::BIGINT AS span_bytes, printf('0x%08X', i % 65536) AS start_address, printf('0x%04X', i % 65536) AS entry_point, 'HDR' AS header, printf('%08X', i) AS data FROM d""",
    ),
)


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cortex-M images: a stack pointer, vectors that follow the document, and its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    little = lambda v: F.regexp_replace(F.lpad(F.hex(v), 8, "0"), "^(..)(..)(..)(..)$", "$4$3$2$1")
    vectors = F.transform(F.sequence(F.lit(2), F.lit(63)), lambda k: little(F.lit(0x08000001) + F.pmod(i, F.lit(1000)) * 16 + 2 * k))
    table = F.unhex(F.concat(F.lit("0020002001010008"), F.array_join(vectors, "")))
    return docs.select(F.concat(i.cast("string"), F.lit(".bin")).alias("file_name"), F.concat(table, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


def cortex_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without "outer", Spark infers a filter and carries the making of the images into it.
    found = W.with_cortex_m(vector_images(spark, sf_dir)).select("file_name", F.inline_outer("r.interrupt_handlers"))
    return found.where("name is not null")


_NAMES = ", ".join(f"'{n}'" for n in W.VECTORS)
_add(
    "cortexm_vectors",
    (
        cortex_vectors,
        f"""WITH v AS (SELECT doc_id AS i, unnest(range(2, 16)) AS k FROM documents)
SELECT i || '.bin' AS file_name, 'Reset_Handler' AS name, '0x08000100' AS address, true AS thumb_mode, NULL::INT AS vector_index FROM (SELECT doc_id AS i FROM documents)
UNION ALL SELECT i || '.bin', 'Reset_Handler', '0x08000100', true, 1 FROM (SELECT doc_id AS i FROM documents)
UNION ALL SELECT i || '.bin', ([{_NAMES}])[k + 1], printf('0x%08X', ((134217729 + (i % 1000) * 16 + 2 * k) // 2) * 2), true, k::INT FROM v""",
    ),
)


def cortex_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = W.with_cortex_m(vector_images(spark, sf_dir))
    size = lambda c: F.size(c).cast("bigint")
    return made.select(
        "file_name", sniff.kind(CONTENT()).alias("kind"), "r.stack_pointer", "r.reset_handler", size("r.vectors").alias("vectors"), F.get("r.vectors", F.lit(15))["address"].alias("last_vector"), F.col("r.total_interrupt_handlers").cast("bigint").alias("handlers"),
        _joined("r.rtos_detected").alias("rtos"), "r.has_rtos", "r.has_hal", _joined(F.transform("r.memory_regions", lambda m: F.concat_ws(" ", m["type"], m["start_address"], m["size"]))).alias("regions"), size("r.peripheral_indicators").alias("peripherals"), size("r.disassembly").alias("disassembly"),
    )


_BINARIES = "b AS (SELECT doc_id::VARCHAR || '.bin' AS file_name, doc_id AS i, coalesce(text, '') AS t FROM documents)"
_add(
    "cortexm_kind",
    (
        cortex_reports,
        f"""WITH {sql_strings(rows=_BINARIES)}, l AS (SELECT file_name, regexp_extract(file_name, '^[0-9]+')::BIGINT AS i, lower(array_to_string(strings, chr(10))) AS low FROM s), r AS (SELECT file_name, i, {_sql_set(G.RTOS)} AS rtos FROM l)
SELECT file_name, 'cortex-m' AS kind, '0x20002000' AS stack_pointer, '0x08000100' AS reset_handler, 16::BIGINT AS vectors, printf('0x%08X', 134217729 + (i % 1000) * 16 + 30) AS last_vector, 16::BIGINT AS handlers, rtos, rtos <> '' AS has_rtos, contains(rtos, 'HAL') AS has_hal,
'RAM 0x20000000 8KB|Flash 0x08000000 64KB-2MB|System 0xE0000000' AS regions, 0::BIGINT AS peripherals, 0::BIGINT AS disassembly FROM r""",
    ),
)


def dicom_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".dcm")).alias("file_name"), F.concat(F.unhex(F.lit("00" * 128)), F.lit(b"DICM\x10\x00\x10\x00"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


def dicom_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.with_dicom(dicom_images(spark, sf_dir), into="d")
    return d.select("file_name", F.col("d.dicom_tags_found").cast("bigint").alias("tags"), "d.patient_data_detected", "d.risk_assessment", "d.hipaa_relevant", F.get(F.transform("d.sample_tags", lambda t: t["tag"]), F.lit(0)).alias("first_tag"))


_DICOM = "b AS (SELECT doc_id::VARCHAR || '.dcm' AS file_name, 'DICM' || chr(16) || coalesce(text, '') AS t FROM documents)"
_add(
    "dicom_reports",
    (
        dicom_reports,
        f"""WITH {sql_strings(rows=_DICOM)}, l AS (SELECT file_name, lower(array_to_string(strings, chr(10))) AS low, '10001000' || substr(hex(encode(t)), 11) AS x, greatest(0, ceil((strlen(t) - 9) / 2.0))::BIGINT AS n FROM s),
p AS (SELECT *, {_sql_set(G.COMPLIANCE)} AS compliance, {_sql_set(G.SECURITY)} AS security, list_transform(range(least(22, n)), lambda i: x[4 * i + 3:4 * i + 4] || x[4 * i + 1:4 * i + 2] || ',' || x[4 * i + 7:4 * i + 8] || x[4 * i + 5:4 * i + 6]) AS tags FROM l),
q AS (SELECT *, list_has_any(tags, ['0010,0010', '0010,0020']) AS patient, CASE WHEN compliance = '' THEN 0 ELSE len(string_split(compliance, '|')) END AS c, CASE WHEN security = '' THEN 0 ELSE len(string_split(security, '|')) END AS z FROM p)
SELECT file_name, least(21, n) AS tags, patient AS patient_data_detected, CASE WHEN c >= 2 AND z >= 2 THEN 'Low' WHEN c >= 1 THEN 'Medium' WHEN patient THEN 'High' ELSE 'Medium' END AS risk_assessment, patient OR contains(security, 'Data Encryption') OR contains(security, 'Access Control') AS hipaa_relevant, '(' || tags[1] || ')' AS first_tag FROM q""",
    ),
)

# Guards.
_RULES = guards.UrlRules(hosts=(*guards.DEFAULT_HOSTS, "example.com"))
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_add(
    "url_guard",
    (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", guards.url_rejection(F.col("url"), _RULES).alias("rejection")),
        f"SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN regexp_matches(url, '#.*[@%]') THEN 'fragment' WHEN {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') THEN NULL ELSE 'host' END AS rejection FROM pages",
    ),
)
_URLS = ("http://169.254.169.254/", "http://10.1.2.3/", "http://8.8.8.8/", "http://127.0.0.1:22/", "ftp://a.com/", "https://user:p@api.openai.com/", "https://api.openai.com/v1#a@b", "https://x.huggingface.co/m", "http://172.32.0.1/", "http://224.9.9.9/", "https://evil.com", "http://localhost:8080/")
_ANSWERS = ("ip", "ip", "ip", "ip", "scheme", "credentials", "fragment", None, "ip", "ip", "host", "localhost")
_add(
    "url_guard_vectors",
    (
        lambda spark, sf_dir: spark.createDataFrame([(u,) for u in _URLS], "url string").select("url", guards.url_rejection(F.col("url")).alias("rejection")),
        "SELECT * FROM (VALUES " + ", ".join(f"('{u}', {repr(a) if a else 'NULL'})" for u, a in zip(_URLS, _ANSWERS, strict=True)) + ") AS v(url, rejection)",
    ),
)
_PORTS = ", ".join(map(str, guards.DANGEROUS_PORTS))


def guarded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in and out of a range, of both versions, and ports of this machine, by supplier."""
    k = F.col("s_suppkey")
    rules = guards.UrlRules(cidrs=("8.8.0.0/13", "bad", "2001:db8::/32"), allow_localhost=True)
    address = F.concat(F.lit("http://8."), F.pmod(k, F.lit(32)).cast("string"), F.lit("."), F.pmod(k, F.lit(256)).cast("string"), F.lit(".1/x"))
    ports = F.array(*map(F.lit, guards.DANGEROUS_PORTS))
    port = F.when(k % 2 == 0, F.element_at(ports, (F.pmod(F.floor(k / 2), F.lit(len(guards.DANGEROUS_PORTS))) + 1).cast("int"))).otherwise((8100 + F.pmod(k, F.lit(50))).cast("int"))
    sixth = F.concat(F.lit("[2001:DB8::"), F.when(k % 3 == 0, "").otherwise(F.lpad(F.hex(k), 4, "0")), F.lit("]"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return suppliers.select("s_suppkey", guards.url_rejection(address, rules).alias("address"), guards.url_rejection(F.concat(F.lit("http://localhost:"), port.cast("string"), F.lit("/")), rules).alias("port"), guards.same_ipv6(sixth, rules.cidrs[2]).alias("sixth"))


_add(
    "url_guard_addresses",
    (
        guarded_addresses,
        f"""SELECT s_suppkey, CASE WHEN s_suppkey % 32 BETWEEN 8 AND 15 THEN NULL ELSE 'ip' END AS address, CASE WHEN (CASE WHEN s_suppkey % 2 = 0 THEN ([{_PORTS}])[(s_suppkey // 2) % {len(guards.DANGEROUS_PORTS)} + 1] ELSE 8100 + s_suppkey % 50 END) IN ({_PORTS}) THEN 'port' END AS port, s_suppkey % 3 = 0 AS sixth FROM supplier""",
    ),
)
_add(
    "path_guard_cli",
    (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", guards.path_rejection(F.concat(F.lit("@"), F.regexp_replace("url", "^https?:/", "")), strip_at=True).alias("stripped"), guards.path_rejection(F.concat(F.lit("@"), F.regexp_replace("url", "^https?:/", ""))).alias("kept")),
        "SELECT page_id, CASE WHEN contains(url, '..') THEN 'path_traversal' ELSE 'absolute_path' END AS stripped, CASE WHEN contains(url, '..') THEN 'path_traversal' END AS kept FROM pages",
    ),
)
_add(
    "path_guard",
    (
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", guards.path_rejection(F.regexp_replace("url", "^https?:/", "")).alias("absolute"), guards.path_rejection(F.concat(F.lit("a/"), F.regexp_replace("url", "^https?://[^/]*/", ""))).alias("relative")),
        "SELECT page_id, CASE WHEN contains(url, '..') THEN 'path_traversal' ELSE 'absolute_path' END AS absolute, CASE WHEN contains(regexp_replace(url, '^https?://[^/]*/', ''), '..') THEN 'path_traversal' END AS relative FROM pages",
    ),
)

# Differences: symbols of texts are their extracted strings, an adaptation, as texts have no symbols.
def string_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and the one after it: what the second's strings add and lack, and sizes."""
    made = blobs(spark, sf_dir).select(F.regexp_extract("file_name", "^[0-9]+", 0).cast("bigint").alias("i"), "file_name", F.length("content").cast("bigint").alias("size_bytes"), B.sha256(CONTENT()).alias("hash_sha256"), B.extract_strings(CONTENT()).alias("detected_symbols"))
    analyses = made.withColumns({"imports": F.array().cast("array<string>"), "exports": F.array().cast("array<string>")})
    pairs = made.select(F.col("file_name").alias("file1_name"), F.concat((F.col("i") + 1).cast("string"), F.lit(".txt")).alias("file2_name"))
    return A.compare(pairs, analyses).select("file1_name", "file2_name", "file1_size", "file2_size", "size_diff_bytes", "file1_sha256", "file2_sha256", _joined("symbols_added").alias("added"), _joined("symbols_removed").alias("removed"))


_add(
    "diff_pairs",
    (
        string_sets,
        f"""WITH {sql_strings()}, n AS (SELECT *, regexp_extract(file_name, '^[0-9]+')::BIGINT AS i FROM s)
SELECT a.file_name AS file1_name, c.file_name AS file2_name, strlen(a.t) AS file1_size, strlen(c.t) AS file2_size, strlen(a.t) - strlen(c.t) AS size_diff_bytes, sha256(a.t) AS file1_sha256, sha256(c.t) AS file2_sha256,
array_to_string(list_sort(list_filter(c.strings, lambda x: NOT list_contains(a.strings, x))), '|') AS added, array_to_string(list_sort(list_filter(a.strings, lambda x: NOT list_contains(c.strings, x))), '|') AS removed FROM n a JOIN n c ON c.i = a.i + 1""",
    ),
)


# Sources and stores.
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as the fields of a form for each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("request"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.when(F.col("role") == "assistant", F.concat("role", "turn")).alias("filename"), F.encode("text", "UTF-8").alias("content"))


_FORM = "f AS (SELECT conv_id AS request, turn AS pos, role AS name, CASE WHEN role = 'assistant' THEN role || turn END AS filename, text AS t FROM conversations)"
_add(
    "uploads_single",
    (
        lambda spark, sf_dir: S.single_uploads(form_fields(spark, sf_dir)).select("request", "file_name", F.length("content").cast("bigint").alias("size"), "error"),
        f"WITH {_FORM}, g AS (SELECT request, max_by(filename, pos) FILTER (WHERE filename IS NOT NULL) AS n, max_by(strlen(t), pos) FILTER (WHERE strlen(t) > 0 AND (filename IS NOT NULL OR strlen(t) > 10)) AS size FROM f GROUP BY request) SELECT request, coalesce(n, 'uploaded_file') AS file_name, size, CASE WHEN size IS NULL THEN 'empty_file' END AS error FROM g",
    ),
)
_add(
    "uploads_pair",
    (
        lambda spark, sf_dir: S.pair_uploads(form_fields(spark, sf_dir)).select("request", F.length("first.content").cast("bigint").alias("first_size"), F.length("second.content").cast("bigint").alias("second_size"), "error"),
        f"WITH {_FORM}, g AS (SELECT request, count(*) AS n, list(strlen(t) ORDER BY pos) AS z FROM f GROUP BY request) SELECT request, CASE WHEN n = 2 THEN z[1] END AS first_size, CASE WHEN n = 2 THEN z[2] END AS second_size, CASE WHEN n <> 2 THEN 'invalid_input' END AS error FROM g",
    ),
)
_add(
    "uploads_profile",
    (
        lambda spark, sf_dir: S.field_profile(form_fields(spark, sf_dir)).select("request", "pos", "name", "filename", F.col("size").cast("bigint").alias("size"), "total_fields", F.regexp_replace("preview", "\\x{FFFD}*([.]{3} .truncated.)?$", "$1").alias("preview")),
        f"""WITH {_FORM}, g AS (SELECT *, strlen(t) AS size, list_filter(range(len(t) + 1), lambda n: strlen(left(t, n)) <= 100) AS fit FROM f)
SELECT request, pos, coalesce(name, 'unknown') AS name, filename, size, count(*) OVER (PARTITION BY request) AS total_fields, CASE WHEN size <= 100 THEN t ELSE left(t, fit[-1]) || '... (truncated)' END AS preview FROM g""",
    ),
)
_add("health", (lambda spark, sf_dir: S.health(spark), "SELECT 'healthy' AS status, 'sedimark' AS service, '1.0' AS version"))
_add(
    "settings_store",
    (
        lambda spark, sf_dir: C.settings(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pos"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"))),
        "SELECT event_type AS key, max_by(user_id, event_id)::VARCHAR AS value FROM events GROUP BY event_type",
    ),
)
_CHANGES = [(1, "add", "a", "http://a", False), (2, "add", "b", "http://b", True), (3, "add", "c", "http://c", False), (4, "default", "c", None, False), (5, "remove", "a", None, False), (6, "add", "d", "http://d", False)]
_add(
    "provider_store",
    (
        lambda spark, sf_dir: C.providers(spark.createDataFrame(_CHANGES, "pos bigint, action string, name string, base_url string, is_default boolean")),
        "SELECT * FROM (VALUES ('b', 'http://b', false), ('c', 'http://c', true), ('d', 'http://d', false)) AS v(name, base_url, is_default)",
    ),
)
_add("json_sink", (lambda spark, sf_dir: S.as_json(strings(spark, sf_dir)), f"WITH {sql_strings()} SELECT to_json({{'file_name': file_name, 'strings': strings}})::VARCHAR AS json FROM s"))

# Signing.
_KEY = b"a key for tests"


def signed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of names, and what a token minted for each is worth before and after its expiry."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"))
    claims = signing.license_claims(F.col("name"), F.lit(1_000_000).cast("bigint"), F.lit("trial_30"), rate_limit=60)
    tokens = names.withColumn("token", signing.minted(claims, _KEY))
    return tokens.select("name", signing.hmac_sha256(F.encode("name", "UTF-8"), _KEY).alias("mac"), signing.token_verdict(F.col("token"), _KEY, 1_000_000 + 30 * 86_400 - 1).alias("before"), signing.token_verdict(F.col("token"), _KEY, 1_000_000 + 30 * 86_400).alias("after"), signing.token_verdict(F.col("token"), b"another", 1).alias("other_key"))


_PADS = ["".join(f"{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_add(
    "signing",
    (
        signed_names,
        f"SELECT s_name AS name, rtrim(translate(base64(unhex(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(s_name)))))), '+/', '-_'), '=') AS mac, 'valid' AS before, 'expired' AS after, 'signature' AS other_key FROM supplier",
    ),
)
_add(
    "deployments",
    (
        lambda spark, sf_dir: spark.createDataFrame([("OSS",), ("Secure",), ("cloud",)], "name string").select("name", M.deployment(F.col("name")).alias("deployment")),
        "SELECT * FROM (VALUES ('OSS', 'oss'), ('Secure', 'secure'), ('cloud', NULL)) AS v(name, deployment)",
    ),
)


# Whole analyses.
def composition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents are made of: digest, size, kind, ratio, entropy, strings, licences, versions, confidences."""
    made = blobs(spark, sf_dir).withColumn("strings", B.extract_strings(CONTENT()))
    found = M.with_license_info(M.with_version_info(made, "strings"), "strings")
    return found.select(
        "file_name", B.sha256(CONTENT()).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"), sniff.kind(CONTENT()).alias("kind"), F.round(B.text_ratio(CONTENT()), 9).alias("text_ratio"), F.size("strings").cast("bigint").alias("n_strings"),
        _joined("license_info.licenses").alias("licenses"), _joined("version_info.version_strings").alias("versions"), F.round("license_info.confidence", 9).alias("license_confidence"), F.round("version_info.confidence", 9).alias("version_confidence"),
    )


_add(
    "composition_report",
    (
        composition_report,
        f"""WITH {sql_strings()}, l AS (SELECT *, {_LICENSES} AS li, {_VERSIONS} AS ve, len({_TEXTS}) AS tx, flatten(list_transform(list_filter(strings, lambda s: len(s) >= 10), lambda s: regexp_extract_all(s, '{M.SPDX_PATTERN}', 1))) AS sp FROM s)
SELECT file_name, sha256(t) AS sha256, strlen(t) AS size_bytes, {_KIND} AS kind, CASE WHEN strlen(t) = 0 THEN NULL ELSE round(len(regexp_replace(t, '[^\\x21-\\x7E \\t\\n\\x0C\\r]', '', 'g'))::DOUBLE / strlen(t), 9) END AS text_ratio, len(strings) AS n_strings, array_to_string(li, '|') AS licenses, array_to_string(ve, '|') AS versions,
round((CASE WHEN len(sp) > 0 THEN 0.5 ELSE 0 END + CASE WHEN len(li) > 0 THEN 0.3 ELSE 0 END + CASE WHEN tx > 0 THEN 0.2 ELSE 0 END)::DOUBLE, 9) AS license_confidence, CASE len(ve) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 ELSE 0.8 END AS version_confidence FROM l""",
    ),
)


def analyzed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of the documents, their lists joined."""
    r = A.analyze(blobs(spark, sf_dir))
    return r.select(
        "file_name", "format", "architecture", _joined("languages").alias("languages"), "hash_sha256", "hash_blake3", "size_bytes", "static_linked", _joined("embedded_strings").alias("strings"), _joined("version_info.version_strings").alias("versions"), "version_info.file_version",
        _joined("license_info.licenses").alias("licenses"), F.round("license_info.confidence", 9).alias("license_confidence"), F.get_json_object("metadata", "$.analysis_type").alias("analysis"), F.get_json_object("metadata", "$.detection_confidence.format").alias("format_confidence"), "parse_error",
    )


def sql_mime(table: str) -> str:
    """Case arms of the magic table over the hexadecimal bytes x."""
    return " ".join(f"WHEN {' OR '.join(f"substr(x, {2 * at + 1}, {2 * len(m)}) = '{m.hex().upper()}'" for m in magic)} THEN '{mime}'" for mime, at, magic in sniff.MIME)


_HTML = r"regexp_matches(upper(ltrim(t)), '^<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--)[ >]')"
_SMALL = r"CASE WHEN coalesce(ratio > 0.8, false) THEN CASE WHEN starts_with(t, '#!') THEN 'script' ELSE 'text/small' END WHEN len(found) > 0 THEN 'firmware-blob' ELSE 'micro-binary' END"
_SPOKEN = "CASE WHEN coalesce(ratio > 0.8, false) THEN array_to_string(list_filter([CASE WHEN starts_with(t, '#!') THEN 'script' END, CASE WHEN contains(t, 'function') OR contains(t, 'def ') THEN 'script' END, CASE WHEN contains(t, '#include') OR contains(t, 'int main') THEN 'C/C++' END, CASE WHEN contains(t, 'pub fn') OR contains(t, 'fn main') THEN 'Rust' END], lambda x: x IS NOT NULL), '|') WHEN len(found) > 0 THEN 'Firmware' ELSE '' END"
#: All but the second digest, which SQL has no function for.
_ANALYZED = f"""WITH {sql_strings()}, k AS (SELECT *, {_KIND} AS kind, {_RATIO} AS ratio, {_FIRMWARE} AS found, {_HINTS} AS hints, hex(encode(t)) AS x, {_LICENSES} AS li, {_VERSIONS} AS ve, {_BEST} AS best, len({_TEXTS}) AS tx, flatten(list_transform(list_filter(strings, lambda s: len(s) >= 10), lambda s: regexp_extract_all(s, '{M.SPDX_PATTERN}', 1))) AS sp FROM s)
SELECT file_name, CASE kind WHEN 'tiny' THEN {_SMALL} WHEN 'raw' THEN CASE {sql_mime('documents')} WHEN {_HTML} THEN 'text/html' ELSE 'application/octet-stream' END WHEN 'compressed' THEN 'compressed-firmware' WHEN 'pe' THEN 'application/wasm' ELSE kind END AS format,
CASE WHEN kind IN ('tiny', 'raw') THEN CASE WHEN len(hints) > 0 THEN array_to_string(hints, ', ') ELSE 'unknown' END WHEN kind = 'pe' THEN 'wasm32' ELSE 'unknown' END AS architecture, CASE kind WHEN 'tiny' THEN {_SPOKEN} WHEN 'compressed' THEN 'Compressed Binary' WHEN 'pe' THEN 'WebAssembly' ELSE '' END AS languages,
sha256(t) AS hash_sha256, strlen(t) AS size_bytes, CASE WHEN kind IN ('tiny', 'raw') THEN len(found) > 0 OR coalesce(ratio < 0.1, false) ELSE kind = 'pe' END AS static_linked, array_to_string(CASE WHEN kind = 'raw' THEN list_concat(strings, strings) ELSE strings END, '|') AS strings, array_to_string(ve, '|') AS versions, best AS file_version, array_to_string(li, '|') AS licenses,
round((CASE WHEN len(sp) > 0 THEN 0.5 ELSE 0 END + CASE WHEN len(li) > 0 THEN 0.3 ELSE 0 END + CASE WHEN tx > 0 THEN 0.2 ELSE 0 END)::DOUBLE, 9) AS license_confidence, CASE WHEN kind IN ('tiny', 'raw') THEN 'raw_firmware_blob' WHEN kind = 'pe' THEN 'wasm' END AS analysis,
CASE WHEN kind IN ('tiny', 'raw') THEN CASE WHEN coalesce(ratio > 0.8, false) THEN 'high' WHEN len(found) > 0 THEN 'medium' ELSE 'low' END END AS format_confidence FROM k"""
_add("analyze_documents", (lambda spark, sf_dir: analyzed_documents(spark, sf_dir).drop("hash_blake3", "parse_error"), _ANALYZED))
_add("analyze_digests", lambda spark, sf_dir: analyzed_documents(spark, sf_dir).select("file_name", "hash_sha256", "hash_blake3", "parse_error"))
# Images are dealt by name first, as blobs of uneven sizes should be.
_add("analyze_lines", lambda spark, sf_dir: A.analyze(hex_images(spark, sf_dir).union(srec_images(spark, sf_dir)).repartition("file_name")))
_add("analyze_vectors", lambda spark, sf_dir: A.analyze(vector_images(spark, sf_dir).repartition("file_name")))


def containers() -> dict[str, bytes]:
    """One container of each kind, with headers alone."""
    elf = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0x400000, 0, 0, 0, 64, 56, 0, 64, 0, 0)
    pe = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 0, 0, 0, 0, 112, 0) + struct.pack("<HBBIIIIIQ", 0x20B, 0, 0, 0, 0, 0, 0x1000, 0, 0x140000000) + bytes(80)
    macho = b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIII", 0x01000007, 3, 2, 0, 0, 0) + bytes(24)
    wasm = b"\0asm\1\0\0\0" + b"\x02\x0b\x01\x03env\x03log\x00\x00" + b"\x03\x02\x01\x00" + b"\x07\x07\x01\x03run\x00\x01" + bytes(32)
    return {"elf": elf, "pe": pe, "macho": macho, "wasm": wasm}


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of containers."""
    rows = spark.createDataFrame(list(containers().items()), "kind string, content binary")
    f = rows.withColumn("f", O.facts(CONTENT(), F.col("kind")))
    return f.select("kind", "f.architecture", "f.entry_point", "f.static_linked", _joined("f.imports").alias("imports"), _joined("f.exports").alias("exports"))


_add(
    "object_facts",
    (
        specimens,
        "SELECT * FROM (VALUES ('elf', 'x86_64', '0x00400000', true, '', ''), ('pe', 'x86_64', '0x140001000', true, '', ''), ('macho', 'x86_64', NULL, false, '', ''), ('wasm', 'wasm32', NULL, true, 'env::log', 'run')) AS v(kind, architecture, entry_point, static_linked, imports, exports)",
    ),
)


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a blob of each kind, some of which are damaged."""
    made = containers() | {
        "arm": b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0x8000, 52, 0, 0, 52, 32, 1, 40, 0, 0),
        "bad": b"\x7fELF" + bytes(60), "fat": b"\xca\xfe\xba\xbe" + bytes(60), "ar": b"!<arch>\n" + b" " * 60,
        "gzip": b"\x1f\x8b\x08\x00" + b"x" * 60, "lz4": b"\x04\x22\x4d\x18" + b"x" * 60, "xz": b"\xfd7zXZ\x00" + b"x" * 60, "zstd": b"\x28\xb5\x2f\xfd" + b"x" * 60, "comp": b"COMP" + b"x" * 60,
        "dicom": bytes(128) + b"DICM" + bytes(40), "cortex": struct.pack("<II", 0x20002000, 0x08000101) + b"FreeRTOS\0" + bytes(300), "tar": bytes(257) + b"ustar" + bytes(40),
        "text": b"hello world", "boot": b"\x00\x01GRUB\x02\x03\x80\x81\x82\x83", "zeros": bytes(10_000), "empty": b"",
        "hex": b":0400000041424344F2\n:00000001FF\n" + b"\n" * 40, "srec": b"S0030000FC\nS107000041424344EE\nS9030000FC\n" + b"\n" * 40,
    }
    r = A.analyze(spark.createDataFrame(list(made.items()), "file_name string, content binary"))
    return r.select("file_name", "format", "architecture", _joined("languages").alias("languages"), "static_linked", "entry_point", F.col("parse_error").isNotNull().alias("damaged"), F.size("embedded_strings").cast("bigint").alias("n_strings"))


#: Wanted records, by hand: "ELF", "asm" and "7zXZ" are strings too, and zeros behind the WebAssembly module are sections without a name.
_KINDS = [
    ("elf", "elf", "x86_64", "", True, "0x00400000", False, 1), ("pe", "pe", "x86_64", "", True, "0x140001000", False, 0), ("macho", "macho", "x86_64", "", False, None, False, 0), ("wasm", "application/wasm", "wasm32", "WebAssembly", True, None, True, 4),
    ("arm", "elf", "arm", "", True, "0x00008000", False, 1), ("bad", "application/wasm", "wasm32", "WebAssembly", True, None, True, 1), ("fat", "macho-fat", "multi", "", False, None, False, 0), ("ar", "archive", "unknown", "", False, None, False, 1),
    *((k, "compressed-firmware", "unknown", "Compressed Binary", False, None, False, n) for k, n in (("gzip", 1), ("lz4", 1), ("xz", 2), ("zstd", 1), ("comp", 1))),
    ("dicom", "dicom-file", "unknown", "", False, None, False, 2), ("cortex", "arm-cortex-m-firmware", "arm_cortex_m", "ARM Assembly|C/C++", True, "0x08000100", False, 2), ("tar", "application/x-tar", "unknown", "", True, None, False, 2),
    ("text", "text/small", "unknown", "", False, None, False, 1), ("boot", "firmware-blob", "unknown", "Firmware", True, None, False, 1), ("zeros", "application/octet-stream", "unknown", "", True, None, False, 0), ("empty", "micro-binary", "unknown", "", False, None, False, 0),
    ("hex", "intel-hex", "embedded", "Firmware", True, None, False, 3), ("srec", "motorola-srec", "embedded", "Firmware", True, "0x0000", False, 4),
]


def _literal(value: object) -> str:
    return "NULL" if value is None else repr(value) if isinstance(value, str) else str(value).lower()


_add("analyze_kinds", (kinds, "SELECT file_name, format, architecture, languages, static_linked, entry_point::VARCHAR AS entry_point, damaged, n_strings::BIGINT AS n_strings FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, k)) + ")" for k in _KINDS) + ") AS v(file_name, format, architecture, languages, static_linked, entry_point, damaged, n_strings)"))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
