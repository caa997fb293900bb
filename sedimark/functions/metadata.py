"""Columns over extracted strings: versions, licences, names, library versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns over single printable strings.
VERSION_PATTERNS = (
    r"\b(\d+\.\d+\.\d+(?:\.\d+)?)\b",
    r"\bv(\d+\.\d+\.\d+(?:\.\d+)?)\b",
    r"\bversion\s*[:=]\s*([^\s,;]+)",
    r"\bVERSION\s*[:=]\s*([^\s,;]+)",
    r"\b(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)\b",
)
LICENSE_PATTERNS = (
    r"(?i)\b(MIT|BSD|GPL|LGPL|Apache|Mozilla|ISC|Unlicense)\b",
    r"(?i)licensed under the ([^.,;]+)",
    r"(?i)license:\s*([^.,;\n]+)",
)
COPYRIGHT_PATTERN = r"(?i)copyright\s+.*"
SPDX_PATTERN = r"SPDX-License-Identifier:\s*([^\s]+)"
LICENSE_TEXT_PATTERNS = (
    r"(?i)permission is hereby granted.*",
    r"(?i)redistribution and use in source and binary forms.*",
    r"(?i)this program is free software.*",
    r"(?i)licensed under the apache license.*",
)
COMPANY_PATTERNS = (
    r"(?i)company:\s*([^.,;\n]+)",
    r"(?i)corporation:\s*([^.,;\n]+)",
    r"(?i)© \d{4}\s+([^.,;\n]+)",
    r"(?i)copyright.*?(\w+(?:\s+\w+){0,3})(?:\s+inc\.?|\s+corp\.?|\s+ltd\.?|\s+llc)",
)
PRODUCT_PATTERNS = (
    r"(?i)product:\s*([^.,;\n]+)",
    r"(?i)application:\s*([^.,;\n]+)",
    r"(?i)program:\s*([^.,;\n]+)",
)
LICENSE_NAMES = {
    "mit": "MIT",
    "bsd": "BSD",
    "gpl": "GPL",
    "lgpl": "LGPL",
    "apache": "Apache-2.0",
    "mozilla": "MPL-2.0",
    "isc": "ISC",
    "unlicense": "Unlicense",
}


# What a string must hold for any of the patterns to fit: one test in place of all of them on most strings.
VERSION_GUARD = r"\d\.\d|version|VERSION"
LICENSE_GUARD = r"(?i)mit|bsd|gpl|apache|mozilla|isc|unlicense|licensed under|license:"
LICENSE_TEXT_GUARD = r"(?i)permission is|redistribution and|this program|licensed under"
COMPANY_GUARD = r"(?i)company:|corporation:|©|copyright"
PRODUCT_GUARD = r"(?i)product:|application:|program:"


def _all(strings: Column, guard: str, *patterns: str) -> Column:
    """First groups of all matches in the strings that the guard lets pass, string by string."""
    found = lambda s: F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in patterns))
    return F.flatten(F.transform(F.filter(strings, lambda s: s.rlike(guard)), found))


def is_valid_version(version: Column) -> Column:
    """3 to 20 bytes with a dot, at most five parts, and no part that is a number over 9,999."""
    parts = F.split(version, r"\.")
    small = F.forall(parts, lambda p: ~p.rlike(r"^\+?[0-9]+$") | F.coalesce(~F.try_to_number(F.regexp_replace(p, r"^\+", ""), F.lit("9" * 38)).between(10_000, 4_294_967_295), F.lit(True)))
    size = F.octet_length(version)
    return (size >= 3) & (size <= 20) & F.contains(version, F.lit(".")) & (F.size(parts) <= 5) & small


def version_strings(strings: Column) -> Column:
    """Distinct valid versions, sorted."""
    found = F.array_distinct(_all(strings, VERSION_GUARD, *VERSION_PATTERNS))
    return F.array_sort(F.filter(found, is_valid_version))


def most_dotted(versions: Column) -> Column:
    """The version with most dots; of several the largest; null of none."""
    ranked = F.transform(versions, lambda v: F.struct((F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))).alias("dots"), v.alias("version")))
    return F.array_max(ranked)["version"]


def version_confidence(versions: Column, file_version: Column) -> Column:
    n = F.size(versions)
    some = F.when(n > 0, F.lit(0.0) + F.lit(0.3)).otherwise(F.lit(0.0))
    named = F.when(file_version.isNotNull(), some + F.lit(0.4)).otherwise(some)
    return F.least(F.lit(1.0), F.when(n == 1, named + F.lit(0.3)).when(n > 1, named + F.lit(0.1)).otherwise(named))


def _name(string: Column, patterns: tuple[str, ...]) -> Column:
    tries = []
    for p in patterns:
        name = F.btrim(F.regexp_extract(string, p, 1), F.lit(" \t\n\r\f\x0b"))
        tries.append(F.when(F.octet_length(name).between(3, 99), name))
    return F.coalesce(*tries)


def company_name(string: Column) -> Column:
    return _name(string, COMPANY_PATTERNS)


def product_name(string: Column) -> Column:
    return _name(string, PRODUCT_PATTERNS)


def first_of(strings: Column, name) -> Column:
    """The first value that a function of a string gives, in the strings' order."""
    return F.get(F.filter(F.transform(strings, name), lambda x: x.isNotNull()), F.lit(0))


def with_version_info(df: DataFrame, strings: str, extra: Column | None = None, into: str = "version_info") -> DataFrame:
    """df with versions, names and confidence of an array of strings.

    Each step is a column of its own, so that Spark evaluates it once.
    """
    versions = version_strings(F.col(strings))
    if extra is not None:
        versions = F.array_sort(F.array_union(versions, extra))
    staged = df.withColumn("_versions", versions).withColumn("_best", most_dotted(F.col("_versions")))
    info = F.struct(
        F.col("_versions").alias("version_strings"),
        F.col("_best").alias("file_version"),
        F.lit(None).cast("string").alias("product_version"),
        first_of(F.filter(strings, lambda s: s.rlike(COMPANY_GUARD)), company_name).alias("company"),
        first_of(F.filter(strings, lambda s: s.rlike(PRODUCT_GUARD)), product_name).alias("product_name"),
        version_confidence(F.col("_versions"), F.col("_best")).alias("confidence"),
    )
    return staged.withColumn(into, info).drop("_versions", "_best")


def normalize_license_name(name: Column) -> Column:
    """The usual identifier of a known licence; other names in lower case."""
    low = F.lower(name)
    found = low
    for known, identifier in LICENSE_NAMES.items():
        found = F.when(low == known, identifier).otherwise(found)
    return found


def infer_license_from_text(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("permission is hereby granted")) & F.contains(low, F.lit("mit")), "MIT")
        .when(F.contains(low, F.lit("redistribution and use in source and binary forms")), "BSD")
        .when(F.contains(low, F.lit("apache license")), "Apache-2.0")
        .when(F.contains(low, F.lit("gnu general public license")), "GPL")
    )


def license_confidence(licenses: Column, spdx: Column, texts: Column) -> Column:
    score = F.when(F.size(spdx) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    score = F.when(F.size(licenses) > 0, score + F.lit(0.3)).otherwise(score)
    return F.least(F.lit(1.0), F.when(F.size(texts) > 0, score + F.lit(0.2)).otherwise(score))


def license_texts(long: Column) -> Column:
    """Strings of over 100 bytes, once for each licence text that they hold."""
    of = lambda s: F.filter(F.array(*(F.when(s.rlike(p), s) for p in LICENSE_TEXT_PATTERNS)), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.filter(long, lambda s: (F.octet_length(s) > 100) & s.rlike(LICENSE_TEXT_GUARD)), of))


def licenses(long: Column, texts: Column) -> Column:
    """Distinct licences that strings name or that licence texts are, sorted."""
    named = F.transform(F.array_distinct(_all(long, LICENSE_GUARD, *LICENSE_PATTERNS)), normalize_license_name)
    inferred = F.filter(F.transform(texts, infer_license_from_text), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.filter(F.concat(named, inferred), lambda x: x != "")))


def with_license_info(df: DataFrame, strings: str, into: str = "license_info") -> DataFrame:
    """df with licences, notices, identifiers and texts of the strings of ten bytes and more."""
    staged = df.withColumn("_long", F.filter(strings, lambda s: F.octet_length(s) >= 10)).withColumn("_texts", license_texts(F.col("_long")))
    staged = staged.withColumns({"_licenses": licenses(F.col("_long"), F.col("_texts")), "_spdx": F.array_sort(F.array_distinct(_all(F.col("_long"), "SPDX-License-Identifier:", SPDX_PATTERN)))})
    info = F.struct(
        F.col("_licenses").alias("licenses"),
        F.flatten(F.transform(F.filter("_long", lambda s: s.rlike("(?i)copyright")), lambda s: F.transform(F.regexp_extract_all(s, F.lit(COPYRIGHT_PATTERN), F.lit(0)), lambda _: s))).alias("copyright_notices"),
        F.col("_spdx").alias("spdx_identifiers"),
        F.col("_texts").alias("license_texts"),
        license_confidence(F.col("_licenses"), F.col("_spdx"), F.col("_texts")).alias("confidence"),
    )
    return staged.withColumn(into, info).drop("_long", "_texts", "_licenses", "_spdx")


def library_version(name: Column) -> Column:
    """The first dot-separated part that is all digits; an empty part is one."""
    return F.get(F.filter(F.split(name, r"\."), lambda p: p.rlike("^[0-9]*$")), F.lit(0))


def unpack_version(version: Column) -> Column:
    """Major and minor of a packed version word."""
    return F.struct(F.shiftright(version, 16).bitwiseAND(F.lit(0xFFFF)).alias("major"), F.shiftright(version, 8).bitwiseAND(F.lit(0xFF)).alias("minor"))


def cpe_candidates(names: Column) -> Column:
    """Sorted distinct CPE names of the known libraries among names."""

    def of(name: Column) -> Column:
        low, version = F.lower(name), library_version(name)
        has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        cpe = lambda part, v: F.concat(F.lit(f"cpe:2.3:a:{part}:"), v, F.lit(":*:*:*:*:*:*:*"))
        return F.array(
            F.when(has("openssl", "libcrypto", "libssl"), cpe("openssl:openssl", F.coalesce(version, F.lit("*")))),
            F.when(has("zlib") & version.isNotNull(), cpe("zlib:zlib", version)),
            F.when(has("curl") & version.isNotNull(), cpe("curl:curl", version)),
        )

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(names, of)), lambda x: x.isNotNull())))


def deployment(name: Column, secure_names: tuple[str, ...] = ("secure",)) -> Column:
    """``oss`` or ``secure`` from a deployment's name; null for others."""
    low = F.lower(name)
    return F.when(low == "oss", "oss").when(low.isin(*secure_names), "secure")
