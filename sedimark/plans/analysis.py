"""The whole analysis of a blob table, and the comparison of pairs.

All kinds but the line formats are one projection of one scan: what belongs to a kind is read from a
column that is null for all others, so Python readers and regular expressions see only their kind. Blobs
of the line formats are written aside first, exploded once for each distinct content, and joined back by
digest. So blobs may share names, as files of several folders do; other columns of the
blobs, such as the path, stay in their records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions import blobs as B
from sedimark.functions import metadata as M
from sedimark.operators import firmware as W
from sedimark.operators import objects as O
from sedimark.operators import signatures as G
from sedimark.operators import sniff
from sedimark.session import settled

TEXTS = "array<string>"


def _empty() -> Column:
    return F.array().cast(TEXTS)


def _record(df: DataFrame, names: list[str], fields: dict[str, Column], strings: Column, versions: Column | None = None, described: Column | None = None) -> DataFrame:
    """One record per blob from its fields; versions and licences are read from described, or else from strings."""
    staged = df.withColumns({"_strings": strings, "_described": strings if described is None else described})
    staged = M.with_license_info(M.with_version_info(staged, "_described", versions), "_described")
    return staged.select(
        *(F.col(f"`{c}`") for c in names),
        *(v.alias(k) for k, v in fields.items()),
        F.col("_strings").alias("embedded_strings"),
        _empty().alias("suspected_secrets"),
        "hash_sha256",
        B.blake3(F.col("content")).alias("hash_blake3"),
        F.length("content").cast("bigint").alias("size_bytes"),
        "version_info",
        "license_info",
        F.lit(None).cast("string").alias("sbom"),
    )


def _by_kind(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    found = F
    for fits, value in cases:
        found = found.when(fits, value)
    return found.otherwise(otherwise)


def _blocks(base: DataFrame, names: list[str], twice: bool, compat: bool) -> DataFrame:
    """Records of all kinds but the line formats."""
    kind, own = F.col("kind"), F.col("own")
    plain = kind.isin("tiny", "raw", "compressed", "archive", "macho-fat")
    tiny, raw, cortex, dicom, objects = kind == "tiny", kind == "raw", kind == "cortex-m", kind == "dicom", kind.isin(*O.READERS)
    only = lambda fits: F.when(fits, F.col("content"))
    again = F.concat(own, own) if twice else own
    staged = base.withColumns({"_plain": only(plain), "_tiny": only(tiny), "_cortex": only(cortex), "_dicom": only(dicom), "_object": only(objects), "_all": F.when(raw | cortex | dicom, again).otherwise(own)})
    staged = W.with_raw_report(staged, F.when(plain, F.col("_all")), "_plain", "p")
    staged = W.with_dicom(W.with_cortex_m(staged, "_cortex", "c"), "_dicom", "d")
    staged = staged.withColumn("f", F.when(objects, O.facts(F.col("_object"), F.when(objects, kind))))
    f = lambda name: F.col(f"f.{name}")
    # What a reader cannot follow is labelled as WebAssembly, with its error.
    wasm = objects & (((kind == "wasm") | f("error").isNotNull()) if compat else (kind == "wasm"))
    libraries = F.concat(f("libraries"), f("imports"), f("symbols"))
    macho = F.struct(F.struct(F.lit("macho").alias("analysis_type"), f("load_commands"), f("frameworks"), f("min_os_version")).alias("macho_metadata"), M.cpe_candidates(libraries).alias("cpe_candidates"))
    module = F.struct(F.lit("1.0").alias("wasm_version"), f("functions").alias("function_count"), f("memories").alias("memory_sections"), f("tables").alias("table_sections"), F.size(f("imports")).alias("import_count"), F.size(f("exports")).alias("export_count"), F.lit("wasm").alias("analysis_type"))
    text = lambda *values: F.array(*map(F.lit, values))
    of_object = lambda name, otherwise: F.when(objects, F.coalesce(f(name), otherwise)).otherwise(otherwise)
    sections = F.array().cast("array<struct<name:string,start_address:bigint,end_address:bigint,size:bigint,permissions:string,section_type:string>>")
    fields = {
        "format": _by_kind((tiny, W.small_format(F.col("_tiny"))), (raw, sniff.mime(F.col("file_name"), F.col("_plain"))), (kind == "compressed", F.lit("compressed-firmware")), (cortex, F.lit("arm-cortex-m-firmware")), (dicom, F.lit("dicom-file")), (wasm, F.lit("application/wasm")), otherwise=kind),
        "architecture": _by_kind((tiny | raw, F.col("p.architecture")), (kind == "macho-fat", F.lit("multi")), (cortex, F.lit("arm_cortex_m")), (wasm, F.lit("wasm32")), (objects, F.coalesce(f("architecture"), F.lit("unknown"))), otherwise=F.lit("unknown")),
        "languages": _by_kind((tiny, W.small_languages(F.col("_tiny"))), (kind == "compressed", text("Compressed Binary")), (cortex, text("ARM Assembly", "C/C++")), (wasm, text("WebAssembly")), otherwise=_empty()),
        "detected_symbols": of_object("symbols", _empty()),
        "imports": of_object("imports", _empty()),
        "exports": of_object("exports", _empty()),
        "linked_libraries": of_object("libraries", _empty()),
        "static_linked": _by_kind((tiny | raw, F.col("p.static_linked")), (cortex, F.lit(True)), (objects, wasm | F.coalesce(f("static_linked"), F.lit(False))), otherwise=F.lit(False)),
        "metadata": _by_kind((tiny | raw, F.to_json(W.raw_metadata("p"))), (cortex, F.to_json(W.cortex_metadata("c"))), (dicom, F.to_json(W.dicom_metadata("d"))), (wasm, F.to_json(module)), (kind == "macho", F.to_json(macho)), otherwise=F.lit("{}")),
        "entry_point": _by_kind((cortex, F.col("c.reset_handler")), (objects, f("entry_point")), otherwise=F.lit(None).cast("string")),
        "code_sections": of_object("code_sections", sections),
        "parse_error": F.when(objects, f("error")),
    }
    # Versions and licences of plain kinds are read from the first extraction alone.
    strings = F.when(objects, F.concat(own, F.coalesce(f("strings"), _empty()))).otherwise(F.col("_all"))
    described = F.when(plain, own).otherwise(strings)
    return _record(staged, names, fields, strings, F.coalesce(f("versions"), _empty()), described)


def _lines(blobs: DataFrame, names: list[str], kind: str) -> DataFrame:
    """Intel HEX and S-records: the blob's strings, then those of its data, then the header."""
    hexadecimal = kind == "intel-hex"
    own = blobs.where(F.col("kind") == kind)
    contents = own.select("hash_sha256", "content").dropDuplicates(["hash_sha256"])
    summary = (W.ihex_summary if hexadecimal else W.srec_summary)(contents, "hash_sha256").withColumnRenamed("key", "hash_sha256")
    joined = own.join(summary, "hash_sha256", "left")
    inner = F.coalesce(B.extract_strings(F.col("data")), _empty())
    header = _empty() if hexadecimal else F.filter(F.array("header"), lambda h: h.isNotNull())
    table, architectures = (G.INTEL_HEX, G.INTEL_HEX_ARCHITECTURES) if hexadecimal else (G.SREC, G.SREC_ARCHITECTURES)
    joined = joined.withColumn("_all", F.concat(F.col("own"), inner, header))
    joined = joined.withColumn("_hints", G.string_labels(F.col("_all"), table))
    strings, hints = F.col("_all"), F.col("_hints")
    metadata = F.struct(
        F.lit("intel_hex" if hexadecimal else "motorola_srec").alias("hex_format" if hexadecimal else "record_format"),
        F.coalesce("total_data_bytes", F.lit(0)).alias("total_data_bytes"), "memory_segments", "entry_points", "start_address", "memory_range", hints.alias("device_hints"),
        F.lit("intel_hex_firmware" if hexadecimal else "srec_firmware").alias("analysis_type"),
    )
    fields = {
        "format": F.lit("intel-hex" if hexadecimal else "motorola-srec"),
        "architecture": G.last_architecture(hints, architectures, "embedded"),
        "languages": F.array(F.lit("Firmware")),
        "detected_symbols": _empty(),
        "imports": _empty(),
        "exports": _empty(),
        "linked_libraries": _empty(),
        "static_linked": F.lit(True),
        "metadata": F.to_json(metadata),
        "entry_point": F.col("entry_point"),
        "code_sections": F.array().cast("array<struct<name:string,start_address:bigint,end_address:bigint,size:bigint,permissions:string,section_type:string>>"),
        "parse_error": F.lit(None).cast("string"),
    }
    return _record(joined, names, fields, strings)


def analyze(blobs: DataFrame, twice: bool = True, compat: bool = True) -> DataFrame:
    """One record for each row of (file_name, content, ...); columns besides the content stay.

    twice repeats the strings of raw, Cortex-M and DICOM blobs, which are extracted again by
    their own analysis. compat labels as WebAssembly what a reader of containers cannot follow; without it such a blob
    keeps its kind; parse_error is set in either case. Sets are sorted; random ids and the time of analysis are left out.
    blobs are read twice, once for the line formats, when this is called, and once for all others, when the result is.
    """
    content = F.col("content")
    names = [c for c in blobs.columns if c != "content"]
    base = blobs.withColumns({"kind": sniff.kind(content), "own": B.extract_strings(content), "hash_sha256": B.sha256(content)})
    lined = F.col("kind").isin("intel-hex", "srec")
    lines = settled(base.where(lined))
    parts = [_blocks(base.where(~F.coalesce(lined, F.lit(False))), names, twice, compat), *(_lines(lines, names, kind) for kind in ("intel-hex", "srec"))]
    return reduce(DataFrame.unionByName, parts)


def compare(pairs: DataFrame, analyses: DataFrame, key: str = "file_name") -> DataFrame:
    """The differences of pairs (file1_name, file2_name): sizes, hashes, and what the second adds and lacks.

    The names of pairs are values of key, which tells blobs apart: the path where files share names.
    """
    side = lambda n: analyses.select(*(F.col(c).alias(f"file{n}_{a}") for c, a in ((key, "name"), ("size_bytes", "size"), ("hash_sha256", "sha256"))), F.struct("imports", "exports", F.col("detected_symbols").alias("symbols")).alias(f"s{n}"))
    joined = pairs.select("file1_name", "file2_name").join(side(1), "file1_name").join(side(2), "file2_name")
    sets = []
    for name in ("imports", "exports", "symbols"):
        sets.append(F.array_sort(F.array_except(f"s2.{name}", f"s1.{name}")).alias(f"{name}_added"))
        sets.append(F.array_sort(F.array_except(f"s1.{name}", f"s2.{name}")).alias(f"{name}_removed"))
    return joined.select(
        "file1_name", "file1_size", "file1_sha256", "file2_name", "file2_size", "file2_sha256", (F.col("file1_size") - F.col("file2_size")).alias("size_diff_bytes"), *sets
    )
