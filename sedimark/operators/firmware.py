"""Firmware images: Intel HEX and S-record lines, Cortex-M vectors, DICOM tags, raw blobs.

Lines become rows keyed by their blob; the bases that Intel HEX carries from line to
line are windows over a blob's lines, and everything else is an aggregate of them. Only
blobs of the two line formats are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.blobs import entropy, extract_strings, latin1, text_ratio
from sedimark.operators import signatures as G
from sedimark.operators import sniff

EDGES = " \t\r\n\f\x0b"
VECTORS = (
    "Initial_SP", "Reset_Handler", "NMI_Handler", "HardFault_Handler", "MemManage_Handler", "BusFault_Handler", "UsageFault_Handler",
    "Reserved", "Reserved", "Reserved", "Reserved", "SVC_Handler", "DebugMon_Handler", "Reserved", "PendSV_Handler", "SysTick_Handler",
)
DICOM_TAGS, DICOM_SAMPLE = 21, 10


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def _hex_pairs(digits: Column) -> Column:
    """The valid bytes of a string of digit pairs, joined; pairs that are no hexadecimal are left out."""
    return F.array_join(F.filter(F.regexp_extract_all(digits, F.lit("(?s).."), F.lit(0)), lambda p: p.rlike("^[0-9A-Fa-f]{2}$")), "")


def lines(blobs: DataFrame, key: str, content: str, first: str) -> DataFrame:
    """(key, pos, line): trimmed lines that begin with ``first``."""
    split = F.split(latin1(F.col(content)), "\n")
    found = blobs.select(F.col(key).alias("key"), F.posexplode(split).alias("pos", "line"))
    return found.select("key", "pos", F.btrim("line", F.lit(EDGES)).alias("line")).where(F.startswith("line", F.lit(first)))


def ihex_records(blobs: DataFrame, key: str = "file_name", content: str = "content") -> DataFrame:
    """(key, pos, type, address, size, data, start): the records up to the end record.

    address is that of data records, with the last linear and segment bases before them;
    start that of start records. Lines of a wrong length or without a sound head are left out.
    """
    found = lines(blobs, key, content, ":").where(F.col("line").rlike("^:[0-9A-Fa-f]{8}") & (F.length("line") >= 11))
    n = _number(F.substring("line", 2, 2))
    parsed = found.select(
        "key", "pos", n.alias("n"), F.length("line").alias("len"), _number(F.substring("line", 4, 4)).alias("at"), _number(F.substring("line", 8, 2)).alias("type"),
        _hex_pairs(F.expr("substring(line, 10, length(line) - 11)")).alias("data"),
    ).where(F.col("len") == 11 + 2 * F.col("n"))
    size = (F.length("data") / 2).cast("bigint")
    order = Window.partitionBy("key").orderBy("pos")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("type") == 1).cast("int")).over(before), F.lit(0))
    base = lambda t, shift: F.coalesce(F.last(F.when((F.col("type") == t) & (size >= 2), _number(F.substring("data", 1, 4)) * shift), ignorenulls=True).over(so_far), F.lit(0))
    segment = F.when((F.col("type") == 3) & (size >= 4), _number(F.substring("data", 1, 4)) * 16 + _number(F.substring("data", 5, 4)))
    start = F.coalesce(segment, F.when((F.col("type") == 5) & (size >= 4), _number(F.substring("data", 1, 8))))
    return (
        parsed.withColumns({"ended": ended, "linear": base(4, 1 << 16), "segment": base(2, 16)})
        .where("ended = 0 and type <> 1")
        .select("key", "pos", "type", F.when(F.col("type") == 0, F.col("linear") + F.col("segment") + F.col("at")).alias("address"), size.alias("size"), "data", start.alias("start"))
    )


def srec_records(blobs: DataFrame, key: str = "file_name", content: str = "content") -> DataFrame:
    """(key, pos, type, address, size, data, start, start_text, header) of S-record lines."""
    found = lines(blobs, key, content, "S").where(F.col("line").rlike("^S.[0-9A-Fa-f]{2}"))
    count, kind = _number(F.substring("line", 3, 2)), F.substring("line", 2, 1)
    size = F.greatest(count - 3, F.lit(0))
    sound = lambda digits: F.col("line").rlike(f"^....[0-9A-Fa-f]{{{digits}}}")
    number = lambda digits: _number(F.expr(f"substring(line, 5, {digits})"))
    data = F.when((kind == "1") & sound(4), F.when(F.length("line") >= 8 + 2 * size, _hex_pairs(F.expr("substring(line, 9, int(2 * greatest(conv(substring(line, 3, 2), 16, 10) - 3, 0)))"))).otherwise(""))
    header = F.btrim(F.decode(F.unhex(F.when(F.length("line") > 10, _hex_pairs(F.expr("substring(line, 9, length(line) - 10)")))), "ISO-8859-1"), F.lit(EDGES))
    start, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for code, digits in (("7", 8), ("8", 6), ("9", 4)):
        fits = (kind == code) & sound(digits)
        start = F.when(fits, number(digits)).otherwise(start)
        text = F.when(fits, F.format_string(f"0x%0{digits}X", number(digits))).otherwise(text)
    return found.select(
        "key", "pos", kind.alias("type"), F.when((kind == "1") & sound(4), number(4)).alias("address"), F.when((kind == "1") & sound(4), size).alias("size"),
        data.alias("data"), start.alias("start"), text.alias("start_text"), F.when((kind == "0") & (header != ""), header).alias("header"),
    )


def _in_order(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"])


def _summary(records: DataFrame, prefix: str, starts: Column, width: int, extra: dict[str, Column]) -> DataFrame:
    data = F.col("address").isNotNull()
    segment = F.when(data, F.struct(F.format_string(f"0x%0{width}X", F.col("address")).alias("address"), "size", F.lit(prefix).alias("type")))
    return records.groupBy("key").agg(
        F.coalesce(F.sum(F.when(data, F.col("size"))), F.lit(0)).alias("total_data_bytes"),
        F.min("address").alias("min_address"),
        F.max(F.col("address") + F.col("size")).alias("max_address"),
        F.filter(_in_order(segment), lambda s: s.isNotNull()).alias("memory_segments"),
        F.filter(_in_order(starts), lambda s: s.isNotNull()).alias("entry_points"),
        F.max_by("start", F.when(F.col("start").isNotNull(), F.col("pos"))).alias("start"),
        F.unhex(F.array_join(_in_order(F.when(data, F.col("data")).otherwise("")), "")).alias("data"),
        *(c.alias(n) for n, c in extra.items()),
    )


def ihex_summary(blobs: DataFrame, key: str = "file_name", content: str = "content") -> DataFrame:
    """One row for each blob with records: bytes, range, segments, entry points, data."""
    return _ranged(_summary(ihex_records(blobs, key, content), "data", F.when(F.col("start").isNotNull(), F.format_string("0x%08X", F.col("start"))), 8, {}))


def srec_summary(blobs: DataFrame, key: str = "file_name", content: str = "content") -> DataFrame:
    header = {"header": F.max_by("header", F.when(F.col("header").isNotNull(), F.col("pos")))}
    return _ranged(_summary(srec_records(blobs, key, content), "data_16bit", F.col("start_text"), 4, header))


def _ranged(summary: DataFrame) -> DataFrame:
    address = lambda c: F.when(F.col(c).isNotNull(), F.format_string("0x%08X", F.col(c)))
    spread = F.coalesce(F.col("max_address") - F.col("min_address"), F.lit(0))
    spans = F.struct(address("min_address").alias("min_address"), address("max_address").alias("max_address"), spread.alias("span_bytes"))
    return summary.withColumns({"memory_range": spans, "start_address": address("start"), "entry_point": F.try_element_at("entry_points", F.lit(-1))})


def with_cortex_m(df: DataFrame, content_column: str = "content", into: str = "r") -> DataFrame:
    """df with vectors, handlers, regions, RTOS and peripherals of Cortex-M images."""
    content = F.col(content_column)
    long = F.length(content) >= 256
    digits = F.hex(F.substring(content, 1, 64))
    number = lambda i: F.conv(F.concat(*(F.substring(digits, i * 8 + at, F.lit(2)) for at in (7, 5, 3, 1))), 16, 10).cast("bigint")
    df = df.withColumn("_words", F.when(long, F.transform(F.sequence(F.lit(0), F.lit(15)), number)))
    word = lambda i: F.get("_words", i)
    shown = lambda v: F.format_string("0x%08X", v)
    no_handlers = "array<struct<name:string,address:string,thumb_mode:boolean,vector_index:int>>"
    stack, reset = word(F.lit(0)), word(F.lit(1))
    target = reset.bitwiseAND(F.lit(0xFFFFFFFE))
    resets = long & (target > 0) & (target < 0x08100000)
    names = F.array(*map(F.lit, VECTORS))
    entries = F.transform("_words", lambda v, i: F.struct(i.alias("index"), F.get(names, i).alias("name"), shown(v).alias("address"), shown(v).alias("raw_value")))
    handler = lambda name, v, i: F.struct(name.alias("name"), shown(v.bitwiseAND(F.lit(0xFFFFFFFE))).alias("address"), (v.bitwiseAND(F.lit(1)) == 1).alias("thumb_mode"), i.alias("vector_index"))
    first = F.when(resets, F.array(handler(F.lit("Reset_Handler"), reset, F.lit(None).cast("int")))).otherwise(F.array().cast(no_handlers))
    live = F.filter(F.sequence(F.lit(1), F.lit(15)), lambda i: word(i).bitwiseAND(F.lit(0xFFFFFFFE)).between(0x08000001, 0x080FFFFF))
    handlers = F.when(long, F.concat(first, F.transform(live, lambda i: handler(F.get(names, i), word(i), i)))).otherwise(F.array().cast(no_handlers))
    staged = df.withColumns({"_strings": extract_strings(content), "_handlers": handlers}).withColumn("_rtos", G.label_set(F.col("_strings"), G.RTOS))
    handlers, rtos = F.col("_handlers"), F.col("_rtos")
    ram = F.when(
        long & stack.between(0x20000000, 0x20100000),
        F.struct(F.lit("RAM").alias("type"), F.lit("0x20000000").alias("start_address"), F.lit("SRAM").alias("purpose"), F.concat(F.floor((stack - 0x20000000) / 1024).cast("string"), F.lit("KB")).alias("size")),
    )
    flash, system = (F.struct(F.lit(t).alias("type"), F.lit(a).alias("start_address"), F.lit(p).alias("purpose"), F.lit(s).cast("string").alias("size")) for t, a, p, s in (("Flash", "0x08000000", "Program Flash Memory", "64KB-2MB"), ("System", "0xE0000000", "System Control Space", None)))
    report = F.struct(
        F.when(long, entries).otherwise(F.array().cast("array<struct<index:int,name:string,address:string,raw_value:string>>")).alias("vectors"),
        handlers.alias("interrupt_handlers"),
        F.when(long, shown(stack)).alias("stack_pointer"),
        F.when(resets, shown(target)).alias("reset_handler"),
        rtos.alias("rtos_detected"),
        F.filter(F.array(ram, flash, system), lambda r: r.isNotNull()).alias("memory_regions"),
        G.peripherals(content).alias("peripheral_indicators"),
        F.array().cast("array<string>").alias("disassembly"),
        F.size(handlers).alias("total_interrupt_handlers"),
        (F.size(rtos) > 0).alias("has_rtos"),
        F.exists(rtos, lambda r: F.contains(r, F.lit("HAL"))).alias("has_hal"),
    )
    return staged.withColumn(into, report).drop("_words", "_strings", "_handlers", "_rtos")


def dicom_tags(content: Column, most: int = DICOM_TAGS) -> Column:
    """(group, element) of the first tags behind the preamble, read every two bytes."""
    digits = F.hex(F.substring(content, 133, 2 * most + 12))
    n = F.least(F.lit(most), F.greatest(F.lit(0), F.ceil((F.length(content) - 132 - 8) / 2))).cast("int")
    pair = lambda at: F.concat(F.substring(digits, at + 3, F.lit(2)), F.substring(digits, at + 1, F.lit(2)))
    tag = lambda i: F.struct(pair(i * 4).alias("group"), pair(i * 4 + 4).alias("element"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), tag)).otherwise(F.array().cast("array<struct<group:string,element:string>>"))


def with_dicom(df: DataFrame, content_column: str = "content", into: str = "r") -> DataFrame:
    """df with tags, compliance, protocols, components, security and risk of DICOM files."""
    content = F.col(content_column)
    # One more tag is looked at than is kept.
    staged = df.withColumns({"_tags": dicom_tags(content), "_seen": dicom_tags(content, DICOM_TAGS + 1), "_strings": extract_strings(content)})
    tags, seen, strings = F.col("_tags"), F.col("_seen"), F.col("_strings")
    patient = F.exists(seen, lambda t: (t["group"] == "0010") & t["element"].isin("0010", "0020"))
    maker = F.exists(seen, lambda t: (t["group"] == "0008") & (t["element"] == "0070"))
    extra = F.filter(F.array(F.when(patient, "Patient Data"), F.when(maker, "Manufacturer")), lambda x: x.isNotNull())
    staged = staged.withColumns({"_compliance": G.label_set(strings, G.COMPLIANCE), "_security": G.label_set(strings, G.SECURITY), "_protocols": F.array_sort(F.array_union(G.label_set(strings, G.PROTOCOLS), extra)), "_patient": patient})
    compliance, security, protocols, patient = (F.col(c) for c in ("_compliance", "_security", "_protocols", "_patient"))
    risk = F.when((F.size(compliance) >= 2) & (F.size(security) >= 2), "Low").when(F.size(compliance) >= 1, "Medium").when(patient, "High").otherwise("Medium")
    shown = lambda t: F.struct(F.concat(F.lit("0x"), t["group"]).alias("group"), F.concat(F.lit("0x"), t["element"]).alias("element"), F.concat(F.lit("("), t["group"], F.lit(","), t["element"], F.lit(")")).alias("tag"))
    report = F.struct(
        F.size(tags).alias("dicom_tags_found"),
        F.transform(F.slice(tags, 1, DICOM_SAMPLE), shown).alias("sample_tags"),
        patient.alias("patient_data_detected"),
        compliance.alias("fda_compliance"),
        protocols.alias("medical_protocols"),
        risk.alias("risk_assessment"),
        G.label_set(strings, G.COMPONENTS).alias("embedded_components"),
        security.alias("security_features"),
        G.manufacturers(content).alias("device_identifiers"),
        (F.size(compliance) == 0).alias("requires_fda_clearance"),
        (patient | F.exists(security, lambda s: s.isin("Data Encryption", "Access Control"))).alias("hipaa_relevant"),
        F.exists(protocols, lambda p: F.contains(p, F.lit("DICOM"))).alias("dicom_compliant"),
    )
    return staged.withColumn(into, report).drop("_tags", "_seen", "_strings", "_compliance", "_security", "_protocols", "_patient")


def small_format(content: Column) -> Column:
    """Format of a blob under the smallest size that is parsed."""
    texty = F.coalesce(text_ratio(content) > 0.8, F.lit(False))
    script = F.startswith(content, F.lit(b"#!"))
    return (
        F.when(texty, F.when(script, "script").otherwise("text/small"))
        .when(sniff.compression(content).isNotNull(), "compressed-firmware")
        .when(F.size(G.firmware_indicators(content)) > 0, "firmware-blob")
        .otherwise("micro-binary")
    )


def small_languages(content: Column) -> Column:
    texty = F.coalesce(text_ratio(content) > 0.8, F.lit(False))
    raw = latin1(content)
    has = lambda *words: raw.rlike("|".join(words))
    text = F.filter(
        F.array(F.when(F.startswith(content, F.lit(b"#!")), "script"), F.when(has("function", "def "), "script"), F.when(has("#include", "int main"), "C/C++"), F.when(has("pub fn", "fn main"), "Rust")),
        lambda x: x.isNotNull(),
    )
    return (
        F.when(texty, text)
        .when(sniff.compression(content).isNotNull(), F.array(F.lit("Compressed Binary")))
        .when(F.size(G.firmware_indicators(content)) > 0, F.array(F.lit("Firmware")))
        .otherwise(F.array().cast("array<string>"))
    )


def with_raw_report(df: DataFrame, strings: Column, content: str = "content", into: str = "r") -> DataFrame:
    """df with characteristics, hints and indicators of blobs of no known format."""
    blob = F.col(content)
    staged = df.withColumns({"_ratio": text_ratio(blob), "_bits": entropy(blob), "_found": G.firmware_indicators(blob), "_hints": G.architecture_hints(blob), "_packed": sniff.compression(blob)})
    ratio, bits, found, hints, packed = (F.col(c) for c in ("_ratio", "_bits", "_found", "_hints", "_packed"))
    report = F.struct(
        F.length(blob).cast("bigint").alias("size_bytes"),
        ratio.alias("ascii_ratio"),
        bits.alias("entropy"),
        (bits > 7.5).alias("likely_encrypted"),
        ((bits > 7.0) & packed.isNull()).alias("likely_compressed"),
        hints.alias("architecture_hints"),
        F.when(F.size(hints) > 0, F.array_join(hints, ", ")).otherwise("unknown").alias("architecture"),
        found.alias("firmware_indicators"),
        F.filter(F.array(packed), lambda x: x.isNotNull()).alias("compression_detected"),
        G.byte_labels(blob, G.CRYPTO).alias("crypto_indicators"),
        G.version_hints(strings).alias("version_hints"),
        ((F.size(found) > 0) | F.coalesce(ratio < 0.1, F.lit(False))).alias("static_linked"),
        F.when(F.size(hints) > 0, "medium").otherwise("low").alias("architecture_confidence"),
        F.when(F.size(found) > 0, "high").otherwise("low").alias("firmware_confidence"),
        F.when(F.coalesce(ratio > 0.8, F.lit(False)), "high").when(F.size(found) > 0, "medium").otherwise("low").alias("format_confidence"),
    )
    return staged.withColumn(into, report).drop("_ratio", "_bits", "_found", "_hints", "_packed")


def raw_metadata(r: str = "r") -> Column:
    """The report of with_raw_report() in its published layout."""
    f = lambda *names: [F.col(f"{r}.{n}").alias(n) for n in names]
    confidence = F.struct(*(F.col(f"{r}.{c}").alias(n) for n, c in (("architecture", "architecture_confidence"), ("firmware_type", "firmware_confidence"), ("format", "format_confidence"))))
    return F.struct(
        F.lit("raw_firmware_blob").alias("analysis_type"),
        F.struct(*f("size_bytes", "ascii_ratio", "entropy", "likely_encrypted", "likely_compressed")).alias("file_characteristics"),
        *f("architecture_hints", "firmware_indicators", "compression_detected", "crypto_indicators", "version_hints"),
        confidence.alias("detection_confidence"),
    )


def cortex_metadata(r: str = "r") -> Column:
    f = lambda *names: [F.col(f"{r}.{n}").alias(n) for n in names]
    n = F.size(f"{r}.vectors")
    performed = F.col(f"{r}.reset_handler").isNotNull()
    return F.struct(
        F.lit("arm_cortex_m").alias("firmware_type"),
        F.struct(F.col(f"{r}.vectors").alias("entries"), (n * 4).alias("size_bytes"), n.alias("total_vectors")).alias("vector_table"),
        *f("interrupt_handlers", "stack_pointer", "reset_handler", "rtos_detected", "memory_regions", "peripheral_indicators"),
        F.lit("arm_cortex_m_firmware").alias("analysis_type"),
        F.struct(F.lit(False).alias("capstone_available"), F.col(f"{r}.disassembly").alias("analysis_info")).alias("disassembly"),
        F.struct(*f("total_interrupt_handlers", "has_rtos", "has_hal"), performed.alias("disassembly_performed")).alias("statistics"),
    )


def dicom_metadata(r: str = "r") -> Column:
    f = lambda *names: [F.col(f"{r}.{n}").alias(n) for n in names]
    return F.struct(
        F.lit("dicom_medical_imaging").alias("medical_device_type"),
        F.struct(F.lit(True).alias("is_dicom_file"), *f("dicom_tags_found", "sample_tags", "patient_data_detected")).alias("dicom_analysis"),
        F.struct(*f("fda_compliance", "medical_protocols", "risk_assessment")).alias("compliance_indicators"),
        *f("embedded_components", "security_features", "device_identifiers"),
        F.lit("dicom_medical_imaging").alias("analysis_type"),
        F.struct(*f("requires_fda_clearance", "hipaa_relevant", "dicom_compliant")).alias("regulatory_notes"),
    )
