import json

from sedimark.operators import firmware as W
from sedimark.plans import analysis as A

SREC = b"""S00F000068656C6C6F202020202000003C
S11F00007C0802A6900100049421FFF07C6C1B787C8C23783C6000003863000026
S11F001C4BFFFFE5398000007D83637880010014382100107C0803A64E800020E9
S111003848656C6C6F20776F726C642E0A0042
S5030003F9
S9030000FC
"""
VECTORS = (0x20002000).to_bytes(4, "little") + (0x08000101).to_bytes(4, "little") + b"\x01\x02\x00\x08" * 62


def record(at: int, kind: int, data: bytes) -> str:
    return f":{len(data):02X}{at:04X}{kind:02X}{data.hex().upper()}00"


def blobs(spark, **named: bytes):
    return spark.createDataFrame([(k, bytes(v)) for k, v in named.items()], "file_name string, content binary")


def plain_ihex(text: str) -> list[tuple[int, int]]:
    linear = segment = 0
    found = []
    for line in text.split("\n"):
        line = line.strip()
        try:
            n, at, kind = int(line[1:3], 16), int(line[3:7], 16), int(line[7:9], 16)
        except ValueError:
            continue
        if line[:1] != ":" or len(line) != 11 + 2 * n:
            continue
        data = bytes.fromhex(line[9 : 9 + 2 * n])
        if kind == 0:
            found.append((linear + segment + at, n))
        elif kind == 1:
            break
        elif kind == 2:
            segment = int.from_bytes(data[:2], "big") << 4
        elif kind == 4:
            linear = int.from_bytes(data[:2], "big") << 16
    return found


def test_intel_hex_bases_end_and_bad_lines(spark):
    lines = [record(0, 4, b"\x08\x00"), record(0, 0, bytes(16)), ":0400", record(16, 2, b"\x10\x00"), record(16, 0, b"abcd"), record(0, 4, b"\x00\x01"), record(2, 0, b"z"), record(0, 3, b"\0\1\0\2"), record(0, 5, b"\0\0\1\0"), record(0, 1, b""), record(9, 0, b"never")]
    text = "\r\n".join(lines)
    df = blobs(spark, x=text.encode(), y="\n".join(lines[:2]).encode())
    found = [(r.address, r.size) for r in W.ihex_records(df).where("key = 'x' and address is not null").orderBy("pos").collect()]
    assert found == plain_ihex(text)
    s = {r.key: r for r in W.ihex_summary(df).collect()}
    assert s["x"].entry_points == ["0x00000012", "0x00000100"] and s["x"].entry_point == "0x00000100" and bytes(s["x"].data) == bytes(16) + b"abcdz"
    assert s["y"].memory_range.min_address == "0x08000000" and s["y"].entry_points == []


def test_srecords(spark):
    s = W.srec_summary(blobs(spark, x=SREC)).first()
    assert (s.total_data_bytes, len(s.memory_segments), s.entry_point, s.start_address) == (28 + 28 + 14, 3, "0x0000", "0x00000000")
    assert s.header.startswith("hello") and s.memory_segments[1].address == "0x001C"


def test_analysis_of_each_kind(spark):
    sample = blobs(
        spark, text=b"hello world", empty=b"", zeros=bytes(10_000), srec=SREC, cortex=VECTORS + b"FreeRTOS v10.4.3 stm32 hal_init\0" + bytes(300),
        gz=b"\x1f\x8b\x08\x00" + b"x" * 60, raw=b"U-Boot 2021.04 ESP32 AES OpenSSL 1.1.1 MIT License text" * 2, ar=b"!<arch>\n" + b" " * 60, bad=b"\x7fELF" + bytes(60), fat=b"\xca\xfe\xba\xbe" + bytes(60),
        dicom=bytes(128) + b"DICM\x10\x00\x10\x00" + b"Siemens hl7 fda encrypt iso 13485 tls " * 3,
        ihex="\n".join([record(0, 0, b"STM32 boot here!"), record(0, 1, b"")]).encode() + b"\n" * 20,
    )
    rows = {r.file_name: r for r in A.analyze(sample).collect()}
    assert len(rows) == 12
    formats = {k: r.format for k, r in rows.items()}
    assert formats == {
        "text": "text/small", "empty": "micro-binary", "zeros": "application/octet-stream", "srec": "motorola-srec", "cortex": "arm-cortex-m-firmware", "gz": "compressed-firmware", "raw": "application/octet-stream",
        "ar": "archive", "bad": "application/wasm", "fat": "macho-fat", "dicom": "dicom-file", "ihex": "intel-hex",
    }
    cortex = json.loads(rows["cortex"].metadata)
    assert rows["cortex"].entry_point == "0x08000100" and cortex["rtos_detected"] == ["FreeRTOS", "STM32 HAL"]
    assert cortex["statistics"]["total_interrupt_handlers"] == 1 + 15 and cortex["interrupt_handlers"][1]["name"] == "Reset_Handler"
    assert rows["ihex"].architecture == "arm_cortex_m" and json.loads(rows["ihex"].metadata)["device_hints"] == ["bootloader", "arm_cortex_m"]
    dicom = json.loads(rows["dicom"].metadata)
    assert dicom["compliance_indicators"]["risk_assessment"] == "Low" and dicom["dicom_analysis"]["patient_data_detected"] and dicom["device_identifiers"] == ["Siemens"]
    raw = json.loads(rows["raw"].metadata)
    assert raw["firmware_indicators"] == ["bootloader", "ESP32"] and raw["crypto_indicators"] == ["AES", "OpenSSL"] and rows["raw"].static_linked
    assert rows["raw"].embedded_strings == 2 * rows["raw"].embedded_strings[: len(rows["raw"].embedded_strings) // 2]
    assert rows["bad"].parse_error and rows["empty"].static_linked is False


def test_comparison(spark):
    rows = [("a", 10, "x", ["i", "j"], ["e"], ["s"]), ("b", 4, "y", ["j", "k", "k"], ["e"], [])]
    analyses = spark.createDataFrame(rows, "file_name string, size_bytes bigint, hash_sha256 string, imports array<string>, exports array<string>, detected_symbols array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a")], "file1_name string, file2_name string")
    found = {(r.file1_name, r.file2_name): r for r in A.compare(pairs, analyses).collect()}
    ab, ba, aa = found["a", "b"], found["b", "a"], found["a", "a"]
    assert (ab.size_diff_bytes, ab.imports_added, ab.imports_removed, ab.symbols_removed) == (6, ["k"], ["i"], ["s"])
    assert ab.imports_added == ba.imports_removed and aa.imports_added == aa.imports_removed == []


def test_files_of_one_name_keep_apart(spark, tmp_path):
    from sedimark.sources import blobs as S

    for folder, data in (("a", b"AAAA"), ("b", b"BBBBBB"), ("c", b"AAAA")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "fw.hex").write_bytes(b"\n".join([record(0, 0, data).encode(), record(0, 1, b"").encode()]) + b"\n" * 40)
    records = A.analyze(S.from_files(spark, str(tmp_path)))
    rows = {r.path.split("/")[-2]: r for r in records.collect()}
    assert len(rows) == 3 and {r.file_name for r in rows.values()} == {"fw.hex"}
    assert [json.loads(rows[k].metadata)["total_data_bytes"] for k in "abc"] == [4, 6, 4]
    assert [len(json.loads(rows[k].metadata)["memory_segments"]) for k in "abc"] == [1, 1, 1]
    paths = [rows[k].path for k in "abc"]
    pairs = spark.createDataFrame([(paths[0], paths[1]), (paths[0], paths[2])], "file1_name string, file2_name string")
    found = A.compare(pairs, records, key="path").collect()
    assert sorted(r.file1_sha256 == r.file2_sha256 for r in found) == [False, True]


def test_containers_that_cannot_be_followed(spark):
    sample = blobs(spark, bad=b"\x7fELF" + bytes(60))
    compat, plain = (A.analyze(sample, compat=c).collect()[0] for c in (True, False))
    assert (compat.format, plain.format) == ("application/wasm", "elf") and compat.parse_error and plain.parse_error
    from sedimark.functions import blobs as B

    assert compat.hash_blake3 == B.blake3_hex(b"\x7fELF" + bytes(60))
