"""Signature families over strings and bytes, as tables of (label, needles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.blobs import has, latin1

Table = tuple[tuple[str, tuple[str, ...]], ...]

# Labels and what a string, in lower case, must contain one of.
INTEL_HEX: Table = (
    ("bootloader", ("boot",)),
    ("interrupt_handler", ("interrupt", "isr")),
    ("peripheral_driver", ("uart", "spi", "i2c")),
    ("avr_microcontroller", ("atmega", "avr")),
    ("arm_cortex_m", ("stm32", "cortex")),
    ("pic_microcontroller", ("pic",)),
)
INTEL_HEX_ARCHITECTURES = {"avr_microcontroller": "avr", "arm_cortex_m": "arm_cortex_m", "pic_microcontroller": "pic"}
SREC: Table = (
    ("bootloader", ("boot",)),
    ("interrupt_handler", ("interrupt", "isr")),
    ("automotive_ecu", ("can", "ecu", "automotive")),
    ("motorola_mcu", ("motorola", "freescale", "nxp")),
    ("motorola_68k", ("68k", "68000")),
    ("coldfire_mcu", ("coldfire",)),
    ("powerpc_mcu", ("powerpc", "ppc")),
)
SREC_ARCHITECTURES = {"automotive_ecu": "automotive", "motorola_68k": "m68k", "coldfire_mcu": "coldfire", "powerpc_mcu": "powerpc"}
RTOS: Table = (
    ("FreeRTOS", ("freertos",)),
    ("ARM RTX", ("rtx",)),
    ("ThreadX", ("threadx", "tx_thread_create")),
    ("Zephyr RTOS", ("zephyr", "k_thread_create")),
    ("CMSIS", ("cmsis", "__main")),
    ("STM32 HAL", ("hal_", "stm32")),
)
COMPLIANCE: Table = (
    ("FDA Regulatory", ("fda", "510k", "pma")),
    ("CE Marking", ("ce mark",)),
    ("ISO 13485", ("iso 13485", "iso13485")),
    ("IEC 62304", ("iec 62304", "iec62304")),
    ("HIPAA Compliance", ("hipaa",)),
)
PROTOCOLS: Table = (
    ("DICOM Protocol", ("dicom",)),
    ("HL7/FHIR", ("hl7", "fhir")),
    ("PACS System", ("pacs",)),
    ("Modality Worklist", ("modality", "worklist")),
    ("MPPS Protocol", ("mpps",)),
)
COMPONENTS: Table = (
    ("Qt Framework", ("qt",)),
    ("OpenCV", ("opencv",)),
    ("VTK Visualization", ("vtk",)),
    ("ITK Medical Imaging", ("itk",)),
    ("GDCM DICOM Library", ("gdcm",)),
    ("DCMTK DICOM Toolkit", ("dcmtk",)),
    ("Cornerstone Medical Imaging", ("cornerstone",)),
)
SECURITY: Table = (
    ("Data Encryption", ("encrypt",)),
    ("Digital Signatures", ("signature",)),
    ("Audit Logging", ("audit log", "audit trail")),
    ("Access Control", ("access control", "authentication")),
    ("TLS/SSL", ("tls", "ssl")),
)
# Labels and the bytes that a blob must contain.
CRYPTO = {"AES": b"AES", "RSA": b"RSA", "SHA": b"SHA", "OpenSSL": b"OpenSSL", "mbedtls": b"mbedtls", "WolfSSL": b"wolfSSL"}
DEVICES = {"ESP32": b"ESP32", "Arduino": b"Arduino", "Raspberry Pi": b"Raspberry Pi", "STM32": b"STM32", "Nordic": b"Nordic", "Qualcomm": b"Qualcomm", "Broadcom": b"Broadcom"}
MANUFACTURERS = {"GE Healthcare": "ge medical", "Siemens": "siemens", "Philips": "philips", "Canon Medical": "canon", "Fujifilm": "fujifilm", "Hologic": "hologic", "Carestream": "carestream", "Agfa": "agfa"}
PERIPHERALS = {0x40000000: "APB1 Peripherals", 0x40010000: "APB2 Peripherals", 0x40020000: "AHB1 Peripherals", 0x50000000: "AHB2 Peripherals", 0xE0000000: "Cortex-M System"}
THUMB = (b"\x00\xbf", b"\x70\x47", b"\x08\x68")
X86 = (b"\x55\x89\xe5", b"\x48\x89\xe5", b"\xeb\xfe")
#: Needles of boot loaders, in lower case; longer ones that hold them add nothing.
BOOT = "u-boot|grub|boot|loader|spl|mlo"


def _some(low: Column, needles: tuple[str, ...]) -> Column:
    found = F.contains(low, F.lit(needles[0]))
    for n in needles[1:]:
        found = found | F.contains(low, F.lit(n))
    return found


def _kept(*labels: Column) -> Column:
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def string_labels(strings: Column, table: Table) -> Column:
    """Labels of all strings, in the order of strings and then of the table, repeats included."""

    def of(string: Column) -> Column:
        low = F.lower(string)
        found = []
        for label, needles in table:
            fits = _some(low, needles)
            if label == "pic_microcontroller":
                fits = fits & _some(low, ("16", "18"))
            found.append(F.when(fits, label))
        return _kept(*found)

    return F.flatten(F.transform(strings, of))


def label_set(strings: Column, table: Table) -> Column:
    """Distinct labels, sorted. Over the joined strings: a needle has no line end, so it fits within one."""
    low = F.lower(F.array_join(strings, "\n"))
    return F.array_sort(_kept(*(F.when(_some(low, needles), label) for label, needles in table)))


def last_architecture(labels: Column, names: dict[str, str], otherwise: str) -> Column:
    """What the last label that names an architecture names."""
    named = F.filter(labels, lambda x: x.isin(*names))
    last = F.element_at(named, -1)
    found = F.lit(otherwise)
    for label, name in names.items():
        found = F.when(last == label, name).otherwise(found)
    return F.when(F.size(named) > 0, found).otherwise(otherwise)


def byte_labels(content: Column, table: dict[str, bytes]) -> Column:
    return _kept(*(F.when(has(content, needle), label) for label, needle in table.items()))


def bootloader(content: Column) -> Column:
    return F.lower(latin1(content)).rlike(BOOT)


def firmware_indicators(content: Column) -> Column:
    return F.concat(_kept(F.when(bootloader(content), "bootloader")), byte_labels(content, DEVICES))


def manufacturers(content: Column) -> Column:
    low = F.lower(latin1(content))
    return _kept(*(F.when(F.contains(low, F.lit(needle)), label) for label, needle in MANUFACTURERS.items()))


def peripherals(content: Column) -> Column:
    found = (F.when(has(content, base.to_bytes(4, "little")), F.struct(F.lit(f"0x{base:08X}").alias("base_address"), F.lit(name).alias("name"))) for base, name in PERIPHERALS.items())
    return _kept(*found)


def architecture_hints(content: Column) -> Column:
    """Instruction patterns of four families, in a fixed order; none in fewer than four bytes."""
    raw = latin1(content)
    labels = _kept(
        F.when(has(content, *THUMB), "ARM Thumb"),
        F.when(has(content, *X86), "x86"),
        F.when(raw.rlike(r"(?s)\x27\xBD..|..\xBD\x27"), "MIPS"),
        F.when(raw.rlike(r"(?s)\x94\x21..|..\x21\x94"), "PowerPC"),
    )
    return F.when(F.length(content) >= 4, labels).otherwise(F.array().cast("array<string>"))


def version_hints(strings: Column) -> Column:
    """Strings of 3 to 19 bytes with a digit, and a dot or a v."""
    return F.filter(strings, lambda s: F.octet_length(s).between(3, 19) & s.rlike("[0-9]") & s.rlike("[.vV]"))
