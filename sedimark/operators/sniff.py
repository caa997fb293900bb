"""Kind and MIME type of blobs: one ordered CASE over magic bytes, lines and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.blobs import begins, latin1, le_u32

TINY = 50

# Magic bytes by name.
COMPRESSED = {
    "gzip": b"\x1f\x8b",
    "lz4": b"\x04\x22\x4d\x18",
    "bzip2": b"BZh",
    "xz": b"\xfd7zX",
    "zstd": b"\x28\xb5\x2f\xfd",
    "comp": b"COMP",
}
EXECUTABLE = {
    "elf": (b"\x7fELF",),
    "pe": (b"MZ",),
    "macho": (b"\xfe\xed\xfa\xce", b"\xce\xfa\xed\xfe"),
    "wasm": (b"\x00asm",),
    "archive": (b"!<arch>\n",),
}
LATER_EXECUTABLE = {
    "macho": (b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf"),
    "macho-fat": (b"\xca\xfe\xba\xbe",),
}
#: The usual MIME table by what stands at an offset; the first that fits.
MIME = (
    ("application/x-executable", 0, (b"\x7fELF",)),
    ("application/vnd.microsoft.portable-executable", 0, (b"MZ",)),
    ("application/wasm", 0, (b"\x00asm",)),
    ("application/epub+zip", 30, (b"mimetypeapplication/epub+zip",)),
    ("application/x-mobipocket-ebook", 60, (b"BOOKMOBI",)),
    ("image/jpeg", 0, (b"\xff\xd8\xff",)),
    ("image/jp2", 0, (b"\x00\x00\x00\x0cjP  \r\n\x87\n",)),
    ("image/png", 0, (b"\x89PNG",)),
    ("image/gif", 0, (b"GIF",)),
    ("image/webp", 8, (b"WEBP",)),
    ("image/tiff", 0, (b"II*\x00", b"MM\x00*")),
    ("image/bmp", 0, (b"BM",)),
    ("image/vnd.adobe.photoshop", 0, (b"8BPS",)),
    ("image/vnd.microsoft.icon", 0, (b"\x00\x00\x01\x00",)),
    ("image/avif", 4, (b"ftypavif",)),
    ("image/heif", 4, (b"ftypheic", b"ftypheix", b"ftypmif1", b"ftypmsf1")),
    ("video/x-m4v", 4, (b"ftypM4V",)),
    ("video/quicktime", 4, (b"ftypqt",)),
    ("audio/m4a", 4, (b"ftypM4A",)),
    ("video/mp4", 4, (b"ftypisom", b"ftypiso2", b"ftypmp41", b"ftypmp42", b"ftypavc1", b"ftypdash")),
    ("video/webm", 0, (b"\x1a\x45\xdf\xa3",)),
    ("video/x-msvideo", 8, (b"AVI ",)),
    ("video/x-ms-wmv", 0, (b"\x30\x26\xb2\x75\x8e\x66\xcf\x11",)),
    ("video/mpeg", 0, (b"\x00\x00\x01\xba", b"\x00\x00\x01\xb3")),
    ("video/x-flv", 0, (b"FLV\x01",)),
    ("audio/midi", 0, (b"MThd",)),
    ("audio/mpeg", 0, (b"ID3", b"\xff\xfb")),
    ("audio/ogg", 0, (b"OggS",)),
    ("audio/x-flac", 0, (b"fLaC",)),
    ("audio/x-wav", 8, (b"WAVE",)),
    ("audio/amr", 0, (b"#!AMR\n",)),
    ("audio/aac", 0, (b"\xff\xf1", b"\xff\xf9")),
    ("audio/x-aiff", 8, (b"AIFF",)),
    ("application/font-woff", 0, (b"wOFF", b"wOF2")),
    ("application/font-sfnt", 0, (b"\x00\x01\x00\x00\x00", b"OTTO")),
    ("application/x-ole-storage", 0, (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",)),
    ("application/zip", 0, (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")),
    ("application/x-tar", 257, (b"ustar",)),
    ("application/vnd.rar", 0, (b"Rar!\x1a\x07",)),
    ("application/gzip", 0, (b"\x1f\x8b\x08",)),
    ("application/x-bzip2", 0, (b"BZh",)),
    ("application/x-7z-compressed", 0, (b"7z\xbc\xaf\x27\x1c",)),
    ("application/pdf", 0, (b"%PDF",)),
    ("application/x-shockwave-flash", 0, (b"CWS", b"FWS")),
    ("application/rtf", 0, (b"{\\rtf",)),
    ("application/postscript", 0, (b"%!",)),
    ("application/vnd.sqlite3", 0, (b"SQLite format 3\x00", b"SQLi")),
    ("application/x-google-chrome-extension", 0, (b"Cr24",)),
    ("application/vnd.ms-cab-compressed", 0, (b"MSCF", b"ISc(")),
    ("application/vnd.debian.binary-package", 0, (b"!<arch>\ndebian-binary",)),
    ("application/x-unix-archive", 0, (b"!<arch>",)),
    ("application/x-compress", 0, (b"\x1f\xa0", b"\x1f\x9d")),
    ("application/x-lzip", 0, (b"LZIP",)),
    ("application/x-rpm", 0, (b"\xed\xab\xee\xdb",)),
    ("application/dicom", 128, (b"DICM",)),
    ("application/zstd", 0, (b"\x28\xb5\x2f\xfd",)),
    ("application/x-xz", 0, (b"\xfd7zXZ\x00",)),
    ("application/x-cpio", 0, (b"070701", b"070702", b"070707")),
    ("text/x-shellscript", 0, (b"#!",)),
    ("text/xml", 0, (b"<?xml ",)),
)
HTML_TAGS = ("!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE", "A", "STYLE", "TITLE", "B", "BODY", "BR", "P", "!--")
EXTENSIONS = {"exe": "application/x-msdownload", "dll": "application/x-msdownload", "so": "application/x-sharedlib", "a": "application/x-sharedlib", "wasm": "application/wasm", "bin": "application/octet-stream"}
OCTETS = "application/octet-stream"


def _first_lines(content: Column) -> Column:
    """The first five lines, trimmed; a blob is not split beyond them."""
    return F.transform(F.slice(F.split(latin1(content), "\n", 6), 1, 5), lambda s: F.btrim(s, F.lit(" \t\r\n\f\x0b")))


def is_intel_hex(content: Column) -> Column:
    """Of the first five lines one begins with a colon, and each is empty, begins so, or is hexadecimal."""
    lines = _first_lines(content)
    return F.exists(lines, lambda s: F.startswith(s, F.lit(":"))) & F.forall(lines, lambda s: (s == "") | F.startswith(s, F.lit(":")) | s.rlike("^[0-9A-Fa-f:]+$"))


def is_srecord(content: Column) -> Column:
    lines = _first_lines(content)
    return F.exists(lines, lambda s: F.startswith(s, F.lit("S"))) & F.forall(lines, lambda s: (s == "") | s.rlike("^S[0-9A-Fa-f]{3,}$"))


def is_cortex_m(content: Column) -> Column:
    """A stack pointer in RAM, then an odd reset address in flash."""
    stack, reset = le_u32(content, 0), le_u32(content, 4)
    return F.coalesce(stack.between(0x20000000, 0x20100000) & reset.between(0x08000000, 0x08100000) & (reset.bitwiseAND(F.lit(1)) == 1), F.lit(False))


def compression(content: Column) -> Column:
    """Name of the compression, without the firmware container; null of none."""
    found = F.lit(None).cast("string")
    for name, magic in reversed(COMPRESSED.items()):
        if name != "comp":
            found = F.when(begins(content, magic), name).otherwise(found)
    return F.when(F.length(content) >= 4, found)


def kind(content: Column) -> Column:
    """tiny, compressed, elf, pe, macho, macho-fat, wasm, archive, dicom, intel-hex, srec, cortex-m or raw; the first that fits."""
    found = F.when(F.length(content) < TINY, "tiny").when(begins(content, *COMPRESSED.values()), "compressed")
    for name, magic in EXECUTABLE.items():
        found = found.when(begins(content, *magic), name)
    found = found.when(F.substring(content, 129, 4) == F.lit(b"DICM"), "dicom")
    found = found.when(is_intel_hex(content), "intel-hex").when(is_srecord(content), "srec")
    for name, magic in LATER_EXECUTABLE.items():
        found = found.when(begins(content, *magic), name)
    return found.when(is_cortex_m(content), "cortex-m").otherwise("raw")


def fallback_mime(name: Column, content: Column) -> Column:
    """By four magics, then by what follows the last dot of the name, or the whole name without one."""
    found = (
        F.when(begins(content, b"\x7fELF"), "application/x-elf")
        .when(begins(content, b"MZ") & (F.length(content) >= 4), "application/x-msdownload")
        .when(begins(content, b"\xfe\xed\xfa\xce", b"\xce\xfa\xed\xfe"), "application/x-mach-binary")
        .when(begins(content, b"\x00asm"), "application/wasm")
    )
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    for known, mime in EXTENSIONS.items():
        found = found.when(extension == known, mime)
    return found.otherwise(OCTETS)


def sniffed_mime(content: Column) -> Column:
    """By the magic table; null if it has none."""
    head = F.ltrim(F.upper(latin1(F.substring(content, 1, 64))))
    html = head.rlike("^<(" + "|".join(HTML_TAGS) + ")[ >]")
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for mime, at, magic in MIME:
        there = begins(content, *magic) if at == 0 else F.substring(content, at + 1, len(magic[0])) == F.lit(magic[0])
        for other in magic[1:] if at else ():
            there = there | (F.substring(content, at + 1, len(other)) == F.lit(other))
        found = found.when(there, mime)
    return found.when(html, "text/html")


def mime(name: Column, content: Column) -> Column:
    return F.coalesce(sniffed_mime(content), fallback_mime(name, content))
