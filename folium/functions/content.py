"""What a document is by its bytes, as one Column expression: signatures, a look into containers, the look of text.

The extension decides only between kinds of text that look alike, and where there is nothing to see.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions import columns as C

#: MIME type, offset, bytes and mask (hexadecimal; a mask of F looks at the whole).
SIGNATURES = (
    ("application/pdf", 0, "255044462D", "FFFFFFFFFF"), ("application/x-ole-storage", 0, "D0CF11E0A1B11AE1", "FFFFFFFFFFFFFFFF"), ("image/png", 0, "89504E470D0A1A0A", "FFFFFFFFFFFFFFFF"),
    ("image/jpeg", 0, "FFD8FF", "FFFFFF"), ("image/gif", 0, "474946383161", "FFFFFFFFF1FF"), ("application/gzip", 0, "1F8B08", "FFFFFF"), ("application/rtf", 0, "7B5C727466", "FFFFFFFFFF"),
    ("application/x-tar", 257, "7573746172", "FFFFFFFFFF"), ("image/webp", 0, "524946460000000057454250", "FFFFFFFF00000000FFFFFFFF"),
)
#: Entries by which archives of office documents are told.
OFFICE = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
TEXTS = ("csv", "log", "markdown", "md", "txt")
_HTML = r"(?is)\A(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body|title|meta|h[1-6]|table|div|p)\b"
_XHTML = r"(?is)\A<\?xml\b[^>]*>\s*(?:<!--.*?-->\s*|<!doctype[^>]*>\s*)*<html\b"
_XML = r"(?s)\A(?:<\?xml\b|(?:<!--.*?-->\s*)*<[A-Za-z_][\w:.\-]*(?:\s[^<>]*)?/?>)"
_JSON = r"""(?s)\A(?:\{\s*["}]|\[\s*(?:["\[{\]0-9\-]|true\b|false\b|null\b))"""
HEAD, TAIL = 4096, 65_536


def _signed(content: Column, offset: int, value: str, mask: str) -> Column:
    """Whether the bytes at offset are the value's where the mask has bits: whole bytes in one comparison, others one by one."""
    runs: list[list[int]] = []
    tests = []
    for i in range(len(value) // 2):
        m, v = int(mask[2 * i : 2 * i + 2], 16), int(value[2 * i : 2 * i + 2], 16)
        if m == 0xFF and runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        elif m == 0xFF:
            runs.append([i, i + 1])
        elif m:
            byte = F.conv(F.hex(F.substring(content, offset + i + 1, 1)), 16, 10).cast("int")
            tests.append(byte.bitwiseAND(F.lit(m)) == F.lit(v & m))
    tests += [F.substring(content, offset + a + 1, b - a) == F.lit(bytes.fromhex(value[2 * a : 2 * b])) for a, b in runs]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _number(content: Column, at: int) -> Column:
    """A whole number of two bytes, the lowest first."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("int")
    return byte(0) + byte(1) * 256


def _seen(part: Column) -> Column:
    return F.decode(part, "ISO-8859-1")


def _archive(content: Column) -> Column:
    """A ZIP archive's own type: what its first entry says if that is named mimetype, else by the names of its entries, which stand at its end."""
    name, more, size = _number(content, 26), _number(content, 28), _number(content, 18)
    first = _seen(F.substring(content, F.lit(31), name))
    said = C.trimmed(_seen(F.substring(content, F.lit(31) + name + more, size)))
    names = F.concat(_seen(F.substring(content, 1, HEAD)), _seen(F.substring(content, F.greatest(F.length(content) - TAIL, F.lit(0)) + 1, F.lit(TAIL))))
    kind = F.when((first == "mimetype") & said.rlike(r"\A[\w.+\-]+/[\w.+\-]+\z"), said)
    for entry, ext in OFFICE.items():
        kind = kind.when(F.contains(names, F.lit(entry)), C.EXTENSIONS[ext])
    return kind.otherwise("application/zip")


def mime_by_content(content: Column, ext: Column) -> Column:
    """The MIME type of the bytes; the extension's where there are none."""
    head = F.regexp_replace(_seen(F.substring(content, 1, HEAD)), r"\A(?:\xEF\xBB\xBF)?\s+|\A\xEF\xBB\xBF", "")
    end = F.rtrim(_seen(F.substring(content, F.greatest(F.length(content) - 64, F.lit(0)) + 1, F.lit(64))), F.lit(" \t\r\n"))
    kind = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, C.mime_of_extension(ext))
    for mime, offset, value, mask in SIGNATURES:
        kind = kind.when(_signed(content, offset, value, mask), mime)
    kind = kind.when(_signed(content, 0, "504B0304", "FFFFFFFF"), _archive(content)).when(_signed(content, 0, "504B0506", "FFFFFFFF"), "application/zip")
    kind = kind.when(head.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"), F.coalesce(C.mime_of_extension(ext), F.lit("application/octet-stream")))
    kind = kind.when(head.rlike(_XHTML), "application/xhtml+xml").when(head.rlike(_HTML), "text/html").when(head.rlike(_XML), "application/xml")
    kind = kind.when(head.rlike(_JSON) & end.rlike(r"[}\]]\z"), "application/json")
    return kind.otherwise(F.when(ext.isin(*TEXTS), C.mime_of_extension(ext)).otherwise("text/plain"))


def detect_by_content(path: Column, content: Column) -> Column:
    """struct(mimetype, extension, filename), for the detector of convert(). An extension that says otherwise than the bytes is left out."""
    ext = C.extension(path)
    mime = mime_by_content(content, ext)
    return F.struct(mime.alias("mimetype"), F.when(C.mime_of_extension(ext).eqNullSafe(mime), ext).alias("extension"), C.filename(path).alias("filename"))
