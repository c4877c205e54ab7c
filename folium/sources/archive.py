"""ZIP archives and EPUB books."""

from __future__ import annotations

import re
import struct
import zlib

from folium.model import Document, node, paragraph, text
from folium.parsers.html_tree import Element, parse
from folium.parsers.html_walk import html_document

# Signatures of the ZIP format.
END, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"


class ZipArchive:
    """Entries by name, stored or deflated; what can't be read is None. Checksums aren't compared; the last of equal names counts."""

    def __init__(self, data: bytes, entries: dict[str, tuple[int, int, int]]):
        self.data, self.entries = data, entries

    @classmethod
    def open(cls, data: bytes) -> ZipArchive | None:
        end = data.rfind(END, max(0, len(data) - 65557))
        if end < 0 or end + 22 > len(data):
            return None
        count, _, at = struct.unpack_from("<HII", data, end + 10)
        entries = {}
        for _ in range(count):
            if data[at : at + 4] != ENTRY or at + 46 > len(data):
                break
            method, _, _, _, packed, _, n, extra, comment = struct.unpack_from("<HHHIIIHHH", data, at + 10)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
            if not name.endswith("/"):
                entries[name] = (offset, packed, method)
            at += 46 + n + extra + comment
        return cls(data, entries)

    @property
    def names(self) -> list[str]:
        return list(self.entries)

    def read(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        offset, packed, method = self.entries[name]
        if self.data[offset : offset + 4] != LOCAL or offset + 30 > len(self.data):
            return None
        n, extra = struct.unpack_from("<HH", self.data, offset + 26)
        start = offset + 30 + n + extra
        body = self.data[start : start + packed]
        if len(body) < packed:
            return None
        if method == 0:
            return body
        inflate = zlib.decompressobj(-15)
        try:
            out = inflate.decompress(body) if method == 8 else None
        except zlib.error:
            return None
        return out if inflate.eof else None

    def read_text(self, name: str) -> str | None:
        found = self.read(name)
        return None if found is None else found.decode("utf-8", "replace")


#: Fixed value: package metadata in the order it is shown, with its labels.
FIELDS = (
    ("title", "Title"), ("creator", "Authors"), ("language", "Language"), ("description", "Description"), ("identifier", "Identifier")
)


def _first(root: Element, *tags: str) -> Element | None:
    return next(root.find_all(set(tags)), None)


def chapters(data: bytes) -> tuple[dict[str, str], list[str]]:
    """(metadata, chapters as XHTML in reading order) of an EPUB; both empty where a part is missing."""
    book = ZipArchive.open(data)
    container = book and book.read_text("META-INF/container.xml")
    rootfile = container and _first(parse(container).root, "rootfile")
    path = rootfile.attrs.get("full-path", "") if rootfile else ""
    package = (book.read_text(path) or book.read_text(path.removeprefix("/"))) if path else None
    if not package:
        return {}, []
    # meta, link and item elements close themselves in XML; the tree then doesn't nest them
    closed = re.sub(r"<([\w:.-]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/>", r"<\1\2></\1>", package)
    # an element title would take the rest as its text in HTML; here it is none of the names that count
    root = parse(re.sub(r"(</?)title\b", r"\1x-title", closed)).root
    meta = {}
    for name, _ in FIELDS:
        if (e := _first(root, f"dc:{name}")) is not None and (value := " ".join(e.text().split())):
            meta[name] = value
    base = path.rpartition("/")[0]
    below = lambda tag, parent: (e for e in root.find_all({tag}) if e.parent is not None and e.parent.tag == parent)
    manifest = {e.attrs.get("id", ""): e.attrs.get("href", "") for e in below("item", "manifest") if "html" in e.attrs.get("media-type", "")}
    out = []
    for e in below("itemref", "spine"):
        href = manifest.get(e.attrs.get("idref", ""))
        full = f"{base}/{href}" if base and href else href
        if full and (body := book.read_text(full) or book.read_text(full.removeprefix("/"))):
            out.append(body)
    return meta, out


def parse_epub(data: bytes) -> Document:
    meta, bodies = chapters(data)
    doc = Document(metadata=dict(meta), title=meta.get("title"))
    for name, label in FIELDS:
        if name in meta:
            doc.blocks.append(paragraph([node("strong", content=[text(f"{label}:")]), text(f" {meta[name]}")]))
    for body in bodies:
        chapter = html_document(body)
        doc.blocks += chapter.blocks
        if doc.title is None:
            doc.title = chapter.title
    return doc
