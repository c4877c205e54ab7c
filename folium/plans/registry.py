"""Which parser takes which document: an ordered registry, compiled into one CASE expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.model import Document
from folium.parsers import html_walk, plain
from folium.sources import archive


@dataclass(frozen=True)
class Converter:
    """Accepts documents by extension or MIME type; parse takes (content, base URL)."""

    name: str
    extensions: tuple[str, ...]
    mimetypes: tuple[str, ...]
    parse: Callable[[bytes, str], Document]

    def accepts(self, detected: Column) -> Column:
        return F.coalesce(
            detected["extension"].isin(*self.extensions), F.lit(False)
        ) | F.coalesce(detected["mimetype"].isin(*self.mimetypes), F.lit(False))


def _defaults() -> list[tuple[float, Converter]]:
    one = lambda f: lambda content, base: f(content)
    # Extensions, MIME types and priorities.
    return [
        (0.0, Converter("markdown", ("md", "markdown"), ("text/markdown",), one(plain.parse_raw))),
        (0.0, Converter("html", ("html", "htm"), ("text/html", "application/xhtml+xml"), html_walk.parse_html)),
        (0.0, Converter("csv", ("csv",), ("text/csv", "application/csv"), one(plain.parse_csv))),
        (0.0, Converter("json", ("json",), ("application/json", "text/json"), one(plain.parse_json))),
        (0.0, Converter("xml", ("xml",), ("text/xml", "application/xml"), one(plain.parse_xml))),
        (0.0, Converter("epub", ("epub",), ("application/epub+zip",), one(archive.parse_epub))),
        (10.0, Converter("text", ("txt", "log", "text"), ("text/plain",), one(plain.parse_raw))),
    ]


@dataclass
class Registry:
    entries: list[tuple[float, Converter]] = field(default_factory=_defaults)

    def register(self, converter: Converter, priority: float = 0.0) -> Registry:
        """Lower priorities are asked first; equal ones in the order of registration."""
        self.entries = sorted([*self.entries, (priority, converter)], key=lambda e: e[0])
        return self

    def with_pdf(self, extract: Callable[[bytes], str]) -> Registry:
        """PDF by an extractor that gives a document's text, page after page."""
        return self.register(Converter("pdf", ("pdf",), ("application/pdf",), lambda content, base: plain.parse_pdf_text(extract(content))))

    @property
    def converters(self) -> list[Converter]:
        return [c for _, c in self.entries]

    def select(self, detected: Column) -> Column:
        """Name of the first converter that accepts; null if none does."""
        case = None
        for c in self.converters:
            case = F.when(c.accepts(detected), c.name) if case is None else case.when(c.accepts(detected), c.name)
        return F.lit(None).cast("string") if case is None else case
