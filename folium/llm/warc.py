"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response gives two records. The metadata record (application/warc-fields) keeps the source's headers as ``response-header`` fields, its
status, the title and the links; the conversion record (text/plain) holds the page's text. Both name the response in
WARC-Refers-To, its target URI and its date, and carry digests of their own block; the metadata record also names the payload digest of the source.
Record ids are UUIDs made from the response's id and the kind, so a rerun makes the same records.

The page is the response's payload with chunks joined, gzip or deflate undone and the named charset decoded; payload digests are of the payload as it came.

Defined results: a null or empty page gives a response with an empty payload and derivatives with empty text. A null url is an empty target URI.
HTML need not be well formed; an unclosed script, style or comment ends with the page. Repeated rows give equal records.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import slices

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:folium:warc")
CRLF = "\r\n"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


@dataclass(frozen=True)
class Record:
    headers: tuple[tuple[str, str], ...]
    block: bytes

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        """The record as it stands in a WARC 1.1 file, uncompressed."""
        head = "".join(f"{k}: {v}{CRLF}" for k, v in self.headers)
        return f"WARC/1.1{CRLF}{head}{CRLF}".encode() + self.block + b"\r\n\r\n"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def make(kind: str, rid: str, target: str, when: str, content_type: str, block: bytes, *more: tuple[str, str]) -> Record:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", when)]
    if target:
        head.append(("WARC-Target-URI", target))
    return Record(
        (*head, *more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))), block
    )


def response(
    rid: str, url: str | None, page: str | None, when: str,
    headers: tuple[tuple[str, str], ...] = (("Content-Type", "text/html; charset=utf-8"),)
) -> Record:
    """A response record around a page's HTML."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    head = "".join(f"{k}: {v}{CRLF}" for k, v in (*headers, ("Content-Length", str(len(payload)))))
    block = f"HTTP/1.1 200 OK{CRLF}{head}{CRLF}".encode() + payload
    return make("response", rid, clean(url), when, "application/http; msgtype=response", block, ("WARC-Payload-Digest", digest(payload)))


def clean(url: str | None) -> str:
    """A header's value stays on its line."""
    return re.sub(r"[\r\n]+", " ", url or "")


def read(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or gzipped member by member; it ends at the first thing that is no record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = tuple((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
        length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), 0)
        yield Record(headers, data[end + 4 : end + 4 + length])
        at = end + 4 + length
        while data.startswith(b"\r\n", at):
            at += 2


RECORDS = "path string, position long, record_type string, record_id string, headers array<struct<name:string,value:string>>, block binary"


def read_warc(spark: SparkSession, path: str | list[str], glob: str = "*.warc*") -> DataFrame:
    """RECORDS of WARC files. A file is read by one task and held whole, so files of up to 2 GB; archives usually have one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for i, r in enumerate(read(content.as_py())):
                    kinds = [
                        pa.string(), pa.int64(), pa.string(), pa.string(),
                        pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()
                    ]
                    row = [
                        where, i, r.header("WARC-Type"), r.header("WARC-Record-ID"), [{"name": k, "value": v} for k, v in r.headers],
                        r.block
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")]
                    )

    return files.mapInArrow(run, RECORDS)


def derive_records(records: DataFrame) -> DataFrame:
    """SCHEMA rows (key: the position in the file) of the metadata and conversion records of each response among RECORDS."""

    def run(batches):
        for batch in slices(batches, "block"):
            out = []
            for position, headers, block in zip(*(batch.column(c).to_pylist() for c in ("position", "headers", "block"))):
                source = Record(tuple((h["name"], h["value"]) for h in headers), block)
                out += [_row(position, r, source.header("WARC-Payload-Digest") or digest(http_parts(block)[2])) for r in derive(source)]
            yield _batch(out, pa.int64())

    return records.where("record_type = 'response'").mapInArrow(run, "key long, " + SCHEMA)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response's block; without a blank line all of it is head."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


# Elements whose content is no text, and those that start a line.
DROPPED = frozenset("script style noscript template".split())
LINES = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li table tr article section header footer nav main aside blockquote pre dl dt dd form body figure figcaption br hr".split()
)
_MARK = re.compile(r"<(?:(!--)|(/?[a-zA-Z][^\s/>]*)([^>]*)>|[/!?][^>]*>)")
_CLOSE = {tag: re.compile(f"</{tag}", re.I) for tag in DROPPED}
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")


def _plain(parts: list[str]) -> str:
    return _BLANKS.sub(" ", html_entities.unescape("".join(parts))).strip(" ")


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """("", text) and (name, what stands in the tag) of a page in one pass.

    Tags are looked for up to the last ``>`` only, so that each that begins also ends: no character is passed over twice for a mark that never comes."""
    at, end = 0, page.rfind(">") + 1
    while True:
        jump = -1
        for m in _MARK.finditer(page, at, end):
            if m.start() > at:
                yield "", page[at : m.start()]
            at = m.end()
            if m[1]:
                jump = page.find("-->", at) + 3
                break
            if m[2]:
                tag = m[2].lower()
                if tag in DROPPED:
                    close = _CLOSE[tag].search(page, at)
                    jump = page.find(">", close.end()) + 1 if close else 0
                    break
                yield tag, m[3]
        if jump < 0:
            comment = page.find("<!--", at)
            yield "", page[at:] if comment < 0 else page[at:comment]
            return
        if jump < 3 or jump > len(page):  # what is dropped ends with the page
            return
        at = jump


def extract(page: str) -> tuple[str, list[str], str]:
    """Title (the first), links and text of a page: a block element starts a line, source line breaks are blanks, empty lines go."""
    title, in_title, links, lines, line = None, None, [], [], []
    for tag, value in pieces(page):
        if not tag:
            (line if in_title is None else in_title).append(value)
        elif tag == "title":
            in_title = [] if in_title is None else in_title
        elif tag == "/title":
            if in_title is not None and title is None:
                title = _plain(in_title)
            in_title = None
        elif tag.removeprefix("/") in LINES:
            lines.append(_plain(line))
            line = []
        elif tag == "a" and (m := _HREF.search(value)):
            links.append(html_entities.unescape(next((x for x in m.groups() if x), "")).strip())
    if title is None and in_title is not None:
        title = _plain(in_title)
    lines.append(_plain(line))
    return title or "", links, "\n".join([x for x in lines if x])


def _unchunked(payload: bytes) -> bytes:
    """The body of a chunked payload; at the first thing that is no chunk, what is left stays as it is."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = re.match(rb"[0-9a-fA-F]+", payload[at : end if end >= 0 else at])
        if size is None:
            return b"".join([*out, payload[at:]])
        n = int(size[0], 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def body_of(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The page as text: chunks joined, gzip and deflate undone (what is damaged stays as it is), decoded by the charset named, else UTF-8."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    coding = named.get("content-encoding", "")
    if coding in ("gzip", "x-gzip", "deflate"):
        for window in (47, -15):
            try:
                payload = zlib.decompressobj(window).decompress(payload)
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:\-]+)", named.get("content-type", ""))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(source: Record) -> tuple[Record, Record]:
    """(metadata, conversion) of a response record."""
    status, headers, payload = http_parts(source.block)
    rid, url, when = source.header("WARC-Record-ID") or "", source.header("WARC-Target-URI") or "", source.header("WARC-Date") or ""
    title, links, text = extract(body_of(headers, payload))
    fields = [
        ("status", status), *(("response-header", f"{k}: {v}") for k, v in headers),
        ("payload-digest", source.header("WARC-Payload-Digest") or digest(payload)), ("title", title),
        *(("outlink", clean(_joined(url, x))) for x in links)
    ]
    linked = (("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", when))
    block = "".join(f"{k}: {v}{CRLF}" for k, v in fields).encode("utf-8", "surrogatepass")
    meta = make("metadata", record_id(rid, "metadata"), url, when, "application/warc-fields", block, *linked)
    return meta, make(
        "conversion", record_id(rid, "conversion"), url, when, "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"), *linked
    )


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, record binary"


def _row(key: object, r: Record, payload_digest: str) -> tuple:
    return (
        key, r.header("WARC-Type"), r.header("WARC-Record-ID"), r.header("WARC-Refers-To"), r.header("WARC-Target-URI") or "",
        r.header("WARC-Date"), r.header("Content-Type"), payload_digest, r.header("WARC-Block-Digest"), len(r.block), r.to_bytes()
    )


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *[pa.string()] * 8, pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", *(x.split()[0] for x in SCHEMA.split(", "))]
    )


def derivatives(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", when: str = "2024-01-01T00:00:00Z",
    with_source: bool = True
) -> DataFrame:
    """key (of its own type) and SCHEMA: of each page its response (unless with_source is off), metadata and conversion records."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL(SCHEMA).fields])

    def run(batches):
        for batch in slices(batches, "page"):
            out = []
            for k, u, p in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "page"))):
                source = response(record_id("response", k, u), u, p, when)
                digest_ = source.header("WARC-Payload-Digest")
                out += [_row(k, r, digest_) for r in ((source,) * with_source + derive(source))]
            yield _batch(out, batch.schema.field("key").type)

    return rows.mapInArrow(run, schema)
