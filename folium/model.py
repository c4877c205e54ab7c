"""The document model: blocks and inlines as trees in Python, as preorder node lists in DataFrames.

A node is a dict with ``kind`` and the fields of its kind; children are lists of nodes. Columns hold the preorder list
(NODE), which explodes into a node table; to_nodes and from_nodes go between the two.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from folium.text import is_blank, unbounded_depth

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("slot", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("ordered", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("loose", T.BooleanType()),
    T.StructField("checked", T.BooleanType()), T.StructField("col_span", T.IntegerType()), T.StructField("row_span", T.IntegerType()), T.StructField(
        "alignments", T.ArrayType(T.StringType())
    ),
    T.StructField("url", T.StringType()), T.StructField("link_title", T.StringType()), T.StructField("asset_id", T.StringType()), T.StructField("anchor", T.StringType()),
])
PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
ASSET = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("bytes", T.BinaryType()),
        T.StructField("name", T.StringType())
    ]
)
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
#: slots in which children hang: field of the tree -> slot of the node.
SLOTS = {"blocks": "block", "content": "inline", "items": "item", "header": "header", "rows": "row", "cells": "cell", "caption": "caption"}
_PLAIN = [f.name for f in NODE.fields[6:]]

Node = dict[str, Any]


@dataclass
class Document:
    blocks: list[Node] = field(default_factory=list)
    title: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    assets: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class MarkdownOptions:
    bullet: str = "-"
    strong_marker: str = "**"
    emphasis_marker: str = "*"
    escape_text: bool = True
    table_cell_line_break: str = "<br>"
    pad_table_columns: bool = False
    front_matter: bool = False
    max_heading_level: int = 6
    images_as_text: bool = False
    max_inline_image_url: int = 2**31 - 1


def node(kind: str, **fields: Any) -> Node:
    return {"kind": kind, **fields}


def text(value: str) -> Node:
    return node("text", text=value)


def paragraph(content: list[Node]) -> Node:
    return node("paragraph", content=content)


def plain_cell(value: str) -> Node:
    return node("table_cell", text=value)


def table(header: list[Node], rows: list[list[Node]], alignments: list[str] | None = None, caption: list[Node] | None = None) -> Node:
    return node("table", header=header, rows=[node("table_row", cells=r) for r in rows], alignments=alignments or [], caption=caption or [])


def plain_text(content: list[Node]) -> str:
    """Inlines without their marks: a line break is a blank, an image its alternative text."""
    out = []
    for x in content:
        kind = x["kind"]
        if kind == "line_break":
            out.append(" ")
        elif "content" in x:
            out.append(plain_text(x["content"]))
        else:
            out.append(x.get("text") or "")
    return "".join(out)


def node_rows(blocks: list[Node]) -> list[tuple]:
    """Preorder list, each node as the values of NODE's fields; parent_id of a top-level block is -1."""
    out: list[tuple] = []

    def add(n: Node, parent: int, depth: int, ordinal: int, slot: str) -> None:
        me = len(out)
        get = n.get
        out.append((me, parent, depth, ordinal, slot, n["kind"], *[get(k) for k in _PLAIN]))
        for name, slot_ in SLOTS.items():
            if children := get(name):
                for i, child in enumerate(children):
                    add(child, me, depth + 1, i, slot_)

    with unbounded_depth():
        for i, b in enumerate(blocks):
            add(b, -1, 0, i, "block")
    return out


def to_nodes(blocks: list[Node]) -> list[dict]:
    """The same as dicts."""
    return [dict(zip(NODE.names, row)) for row in node_rows(blocks)]


def from_nodes(nodes: list[dict]) -> list[Node]:
    """The trees again, from a preorder list."""
    names = {v: k for k, v in SLOTS.items()}
    made: list[Node] = []
    top: list[Node] = []
    for row in nodes:
        n = {"kind": row["kind"]} | {k: row[k] for k in _PLAIN if row[k] is not None}
        made.append(n)
        (top if row["parent_id"] < 0 else made[row["parent_id"]].setdefault(names[row["slot"]], [])).append(n)
    return top


class InlineBuilder:
    """Collects inlines; empty strings add nothing, except to links and images."""

    def __init__(self) -> None:
        self.content: list[Node] = []

    def _styled(self, kind: str, value: str) -> InlineBuilder:
        if value:
            self.content.append(node(kind, content=[text(value)]))
        return self

    def text(self, value: str) -> InlineBuilder:
        if value:
            self.content.append(text(value))
        return self

    def strong(self, value: str) -> InlineBuilder:
        return self._styled("strong", value)

    def emphasis(self, value: str) -> InlineBuilder:
        return self._styled("emphasis", value)

    def code(self, value: str) -> InlineBuilder:
        if value:
            self.content.append(node("code_span", text=value))
        return self

    def link(self, label: str, url: str, title: str | None = None) -> InlineBuilder:
        self.content.append(node("link", content=[text(label)], url=url, link_title=title))
        return self

    def image(self, alt: str, url: str, title: str | None = None, asset_id: str | None = None) -> InlineBuilder:
        self.content.append(node("image", text=alt, url=url, link_title=title, asset_id=asset_id))
        return self

    def line_break(self) -> InlineBuilder:
        self.content.append(node("line_break"))
        return self

    def __iadd__(self, inline: Node) -> InlineBuilder:
        self.content.append(inline)
        return self


def styled(content: list[Node], bold: bool = False, italic: bool = False, strike: bool = False) -> list[Node]:
    """content in strong, emphasis and strikethrough, from the outside in."""
    for on, kind in ((strike, "strikethrough"), (italic, "emphasis"), (bold, "strong")):
        if on:
            content = [node(kind, content=content)]
    return content


class DocumentBuilder:
    """Collects blocks. Blank headings, paragraphs and raw Markdown, and tables and lists without rows, add nothing; code and comments always count."""

    def __init__(self) -> None:
        self.document = Document()

    def add(self, block: Node) -> DocumentBuilder:
        self.document.blocks.append(block)
        return self

    def add_all(self, blocks: list[Node]) -> DocumentBuilder:
        self.document.blocks += blocks
        return self

    def asset(self, asset: Node) -> DocumentBuilder:
        self.document.assets.append(asset)
        return self

    def meta(self, key: str, value: str | None) -> DocumentBuilder:
        if value and not is_blank(value):
            self.document.metadata[key] = value
        return self

    def title(self, value: str | None) -> DocumentBuilder:
        self.document.title = value
        return self

    def title_if_absent(self, value: str | None) -> DocumentBuilder:
        if self.document.title is None and value and not is_blank(value):
            self.document.title = value
        return self

    def _content(self, what: str | list[Node]) -> list[Node]:
        return ([] if is_blank(what) else [text(what)]) if isinstance(what, str) else what

    def heading(self, level: int, what: str | list[Node], anchor: str | None = None) -> DocumentBuilder:
        content = self._content(what)
        return self.add(node("heading", level=level, content=content, anchor=anchor)) if content else self

    def paragraph(self, what: str | list[Node]) -> DocumentBuilder:
        content = self._content(what)
        return self.add(paragraph(content)) if content else self

    def code(self, code: str, language: str | None = None) -> DocumentBuilder:
        return self.add(node("code_block", text=code, language=language))

    def comment(self, value: str) -> DocumentBuilder:
        return self.add(node("html_comment", text=value))

    def raw(self, value: str) -> DocumentBuilder:
        return self if is_blank(value) else self.add(node("raw_block", text=value))

    def bullet_list(self, items: list[str]) -> DocumentBuilder:
        made = [node("list_item", blocks=[paragraph([text(i)])]) for i in items]
        return self.add(node("list", ordered=False, items=made)) if made else self

    def table(self, header: list[str], rows: list[list[str]], alignments: list[str] | None = None) -> DocumentBuilder:
        return self.add(
            table([plain_cell(c) for c in header], [[plain_cell(c) for c in r] for r in rows], alignments)
        ) if header or rows else self

    def build(self) -> Document:
        return self.document
