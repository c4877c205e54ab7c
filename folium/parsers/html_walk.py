"""Element trees to document blocks."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from folium.model import Document, Node, node, paragraph, plain_text, table, text
from folium.parsers.html_tree import Element, TreeBuilder, parse
from folium.text import HTML_SPACE, SPACE, decode, is_blank, trim, trim_end, unbounded_depth

# What is dropped with all it holds, what only holds blocks, what stands as a block, the marks of inlines.
DROPPED = frozenset("script style noscript template button svg iframe form input select".split())
CONTAINERS = frozenset(
    "div section article main header footer aside nav body html figure details summary fieldset center hgroup picture colgroup".split()
)
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table pre blockquote hr dl li figcaption".split()) | CONTAINERS
MARKS = {
    **dict.fromkeys(("strong", "b"), "strong"), **dict.fromkeys(("em", "i", "cite", "var"), "emphasis"), **dict.fromkeys(("del", "s", "strike"), "strikethrough"),
    **dict.fromkeys(("code", "kbd", "samp", "tt"), "code_span"),
}
_INTEGER = re.compile(r"[+-]?[0-9]{1,10}")


def _integer(value: str | None, default: int) -> int:
    """A whole number of 32 bits, written without blanks."""
    found = int(value) if value and _INTEGER.fullmatch(value) else None
    return default if found is None or not -(2**31) <= found < 2**31 else found


def prune(root: Element) -> None:
    """Remove the subtrees that never count, wherever they stand."""
    stack = [root]
    while stack:
        e = stack.pop()
        e.children = [c for c in e.children if isinstance(c, str) or c.tag not in DROPPED]
        stack += [c for c in e.children if isinstance(c, Element)]


class Walker:
    def __init__(self, base: str = ""):
        self.base = base if urlsplit(base).scheme in ("http", "https", "file", "ftp") and "://" in base else ""

    def url(self, raw: str) -> str:
        if not self.base:
            return raw
        try:
            return urljoin(self.base, raw.strip()) or raw
        except ValueError:
            return raw

    # -- blocks
    def blocks(self, e: Element) -> list[Node]:
        """Children as blocks, runs of inlines as paragraphs. Containers are entered and left on a stack of their own."""
        out: list[Node] = []
        run: list[Node] = []

        def flush() -> None:
            if content := trim_edges(run):
                out.append(paragraph(content))
            run.clear()

        stack = [iter(e.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                flush()
                stack.pop()
            elif isinstance(c, str) or c.tag not in BLOCKS:
                self.add_inline(c, run)
            else:
                flush()
                if c.tag in CONTAINERS or c.tag == "li":
                    stack.append(iter(c.children))
                else:
                    out += self.block(c)
        return out

    def block(self, e: Element) -> list[Node]:
        tag = e.tag
        if tag in ("ul", "ol"):
            return self.item_list(e)
        if tag == "table":
            return self.table(e)
        if tag == "dl":
            return self.definitions(e)
        if tag == "hr":
            return [node("thematic_break")]
        if tag == "pre":
            code = next(e.find_all({"code"}), e)
            language = next(
                (c.partition("-")[2] for c in code.attrs.get("class", "").split() if c.startswith(("language-", "lang-"))), None
            )
            return [node("code_block", text=trim_end(code.text()), language=language or None)]
        if tag == "blockquote":
            inner = self.blocks(e)
            return [node("block_quote", blocks=inner)] if inner else []
        content = trim_edges(self.inlines(e))
        if not content:
            return []
        if tag == "p":
            return [paragraph(content)]
        if tag == "figcaption":
            return [paragraph([node("emphasis", content=content)])]
        return [node("heading", level=int(tag[1]), content=content, anchor=None if is_blank(e.attrs.get("id", "")) else e.attrs["id"])]

    def item_list(self, e: Element) -> list[Node]:
        items = []
        for c in e.children:
            if isinstance(c, Element) and c.tag == "li" and (inner := self.blocks(c)):
                items.append(node("list_item", blocks=inner))
        return [node("list", ordered=e.tag == "ol", start=_integer(e.attrs.get("start"), 1), loose=False, items=items)] if items else []

    def definitions(self, e: Element) -> list[Node]:
        out = []
        for c in e.children:
            if isinstance(c, Element) and c.tag in ("dt", "dd") and (content := trim_edges(self.inlines(c))):
                out.append(paragraph([node("strong", content=content)] if c.tag == "dt" else content))
        return out

    def table(self, e: Element) -> list[Node]:
        caption = next(e.find_all({"caption"}), None)
        header: list[Node] = []
        body: list[list[Node]] = []
        own = [tr for tr in e.find_all({"tr"}) if nearest_table(tr) is e]
        for i, tr in enumerate(own):
            parts = [c for c in tr.children if isinstance(c, Element) and c.tag != "#comment"]
            cells = [self.cell(c) for c in parts if c.tag in ("td", "th")]
            if not cells:
                continue
            # only the very first row can be the header
            if i == 0 and all(c.tag == "th" for c in parts):
                header = cells
            else:
                body.append(cells)
        return [table(header, body, caption=trim_edges(self.inlines(caption)) if caption else [])] if header or body else []

    def cell(self, e: Element) -> Node:
        span = lambda name: min(100, max(1, _integer(e.attrs.get(name), 1)))
        return node("table_cell", content=trim_edges(self.inlines(e)), col_span=span("colspan"), row_span=span("rowspan"))

    # -- inlines
    def inlines(self, e: Element) -> list[Node]:
        out: list[Node] = []
        for c in e.children:
            self.add_inline(c, out)
        return out

    def add_inline(self, c: Element | str, out: list[Node]) -> None:
        if isinstance(c, str):
            if value := HTML_SPACE.sub(" ", c):
                out.append(text(value))
            return
        tag = c.tag
        if tag == "br":
            out.append(node("line_break"))
        elif tag == "img":
            if not is_blank(src := c.attrs.get("src", "")):
                out.append(node("image", text=c.attrs.get("alt", ""), url=self.url(src), link_title=_title(c)))
        elif tag == "a":
            content, href = trim_edges(self.inlines(c)), c.attrs.get("href", "")
            if content and (is_blank(href) or href.startswith("javascript:")):
                out += content
            elif content:
                out.append(node("link", content=content, url=self.url(href), link_title=_title(c)))
        elif tag not in MARKS:
            for x in c.children:
                self.add_inline(x, out)
        elif MARKS[tag] == "code_span":
            if code := trim(c.text()):
                out.append(node("code_span", text=code))
        else:
            content = self.inlines(c)
            if inner := trim_edges(content):
                # a blank at either edge stays, outside of the mark
                blank = lambda x, at: x["kind"] == "text" and x["text"][at] == " "
                out += [text(" ")] * blank(content[0], 0) + [node(MARKS[tag], content=inner)] + [text(" ")] * blank(content[-1], -1)


def _title(e: Element) -> str | None:
    value = e.attrs.get("title", "")
    return None if is_blank(value) else value


def trim_edges(content: list[Node]) -> list[Node]:
    content = list(content)
    blank = lambda x: x["kind"] == "text" and is_blank(x["text"])
    while content and blank(content[0]):
        content.pop(0)
    while content and blank(content[-1]):
        content.pop()
    if content and content[0]["kind"] == "text":
        content[0] = text(content[0]["text"].lstrip(SPACE))
    if content and content[-1]["kind"] == "text":
        content[-1] = text(trim_end(content[-1]["text"]))
    return [x for x in content if x["kind"] != "text" or x["text"]]


def nearest_table(e: Element) -> Element | None:
    up = e.parent
    while up is not None and up.tag != "table":
        up = up.parent
    return up


# What a title folds into one blank, and what it leaves out.
_SPACES, _UNSEEN = re.compile("[ \t\n\r\f\u00a0]+"), re.compile("[\u200b\u00ad]")


def title_of(tree: TreeBuilder) -> str | None:
    """Of the first title element in the head."""
    found = next(tree.head.find_all({"title"}), None)
    value = trim(_SPACES.sub(" ", _UNSEEN.sub("", found.text()))) if found is not None else ""
    return value or None


def html_document(source: str, base: str = "") -> Document:
    tree = parse(source)
    prune(tree.root)
    with unbounded_depth():
        blocks = Walker(base).blocks(tree.body)
        title = title_of(tree)
        if title is None:
            first = next((b for b in blocks if b["kind"] == "heading"), None)
            title = trim(plain_text(first["content"])) or None if first else None
    return Document(blocks, title)


def html_title(source: str) -> str | None:
    """The title alone: blocks are made only where no title element has one."""
    return title_of(parse(source)) or html_document(source).title


def parse_html(content: bytes, base: str = "") -> Document:
    return html_document(decode(content), base)
