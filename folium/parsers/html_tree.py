"""HTML text to a tree of elements, by the tree construction rules of the HTML standard that bear on content.

Built: implied ends, void and raw-text elements, the list of active formatting elements with markers and its limit of three
equal entries, their reconstruction, the adoption agency, implied table parts and foster parenting.
"""

from __future__ import annotations

import html
import re
from itertools import islice

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul dd dt plaintext".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = CLOSES_P | frozenset(
    "applet area base body br button caption col colgroup embed frame head html iframe img input link marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template #root".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
MARKED = frozenset("applet marquee object td th caption".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
TABLE_CONTEXT = frozenset("table tbody tfoot thead tr".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript noframes".split())
TEXT_ONLY = RAW | ESCAPABLE
IN_TABLE = TABLE_PARTS | frozenset("script style template form".split())
TABLE_SCOPE = frozenset("html table template #root".split())
OUTER_SCOPE = frozenset("html template #root".split())
P_SCOPE, ITEM_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}
P, TABLE, CELL_CONTEXT = frozenset({"p"}), frozenset({"table"}), frozenset("tr tbody thead tfoot table".split())
ROW_CONTEXT = CELL_CONTEXT - {"tr"}
PREFORMATTED = frozenset("pre textarea listing".split())


#: Fixed value: how many open elements a search for one in scope looks at.
SCOPE_DEPTH = 101


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag = tag
        self.attrs = {} if attrs is None else attrs
        self.children: list = []
        self.parent: Element | None = None

    def append(self, child: "Element | str") -> None:
        if isinstance(child, Element):
            child.detach()
            child.parent = self
        elif self.children and isinstance(self.children[-1], str):
            self.children[-1] += child
            return
        self.children.append(child)

    def insert_before(self, child: "Element | str", before: "Element") -> None:
        at = next(i for i, c in enumerate(self.children) if c is before)
        if isinstance(child, Element):
            child.detach()
            at = next(i for i, c in enumerate(self.children) if c is before)
            child.parent = self
        elif at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += child
            return
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def find_all(self, tags: frozenset[str] | set[str]):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Element):
                if c.tag in tags:
                    yield c
                stack += reversed(c.children)

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)


_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""", re.S)


#: A tag of a name alone is looked up by its text; so many are remembered.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_LONGEST, _REMEMBERED = 16, 1024
_plain: dict[str, tuple[bool, str] | None] = {}


def _named(piece: str) -> tuple[bool, str] | None:
    """Whether it is an end tag, and its name; of what is more than a name, or begins raw text, nothing."""
    m = _PLAIN.fullmatch(piece)
    out = (bool(m[1]), m[2].lower()) if m and (m[1] or m[2].lower() not in TEXT_ONLY) else None
    if len(_plain) < _REMEMBERED:
        _plain[piece] = out
    return out


def tokens(source: str):
    """("text", s), ("start", tag, attrs, closed by itself), ("end", tag) and ("comment",)."""
    at, size, search, unescape = 0, len(source), _TOKEN.search, html.unescape
    find, get = source.find, _plain.get
    while at < size:
        start = find("<", at)
        end = find(">", start, start + _LONGEST) + 1 if start >= 0 else 0
        if end:
            piece = source[start:end]
            plain = get(piece, False)
            if plain is False:
                plain = _named(piece)
            if plain:
                if start > at:
                    yield "text", unescape(source[at:start])
                at = end
                yield ("end", plain[1]) if plain[0] else ("start", plain[1], {}, False)
                continue
        m = search(source, at)
        if m is None:
            yield "text", unescape(source[at:])
            return
        start, end = m.span()
        if start > at:
            yield "text", unescape(source[at:start])
        at = end
        closing, tag, raw = m.groups()
        if closing:
            yield "end", closing.lower()
        elif not tag:
            if not m[0][:9].lower() == "<!doctype":
                yield ("comment",)
        else:
            tag = tag.lower()
            attrs: dict[str, str] = {}
            if raw:
                for a in _ATTRIBUTE.finditer(raw):
                    attrs.setdefault(a[1].lower(), unescape(next((x for x in a.groups()[1:] if x is not None), "")))
            yield "start", tag, attrs, raw.rstrip().endswith("/")
            if tag in TEXT_ONLY:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                body = source[at : end.start() if end else len(source)]
                if body:
                    yield "text", html.unescape(body) if tag in ESCAPABLE else body
                yield "end", tag
                at = end.end() if end else size


class TreeBuilder:
    def __init__(self) -> None:
        self.root = Element("#root")
        self.html = Element("html")
        self.head, self.body = Element("head"), Element("body")
        self.root.append(self.html)
        self.html.append(self.head)
        self.html.append(self.body)
        self.in_head = True
        self.open = [self.root, self.html, self.body]
        self.active: list[Element | None] = []

    def top(self) -> Element:
        return self.open[-1]

    def in_scope(self, tags, stops=SCOPE) -> bool:
        for e in islice(reversed(self.open), SCOPE_DEPTH):
            tag = e.tag
            if tag in tags:
                return True
            if tag in stops:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.open) > 3:
            if self.open.pop().tag in tags:
                return

    def implied_ends(self, but: str = "") -> None:
        while len(self.open) > 3 and self.top().tag in IMPLIED and self.top().tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope(P, P_SCOPE):
            self.implied_ends("p")
            self.pop_to({"p"})

    # -- where nodes go
    def place(self, child: Element | str) -> None:
        top = self.open[-1]
        if top.tag in TABLE_CONTEXT and (child.tag not in IN_TABLE if isinstance(child, Element) else child.strip()):
            table = next((e for e in reversed(self.open) if e.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.insert_before(child, table)
                return
        top.append(child)

    def push(self, tag: str, attrs: dict | None = None) -> Element:
        e, top = Element(tag, attrs), self.open[-1]
        if top.tag in TABLE_CONTEXT and tag not in IN_TABLE:
            self.place(e)
        else:  # a new element where it stands: nothing to take it from, nothing to move it before
            e.parent = top
            top.children.append(e)
        self.open.append(e)
        return e

    # -- formatting
    def remember(self, e: Element) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            a = self.active[i]
            if a is None:
                break
            if a.tag == e.tag and a.attrs == e.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(e)

    def reconstruct(self) -> None:
        at = len(self.active)
        if not at or self.active[-1] is None:
            return
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.active)):
            self.active[i] = self.push(self.active[i].tag, dict(self.active[i].attrs))

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: an end tag of a formatting element that may be misnested."""
        if self.top().tag == tag and self.top() not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            entry = None
            for a in reversed(self.active):
                if a is None:
                    break
                if a.tag == tag:
                    entry = a
                    break
            if entry is None:
                self.end_any(tag)
                return
            if entry not in self.open:
                self.active.remove(entry)
                return
            if not any(e is entry for e in self._scoped()):
                return
            at = self.open.index(entry)
            furthest = next((e for e in self.open[at + 1 :] if e.tag in SPECIAL), None)
            if furthest is None:
                del self.open[at:]
                self.active.remove(entry)
                return
            ancestor, mark = self.open[at - 1], self.active.index(entry)
            last, i, inner = furthest, self.open.index(furthest), 0
            while True:
                inner, i = inner + 1, i - 1
                e = self.open[i]
                if e is entry:
                    break
                if inner > 3 and e in self.active:
                    k = self.active.index(e)
                    del self.active[k]
                    mark -= k < mark
                if e not in self.active:
                    del self.open[i]
                    continue
                copy = Element(e.tag, dict(e.attrs))
                k = self.active.index(e)
                self.active[k] = self.open[i] = copy
                if last is furthest:
                    mark = k + 1
                copy.append(last)
                last = copy
            last.detach()
            if ancestor.tag in TABLE_CONTEXT:
                self.open.append(ancestor)
                self.place(last)
                self.open.pop()
            else:
                ancestor.append(last)
            copy = Element(entry.tag, dict(entry.attrs))
            for c in furthest.children:
                if isinstance(c, Element):
                    c.parent = copy
            copy.children, furthest.children = furthest.children, []
            furthest.append(copy)
            k = self.active.index(entry)
            del self.active[k]
            self.active.insert(mark - (k < mark), copy)
            self.open.remove(entry)
            self.open.insert(self.open.index(furthest) + 1, copy)

    def _scoped(self):
        for e in reversed(self.open):
            yield e
            if e.tag in SCOPE:
                return

    # -- tags
    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("html", "head", "body", "frameset", "frame"):
            if tag == "body":
                self.in_head = False
            return
        if self.in_head:
            if tag in HEAD_ONLY:
                e = Element(tag, attrs)
                self.head.append(e)
                self.open.append(e)
                if tag in VOID:
                    self.open.pop()
                return
            self.in_head = False
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs)
            return
        if tag == "image":
            tag = "img"
        if tag in CLOSES_P and tag not in ("li", "dd", "dt") and not (tag == "form" and self.in_scope({"form"})):
            self.close_p()
        if tag in HEADINGS and self.top().tag in HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt"):
            group = {"li"} if tag == "li" else {"dd", "dt"}
            for e in reversed(self.open):
                if e.tag in group:
                    self.implied_ends(e.tag)
                    self.pop_to({e.tag})
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.top().tag == "option":
                self.open.pop()
        elif tag == "button" and self.in_scope({"button"}):
            self.implied_ends()
            self.pop_to({"button"})
        elif tag == "a":
            for e in reversed(self.active):
                if e is None:
                    break
                if e.tag == "a":
                    self.adopt("a")
                    if e in self.active:
                        self.active.remove(e)
                    if e in self.open:
                        self.open.remove(e)
                    break
        elif tag == "nobr" and self.in_scope({"nobr"}):
            self.reconstruct()
            self.adopt("nobr")
        if tag == "table" and self.top().tag in TABLE_CONTEXT:
            self.pop_to({"table"})
        if tag not in CLOSES_P and tag not in HEAD_ONLY and tag not in ("param", "source", "track"):
            self.reconstruct()
        e = self.push(tag, attrs)
        if tag in FORMATTING:
            self.remember(e)
        elif tag in MARKED:
            self.active.append(None)
        elif tag in VOID:
            self.open.pop()

    def table_part(self, tag: str, attrs: dict) -> None:
        if not self.in_scope(TABLE, TABLE_SCOPE):
            return
        if tag in ("td", "th"):
            self.to_context(CELL_CONTEXT)
            if self.top().tag == "table":
                self.push("tbody")
            if self.top().tag != "tr":
                self.push("tr")
            self.push(tag, attrs)
            self.active.append(None)
            return
        if tag == "tr":
            self.to_context(ROW_CONTEXT)
            if self.top().tag == "table":
                self.push("tbody")
            self.push(tag, attrs)
            return
        if tag == "col":
            self.to_context({"colgroup", "table"})
            if self.top().tag == "table":
                self.push("colgroup")
            self.push(tag, attrs)
            self.open.pop()
            return
        self.to_context({"table"})
        self.push(tag, attrs)
        if tag == "caption":
            self.active.append(None)

    def to_context(self, tags) -> None:
        open_ = self.open
        while len(open_) > 3 and open_[-1].tag not in tags:
            if open_.pop().tag in ("td", "th", "caption"):
                self.clear_to_marker()

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            self.in_head = self.in_head and tag == "html"
            return
        if self.open[-1].tag == tag and (tag in TEXT_ONLY or tag == "template"):
            self.open.pop()
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self.in_scope(P, P_SCOPE):
                self.in_head = False
                self.push("p")
            self.implied_ends("p")
            self.pop_to({"p"})
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied_ends()
                self.pop_to(HEADINGS)
        elif tag in ("td", "th", "caption"):
            if self.in_scope({tag}, TABLE_SCOPE):
                self.pop_to({tag})
                self.clear_to_marker()
        elif tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if self.in_scope({tag}, TABLE_SCOPE if tag != "table" else OUTER_SCOPE):
                self.to_context({tag})
                self.open.pop()
        elif tag in ("li", "dd", "dt"):
            if self.in_scope({tag}, ITEM_SCOPE if tag == "li" else SCOPE):
                self.implied_ends(tag)
                self.pop_to({tag})
        elif tag in CLOSES_P or tag in ("button", "applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.implied_ends()
                self.pop_to({tag})
                if tag in MARKED:
                    self.clear_to_marker()
        else:
            self.end_any(tag)

    def end_any(self, tag: str) -> None:
        for e in reversed(self.open[3:]):
            if e.tag == tag:
                self.implied_ends(tag)
                self.pop_to({tag})
                return
            if e.tag in SPECIAL:
                return

    def characters(self, value: str) -> None:
        if "\r" in value or "\0" in value:
            value = value.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        top = self.open[-1]
        if top.tag in TEXT_ONLY:
            top.append(value)
            return
        if self.in_head:
            value = value.lstrip(" \t\n\f")
            if not value:
                return
            self.in_head = False
        if value:
            if self.active and (top.tag not in TABLE_CONTEXT or value.strip(" \t\n\f")):
                self.reconstruct()
            self.place(value)

    def comment(self) -> None:
        """An element without content stands for it: texts on its two sides stay apart."""
        if not self.in_head:
            self.top().append(Element("#comment"))


def parse(source: str) -> TreeBuilder:
    """The builder after all of source: head, body and root are its elements."""
    b, preformatted = TreeBuilder(), False
    start, end, characters = b.start, b.end, b.characters
    for t in tokens(source.removeprefix("﻿")):
        kind = t[0]
        if kind == "text":
            characters(t[1])
        elif kind == "start":
            preformatted = preformatted or t[1] in PREFORMATTED
            start(*t[1:])
        elif kind == "end":
            end(t[1])
        else:
            b.comment()
    for pre in b.root.find_all(PREFORMATTED) if preformatted else ():
        if pre.children and isinstance(pre.children[0], str) and pre.children[0].startswith("\n"):
            pre.children[0] = pre.children[0][1:]
    return b
