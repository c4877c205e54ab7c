"""CSV, JSON, XML, plain text and Markdown to documents."""

from __future__ import annotations

import re

from folium.model import Document, node, plain_cell, table
from folium.text import SPACE, decode, is_letter, trim

_CSV = re.compile(r'"|,|\r\n|\r|\n')


def _field(raw: str, quoted: bool) -> str:
    raw = raw.strip(" \t\n\r")
    if quoted:
        raw = raw[1:] if raw.startswith('"') else raw
        raw = raw[:-1] if raw.endswith('"') else raw
        raw = raw.replace('""', '"')
    return raw


def csv_records(content: str) -> list[list[str]]:
    """Records of comma-separated text: quotes open and close anywhere, rows keep their own lengths, empty lines are none."""
    records: list[list[str]] = []
    row: list[str] = []
    start, inside, quoted = 0, False, False

    def close(end: int) -> None:
        nonlocal row
        row.append(_field(content[start:end], quoted))
        if row != [""] or quoted:
            records.append(row)
        row = []

    for m in _CSV.finditer(content):
        mark = m[0]
        if mark == '"':
            inside, quoted = not inside, True
        elif not inside:
            if mark == ",":
                row.append(_field(content[start : m.start()], quoted))
            else:
                close(m.start())
            start, quoted = m.end(), False
    if start < len(content) or row:
        close(len(content))
    return records


def parse_csv(content: bytes) -> Document:
    records = csv_records(decode(content))
    if not records:
        return Document()
    cells = [[plain_cell(c) for c in r] for r in records]
    return Document([table(cells[0], cells[1:])])


_BLANK = re.escape(SPACE)
_JSON = re.compile(rf'[{_BLANK}]+|("(?:[^"\\]|\\.)*")|([{{}}\[\],:])|([^{_BLANK}{{}}\[\],:]+)', re.S)


def pretty_json(source: str) -> str:
    """Re-indented by 4, tokens as they were written; text that breaks off within a string, after a comma or before any value comes back as it is."""
    found = [m for m in _JSON.finditer(source) if m.lastindex]
    if any(m[0][0] == '"' and m[1] is None for m in found):  # a string that never ends
        return source
    tokens = [m[0] for m in found]
    out: list[str] = []
    depth, at, complete = 0, 0, False
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t in "{[":
            if at < len(tokens) and tokens[at] in "}]":
                out.append(t + tokens[at])
                at, complete = at + 1, True
            else:
                depth += 1
                out.append(t + "\n" + "    " * depth)
        elif t in "}]":
            depth -= 1
            out.append("\n" + "    " * depth + t)
            complete = True
        elif t == ",":
            out.append(",\n" + "    " * depth)
            complete = False
        elif t == ":":
            out.append(": ")
        else:
            out.append(t)
            complete = True
    return "".join(out) if complete else source


def parse_json(content: bytes) -> Document:
    return Document([node("code_block", text=pretty_json(decode(content)), language="json")])


_TAG = re.compile(r"([^<]*)<([^>]*)>")


def pretty_xml(source: str) -> str:
    """Re-indented by 2; an element of one line of text stays on one line. Declarations go, other tags stay as written."""
    tags = _TAG.findall(source[: source.rfind(">") + 1])  # each < before the last > is closed
    out: list[str] = []
    depth, at = 0, 0

    def closing(i: int) -> bool:
        return i < len(tags) and tags[i][1].startswith("/")

    while at < len(tags):
        before, tag = tags[at]
        if before := trim(before):
            out.append("  " * depth + before)
        at += 1
        if tag.startswith("?xml"):
            continue
        if tag.startswith("/"):
            depth = max(0, depth - 1)
            out.append(f"{'  ' * depth}<{tag}>")
        elif tag[:1] in ("?", "!") or tag.endswith("/"):
            out.append(f"{'  ' * depth}<{tag}>")
        elif closing(at) and (leaf := trim(tags[at][0])) and "\n" not in leaf:
            out.append(f"{'  ' * depth}<{tag}>{leaf}<{tags[at][1]}>")
            at += 1
        else:
            out.append(f"{'  ' * depth}<{tag}>")
            depth += 1
    return "\n".join(out) or source


def parse_xml(content: bytes) -> Document:
    return Document([node("code_block", text=pretty_xml(decode(content)), language="xml")])


def parse_raw(content: bytes) -> Document:
    """Markdown and plain text stay as they are."""
    return Document([node("raw_block", text=decode(content))])


_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_WORD = re.compile(r"[^\W\d_]{2,}")


_FIRST_LETTERS = re.compile(r"[^\W\d_]*")


def _last_letters(s: str) -> str:
    """The run of letters that s ends with, read from its end."""
    n = len(s)
    while n and is_letter(s[n - 1]):
        n -= 1
    return s[n:]


def _join(parts: list[str], words: set[str], longest: int) -> str:
    """Lines as one; what a hyphen becomes hangs on the word before it, of which only the last is looked at again."""
    done, tail, word = [], parts[0], _last_letters(parts[0][:-1])
    for part in parts[1:]:
        if word and tail[-1] == "-":
            first = _FIRST_LETTERS.match(part)[0]
            known = len(word) <= longest and word.lower() in words and first.lower() in words
            grows = not known and len(first) == len(part) - 1 and part[-1] == "-"
            tail = (tail if known else tail[:-1]) + part
            word = word + first if grows or (not known and part == "-") else _last_letters(part[:-1])
        else:
            done.append(tail)
            tail, word = f" {part}", _last_letters(part[:-1])
    return "".join([*done, tail])


def text_blocks(source: str, reflow: bool = True) -> list[str]:
    """Paragraphs of plain text. reflow joins wrapped lines: a hyphen at a line's end stays if both halves are words of the text."""
    source = re.sub(r"\r\n|\r|\f", "\n", source)
    found = [[x for x in map(trim, p.split("\n")) if x] for p in _PARAGRAPH.split(source)]
    found = [p for p in found if p]
    if not reflow:
        return ["\n".join(p) for p in found]
    words = {w.lower() for w in _WORD.findall(source)}
    merged: list[list[str]] = []
    for p in found:
        if merged and len(merged[-1][-1]) > 1 and merged[-1][-1][-1] == "-" and is_letter(merged[-1][-1][-2]):
            merged[-1] += p
        else:
            merged.append(list(p))
    longest = max(map(len, words), default=0)
    return [_join(p, words, longest) for p in merged]


BROKEN = "\ufffe"
_BROKEN_WORD = re.compile(rf"(?<![^\W\d_])[^\W\d_]+{BROKEN}[^\W\d_]+")


def repair_hyphens(source: str) -> str:
    """U+FFFE, a hyphen at a line's end in extracted text: kept as ``-`` between two words known elsewhere in the text, else dropped."""
    first, *rest = source.split(BROKEN)
    if not rest:
        return source
    # halves of broken words are no evidence of themselves
    words = {w.lower() for w in _WORD.findall(_BROKEN_WORD.sub(" ", source))}
    out, before, longest = [first], _last_letters(first), max(map(len, words), default=0)
    for part in rest:
        after = _FIRST_LETTERS.match(part)[0]
        known = len(before) <= longest and before.lower() in words and after.lower() in words
        out += ["-" * known, part]
        before = before + part if after == part and not known else _last_letters(part)
    return "".join(out)


def parse_pdf_text(extracted: str) -> Document:
    """A document from text that an extractor found, page after page."""
    return Document([node("paragraph", content=[node("text", text=p)]) for p in text_blocks(repair_hyphens(extracted))])


