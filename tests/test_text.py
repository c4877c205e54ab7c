"""Reflow and repair as expressions against the same in Python and against a join of whole strings; parsers on hostile texts."""

import io
import random
import re
import time
import zipfile

import pytest

from folium.functions.reflow import BROKEN, reflowed, repaired
from folium.parsers import plain
from folium.parsers.plain import pretty_xml, repair_hyphens, text_blocks
from folium.render import render
from folium.sources.archive import parse_epub
from folium.text import is_letter

PIECES = ["word", "Well", "known", "well", "a", "-", "a-", "well-", "known-", "x ", " ", "\n", "\n", "\n\n", "\r\n", "\f", "é-", "\n-\n", "1-", "well-\nknown", "be-\n\nginn", "漢-\n漢"]


def made(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r["made"] for r in df.select("id", expression(df["text"]).alias("made")).collect()}


def joined_by_hand(source):
    """Paragraphs joined character by character on one growing string."""
    source = re.sub(r"\r\n|\r|\f", "\n", source)
    words = {w.lower() for w in re.findall(r"[^\W\d_]{2,}", source)}
    found = [[x.strip() for x in p.split("\n") if x.strip()] for p in re.split(r"\n[ \t]*\n", source)]
    merged = []
    for p in filter(None, found):
        if merged and len(merged[-1][-1]) > 1 and merged[-1][-1][-1] == "-" and is_letter(merged[-1][-1][-2]):
            merged[-1] += p
        else:
            merged.append(list(p))
    out = []
    for p in merged:
        s = p[0]
        for part in p[1:]:
            if len(s) > 1 and s[-1] == "-" and is_letter(s[-2]):
                head, tail = re.search(r"[^\W\d_]+-\Z", s)[0][:-1], re.match(r"[^\W\d_]*", part)[0]
                s = (s if head.lower() in words and tail.lower() in words else s[:-1]) + part
            else:
                s = f"{s} {part}"
        out.append(s)
    return out


def test_reflow(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", "\n", "-", "a-", "a-\n-\n-\nb", "a-\n-\n\nb", None]
    got = made(spark, texts, reflowed)
    for i, x in enumerate(texts):
        if x is None:
            assert got[i] is None
        else:
            assert got[i] == joined_by_hand(x) == text_blocks(x), x


def test_repair(spark):
    r = random.Random(8)
    pieces = ["chat", "opt", BROKEN, BROKEN, " ", "chat opt ", "-", "1", "é", "漢", "\n"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(1500)] + ["", BROKEN, None]
    got = made(spark, texts, repaired)
    assert got == {i: None if x is None else repair_hyphens(x) for i, x in enumerate(texts)}


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([("a-\nb",)], "text string")
    plan = df.select(reflowed(df["text"]), repaired(df["text"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


HOSTILE = {"xml": "<a ", "lines": "a-\n", "words": "ab-\n", "broken": "ab" + BROKEN, "parts": "x " + BROKEN, "dash": "a-\n-\n"}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_in_python(name):
    run = {"xml": pretty_xml, "broken": repair_hyphens, "parts": repair_hyphens}.get(name, text_blocks)
    began = time.process_time()
    run(HOSTILE[name] * 60_000)
    assert time.process_time() - began < 8


def test_hostile_texts_in_spark(spark):
    began = time.time()
    got = made(spark, ["a-\n" * 20_000, "ab-\n" * 20_000, "word-\nnext " * 20_000], reflowed)
    assert got[0] == ["a" * 20_000 + "-"] and len(got[1][0]) in (60_000, 40_001) and got[2][0].startswith("word-next word-next")
    assert made(spark, [("ab" + BROKEN) * 20_000], repaired)[0] == "ab" * 20_000
    assert time.time() - began < 90


def book(package):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='p.opf'/></rootfiles></container>")
        z.writestr("p.opf", package)
        for name in ("one", "two", "three"):
            z.writestr(f"{name}.xhtml", f"<html><head><title>{name}</title></head><body><p>{name}</p></body></html>")
    return out.getvalue()


ITEM = "<item id='{0}' href='{0}.xhtml' media-type='application/xhtml+xml'/>"


@pytest.mark.parametrize(
    ("package", "markdown", "title"),
    [
        (f"<package><metadata><title>plain</title></metadata><manifest>{ITEM.format('one')}</manifest><spine><itemref idref='one'/></spine></package>", "one", "one"),
        (f"<package><metadata><dc:title> A  B </dc:title><title>no</title></metadata><manifest>{ITEM.format('one')}</manifest><spine><itemref idref='one'/></spine></package>", "**Title:** A B\n\none", "A B"),
        (f"<package><manifest>{ITEM.format('one')}<x>{ITEM.format('two')}</x></manifest>{ITEM.format('three')}<spine><itemref idref='two'/><itemref idref='one'/><itemref idref='three'/></spine></package>", "one", "one"),
        (f"<package><manifest>{ITEM.format('one')}{ITEM.format('two')}</manifest><guide><itemref idref='two'/></guide><itemref idref='two'/><spine><itemref idref='one'/><b><itemref idref='two'/></b></spine></package>", "one", "one"),
    ],
)
def test_epub_packages(package, markdown, title):
    doc = parse_epub(book(package))
    assert (render(doc), doc.title) == (markdown, title)
    assert plain.parse_raw(b"x").blocks
