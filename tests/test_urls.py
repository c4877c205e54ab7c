"""References resolved as expressions against the standard library's resolution."""

import random
from urllib.parse import urljoin

from folium.functions.urls import resolved
from folium.parsers.html_walk import Walker

BASES = ["http://h.org/a/b/c?q#f", "https://h.org", "http://h.org/", "http://u:p@h.org:80/x/y/", "file:///a/b", "HTTP://H.org/A/b", "ftp://h/a//b/c", "http://h.org/a?x/y", "http://h.org/é/b c"]
KNOWN = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", ".": "http://a/b/c/", "..": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x", "//g/x": "http://g/x", "mailto:x@y": "mailto:x@y", "https://z/../y": "https://z/../y",
}


def made(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "id int, b string, r string")
    return {r["id"]: r["url"] for r in df.select("id", resolved(df["b"], df["r"]).alias("url")).collect()}


def test_examples_of_the_standard(spark):
    got = made(spark, [("http://a/b/c/d;p?q", r) for r in KNOWN])
    assert dict(zip(KNOWN, got.values())) == KNOWN


def test_against_the_standard_library(spark):
    r = random.Random(5)
    pieces = ["a", "b.html", ".", "..", "/", "/", "//", "?", "x=1", "#", "f", "é", "%20", "g h", "..."]
    pairs = [(b, "".join(r.choice(pieces) for _ in range(r.randrange(8)))) for b in BASES for _ in range(400)]
    pairs = [(b, x) for b, x in pairs if not x.startswith("///")]  # an authority that is empty: the library's versions differ
    got = made(spark, pairs)
    for i, (b, x) in enumerate(pairs):
        assert got[i] == (urljoin(b, x.strip()) or x), (b, x)


def test_what_is_left_alone(spark):
    pairs = [("", "a/b"), (None, "../x"), ("http:nothing", "x"), ("mailto:a@b", "x"), ("http://h/", None), ("http://h/a", ""), ("http://h/a/b", "  ../c \n"), ("http://h/a", "javascript:x()")]
    got = made(spark, pairs)
    assert [got[i] for i in range(len(pairs))] == ["a/b", "../x", "x", "x", None, "http://h/a", "http://h/c", "javascript:x()"]
    assert [Walker(b or "").url(x) for b, x in pairs if x is not None] == [got[i] for i, (_, x) in enumerate(pairs) if x is not None]
