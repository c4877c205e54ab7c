"""Winnowing against windows looked up one by one."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folium.llm import decontaminate, queries
from tests.llm.test_operators import SCHEMA, empty, odd_docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"
NONE = hashlib.sha256(b"").hexdigest()


def split(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[x]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def found(spark, docs, items):
    df = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    rows = df.collect()
    for r in rows:  # the spans are the words hit, apart and in order
        ends = [x for s in r["spans"] for x in (s["start"], s["end"])]
        assert ends == sorted(set(ends)) and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)


def test_brute_force(spark):
    r = random.Random(11)
    for vocabulary in ("a b c", "the of and river stone Ünï 漢字 x9 B2".upper() + " light paper", " ".join(f"w{i}" for i in range(300))):
        v = vocabulary.split()
        text = lambda n: r.choice((" ", "\n", ", ")).join(r.choice(v) for _ in range(n))
        items = [(i, text(r.choice((1, 3, 7, 9, 10, 11, 12, 25, 40)) + (4 if len(v) < 5 else 0))) for i in range(25)]
        items += [(3, items[4][1]), (77, items[5][1]), items[6], (None, text(12)), (8, None), (9, ""), (None, None)]
        docs = [(i, text(r.randrange(0, 90))) for i in range(40)]
        for i in range(40, 80):  # passages of items, cut at either end
            w = (items[r.randrange(len(items))][1] or "").split()
            a, b = r.randrange(4), r.randrange(4)
            docs.append((i, f"{text(r.randrange(20))} {' '.join(w[a : len(w) - b])} {text(r.randrange(20))}"))
        docs += [docs[50], docs[50], (None, docs[51][1]), (200, None), (201, ""), (202, " \n!? ")]
        want = by_hand(docs, items)
        assert found(spark, docs, items) == want and any(x[-1] for x in want)


def test_no_shared_window_is_missed():
    """Whatever stands around them, LENGTH equal words keep a gram at the same place."""
    r = random.Random(3)
    for _ in range(300):
        make = lambda n: [r.randrange(3) for _ in range(n)]
        a, b, shared = make(r.randrange(30)), make(r.randrange(30)), make(decontaminate.LENGTH)
        kept = []
        for before in (a, b):
            codes = np.array(before + shared + make(9), np.uint64)
            places, h = decontaminate.winnow(codes, np.zeros(len(codes), np.int64))
            kept.append({(p - len(before), int(x)) for p, x in zip(places, h) if len(before) <= p <= len(before) + decontaminate.LENGTH - decontaminate.GRAM})
        assert kept[0] & kept[1]


def test_long_texts_and_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = lambda n: " ".join(f"f{i % 977}" for i in range(n))
    n = decontaminate.BLOCK
    texts = [f"{filler(n - k)} {passage} {filler(2 * n)} {passage}" for k in (1, 19, 30, 59)]
    docs = list(enumerate(texts)) + [(100 + i, f"x {passage}") for i in range(300)] + [(999, "漢" * 2_000_000)]
    got = found(spark, docs, [(1, passage), (2, passage), (3, "p0 p1 p2 p3"), (4, texts[0])])
    of = lambda *i: hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()
    assert got[(0, 3 * n - 1 + 120, 3 * n + 119, 4, of(1, 2, 3, 4), True)] == 1
    assert all(got[(100 + i, 61, 60, 4, of(1, 2, 3, 4), True)] == 1 for i in range(300))
    assert got[(999, 1, 0, 0, NONE, False)] == 1


def test_odd_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([(1, "of of of of of of of of of of"), (2, "one")], ITEMS)
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == 15 and {r["doc_id"] for r in rows if r["contaminated"]} == {8, 6}
    assert {r["n_hit"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert decontaminate.contamination(empty(spark), items).count() == 0
    none = decontaminate.contamination(docs, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == 15 and not any(r["contaminated"] for r in none)
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("row", "n", "hash", "place", "words", "gram", "grams", "spans", "item", "key")])
    assert decontaminate.contamination(clash, clash.withColumnRenamed("doc_id", "item_id")).count() == 15
    assert "doc_id long" in SCHEMA


def test_query(spark):
    got = queries.op11_decontaminate(spark, "/root/testdata/sf0.001")
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([tuple(x) for x in docs.select("doc_id", "text").collect()], [tuple(x) for x in items.select("item_id", "text").collect()])
    assert Counter(tuple(x) for x in got.collect()) == want and any(x[-1] for x in want)
