"""The audit against dense counts of Python's own numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folium.llm import divergence
from tests.llm.test_operators import empty, odd_docs

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "text string, lang string, source string"


def by_hand(docs, least=3, top=200):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(w)
        seen[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=lambda t: t.encode())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pair, 1)]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(term, 1)]
    return Counter(out)


def found(spark, docs, **more):
    df = divergence.audit(spark.createDataFrame(docs, DOCS).repartition(5), **more)
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_brute_force(spark, monkeypatch):
    r = random.Random(12)
    words = [f"{a}{b}" for a in "abxyzñé漢" for b in ("", "a", "bc", "É", "ö", "\U0001F600", "q" * 70)]
    text = lambda n: r.choice((" ", ", ", "1")).join(r.choice(words).upper() if r.random() < 0.3 else r.choice(words) for _ in range(n))
    docs = [(text(r.randrange(60)), r.choice(("en", "de", None)), r.choice(("s1", "s2", "s10", "ü", None))) for _ in range(300)]
    docs += docs[:9] + [(None, "en", "bare"), ("", "en", "bare"), ("lone words here", "it", "s1"), (None, "it", "s2"), ("x", "fr", "s"), (None, None, None)]
    want = by_hand(docs)
    assert found(spark, docs) == want and any(k[2] == "term" for k in want)
    # more terms in a group than are listed
    many = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k, 400)), "en", f"s{k % 3}") for k in range(0, 300, 10)]
    assert found(spark, many) == by_hand(many)


def test_small_pieces():
    """Chunks cut into pieces for many sources add up to the same, and counts beyond 32 bits are exact."""
    chunk = {"lang": "en", "terms": [b"a", b"b", b"c", b"d", b"e"], "sources": ["s", "t"], "source_ids": [0, 0, 1, 1], "term_ids": [0, 4, 4, 2], "counts": [5, (1 << 45) + 3, 7, 1]}
    groups, whole, cut = [("r", 0), ("s", (1 << 45) + 8), ("t", 8)], divergence._Scores(), divergence._Scores()
    terms = whole.add(chunk, groups, 5)
    size, divergence.CHUNK_CELLS = divergence.CHUNK_CELLS, 6
    try:
        pieces = list(divergence._narrowed(chunk, 3))
    finally:
        divergence.CHUNK_CELLS = size
    assert [len(x["terms"]) for x in pieces] == [2, 2, 1]
    assert sorted(t for x in pieces for t in cut.add(x, groups, 5)) == sorted(terms) and list(cut.rows()) == list(whole.rows())
    n = np.array([0, 1, 10**12, 10**15 - 1])
    assert divergence.shares(n, 10**15 + 7).tolist() == [1 + 10**9 * (int(x) + 1) // (10**15 + 7) for x in n]


def test_odd_tables(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert Counter(tuple(r) for r in divergence.audit(docs).collect()) == by_hand(rows)
    assert divergence.audit(empty(spark)).count() == 0
    clash = docs.select("text", "lang", "source", *[F.lit(1).alias(c) for c in ("term", "occurrences", "documents", "part", "item", "value", "rank", "groups")])
    assert divergence.audit(clash).count() == divergence.audit(docs).count()
    long = [(" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(400_000)), "en", "s")] * 3 + [("漢" * 500_000, "en", "t")] * 3
    assert found(spark, long) == by_hand(long)
