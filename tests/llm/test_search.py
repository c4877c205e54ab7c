"""op3 where it grew with the driver or with the square of the input: query words, bounds of a batch of queries."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import search


def texts(n, seed, words=400, most=80):
    r = random.Random(seed)
    return [" ".join(f"w{int(words * r.random() ** 3)}" for _ in range(r.randrange(0, most))) for _ in range(n)]


def test_no_query_is_read_on_the_driver(spark, monkeypatch):
    """Words of queries are taken by tasks; before, the driver took them, one text after another, in each block."""
    docs = spark.createDataFrame([*enumerate(texts(300, 1)), (300, None), (301, ". -"), (40, "w1 w2"), (40, "w1 w2")], "doc_id long, text string")
    want = search.search(docs, F.col("doc_id") % 20 == 0, k=5).collect()
    real, driver = search.words_of, os.getpid()
    monkeypatch.setattr(search, "words_of", lambda texts: real(texts) if os.getpid() != driver else pytest.fail("read on the driver"))
    got = search.search(docs, F.col("doc_id") % 20 == 0, k=5, query_block=4).collect()
    assert sorted(want) == sorted(got) and len(want) > 60 and sum(r["query_id"] == 40 for r in got) == 10


@pytest.mark.parametrize("window, block, stride, long, summed", [(64, 4, 128, 16, 8), (1024, 4, 16_384, 16, 8), (32, 8, 32, 64, 2), (256, 4, 512, 2, 1)])
def test_a_batch_finds_what_all_scores_say(monkeypatch, window, block, stride, long, summed):
    for name, value in {"WINDOW": window, "BLOCK": block, "STRIDE": stride, "LONG": long, "SUMMED": summed}.items():
        monkeypatch.setattr(search, name, value)
    bodies = texts(700, 2)
    found, lengths = search.words_of(pa.array(bodies))
    row = search.shard_row(np.arange(700), lengths, pa.chunked_array([found]))
    known = search._terms(row) + ["none of them"]
    idf = np.log1p(700 / np.append(np.frombuffer(row["counts"], np.int32), 1))
    mean, number = row["words"] / 700, {w: i for i, w in enumerate(known)}
    shard = search.Shard(row, known, idf, mean)
    bags = [np.unique([number[w] for w in text.split()], return_counts=True) if text else None for text in bodies]
    queries = [(np.append(b[0], len(known) - 1), np.append(b[1], 1).astype(float)) for b in bags[::9] if b is not None]
    scores = np.zeros((len(queries), 700))
    for d, b in enumerate(bags):
        if b is not None:
            impact = np.zeros(len(known))
            impact[b[0]] = idf[b[0]] * b[1] * 2.2 / (b[1] + 1.2 * (0.25 + 0.75 * b[1].sum() / mean))
            scores[:, d] = [round(float(impact[t] @ n), 6) for t, n in queries]
    want = [[d for d in np.lexsort((np.arange(700), -s))[:10] if s[d] > 0] for s in scores]
    read = []
    for nth in (None, 9, 0):  # no floors, the tenth score and the first
        floors = [0.0 if nth is None else s[w[min(nth, len(w) - 1)]] for s, w in zip(scores, want)]
        shard.table = Counted(shard.table, rows := [])
        for (ids, got), s, w, floor in zip(shard.tops(queries, floors, 10), scores, want, floors):
            some = [d for d in w if s[d] >= floor]
            assert ids[: len(some)].tolist() == some and np.allclose(got[: len(some)], s[some], atol=2e-6)
        read.append(sum(rows))
    assert read[2] <= read[1] <= read[0]


class Counted:
    """A table that notes how many rows are read."""

    def __init__(self, table, rows):
        self.table, self.rows, self.shape = getattr(table, "table", table), rows, table.shape

    def __getitem__(self, at):
        self.rows.append(len(at))
        return self.table[at]


def test_few_documents_are_scored_in_full():
    """With the tenth score as floor, bounds of frequent words at each place leave few documents; the block maxima alone leave many more."""
    n, r = 4000, np.random.default_rng(5)
    often = r.poisson(r.gamma(1.0, 1.0, (n, 60)))
    lengths = often.sum(axis=1)
    words = pa.array([f"w{j}" for i in range(n) for j in np.repeat(np.arange(60), often[i])])
    row = search.shard_row(np.arange(n), lengths, pa.chunked_array([words]))
    shard = search.Shard(row, [f"w{j}" for j in range(60)], np.ones(60), lengths.mean())
    queries = [(np.arange(60), np.maximum(1.0, often[i])) for i in range(20)]
    tenth = [float(s[-1]) for _, s in shard.tops(queries, [0.0] * 20, 10)]
    shard.table = Counted(shard.table, rows := [])
    one = [ids.tolist() for ids, _ in shard.tops(queries, tenth, 10)]
    by_batch = sum(rows)
    rows.clear()
    weights = shard.weights(queries)
    two = [shard.top(*q, weights[j], weights[j] @ shard.block_max.T, 10, tenth[j])[0].tolist() for j, q in enumerate(queries)]
    assert one == two and 200 <= by_batch <= 220 and sum(rows) > 4 * by_batch


def test_words_of_a_shard_are_numbered_at_once():
    row = {"terms": "\n".join(["b", "é", "aa", "日本"]).encode()}
    assert search._codes(row, ["日本", "b", "c", "é"]).tolist() == [1, 3, -1, 0]
    assert search._codes({"terms": b""}, ["a"]).tolist() == [] and search._codes({"terms": b"a"}, {"a": 0}).tolist() == [0]
