"""Source divergence audit over an integer dictionary of terms.

Each task gives its words numbers and counts them per (language, source), so that a group's rows shrink before any shuffle. The counts are dealt by ranges of (language, term) and
sorted, so that a chunk, CHUNK terms or so of one language, holds all that is known of its terms. There the terms that enough documents have become a sorted array; searchsorted gives each count its term's id
and its source's id, and bincount makes one dense vector of counts per source. Ids go up as terms do in UTF-8 order, from chunk to chunk too, so ties are broken by id. The encoded
chunks are stored once; a first pass over them sums kept terms and occurrences, a second one computes the shares and divergences of all pairs of sources and each source's leading terms.

All numbers are whole and exact: shares are parts of a billion, quotients are taken digit by digit so that no product leaves 64 bits, sums over chunks are Spark's, which fail rather than wrap.
The vectors of a chunk are bounded by CHUNK_CELLS, however many sources a language has; pairs of sources are the result's own size.

Defined results: a null text, language or source is ''. A language without kept terms has pairs of value 0 and no terms. Every row is a document of its own, repeated ones too. Terms of any length
count whole. Extra columns of any name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm import words as W
from folium.llm.common import partitions, slices, stored, with_size

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP = 3, 200
CHUNK, CHUNK_CELLS = 1 << 12, 1 << 20
#: A task's counts go out when they are so many, or their terms so many bytes.
HELD_COUNTS, HELD_BYTES = 1 << 20, 64 << 20
_WORDS = W.letters(digits=False)
COUNTS = "lang string, source string, term binary, occurrences long, documents long"


class _Numbers(dict):
    """Words to the numbers in which they were first seen."""

    def __init__(self):
        super().__init__()
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.size += len(word)
        return n


class _Counted:
    """Occurrences and documents of (group, word), as sorted arrays that are merged as they grow."""

    def __init__(self):
        self.words, self.groups = _Numbers(), {}
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, groups: list[tuple[str, str]], raws: list[bytes | None]) -> None:
        """The documents of a batch."""
        numbers, counts = [], np.zeros(len(raws), np.int64)
        for i, raw in enumerate(raws):
            for part in W.segments(raw or b"", _WORDS):
                numbers.append(np.fromiter(map(self.words.__getitem__, part), np.int64, len(part)))
                counts[i] += len(part)
        of = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        if not numbers:
            return
        # one sort gives the distinct words of each document with their counts
        key, n = np.unique((np.repeat(np.arange(len(raws)), counts) << 32) | np.concatenate(numbers), return_counts=True)
        key = (of[key >> 32] << 32) | (key & 0xFFFFFFFF)
        self.waiting.append(_summed(key, np.column_stack([n, np.ones(len(n), np.int64)])))
        self.fresh += len(self.waiting[-1][0])
        if self.fresh > len(self.keys) + (1 << 17):
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.sums), *self.waiting]
        self.keys, self.sums = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([s for _, s in parts]))
        self.waiting, self.fresh = [], 0

    def full(self) -> bool:
        return len(self.keys) + self.fresh > HELD_COUNTS or self.words.size > HELD_BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of COUNTS; each group has one without a term."""
        self.merge()
        words, groups = np.array([*self.words, None], object), [*self.groups]
        for at in range(0, len(self.keys) or 1, 1 << 15):
            key, sums = self.keys[at : at + (1 << 15)], self.sums[at : at + (1 << 15)]
            of, word = key >> 32, key & 0xFFFFFFFF
            if at == 0:
                bare = np.arange(len(groups))
                of, word = np.concatenate([bare, of]), np.concatenate([np.full(len(bare), len(words) - 1), word])
                sums = np.concatenate([np.zeros((len(bare), 2), np.int64), sums])
            names = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(of)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(words[word].tolist(), pa.binary()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["lang", "source", "term", "occurrences", "documents"]
            )


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(sums[order], first, axis=0) if len(first) else sums[:0]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """COUNTS summed over the table; the row of a group without a term has term null."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches):
        held = _Counted()
        for batch in slices(batches, "text"):
            held.add(list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())), W.raw_texts(batch.column("text")))
            if held.full():
                yield from held.batches()
                held = _Counted()
        if held.groups:
            yield from held.batches()

    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


CHUNKS = "lang string, terms array<binary>, sources array<string>, source_ids array<int>, term_ids array<int>, counts array<long>"


def _chunk(lang: str, terms: list[bytes], sources: list[str], counts: np.ndarray, documents: np.ndarray, least: int) -> dict | None:
    """The encoding of all counts of a range of terms: kept terms and sources in order, and an id of either for each count. None where no term is kept."""
    names = np.array(terms, object)
    known, of = np.unique(names, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, of, documents)
    kept = known[total >= least]
    if not len(kept):
        return None
    # a term that is not kept would stand where a kept one does
    at = np.minimum(np.searchsorted(kept, names), len(kept) - 1)
    rows = np.flatnonzero(kept[at] == names)
    groups = np.array(sorted(set(sources)), object)
    return {
        "lang": lang, "terms": kept.tolist(), "sources": groups.tolist(), "source_ids": np.searchsorted(groups, np.array(sources, object)[rows]).tolist(),
        "term_ids": at[rows].tolist(), "counts": counts[rows].tolist()
    }


def encoded(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """CHUNKS of the kept terms; all counts of a term are in one chunk, whose terms follow each other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = counts.sparkSession
    dealt = counts.where("term is not null").repartitionByRange(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    schema = to_arrow_schema(spark.createDataFrame([], CHUNKS).schema)

    def run(batches):
        held: list[tuple] = []
        distinct = size = 0

        def flush():
            nonlocal held, distinct, size
            if held:
                lang, sources, terms, n, documents = zip(*held)
                made = _chunk(lang[0], terms, sources, np.array(n, np.int64), np.array(documents, np.int64), least)
                if made:
                    yield pa.RecordBatch.from_pylist([made], schema=schema)
            held, distinct, size = [], 0, 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "term", "occurrences", "documents"))):
                last = held[-1] if held else None
                if last is not None and (last[0] != row[0] or last[2] != row[2]):
                    if last[0] != row[0] or distinct >= CHUNK or len(held) >= CHUNK_CELLS or size >= 8 << 20:
                        yield from flush()
                    else:
                        distinct, size = distinct + 1, size + len(row[2])
                held.append(row)
        yield from flush()

    return dealt.mapInArrow(run, CHUNKS)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in base 1000."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


PARTS = "lang string, source string, part string, item string, value long"


def _dense(cells: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """bincount of whole numbers: both halves of a count are exact as doubles."""
    low, high = (np.bincount(cells, part, size).astype(np.int64) for part in (counts & 0xFFFFFFFF, counts >> 32))
    return (high << 32) + low


class _Scores:
    """Sums of the pairs of each language over a task's chunks, and the leading terms of each chunk."""

    def __init__(self):
        self.pairs: dict[str, tuple[list[str], np.ndarray]] = {}

    def add(self, chunk: dict, groups: list[tuple[str, int]], kept: int) -> list[tuple]:
        """The chunk's TOP terms of each source; its part of the pairs is kept. groups: sources in order and occurrences of kept terms."""
        lang, terms = chunk["lang"], chunk["terms"]
        names, n = [g for g, _ in groups], len(terms)
        of = np.searchsorted(np.array(names, object), np.array(chunk["sources"], object))
        cells = of[np.asarray(chunk["source_ids"], np.int64)] * n + np.asarray(chunk["term_ids"], np.int64)
        counts = _dense(cells, np.asarray(chunk["counts"], np.int64), len(names) * n).reshape(len(names), n)
        totals = np.array([t for _, t in groups], np.int64)
        p = shares(counts, totals[:, None] + kept)
        q = shares(counts.sum(axis=0), int(totals.sum()) + kept)
        sums = self.pairs.setdefault(lang, (names, np.zeros((len(names), len(names)), np.int64)))[1]
        out = []
        for i, name in enumerate(names):
            for j in range(len(names)):
                if i != j:
                    sums[i, j] += divergence(p[i], p[j]).sum()
            found = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = divergence(p[i, found], q[found])
            out += [(lang, name, "term", terms[found[k]].decode("utf-8", "replace"), int(f[k])) for k in np.lexsort((found, -f))[:TOP]]
        return out

    def rows(self) -> Iterator[tuple]:
        for lang, (names, sums) in self.pairs.items():
            for i, name in enumerate(names):
                yield from ((lang, name, "pair", other, int(sums[i, j])) for j, other in enumerate(names) if i != j)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    chunks = stored(encoded(counts, least), "chunks")
    pairs = F.explode(F.arrays_zip("source_ids", "counts")).alias("c")
    by_source = chunks.select("lang", "sources", pairs).select("lang", F.element_at("sources", F.col("c.source_ids") + 1).alias("source"), F.col("c.counts").alias("n"))
    total = by_source.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(counts.where("term is null").select("lang", "source").join(total, ["lang", "source"], "left").fillna({"total": 0}), "groups")
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("kept"))
    # each chunk is given the totals of its language's sources, as many as its vectors
    of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")).join(kept, "lang")
    of_lang = with_size(stored(of_lang, "languages"), F.size("groups") * 3)

    def run(batches):
        scores = _Scores()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                known = [(g["source"], g["total"]) for g in chunk["groups"]]
                for part in _narrowed(chunk, len(known)):
                    yield from _batches(scores.add(part, known, chunk["kept"]))
        yield from _batches(scores.rows())

    scored = chunks.join(of_lang, "lang").mapInArrow(run, PARTS)
    others = groups.select("lang", F.col("source").alias("item"))
    zero = groups.select("lang", "source").join(with_size(stored(others, "others"), F.lit(3)), "lang").where("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")
    )
    scored = stored(scored, "scored")
    pair = scored.where("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(best)) for x in (pair, scored.where("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP))


def _batches(rows) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    for part in iter(lambda it=iter(rows): list(islice(it, 1 << 14)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=["lang", "source", "part", "item", "value"])


def _narrowed(chunk: dict, groups: int) -> Iterator[dict]:
    """The chunk in pieces of so few terms that the vectors of all groups stay within CHUNK_CELLS."""
    n, most = len(chunk["terms"]), max(1, CHUNK_CELLS // max(1, groups))
    if n <= most:
        yield chunk
        return
    ids = {c: np.array(chunk[c], np.int64) for c in ("source_ids", "term_ids", "counts")}
    for at in range(0, n, most):
        rows = (ids["term_ids"] >= at) & (ids["term_ids"] < at + most)
        yield chunk | {"terms": chunk["terms"][at : at + most], "source_ids": ids["source_ids"][rows], "term_ids": ids["term_ids"][rows] - at, "counts": ids["counts"][rows]}
