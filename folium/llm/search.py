"""Exact BM25 top-k: an inverted index, searched shard by shard with block-max WAND, merged under global statistics.

The index is built once, over every word of every document, and written to the shared folder: one row for each shard of at most
shard_docs documents, with posting lists (places in rising order, and frequencies). Scores use the document frequencies, the number
of documents and the mean length of the whole collection, so those of different shards compare and the merged top k is exact.

In a shard similar documents have neighbouring places. Each list has the largest impact of each window of WINDOW places and, where it
holds a LONG-th of the shard's documents or more, of each block of BLOCK places; how often a document has the word of such a list is kept as a column.
A query walks the shard in the order of places, with a cursor into each of its lists. The next pivots are the windows, from the cursors on, whose
summed maxima pass the threshold (the k-th score so far, or a floor known from other shards), STRIDE places at most at a time; all cursors skip to them, and what lies
between is never read. Within them the postings of the shorter lists are summed, and with the bounds of the long ones they name the pivot documents;
only those are scored in full and can raise the threshold. The bounds of the long lists are those of the blocks; for the longest (a SUMMED-th of the documents)
their impacts are summed at each place. Queries whose heaviest words are the same stand together, and both come from a matrix product for AT_ONCE of them, rounded up.
An eighth of the shards is searched first: its k-th scores are the floors of the others.

Queries are bags of words: a word repeated in the query counts as often. Tasks take their words, once; they run in blocks of query_block rows and query_chars
characters at most, each against the same index.

Defined results: a null or empty text matches nothing, as document or query; only documents that share a word with the
query are returned, so a query can have fewer than k. Scores are rounded to 6 places; equal ones rank by the lower id. Repeated rows are
separate documents, but ask once for each different text of an id. Rows of a null id neither ask nor are found nor counted. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import dropped, slices, stored, whole

K1, B = 1.2, 0.75
#: Places of a window, of a block, and of the pivot windows that are read at once.
WINDOW, BLOCK, STRIDE = 8192, 4, 16_384
#: A list is long if a LONG-th of a shard's documents have the word, and has its impacts summed at each place if a SUMMED-th have it.
LONG, SUMMED = 16, 8
#: Queries whose bounds of long lists are computed at once.
AT_ONCE = 128
#: So many documents are scored first where there is no threshold yet.
FEW = 64
#: Scores that differ by less may be equal once they are rounded.
NEAR = 1e-5


#: What stands between words, which are runs of Unicode letters and numbers in lower case.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), BETWEEN, " "))
    words, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), lengths)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(owner, minlength=len(texts))


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges [starts, ends), one after another."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    out += np.arange(len(out))
    return out


# -- the index
INDEX = "docs long, words long, ids binary, lengths binary, terms binary, counts binary, places binary, times binary"


def shard_row(ids: np.ndarray, lengths: np.ndarray, words: pa.ChunkedArray) -> dict:
    """INDEX of documents, those that are alike side by side: of the same heaviest word among the frequent ones."""
    n = len(ids)
    coded = words.combine_chunks().dictionary_encode() if words.num_chunks else pa.array([], pa.string()).dictionary_encode()
    size = max(1, len(coded.dictionary))
    found, times = np.unique(np.repeat(np.arange(n), lengths) * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    place, term = np.divmod(found, size)
    df = np.bincount(term, minlength=len(coded.dictionary))
    frequent = np.flatnonzero(df[term] >= max(8, n / 8))
    weight = times[frequent] / (times[frequent] + lengths[place[frequent]] / max(1.0, lengths.mean())) * np.log1p(n / df[term[frequent]])
    by = frequent[np.argsort(weight, kind="stable")]
    heaviest = np.full(n, -1)
    heaviest[place[by]] = term[by]  # of several the largest is written last
    order = np.lexsort((lengths, heaviest))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = rank[place]
    by = np.argsort(term * n + place, kind="stable")
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return {
        "docs": n, "words": int(lengths.sum()), "ids": ids[order].tobytes(), "lengths": lengths[order].tobytes(), "terms": "\n".join(coded.dictionary.to_pylist()).encode(),
        "counts": df.astype(np.int32).tobytes(), "places": small(place[by]).tobytes(), "times": small(times[by]).tobytes(),
    }


def _numbers(blob: bytes, n: int) -> np.ndarray:
    """n whole numbers of the width that they were written with."""
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(blob) // n] if n else np.uint8)


def _terms(row: dict) -> list[str]:
    return row["terms"].decode().split("\n") if row["terms"] else []


def _indexed(shard_docs: int, shard_words: int):
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def run(batches):
        ids, lengths, words = [], [], []

        def shard() -> pa.RecordBatch:
            row = shard_row(np.concatenate(ids), np.concatenate(lengths), pa.chunked_array(words, pa.string()))
            ids.clear(), lengths.clear(), words.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

        for batch in slices(batches, "text", max_bytes=2 << 20):
            found, n = words_of(batch.column("text"))
            ids.append(batch.column("id").to_numpy())
            lengths.append(n)
            words.append(found)
            if sum(map(len, ids)) >= shard_docs or sum(map(len, words)) >= shard_words:
                yield shard()
        if ids:
            yield shard()

    return run


def _codes(row: dict, known) -> np.ndarray:
    """The numbers of the shard's terms among the words known, -1 for others."""
    blob = np.frombuffer(row["terms"], np.uint8)
    ends = np.flatnonzero(blob == 10)
    n = len(ends) + 1 if len(blob) else 0
    ends = np.concatenate(([0], ends - np.arange(len(ends)), [len(blob) - len(ends)])[: n + 2 if n else 1]).astype(np.int32)
    terms = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(blob[blob != 10]))
    known = known if isinstance(known, pa.Array) else pa.array(list(known), pa.string())
    return pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.zeros(0, np.int64)


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """The ranges [start, end) of rising whole numbers that follow one another."""
    first = _changes(numbers - np.arange(len(numbers)))
    return [(int(numbers[a]), int(numbers[b - 1]) + 1) for a, b in zip(first, np.append(first[1:], len(numbers)))]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _frequencies(shared):
    """term (number in the block's vocabulary) and df in each shard."""

    def run(batches):
        known = pa.array(shared.value, pa.string())
        df = np.zeros(len(known), np.int64)
        for row in _rows(batches):
            at = _codes(row, known)
            df[at[at >= 0]] += np.frombuffer(row["counts"], np.int32)[at >= 0]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


# -- the search
class Shard:
    """The posting lists of a shard that a block of queries asks for, with their maxima.

    known: the words asked for, in the order of their numbers."""

    def __init__(self, row: dict, known, idf: np.ndarray, mean_length: float):
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        n, counts, code = len(self.ids), np.frombuffer(row["counts"], np.int32).astype(np.int64), _codes(row, known)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        places, times = _numbers(row["places"], total), _numbers(row["times"], total)
        self.norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.windows = -(-n // WINDOW)

        def read(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The postings of lists, one after another: number of the list, place, times, impact."""
            at = spans(ends[lists] - counts[lists], ends[lists])
            of, place, often = np.repeat(np.arange(len(lists)), counts[lists]), places[at].astype(np.int64), times[at]
            return of, place, often, idf[code[lists]][of] * (K1 + 1) * often / (often + self.norm[place])

        # long lists, the longest first: how often each document has the word, a column each, and the maxima of blocks and windows;
        # the impacts themselves of those that a SUMMED-th of the documents have
        long = np.flatnonzero((code >= 0) & (counts >= max(8, n / LONG)))
        long = long[np.argsort(-counts[long], kind="stable")]
        of, place, often, impact = read(long)
        self.column = np.full(len(idf), -1)
        self.column[code[long]] = np.arange(len(long))
        self.idf = idf[code[long]]
        self.table = np.zeros((n, len(long)), often.dtype)
        self.table[place, of] = often
        bound = np.nextafter(impact.astype(np.float32), np.float32(np.inf))  # not below the impact
        blocks = self.windows * (WINDOW // BLOCK)
        block = of * blocks + place // BLOCK
        first = _changes(block)
        maxima = np.zeros(len(long) * blocks, np.float32)
        maxima[block[first]] = np.maximum.reduceat(bound, first) if len(first) else bound
        self.block_max = maxima.reshape(len(long), blocks).T
        self.window_max = maxima.reshape(len(long), self.windows, WINDOW // BLOCK).max(axis=2)
        self.summed = int((counts[long] >= max(8, n / SUMMED)).sum())
        self.impact = np.zeros((self.summed, self.windows * WINDOW), np.float32)
        some = int(counts[long[: self.summed]].sum())
        self.impact[of[:some], place[:some]] = bound[:some]
        # the others: postings in the order of lists, and an entry for each (list, window) that has any
        short = np.flatnonzero((code >= 0) & (counts < max(8, n / LONG)))
        short = short[np.argsort(-counts[short], kind="stable")]
        of, place, _, self.impacts = read(short)
        entry = of * self.windows + place // WINDOW
        first = _changes(entry)
        self.entry_window = place[first] // WINDOW
        self.entry_max = np.maximum.reduceat(self.impacts, first) if len(first) else np.zeros(0)
        self.entry_start, self.entry_end = first, np.append(first[1:], len(place))
        self.places = place.astype(np.min_scalar_type(self.windows * WINDOW))
        bounds = np.searchsorted(of[first], np.arange(len(short) + 1))
        self.list_start, self.list_end = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64)
        self.list_start[code[short]], self.list_end[code[short]] = bounds[:-1], bounds[1:]

    def weights(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each query (a row) and long list how often it counts."""
        weights = np.zeros((len(queries), self.table.shape[1]))
        for j, (terms, times) in enumerate(queries):
            at = self.column[terms]
            weights[j, at[at >= 0]] = times[at >= 0]
        return weights

    def cursors(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of a query's short lists, how often each counts, and the most that these lists give in each window."""
        starts, ends = self.list_start[terms], self.list_end[terms]
        entries, often = spans(starts, ends), np.repeat(times, ends - starts)
        return entries, often, np.bincount(self.entry_window[entries], weights=often * self.entry_max[entries], minlength=self.windows)

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], floors: list[float], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """top() of each query (terms, times). The bounds of the long lists come from matrix products over the windows that any query has to
        visit: for each block from the block maxima, and for each place for the summed lists."""
        weights = self.weights(queries)
        cursors = [self.cursors(*q) for q in queries]
        most = (weights @ self.window_max + [c[2] for c in cursors]).reshape(len(queries), self.windows)
        visited = np.flatnonzero(((most > 0) & (most >= np.array(floors)[:, None] - NEAR)).any(axis=0))
        single = (weights * (1 + (weights.shape[1] + 4) * 2.0**-23)).astype(np.float32)  # sums in single precision may be too low by so much
        whole, rest = single[:, : self.summed], single[:, self.summed :]
        bounds = np.zeros((len(queries), self.windows, WINDOW // BLOCK, BLOCK), np.float32)
        for start, end in _runs(visited):
            place, block = slice(start * WINDOW, end * WINDOW), slice(start * (WINDOW // BLOCK), end * (WINDOW // BLOCK))
            at = bounds[:, start:end]
            at[:] = (whole @ self.impact[:, place]).reshape(at.shape)
            at += (rest @ self.block_max.T[self.summed :, block]).reshape(*at.shape[:3], 1)
        return [self.top(*q, weights[j], bounds[j].ravel(), k, floors[j], cursors[j]) for j, q in enumerate(queries)]

    def top(
        self, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int, floor: float = 0.0, cursors=None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by falling score and rising id; scores below floor are of no interest.

        weight: how often each long list counts; bound: the most that these lists give, in each block or at each place."""
        entries, often, most = cursors or self.cursors(terms, times)
        window = self.entry_window[entries]
        bound = bound.reshape(self.windows, -1)
        most = most + bound.max(axis=1, initial=0.0)
        long = np.flatnonzero(weight)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        threshold, at = floor, 0
        while True:
            ahead = at + np.flatnonzero((most[at:] > 0) & (most[at:] >= threshold - NEAR))
            if not len(ahead):
                return best_ids, best
            # the next pivot windows: none between them can hold a result, and no posting between them is read
            pivot = ahead[: max(1, STRIDE // WINDOW)]
            slot = np.full(self.windows, -1)
            slot[pivot] = np.arange(len(pivot))
            now = np.flatnonzero(slot[window] >= 0)
            starts, ends = self.entry_start[entries[now]], self.entry_end[entries[now]]
            postings = spans(starts, ends)
            given = self.impacts[postings]
            given *= np.repeat(often[now], ends - starts)
            places = self.places[postings]
            if len(pivot) < self.windows:
                places = places + np.repeat((slot[window[now]] - window[now]) * WINDOW, ends - starts)
            score = np.bincount(places, weights=given, minlength=len(pivot) * WINDOW)
            upper = (score.reshape(len(pivot), bound.shape[1], -1) + bound[pivot][:, :, None]).ravel()
            pivots = np.flatnonzero((upper > 0) & (upper >= threshold - NEAR))
            pivots = pivots[pivot[pivots // WINDOW] * WINDOW + pivots % WINDOW < len(self.ids)]
            while len(pivots):
                some = pivots
                if len(pivots) > FEW and threshold <= 0:  # the most promising ones set a threshold for the others
                    some = pivots[np.argpartition(-upper[pivots], FEW)[:FEW]]
                docs = pivot[some // WINDOW] * WINDOW + some % WINDOW
                had = self.table[docs][:, long].astype(float)
                impact = self.idf[long] * (K1 + 1) * had / (had + self.norm[docs][:, None])
                found = np.round(score[some] + impact @ weight[long], 6)
                keep = np.flatnonzero((found > 0) & (found >= threshold - NEAR))
                best, best_ids = np.concatenate((best, found[keep])), np.concatenate((best_ids, self.ids[docs[keep]]))
                top = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[top], best_ids[top]
                if len(best) == k:
                    threshold = max(floor, float(best[-1]))
                upper[some] = -1.0
                pivots = pivots[(upper[pivots] > 0) & (upper[pivots] >= threshold - NEAR)]
            at = int(pivot[-1]) + 1


def _searched(shared, floors: dict[int, float], k: int):
    def run(batches):
        words, queries, idf, mean_length = shared.value
        known = pa.array(words, pa.string())
        for row in _rows(batches):
            shard = Shard(row, known, idf, mean_length)
            for i in range(0, len(queries), AT_ONCE):
                some = queries[i : i + AT_ONCE]
                found = shard.tops([q[1:] for q in some], [floors.get(q[0], 0.0) for q in some], k)
                numbers = np.repeat([q[0] for q in some], [len(ids) for ids, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), *(pa.array(np.concatenate(c)) for c in zip(*found))], names=["query", "doc_id", "score"]
                )

    return run


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = 16_384, shard_words: int = 8_000_000
) -> DataFrame:
    """INDEX rows, stored: one for each shard. A shard ends with its task's input, or at about shard_docs documents or shard_words words."""
    rows = docs.select(whole(docs, key).alias("id"), F.col(text).alias("text")).where("id is not null")
    return stored(rows.mapInArrow(_indexed(shard_docs, shard_words), INDEX), "index")


def _bags(batches):
    """id, words and times: each word of a text once, and how often the text has it. Texts without words are left out."""
    for batch in slices(batches, "text", max_bytes=2 << 20):
        words, n = words_of(batch.column("text"))
        coded = words.combine_chunks().dictionary_encode() if isinstance(words, pa.ChunkedArray) else words.dictionary_encode()
        size = max(1, len(coded.dictionary))
        found, times = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        of, word = np.divmod(found, size)
        some = np.flatnonzero(n)
        ends = pa.array(np.append(np.searchsorted(of, some), len(of)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(some)), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(ends, pa.array(times))],
            names=["id", "words", "times"],
        )


def _asked(bags: DataFrame) -> tuple[list[int], list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Ids of the queries by number, the words asked for by number, and the queries: (number, words, times)."""
    found = bags.select("id", "words", "times").toArrow().combine_chunks()
    if not found.num_rows:
        return [], [], []
    words, times = found["words"].chunk(0), found["times"].chunk(0)
    coded = words.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(words).to_numpy())[:-1]
    terms = np.split(coded.indices.to_numpy().astype(np.int64), ends)
    often = np.split(times.flatten().to_numpy().astype(float), ends)
    return found["id"].to_pylist(), coded.dictionary.to_pylist(), list(zip(range(len(terms)), terms, often))


def _alike(queries: list[tuple[int, np.ndarray, np.ndarray]], df: np.ndarray, total: int, idf: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The queries in the order of their heaviest word among the frequent ones: alike ones are searched together."""

    def heaviest(query) -> int:
        _, terms, times = query
        weight = np.where(df[terms] >= total / LONG, times * idf[terms], 0)
        return int(terms[np.argmax(weight)])

    return sorted(queries, key=heaviest)


def search(
    docs: DataFrame, is_query: Column, k: int = 10, key: str = "doc_id", text: str = "text", query_block: int = 4096,
    query_chars: int = 1 << 26, shard_docs: int = 16_384
) -> DataFrame:
    """query_id, doc_id, rank, score: the k best rows of docs for each of its rows where is_query holds."""
    spark = docs.sparkSession
    asked = docs.where(is_query).select(
        whole(docs, key).alias("id"), F.col(text).alias("text")
    ).where("id is not null and text is not null")
    # the queries' words are taken once, by tasks, and stored: no block reads the documents again
    bags = stored(asked.dropDuplicates(["id", "text"]).mapInArrow(_bags, "id long, words array<string>, times array<long>"), "asked")
    index = build_index(docs, key, text, shard_docs)
    total, words = index.agg(F.sum("docs"), F.sum("words")).first()
    letters = F.aggregate("words", F.lit(0).cast("long"), lambda n, word: n + F.length(word))
    n, chars = bags.agg(F.count(F.lit(1)), F.sum(letters)).first()
    blocks = max(1, math.ceil(n / query_block), math.ceil((chars or 0) / query_chars))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    some, schema, out = F.pmod(F.xxhash64("ids"), F.lit(8)) == 0, "query long, doc_id long, score double", []
    for i in range(blocks):
        ids, known, queries = _asked(bags.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i))
        if not queries:
            continue
        counts = index.select("terms", "counts").mapInArrow(_frequencies(spark.sparkContext.broadcast(known)), "term long, df long")
        df = np.zeros(len(known))
        for b in counts.groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_batches():
            df[b.column(0).to_numpy()] = b.column(1).to_numpy()
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        model = spark.sparkContext.broadcast((known, _alike(queries, df, total, idf), idf, words / max(total, 1)))
        # an eighth of the shards first: its k-th scores are where the others' walks start
        first = stored(ranked(index.where(some).mapInArrow(_searched(model, {}, k), schema)), "first")
        floors = {r["query"]: r["score"] for r in first.where(F.col("rank") == k).select("query", "score").collect()}
        rest = index.where(~some).mapInArrow(_searched(model, floors, k), schema)
        best = ranked(first.select("query", "doc_id", "score").unionByName(rest))
        numbered = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "query long, query_id long"))  # query_block rows at most
        out.append(stored(best.join(numbered, "query").select("query_id", "doc_id", "rank", "score"), "best"))
        dropped(first)
    dropped(index)
    dropped(bags)
    if not out:
        return spark.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    return spark.read.schema(out[0].schema).parquet(*[t._folium_path for t in out])
