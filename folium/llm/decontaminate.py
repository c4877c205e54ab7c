"""Benchmark decontamination by winnowing.

Of each run of LENGTH - GRAM + 1 consecutive hashes of GRAM words a text keeps the least, the last of equal ones. So any LENGTH words that a document
and an item share keep the same hash at the same place in both, and no shared window can be missed. Kept hashes of items and documents are
joined; a pair that meets is extended, word by word, as far as a window of LENGTH words around the kept words can reach, and counts if LENGTH words agree.
Extended hits lie within the union of all shared windows and cover each of them: the words hit are exact. Items of fewer than LENGTH words are one window: for each
such length n, the hash of n words is kept at every place.

What Python tasks know of the benchmark is a bit table of fixed size (BITS) over its kept hashes: documents give out only hashes whose bit is set, with the words around
them; the join afterwards is exact. Words are compared by 64-bit hashes. The benchmark's side of the join is broadcast only if it is counted to be small.

Defined results: a null text has no words, neither has one of blanks and marks. Repeated rows are judged once each, alike; rows of a null key too. An item is all rows of its id; an
item whose id is null counts among the hits but not among the items. Texts of any length are read whole, in blocks that overlap. Extra columns of any name are left alone.
Empty documents give an empty result; an empty benchmark gives documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm import words as W
from folium.llm.common import slices, stored, with_size

LENGTH, GRAM = 10, 8
#: Bits of the table of kept hashes: 8 MB, whatever the benchmark holds.
BITS = 26
#: Words of a block of a long text; blocks overlap by 2 * LENGTH words.
BLOCK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = W.letters(digits=True)


def winnow(codes: np.ndarray, text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams kept of the concatenated codes of texts; text: the number of the text of each word."""
    windows = len(codes) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(codes) - gram + 1
    h = np.full(n, np.uint64(length))
    for j in range(gram):
        h = (h ^ (h >> np.uint64(29))) * _MIX + codes[j : n + j]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    least, at = h[:windows].copy(), np.arange(windows)
    for j in range(1, length - gram + 1):
        x = h[j : windows + j]
        later = np.flatnonzero(x <= least)
        least[later] = x[later]
        at[later] = later + j
    places = np.unique(at[text[:windows] == text[length - 1 :]])
    return places, h[places]


def around(codes: np.ndarray, text: np.ndarray, places: np.ndarray, length: int, gram: int, outside: int) -> np.ndarray:
    """One row for each place: the gram's words with the length - gram words on either side; outside stands beyond the text's ends."""
    at = places[:, None] + np.arange(gram - length, length)
    inside = (at >= 0) & (at < len(codes))
    at = np.where(inside, at, 0)
    inside &= text[at] == text[places][:, None]
    return np.where(inside, codes[at], np.uint64(outside))


def spans(a: np.ndarray, b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(words before, words after) of the gram's start for which a and b agree without a gap; both 0 where less than length words agree."""
    same, reach = a == b, length - gram
    before = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
    after = gram + np.cumprod(same[:, reach + gram :], axis=1).sum(axis=1)
    found = same[:, reach : reach + gram].all(axis=1) & (before + after >= length)
    return np.where(found, before, 0), np.where(found, after, 0)


def _blocks(raw: bytes | None, codes: W.Codes) -> Iterator[tuple[int, np.ndarray]]:
    """(first word's number, codes) of overlapping blocks of one text."""
    held, first = [], 0
    size = 0
    for part in W.segments(raw or b"", _WORDS):
        held.append(codes.array(part))
        size += len(part)
        if size >= BLOCK:
            block = np.concatenate(held)
            yield first, block
            held, first, size = [block[-2 * LENGTH :].copy()], first + size - 2 * LENGTH, 2 * LENGTH
    block = np.concatenate(held) if held else np.zeros(0, np.uint64)
    yield first, block


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    data = np.ascontiguousarray(rows)
    width = data.itemsize * data.shape[1]
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _kept(raws: list[bytes | None], codes: W.Codes, outside: int, lengths: list[int] | None, bits: np.ndarray | None):
    """(words of each text, batches of kept grams: number of the text, length, hash, place, words around).

    lengths: of the short windows to look for in each text; None: the text is an item and shorter ones are one window."""
    totals = np.zeros(len(raws), np.int64)
    found = []
    batch: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        if size:
            all_codes = np.concatenate([c for _, _, c in batch])
            counts = [len(c) for _, _, c in batch]
            number = np.repeat(np.arange(len(batch)), counts)
            origin = np.repeat([i for i, _, _ in batch], counts)
            place = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([f for _, f, _ in batch], counts)
            whole = np.repeat(totals[[i for i, _, _ in batch]], counts)
            for n in [*(lengths if lengths is not None else sorted({int(x) for x in whole if x < LENGTH})), LENGTH]:
                gram = min(n, GRAM) if n == LENGTH else n
                places, h = winnow(all_codes, number, n, gram)
                if lengths is None and n < LENGTH:
                    ok = whole[places] == n
                elif bits is not None:
                    slot = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    ok = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                else:
                    ok = slice(None)
                places, h = places[ok], h[ok]
                if len(places):
                    found.append((origin[places], n, h, place[places], around(all_codes, number, places, n, gram, outside)))
        batch, size = [], 0

    for i, raw in enumerate(raws):
        for first, block in _blocks(raw, codes):
            totals[i] = first + len(block)
            if len(block):
                batch.append((i, first, block))
                size += len(block)
            # what is cut into blocks is longer than any short window, so its length need not be known yet
            if size >= BLOCK:
                flush()
    flush()
    return totals, found


ITEM_GRAMS = "item string, n int, hash long, words binary"


def item_grams(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """ITEM_GRAMS of every row."""
    rows = items.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        codes = W.Codes()
        for batch in slices(batches, "text"):
            _, found = _kept(W.raw_texts(batch.column("text")), codes, 1, None, None)
            for origin, n, h, _, around_ in found:
                names = batch.column("item").take(pa.array(origin))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(h), n, np.int32)), _long(h), _packed(around_)], names=["item", "n", "hash", "words"])

    return rows.mapInArrow(run, ITEM_GRAMS)


def _bit_table(grams: DataFrame) -> np.ndarray:
    """The bit of each hash set: bitmaps of 4 KB, made by Spark, at most 2 ** BITS / 8 bytes in all."""
    at = (F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("at")
    made = grams.select(at).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for part, bits in made.collect():
        table[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return table


def document_grams(docs: DataFrame, lengths: list[int], bits: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each document: row, key, n_words; and one for each kept gram that may be an item's: row, n, hash, place, words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["key"]])
    for name, kind in (("n_words", "long"), ("n", "integer"), ("hash", "long"), ("place", "long"), ("words", "binary")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        codes = W.Codes()
        for batch in slices(batches, "text"):
            totals, found = _kept(W.raw_texts(batch.column("text")), codes, 0, lengths, shared.value)
            kind, size = batch.column("key").type, batch.num_rows
            names = schema.names
            none = [pa.nulls(size, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(totals), *none], names=names)
            for origin, n, h, place, around_ in found:
                m = len(h)
                columns = [
                    batch.column("row").take(pa.array(origin)), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.array(np.full(m, n, np.int32)), _long(h),
                    _long(place), _packed(around_)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def _extended(pairs: DataFrame) -> DataFrame:
    """row, start, end (words), gram of the pairs that agree over a whole window; pairs: row, n, place, gram, words, item_words."""

    def run(batches):
        for batch in batches:
            lengths = batch.column("n").to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                gram = GRAM if n == LENGTH else int(n)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("words", "item_words"))
                before, after = spans(a, b, int(n), gram)
                place = part.column("place").to_numpy()
                out = pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(place - before), pa.array(place + after), part.column("gram")], names=["row", "start", "end", "gram"]
                )
                yield out.filter(pa.array(after > 0))

    return pairs.select("row", "n", "place", "gram", "words", "item_words").mapInArrow(run, "row long, start long, end long, gram long")


def merged(found: Column) -> Column:
    """Spans (array of start, end) as the fewest spans that cover the same words, in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(none.alias("done"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    closed = lambda s: F.when(s["start"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] > s["end"]
        return F.struct(
            F.when(apart, closed(s)).otherwise(s["done"]).alias("done"), F.when(apart, x["start"]).otherwise(s["start"]).alias("start"),
            F.when(apart, x["end"]).otherwise(F.greatest(s["end"], x["end"])).alias("end")
        )

    return F.aggregate(F.sort_array(found), start, step, closed)


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """key, n_words, n_hit, spans (array of start and end, numbers of words), n_items, items_sha256, contaminated of every row of docs."""
    member = stored(item_grams(items, item, item_text), "item-grams")
    grams = stored(member.groupBy("n", "hash", "words").agg(F.count(F.lit(1)).alias("rows")).withColumn("gram", F.monotonically_increasing_id()), "grams")
    lengths = sorted(r[0] for r in grams.where(F.col("n") < LENGTH).select("n").distinct().collect())
    found = stored(document_grams(docs, lengths, _bit_table(grams), key, text), "document-grams")
    # 12 words around each gram and the columns' own bytes
    ours = with_size(grams.select("n", "hash", "gram", F.col("words").alias("item_words")), F.lit(2 * LENGTH - GRAM))
    hits = stored(_extended(found.where("n is not null").join(ours, ["n", "hash"])), "hits")
    by_row = hits.groupBy("row").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set("gram")).alias("grams")
    ).withColumn("spans", merged(F.col("spans")))
    by_row = stored(by_row, "contaminated")
    # documents that hit the same grams, as copies do, have their items listed once
    named = member.where("item is not null").join(grams, ["n", "hash", "words"]).select("gram", "item").distinct()
    sets = by_row.select("grams").distinct()
    listed = sets.withColumn("gram", F.explode("grams")).join(named, "gram").select("grams", "item").distinct().groupBy("grams").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256")
    )
    hit = by_row.join(listed, "grams", "left").select("row", "spans", "n_items", "items_sha256")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    all_rows = found.where("n is null").select("row", "key", "n_words").join(with_size(stored(hit, "contamination"), F.lit(16)), "row", "left")
    return all_rows.select(
        F.col("key").alias(key), "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.coalesce(n_hit > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )
