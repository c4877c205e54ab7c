"""Line deduplication across documents: equal lines, and lines within one edit, keep their earliest occurrence only.

Lines are compared without surrounding blanks, tabs and carriage returns. Method: a deletion neighbourhood. A line is
hashed with one character deleted, for each character; two lines are within one edit exactly if such keys meet (both
shortened at the same place, or one shortened and the other whole). Keys are made only where they can meet: first every
distinct line leaves hashes of itself without its first or second half, then lines that share one leave hashes without
each of 16 blocks, and only where those are shared are the block's characters deleted one by one. Equal keys are joined
by their least member, so a key shared by any number of lines costs one row each; every match is verified on the texts.

A distinct line is dropped if an earlier one (by first occurrence: key, then line number) is within one edit of it.

Defined results: keys are whole numbers. Null and empty texts stay as they are. Equal lines take part from equal_chars characters (min_chars if
not given), those within an edit from min_chars: of shorter ones an edit makes another word. Lines of blanks are always kept. Rows that
repeat (same key) count as occurrences of the same lines: the lines of all rows of a key are kept or dropped alike.
An empty table gives an empty result. Rows of a null key are kept untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import code_points, dropped, slices, stored, whole, with_size
from folium.llm.minhash import mix

BLOCKS = 16
_K = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_K, -1, 1 << 64))
#: Fixed part of the patterns below: what is stripped around a line.
BLANKS = " \t\r"


def lines_of(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """doc, pos, line (stripped) of the lines that take part."""
    split = F.posexplode(F.split(F.col(text), "\n"))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(whole(docs, key).alias("doc"), split.alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)


def _half_keys() -> Column:
    """Hashes of the line without its second or first half, taken at its length and at one less (as the longer of a pair)."""
    n = F.length("line")
    out = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), m, F.substring("line", F.lit(1), half)))
        out.append(F.xxhash64(F.lit(1), m, F.substring("line", n - (m - half) + 1, m - half)))
    return F.array(*out)


class _Hashed:
    """Polynomial hashes of any prefix, suffix or shortening of a line."""

    def __init__(self, line: str):
        codes = mix(code_points(line))
        self.n = len(codes)
        self.powers = np.concatenate((np.ones(1, np.uint64), np.full(self.n, _K, np.uint64))).cumprod(dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * self.powers[:-1], dtype=np.uint64)))

    def whole(self) -> np.ndarray:
        return self.sums[-1:]

    def without(self, at: np.ndarray) -> np.ndarray:
        """The line without the character at each place."""
        return self.sums[at] + (self.sums[-1] - self.sums[at + 1]) * _INVERSE

    def without_block(self, m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first `left` characters beside the last m - right; m is the length that the line is taken at."""
        excess = self.n - m
        tail = self.sums[-1] - self.sums[right + excess]
        if excess:
            tail = tail * _INVERSE
        return mix(mix(self.sums[left]) + mix(tail) + left.astype(np.uint64))


def _edges(m: int) -> np.ndarray:
    return np.arange(BLOCKS + 1) * m // BLOCKS


def block_keys(line: str) -> list[tuple[int, int, int]]:
    """(key, excess, block) of the line without each block, at its length (excess 0) and as the longer one of a pair (excess 1)."""
    h, out = _Hashed(line), []
    for excess in (0, 1):
        m = h.n - excess
        edges, blocks = _edges(m), np.arange(BLOCKS, dtype=np.uint64)
        keys = mix(h.without_block(m, edges[:-1], edges[1:]) ^ mix(np.uint64(m) * np.uint64(64) + blocks))
        out += zip(keys.view(np.int64).tolist(), [excess] * BLOCKS, range(BLOCKS))
    return out


def variant_keys(line: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(key, kind) for the (excess, block) given. Kinds: 0 shortened at a place, equal keys are one substitution apart;
    1 shortened, 2 whole: equal keys of kinds 1 and 2 are one insertion apart."""
    h, out = _Hashed(line), set()
    for excess, block in places:
        m = h.n - excess
        edges = _edges(m)
        at = np.arange(edges[block], edges[block + 1] + excess)
        if excess:
            keys = mix(h.without(at) ^ mix(np.full(1, m, np.uint64)))
            out.update((int(x), 1) for x in keys.view(np.int64))
        else:
            keys = mix(mix(h.without(at)) + at.astype(np.uint64) * np.uint64(3) + np.uint64(1))
            out.update((int(x), 0) for x in keys.view(np.int64))
            out.add((int(mix(h.whole() ^ mix(np.full(1, m, np.uint64))).view(np.int64)[0]), 2))
    return sorted(out)


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _emit(make, columns: list[str], schema: str):
    def run(batches):
        for batch in slices(batches, "line"):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "pos", "line", *columns))):
                out += [(*row[:2], *x) for x in make(*row[2:])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * (len(out[0]) - 3)))],
                    names=["doc", "pos", "key", *schema]
                )

    return run


def near_lines(docs: DataFrame, distinct: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """doc, pos (first occurrence) of the distinct lines that an earlier one is within one edit of, and that one's w_doc, w_pos.

    distinct: doc, pos of first occurrences, halves."""
    half = distinct.select("doc", "pos", F.explode(F.array_distinct("halves")).alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    some = stored(half.join(shared, "half", "left_semi").select("doc", "pos").distinct(), "some")
    texts = stored(
        lines_of(docs, key, text, min_chars).join(with_size(some), ["doc", "pos"], "left_semi").dropDuplicates(["doc", "pos"]), "texts"
    )
    blocks = texts.mapInArrow(_emit(block_keys, [], ["excess", "block"]), "doc long, pos int, key long, excess int, block int")
    shared = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    places = blocks.join(shared, "key", "left_semi").groupBy("doc", "pos").agg(F.collect_set(F.struct("excess", "block")).alias("places"))
    chosen = texts.join(places, ["doc", "pos"]).withColumn("places", F.transform("places", lambda p: p["excess"] * BLOCKS + p["block"]))
    variants = stored(
        chosen.mapInArrow(
            _emit(lambda line, at: variant_keys(line, [divmod(x, BLOCKS) for x in at]), ["places"], ["kind"]),
            "doc long, pos int, key long, kind int"
        ),
        "variants"
    )
    at = F.struct("doc", "pos")
    # of each key, the earliest of the lines that a line of each kind is within one edit of
    least = variants.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, at)).alias(f"k{k}") for k in range(3)])
    least = least.where("k0 is not null or (k1 is not null and k2 is not null)")
    witness = F.when(F.col("kind") == 0, F.col("k0")).when(F.col("kind") == 1, F.col("k2")).otherwise(F.col("k1"))
    pairs = variants.join(least, "key").select("doc", "pos", witness.alias("w")).where(F.col("w").isNotNull() & (F.col("w") < at))
    pairs = pairs.select("doc", "pos", F.col("w.doc").alias("w_doc"), F.col("w.pos").alias("w_pos")).distinct()
    both = pairs.join(texts, ["doc", "pos"]).join(
        texts.select(F.col("doc").alias("w_doc"), F.col("pos").alias("w_pos"), F.col("line").alias("w_line")), ["w_doc", "w_pos"]
    )
    # levenshtein ends early at its limit
    found = stored(both.where(F.levenshtein("line", "w_line", 1) >= 0).select("doc", "pos", "w_doc", "w_pos"), "near")
    for t in (some, texts, variants):
        dropped(t)
    return found


def dropped_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, equal_chars: int | None = None
) -> DataFrame:
    """doc, pos, near (dropped for an edit rather than for being equal) of every line to drop."""
    # each line as hashes: texts don't travel
    lines = lines_of(docs, key, text, min_chars if equal_chars is None else max(1, min(equal_chars, min_chars)))
    own = stored(
        lines.select(
            "doc", "pos", F.xxhash64("line").alias("one"), F.xxhash64(F.lit(7), F.length("line"), "line").alias("two"),
            F.when(F.length("line") >= min_chars, _half_keys()).alias("halves")
        ),
        "lines"
    )
    distinct = stored(
        own.groupBy("one", "two").agg(
            F.min(F.struct("doc", "pos", "halves")).alias("f"), F.count(F.lit(1)).alias("n")
        ).select("one", "two", "n", "f.*"),
        "distinct"
    )
    near = near_lines(docs, distinct, key, text, min_chars)
    lost = near.select("doc", "pos").distinct().withColumn("near", F.lit(True))
    known = distinct.select("one", "two", "n", F.col("doc").alias("f_doc"), F.col("pos").alias("f_pos"))
    known = known.join(
        lost.select(F.col("doc").alias("f_doc"), F.col("pos").alias("f_pos"), "near"), ["f_doc", "f_pos"], "left"
    ).where("n > 1 or near")
    known = stored(known.select("one", "two", "f_doc", "f_pos", F.coalesce("near", F.lit(False)).alias("near")), "known")
    again = (F.col("doc") != F.col("f_doc")) | (F.col("pos") != F.col("f_pos"))
    found = stored(
        own.select("doc", "pos", "one", "two").join(with_size(known), ["one", "two"]).where(again | F.col("near")).select(
            "doc", "pos", (F.col("near") & ~again).alias("near")
        ).distinct(),
        "lost"
    )
    for t in (own, distinct, near, known):
        dropped(t)
    return found


COUNTS = ("n_lines", "dropped_equal", "dropped_near")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, equal_chars: int | None = None) -> DataFrame:
    """All columns of docs, text without the lines to drop, and COUNTS; columns of docs with the names of COUNTS are replaced."""
    lost = dropped_lines(docs, key, text, min_chars, equal_chars)
    by_doc = stored(
        lost.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("pos"), F.sum(F.col("near").cast("long")).alias("near")), "by_doc"
    )
    dropped(lost)
    # the row goes as one column, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = rows.join(with_size(by_doc, F.size("pos")), F.col(f"row.`{key}`").cast("long") == F.col("doc"), "left")
    content = F.col(f"row.`{text}`")

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("pos"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # a lambda's variable holds the lines: they are split once
    kept = F.get(F.transform(F.array(F.split(content, "\n")), without), F.lit(0))
    near, all_ = F.coalesce("near", F.lit(0)).cast("long"), F.coalesce(F.size("pos"), F.lit(0)).cast("long")
    counts = (F.coalesce(F.size(F.split(content, "\n")), F.lit(0)).cast("long"), all_ - near, near)
    same = [
        F.when(F.col("doc").isNull(), content).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in COUNTS
    ]
    return marked.select(*same, *[x.alias(c) for x, c in zip(counts, COUNTS)])
