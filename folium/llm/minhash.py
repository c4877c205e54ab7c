"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is a weighted set: its word 5-shingles with the number of times each occurs. DartMinHash throws darts at
the weighted elements: an element is a strip of the plane whose width is its weight, the darts that fall into a strip
are drawn by hashing (element, region), with ranks that grow region by region; per signature coordinate the dart of
lowest rank is kept. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. About
k ln k darts serve all k coordinates, whatever the number of elements.

Steps: texts that are equal word for word become one class, and only its earliest document goes on. Signatures are cut
into bands. All pairs of different texts that share a bucket are compared: in buckets of up to 9 texts as rows, in larger ones in blocks of two
parts of about 2,048 texts each, where sizes and parity sketches, which lose no pair, decide what is verified exactly. A member of a bucket of p parts goes
to p blocks, so its comparisons grow with the bucket. Verified links are counted and closed into groups.

Defined results: a null, empty or blank text, or one of fewer than 5 words, has one shingle of what words it has;
documents without a word are not grouped at all. Ties go to the lowest id. Repeated rows are copies. Classes and groups are of
texts, not of ids: different texts of one id are compared like others, and a null id names nothing: class_id and group_id are
the least of the other ids, null only where there is none. An empty table gives an empty result. Nothing is capped: very long texts have all their shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import dropped, slices, stored, whole, with_size

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64) + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Rank ranges are [0, FIRST), [FIRST, 2 FIRST), [2 FIRST, 4 FIRST) ..., the same for every set: equal elements throw equal darts.
FIRST = 2.0**-8
#: Elements x cells that one step handles at a time.
STEP = 1 << 18


def _poisson(mean: float) -> np.ndarray:
    terms = np.exp(-mean) * np.cumprod(np.concatenate(([1.0], mean / np.arange(1, 16))))
    return np.cumsum(terms)


def _throw(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, strip: int, base: float, width: float, low: float, high: float,
    level: int, seed: int
):
    """(owner, rank, dart) of the darts in weights [base, base + width) and ranks [low, high) that fall below their element's weight."""
    cells = max(1, int(np.ceil(width * (high - low))))
    chances = _poisson(width * (high - low) / cells)
    if cells > 1:
        cell = np.tile(np.arange(cells, dtype=np.uint64), len(elements))
        elements, weights, owner = (np.repeat(x, cells) for x in (elements, weights, owner))
    else:
        cell = np.zeros(len(elements), np.uint64)
    place = mix(np.array([(seed << 32) ^ (strip << 20) ^ level], np.uint64))
    key = mix(elements ^ mix(place + cell))
    counts = np.searchsorted(chances, unit(key), side="right")
    for j in range(int(counts.max(initial=0))):
        hit = np.flatnonzero(counts > j)
        one, two = mix(key[hit] + np.uint64(2 * j + 1)), mix(key[hit] + np.uint64(2 * j + 2))
        under = base + width * unit(one) < weights[hit]
        ranks = low + (high - low) * (cell[hit].astype(np.float64) + unit(two)) / cells
        yield owner[hit][under], ranks[under], mix(one[under] ^ two[under])


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (sets x k, uint64) of weighted sets given as parallel arrays; owner says which set an element is of.

    Rank ranges are thrown in rising order, for all sets at once, until each coordinate of each set has its earliest dart.
    Strips of weight are [0, 1), [1, 2), [2, 4) ...; a strip and a rank range are cut into cells of one expected dart at most,
    so an element throws the darts of its own regions only. A set without elements keeps zeros."""
    out, filled = np.zeros(sets * k, np.uint64), np.zeros(sets * k, bool)
    open_sets = np.zeros(sets, bool)
    open_sets[owner] = True
    low, high, level = 0.0, FIRST, 0
    while open_sets.any():
        live = open_sets[owner]
        elements, weights, owner = elements[live], weights[live], owner[live]
        darts = []
        strip, base, width = 0, 0.0, 1.0
        while True:
            which = np.flatnonzero(weights > base)
            if not len(which):
                break
            at_once = max(1, STEP // max(1, int(np.ceil(width * (high - low)))))
            for i in range(0, len(which), at_once):
                w = which[i : i + at_once]
                for x, ranks, dart in _throw(elements[w], weights[w], owner[w], strip, base, width, low, high, level, seed):
                    at = x * k + (mix(dart) % np.uint64(k)).astype(np.int64)
                    free = ~filled[at]
                    darts.append((at[free], ranks[free], dart[free]))
            strip, base, width = strip + 1, base + width, base + width
        if darts:
            at, ranks, dart = (np.concatenate(x) for x in zip(*darts))
            last = np.argsort(-ranks, kind="stable")  # of several darts the earliest is written last
            out[at[last]] = dart[last]
            filled[at] = True
        open_sets &= ~filled.reshape(sets, k).all(axis=1)
        low, high, level = high, high * 2, level + 1
    return out.reshape(sets, k)


class _WordHash(dict):
    """Hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], known: dict, size: int) -> np.ndarray:
    """Hash of every window of size words, in order; fewer words make one window of what there is."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - size + 1)
    total = np.full(n, len(codes) if len(codes) < size else size, np.uint64)
    for k in range(min(size, len(codes))):
        total = mix(total) + codes[k : k + n]
    return mix(total)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _occurrences(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, which time it occurs) from sorted hashes; start: where each run of equal ones begins."""
    time = np.arange(len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat))))
    return np.where(time > 0, mix(flat ^ mix(time)), flat)


#: Bits of a parity sketch, at least.
PARITY = 1024


def parities(elements: np.ndarray, owner: np.ndarray, sets: int, size: int = PARITY) -> np.ndarray:
    """size bits of each set, in 64-bit words: bit b is odd where an odd number of elements hash to b.

    An element that two sets do not share flips one bit, so sets differ in as many bits at most as they have elements apart."""
    bits = np.zeros(sets * size, np.uint8)
    np.bitwise_xor.at(bits, owner * size + (mix(elements ^ GOLDEN) % np.uint64(size)).astype(np.int64), np.uint8(1))
    return np.packbits(bits.reshape(sets, size), axis=1).view(np.uint64)


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, h1, h2: two hashes that stand for the text, as ids can be null or shared by different texts."""
    content = F.col(text)
    return docs.select(
        whole(docs, key).alias("id"), content.alias("text"), F.xxhash64(content).alias("h1"),
        F.xxhash64(F.lit(7), F.length(content), content).alias("h2")
    )


def signatures(docs: DataFrame, key: str, text: str, size: int = 5, k: int = 96, rows: int = 4, seed: int = 1) -> DataFrame:
    """id, h1 and h2 (of the text), n (shingles), one and two (128 bits of the content), bands (array of k / rows hashes)."""
    source = _source(docs, key, text)

    def run(batches):
        known = _WordHash()
        for batch in slices(batches, "text", max_rows=512, max_bytes=1 << 20):
            parts = [shingles(_words(t), known, size) for t in batch.column("text").to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            owner, flat = np.repeat(np.arange(len(parts)), n), np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            weights = np.diff(np.append(at, len(flat))).astype(np.float64)
            found = dart_signatures(flat[at], weights, owner[at], len(parts), k, seed)
            bands = found.reshape(len(parts), k // rows, rows)
            total = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), bands.shape[:2]).copy()
            for j in range(rows):
                total = mix(total) + bands[:, :, j]
            digests = [xxhash.xxh3_128_intdigest(b"".join((p.tobytes(), b"."))) for p in parts]
            one = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)
            two = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(parts) + 1, dtype=np.int32) * (k // rows)), pa.array(mix(total).view(np.int64).ravel())
            )
            given = [batch.column(c) for c in ("id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays(
                [*given, pa.array(n), pa.array(one), pa.array(two), lists], names=["id", "h1", "h2", "n", "one", "two", "bands"]
            )

    return source.mapInArrow(run, "id long, h1 long, h2 long, n long, one long, two long, bands array<long>")


def shingle_sets(texts: DataFrame, size: int = 5) -> DataFrame:
    """c, set: rising hashes of (shingle, which time it occurs), so that multisets compare as sets; texts: c, text."""

    def run(batches):
        known = _WordHash()
        for batch in slices(batches, "text", max_bytes=1 << 20):
            lists = []
            for t in batch.column("text").to_pylist():
                flat = np.sort(shingles(_words(t), known, size))
                start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
                lists.append(np.sort(_occurrences(flat, start).view(np.int64)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["c", "set"])

    return texts.select("c", "text").mapInArrow(run, "c long, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (u, v), by alternating large and small stars."""
    now, mark = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    ), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("u"), F.col("m").alias("v")).union(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        new = stored(small, "edges")
        dropped(now)
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        now, mark = new, seen


#: A bucket of one more member at most is paired row by row; larger ones are compared in blocks.
NEAR = 8
#: Members, and shingles, of a part of a larger bucket, about: a block holds two parts.
PART_MEMBERS, PART_SHINGLES = 2048, 1 << 21
#: Words of parity sketches that are compared at once.
WORDS_AT_ONCE = 1 << 20


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b, x, y: their sizes) of all pairs of the buckets of NEAR + 1 members at most; members: key, c, n."""
    w = Window.partitionBy("key").orderBy("c")
    others = [F.struct(F.lag("c", i).over(w).alias("c"), F.lag("n", i).over(w).alias("n")) for i in range(1, NEAR + 1)]
    found = members.select(
        "c", "n", F.array(*others).alias("others")
    ).select("c", "n", F.explode("others").alias("o")).where("o.c is not null")
    return found.select(F.col("o.c").alias("a"), F.col("c").alias("b"), F.least("n", "o.n").alias("x"), F.greatest("n", "o.n").alias("y"))


def _linked(
    key: int, c: np.ndarray, part: np.ndarray, bands: np.ndarray, small: np.ndarray, ends: np.ndarray, flat: np.ndarray, threshold: float
):
    """(links, root) of each member of a block: of all pairs of its two parts (or within its one) those that reach threshold are counted and joined.

    A pair that meets in several buckets is compared in the first only, and not at all if one of them is small: each counts once."""
    n = np.diff(ends)
    low, high = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    within = part.min() == part.max()
    size = max(PARITY, 1 << int(2 * len(flat) // len(n)).bit_length())  # of texts of any length, memory stays near that of the sets
    parity = parities(flat.view(np.uint64), np.repeat(np.arange(len(n)), n), len(n), size)
    links, root = np.zeros(len(c), np.int64), np.arange(len(c))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at_once = max(1, WORDS_AT_ONCE // (len(high) * parity.shape[1]))
    for i in range(0, len(low), at_once):
        rows = low[i : i + at_once]
        apart = np.bitwise_count(parity[rows][:, None] ^ parity[high][None]).sum(axis=2, dtype=np.int64)
        total = n[rows][:, None] + n[high][None]
        near = (apart <= total * ((1 - threshold) / (1 + threshold)) + 1e-6) & (
            np.minimum(n[rows][:, None], n[high][None]) >= threshold * np.maximum(n[rows][:, None], n[high][None]) - 1e-9
        )
        if within:
            near &= rows[:, None] < high[None]
        xs, ys = np.nonzero(near)
        xs, ys = rows[xs], high[ys]
        same = bands[xs] == bands[ys]
        own = (bands[xs, same.argmax(axis=1)] == key) & ~(same & small[xs]).any(axis=1)
        xs, ys = xs[own], ys[own]
        for x in np.unique(xs):
            others = ys[xs == x]
            a = flat[ends[x] : ends[x + 1]]
            for j in range(0, len(others), 256):
                some = others[j : j + 256]
                b = np.concatenate([flat[ends[y] : ends[y + 1]] for y in some])
                hit = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[some])[:-1])))
                for y in some[both >= threshold * (n[x] + n[some] - both) - 1e-9]:
                    links[x] += 1
                    links[y] += 1
                    root[find(y)] = find(x)
    return links, np.array([find(i) for i in range(len(c))], np.int64)


def _in_blocks(places: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """u, v, links: of each member that has links in a block, another of its component there (or itself) and their number.

    places: c, bands, small (whether the bucket of each band is), places (key and parts of each larger bucket that it is in), one row for each text;
    sets: c, set. A bucket is cut into parts and each two parts make a block, so that every pair of the bucket meets, however large it is,
    and no task holds more than two parts."""
    each = places.join(sets, "c").select("c", "bands", "small", "set", F.explode("places").alias("p")).select(
        "c", "bands", "small", "set", F.col("p.key").alias("key"), F.pmod(F.xxhash64("c"), F.col("p.parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.parts") - 1)).alias("other")
    )
    blocks = each.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = lambda name: t.column(name).combine_chunks()
        c, part, i, j = (t.column(x).to_numpy() for x in ("c", "part", "i", "j"))
        links, root = np.zeros(len(c), np.int64), np.arange(len(c))
        if i[0] == j[0] or part.min() < part.max():
            sets_, k = column("set"), len(column("bands")[0])
            bands = column("bands").flatten().to_numpy().reshape(-1, k)
            small = column("small").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            ends = np.concatenate(([0], np.cumsum(sets_.value_lengths().to_numpy())))
            links, root = _linked(int(t.column("key")[0].as_py()), c, part, bands, small, ends, sets_.flatten().to_numpy(), threshold)
        at = np.flatnonzero(links)
        return pa.table({"u": pa.array(c[at]), "v": pa.array(c[root[at]]), "links": pa.array(links[at])})

    return blocks.groupBy("key", "i", "j").applyInArrow(run, "u long, v long, links long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose weighted Jaccard similarity reaches threshold."""
    near = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("c").alias("b"), F.col("set").alias("set_b")), "b"
    )
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = near.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
    return near.where(F.col("both") >= threshold * (F.col("all") - F.col("both")) - 1e-9).select("a", "b")


def _grouped(docs: DataFrame, key: str, text: str, threshold: float, size: int, k: int, rows: int, seed: int) -> DataFrame:
    """id, h1, h2, n, c (the number of its class; null without words), class_id, root (the number of its group), group_id, links of every row of docs."""
    found = stored(signatures(docs, key, text, size, k, rows, seed), "signatures")
    reps = found.where("n > 0").groupBy("one", "two").agg(
        F.min("id").alias("class_id"), F.min(F.struct("h1", "h2", "n", "bands")).alias("r")
    )
    reps = stored(reps.select("one", "two", "class_id", "r.*", F.monotonically_increasing_id().alias("c")), "classes")
    band = reps.select("c", "n", F.posexplode("bands").alias("band", "key"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_MEMBERS), F.ceil(F.sum("n") / PART_SHINGLES))
    sizes = band.groupBy("key").agg(F.count(F.lit(1)).alias("count"), parts.alias("parts")).where("count > 1")
    members = stored(band.join(sizes, "key"), "members")
    few = F.col("count") <= NEAR + 1
    alike = F.col("x") >= threshold * F.col("y") - 1e-9
    tried = stored(_pairs(members.where(few)).where(alike).select("a", "b").distinct(), "pairs")
    at = stored(tried.select(F.explode(F.array("a", "b")).alias("c")).union(members.where(~few).select("c")).distinct(), "ids")
    chosen = stored(reps.join(with_size(at), "c", "left_semi").select("c", "h1", "h2"), "chosen")
    texts = _source(docs, key, text).join(with_size(chosen), ["h1", "h2"]).dropDuplicates(["c"])
    sets = stored(shingle_sets(texts, size), "sets")
    links = stored(_verified(tried, sets, threshold), "links")
    # one row for each member of larger buckets, with these and its bands of small ones: joins take texts, not their places in buckets
    places = members.groupBy("c").agg(
        F.collect_set(F.when(few, F.col("band"))).alias("few"), F.collect_list(F.when(~few, F.struct("key", "parts"))).alias("places")
    ).where(F.size("places") > 0)
    places = places.join(reps.select("c", "bands"), "c").select(
        "c", "bands", F.transform("bands", lambda x, i: F.array_contains("few", i)).alias("small"), "places"
    )
    blocks = stored(_in_blocks(places, sets, threshold), "blocks")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(blocks.select("u", "v")))
    counts = links.select(F.explode(F.array("a", "b")).alias("c"), F.lit(1).cast("long").alias("links")).union(blocks.select("u", "links"))
    degree = counts.groupBy("c").agg(F.sum("links").alias("links"))
    grouped = reps.select("one", "two", "c", "class_id").join(
        roots.select(F.col("node").alias("c"), "root"), "c", "left"
    ).join(degree, "c", "left")
    grouped = stored(
        grouped.select("one", "two", "c", "class_id", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links")),
        "grouped"
    )
    named = stored(grouped.join(grouped.groupBy("root").agg(F.min("class_id").alias("group_id")), "root"), "named")
    for x in (members, tried, at, chosen, sets, links, blocks, grouped):
        dropped(x)
    # texts without words share a digest, and may be many: they have no part in the join, whose copies of one text Spark can split
    with_words = found.where("n > 0").drop("bands").join(named, ["one", "two"]).drop("one", "two")
    lone = found.where("n = 0").select(
        "id", "h1", "h2", "n", *[F.lit(None).cast("long").alias(c) for c in ("root", "c", "class_id", "links", "group_id")]
    )
    return with_words.unionByName(lone)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, k: int = 96, rows: int = 4,
    seed: int = 1
) -> DataFrame:
    """One row per row of docs: key, class_id (least key of the same words), group_id (least key of its group), links
    (all other classes that share a band with its own and reach threshold), n_shingles.

    At similarity 0.8, 24 bands of 4 miss a pair with a chance of 3e-6."""
    lone = F.col("n") == 0
    named = [F.when(lone, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "group_id")]
    return _grouped(docs, key, text, threshold, size, k, rows, seed).select(
        F.col("id").alias(key), *named, F.when(lone, 0).otherwise(F.col("links")).cast("long").alias("links"),
        F.col("n").alias("n_shingles")
    )


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = 5, k: int = 96, rows: int = 4,
    seed: int = 1
) -> DataFrame:
    """Of each group of near-duplicates one row of docs: that of the least key, of a null key only where there is no other.

    Documents without a word are kept: once for each key, and all those of a null key."""
    found = _grouped(docs, key, text, threshold, size, k, rows, seed).where("n > 0")
    own = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h1", "h2")
    # only rows that are there twice have to be told apart: texts of the others don't travel
    each = found.groupBy("root", own.alias("m")).agg(F.count(F.lit(1)).alias("times"))
    least = each.groupBy("root").agg(F.min(F.struct("m", "times")).alias("x")).select("x.m.*", (F.col("x.times") > 1).alias("twice"))
    kept = stored(least, "kept")
    marks = ["none", "id", "h1", "h2"]
    names = docs.columns
    id_, content = whole(docs, key), F.col(f"`{text}`")
    wordless = ~F.coalesce(content, F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), wordless.alias("wordless"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"),
        F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(7), F.length(content), content).alias("h2"),
    )
    first = marked.where("not wordless").join(with_size(kept), marks)
    blank = marked.where("wordless")
    parts = [
        first.where("not twice"), first.where("twice").dropDuplicates(marks), blank.where("not none").dropDuplicates(marks),
        blank.where("none")
    ]
    whole_rows = [p.select(*[F.col(f"row.`{c}`").alias(c) for c in names]) for p in parts]
    return reduce(DataFrame.unionByName, whole_rows)
