"""Packing documents into sequences of a fixed length by the sum-of-squares rule, mostly in its thrifty form.

A piece is placed where the sum of the squared numbers of open sequences per residual gap becomes smallest. Each shard is packed in two ways, of which the one with
fewer sequences counts: thrifty, the longest first, where a new sequence is opened only if no open one has room (this wins on most mixes of lengths); or by the plain rule, where a
new sequence is one of the choices, the longest first down to a quarter of the capacity and the others mixed.

A document's ids and a closing id make one run. A run beyond the capacity is cut into full pieces, of which the first
may be shorter; full pieces fill a sequence each. The others are dealt to shards of about shard_items documents by a hash; each shard packs on its own,
so that it leaves only few sequences unfilled and no task holds more than its shard.

Defined results: keys are whole numbers. A null or empty text is its closing id alone. Repeated rows are packed once each. An empty table
gives an empty result. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import slices, stored, whole

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """encode(text) -> ids, those of the tokenizers library for the byte-level BPE file at path.

    tiktoken runs the same merges about four times faster; what it can't take (its regex gives up on extreme runs) goes
    to the tokenizers library itself."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast = tiktoken.Encoding("byte_bpe", pat_str=GPT2_PATTERN, mergeable_ranks=_ranks(spec), special_tokens={})
    special = [t["content"] for t in spec["added_tokens"]]

    def encode(text: str) -> list[int]:
        if len(text) > 1_000_000 or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except Exception:  # the regex engine's own limits
            return slow.encode(text, add_special_tokens=False).ids

    return encode


#: Fixed value: the pattern of byte-level BPE files of this kind.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE files write bytes as: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _ranks(spec: dict) -> dict[bytes, int]:
    letters, added = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a run of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pack_in(order: np.ndarray, lengths: np.ndarray, capacity: int, thrifty: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing in a given order: sequence number and offset of each piece.

    A new sequence is one of the choices; with thrifty, only where no open one has room."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
    counts = np.zeros(capacity + 1, np.int64)
    number, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i in order:
        size, gap = int(lengths[i]), 0
        if size < capacity:
            # change of the sum of squares when a bin of gap g becomes one of gap g - size; gap 0 isn't open and counts nothing
            there = counts[size:capacity]
            after = counts[: capacity - size].copy()
            after[0] = 0
            change = 2 * (after - there) + 2
            change[0] = 1 - 2 * counts[size]
            change = np.where(there > 0, change, never)
            best = int(change.argmin())
            if change[best] < never and (thrifty or change[best] <= 2 * counts[capacity - size] + 1):
                gap = best + size
        if gap:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            b, gap, used = used, capacity, used + 1
        number[i], offset[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            counts[gap - size] += 1
    return number, offset


def pack(lengths: np.ndarray, capacity: int, mixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The better of two ways: thrifty, the longest first; or the longest first down to a quarter of the capacity, then the others in the order of mixed."""
    down = np.argsort(-lengths, kind="stable")
    mixed = np.arange(len(lengths)) if mixed is None else np.argsort(mixed, kind="stable")
    quarters = np.concatenate([down[lengths[down] > capacity // 4], mixed[lengths[mixed] <= capacity // 4]])
    ways = (pack_in(down, lengths, capacity, thrifty=True), pack_in(quarters, lengths, capacity))
    return min(ways, key=lambda found: found[0].max(initial=-1))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, without its place."""
    rows = docs.select(whole(docs, key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        encode = tokenizer(vocabulary)
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*(encode(content) if content else ()), end_id], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
    shard_items: int = 12_000, rows: int | None = None
) -> DataFrame:
    """PIECES: every piece with its sequence and its offset there. rows: of docs, if known (else they are counted).

    Full pieces are sequences already and need no shard; of the others a document has one at most, so that shards grow with documents."""
    shards = max(1, math.ceil((docs.count() if rows is None else rows) / shard_items))
    found = stored(pieces(docs, vocabulary, capacity, end_id, key, text), "pieces")
    full = found.where(F.col("length") == capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()
    ).withColumn("offset", F.lit(0).cast("long"))
    shard = F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(shards)).cast("int")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        crc = group.column("ids_crc32").to_numpy().astype(np.uint64)
        number, offset = pack(group.column("length").to_numpy(), capacity, crc * np.uint64(0x9E3779B97F4A7C15))
        ids = (int(group.column("shard")[0].as_py()) << 40) + number
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return found.where(F.col("length") < capacity).withColumn("shard", shard).groupBy("shard").applyInArrow(run, PIECES).unionByName(full)
