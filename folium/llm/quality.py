"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Base statistics of each whole text are counted exactly; rules turn them into votes: good, bad or none. The generative
model holds votes independent given the quality; for each rule and quality it has the chance of each vote, fitted by
expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules, whatever the input).
A document is kept if its posterior probability of being good reaches a half and no base rule fails.

Defined results: a null text has no words and fails the base; so does an empty one. Repeated rows are judged alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import WHITESPACE, slices, stored

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
ENDS = (b".", b"!", b"?", b'"', b":")
WINDOW = 8
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_ascii", "n_shouts",
    "n_distinct_words", "n_stutters"
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_CODES = _Codes()


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text, the first time included.

    Windows meet by hash; those that meet are compared word by word."""
    n = len(words)
    if n <= window:
        return 0
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, n)
    total = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        total = (total ^ (total >> np.uint64(29))) * _MIX + codes[k : n - window + 1 + k]
    at = np.argsort(total, kind="stable")
    same = np.flatnonzero(total[at][1:] == total[at][:-1])
    if not len(same):
        return 0
    # the same word codes at each place: equal words, as far as 64 bits of a word's own hash tell; the words themselves decide
    pairs = zip(at[same].tolist(), at[same + 1].tolist())
    if any(words[a : a + window] != words[b : b + window] for a, b in pairs):
        return _repeated_exactly(words, window)
    twice = np.zeros(n - window + 1, bool)
    twice[at[same]] = True
    twice[at[same + 1]] = True
    return _covered(twice, n, window)


def _covered(starts: np.ndarray, n: int, window: int) -> int:
    steps = np.zeros(n + 1, np.int64)
    steps[:-window][starts] += 1
    np.subtract.at(steps, np.flatnonzero(starts) + window, 1)
    return int((np.cumsum(steps)[:n] > 0).sum())


def _repeated_exactly(words: Sequence[bytes], window: int) -> int:
    """The same by the words themselves, for a text in which different windows share a hash."""
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen = Counter(windows)
    return _covered(np.array([seen[w] > 1 for w in windows]), len(words), window)


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    left = raw.translate(None, WHITESPACE)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITESPACE)]
    upper, lower = len(left) - len(left.translate(None, UPPER)), len(left) - len(left.translate(None, LOWER))
    ended = sum(x.rstrip(WHITESPACE).endswith(ENDS) for x in lines)
    return (
        len(words), len(text) - (len(raw) - len(left)), len(left) - len(left.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), ended, upper, upper + lower, left.count(b"!"), len(set(words)), sum(map(operator.eq, words, islice(words, 1, None))),
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and STATS (long) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.select("key").schema
    for name in STATS:
        schema = schema.add(name, "long")

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(found[:, i]) for i in range(len(STATS)))], names=["key", *STATS]
            )

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Voter:
    """Votes bad where bad holds, else good where good holds, else abstains."""

    name: str
    bad: Column
    good: Column


def voters() -> list[Voter]:
    """The production rules over STATS."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    repeat, symbols, dups, ended = F.col("n_repeat_words") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_ended_lines") / lines
    capitals, shouts, length = F.col("n_upper") / F.greatest(F.col("n_ascii"), F.lit(1)), F.col("n_shouts") / words, F.col("word_chars") / words
    distinct, stutters = F.col("n_distinct_words") / F.sqrt(words), F.col("n_stutters") / words
    never = F.lit(False)
    # A measure with two thresholds has a voter at each: over both, its two votes say how far, not that two things were seen.
    # Merged into one vote (on sf0.1, against labels) the evidence is lost among the good votes of rules that look at something else: 91 of 571 bad documents were kept,
    # none by these.
    return [
        Voter("repetition", repeat > 0.3, repeat < 0.02),
        Voter("stutter", stutters > 0.2, stutters < 0.05),
        Voter("symbols", symbols > 0.1, symbols < 0.01),
        Voter("symbol_words", symbols > 0.3, never),
        Voter("duplicate_lines", (dups > 0.5) & (F.col("n_dup_lines") > 2), never),
        Voter("capitals", (capitals > 0.4) & (F.col("n_ascii") >= 20), capitals < 0.15),
        Voter("shouting", shouts > 0.2, shouts < 0.01),
        Voter("word_length", (length < 2.5) | (length > 12), (length >= 3) & (length <= 9)),
        Voter("line_ends", (ended < 0.5) & (F.col("n_words") >= 20), ended > 0.9),
        Voter("variety", (distinct < 2.0) & (F.col("n_words") >= 30), distinct > 4.0),
    ]


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """Prior of good, and chances[rule, quality, vote] (quality 0 bad, 1 good; vote 0 none, 1 good, 2 bad).

    Starts from whether a pattern has bad votes, so that class 1 is the good one. After each round, a bad vote may not be likelier
    among the good than among the bad (nor the reverse): such a chance is set to its mean, and the rule then says nothing."""
    n = patterns.shape[1]
    hits = np.stack([(patterns == v) for v in range(3)], axis=2).astype(float)
    bad = (patterns == 2).sum(axis=1)
    post = np.where(bad == 0, 0.98, np.where(bad == 1, 0.1, 0.02))
    prior, chances = 0.8, np.zeros((n, 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((post * counts).sum() / max(counts.sum(), 1e-9), 0.05, 0.98))
        for q, weight in ((0, (1 - post) * counts), (1, post * counts)):
            mass = np.einsum("p,prv->rv", weight, hits) + smooth
            chances[:, q] = mass / mass.sum(axis=1, keepdims=True)
        for vote, worse in ((1, 1), (2, 0)):
            wrong = chances[:, worse, vote] < chances[:, 1 - worse, vote]
            chances[wrong, :, vote] = chances[wrong, :, vote].mean(axis=1, keepdims=True)
        new = posterior(patterns, prior, chances)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return prior, chances


def posterior(patterns: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    logs = np.log(chances)
    at = np.arange(patterns.shape[1])
    bad, good = (logs[at, q, patterns].sum(axis=1) + np.log(p) for q, p in ((0, 1 - prior), (1, prior)))
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def filter_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Voter] | None = None) -> DataFrame:
    """key, STATS, base_failed, votes (0 none, 1 good, 2 bad for each rule), posterior, kept."""
    spark, rules = docs.sparkSession, rules or voters()
    votes = F.array(*[F.when(r.bad, 2).when(r.good, 1).otherwise(0) for r in rules])
    rows = stored(measure(docs, key, text), "quality").withColumn("votes", votes)
    seen = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([r["votes"] for r in seen], np.int64).reshape(len(seen), len(rules))
    prior, chances = em(patterns, np.array([r["n"] for r in seen], float))
    logs = np.log(chances)
    # the posterior as an expression over the votes: one table look-up a rule
    ratio = F.lit(float(np.log(prior) - np.log(1 - prior)))
    for i in range(len(rules)):
        gains = F.array(*[F.lit(float(logs[i, 1, v] - logs[i, 0, v])) for v in range(3)])
        ratio = ratio + F.element_at(gains, F.element_at("votes", i + 1) + 1)
    found = rows.withColumn("base_failed", base_failed()).withColumn("posterior", 1 / (1 + F.exp(-ratio)))
    found = found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    return found.withColumnRenamed("key", key) if key != "key" else found
