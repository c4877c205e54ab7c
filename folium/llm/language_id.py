"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is lower-cased and taken as its runs of letters; each run is scored between blanks. The language with the lowest
cross-entropy per character wins; a document whose best cross-entropy lies beyond what held-back labelled documents
of that language reach is rejected.

Defined results: a null text, or one without a letter, gives ``und``, score 0 and rejected. Rows repeat as they come.
Equal cross-entropies go to the language that sorts first. No labelled row: every document is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.charlm import CharModel, count_grams, kneser_ney, word_scores
from folium.llm.common import dropped, fraction_of, free_name, slices, stored

LETTERS = re.compile(r"[^\W\d_]+")
#: How sharply a difference in cross-entropy (nats a character) turns into the score.
SHARPNESS = 20.0
#: Words whose scores a worker keeps; beyond that it starts anew.
KEPT_WORDS = 200_000
#: New words scored at once: their n-grams' hashes take several hundred bytes a word.
SCORED_WORDS = 4_096


@dataclass
class LanguageModels:
    langs: list[str]
    models: list[CharModel]
    limits: np.ndarray

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer(dict):
    """Scores texts; keeps the scores of words it has seen, as a dict from word to row."""

    def __init__(self, trained: LanguageModels):
        super().__init__()
        self.trained = trained
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new, self.known, self.lengths = [], np.zeros((0, len(self.trained.models))), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def _learn(self) -> None:
        """Scores the new words, a few thousand at a time; known and lengths have room for more rows than there are words."""
        if len(self) > len(self.known):
            room = len(self) + len(self) // 4 - len(self.known)
            self.known = np.concatenate([self.known, np.zeros((room, self.known.shape[1]))])
            self.lengths = np.concatenate([self.lengths, np.zeros(room, np.int64)])
        done = len(self) - len(self.new)
        for k in range(0, len(self.new), SCORED_WORDS):
            part = self.new[k : k + SCORED_WORDS]
            rows = slice(done + k, done + k + len(part))
            self.known[rows], self.lengths[rows] = word_scores(self.trained.models, part)
        self.new = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each model (texts x models), and the characters scored."""
        if len(self) > KEPT_WORDS:
            self.reset()
        rows, ends = [], []
        for text in texts:
            words = LETTERS.findall(text.lower()) if text else []
            rows.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self._learn()
        sums = np.zeros((len(texts), len(self.trained.models)))
        chars = np.zeros(len(texts), np.int64)
        for i, at in enumerate(rows):
            if len(at):
                sums[i], chars[i] = self.known[at].sum(axis=0), self.lengths[at].sum()
        return -sums / np.maximum(chars, 1)[:, None], chars


def _count(order: int):
    def run(batches):
        words: dict[str, Counter] = {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, seen in words.items():
            grams = count_grams(seen, order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()),
                    pa.array(list(grams.values()), pa.int64())
                ],
                names=["lang", "gram", "n"]
            )

    return run


def _entropies(shared):
    """lang, entropy (under its own model), other and away (the best of the other models, as if lang had not been learned) of each text."""

    def run(batches):
        score = None
        for batch in slices(batches, "text"):
            score = score or shared.value.scorer()
            langs = shared.value.langs
            found, chars = score(batch.column("text").to_pylist())
            own = np.array([langs.index(x) if x in langs else -1 for x in batch.column("lang").to_pylist()], np.int64)
            at = np.flatnonzero((chars > 0) & (own >= 0))
            rest = found[at]
            entropy = rest[np.arange(len(at)), own[at]]
            rest[np.arange(len(at)), own[at]] = np.inf
            other = rest.argmin(axis=1) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.array(entropy), pa.array(other), pa.array(rest.min(axis=1) if len(at) else entropy)],
                names=["lang", "entropy", "other", "away"]
            )

    return run


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 5, docs_per_lang: int = 2000,
    chars_per_lang: int = 8_000_000, seed: int = 7, tail: float = 0.002
) -> LanguageModels:
    """Models from labelled rows. Of each language a sample of about docs_per_lang documents and chars_per_lang characters at most, drawn by the hash of key,
    is read whole: three quarters of it give the counts, the rest calibrates the rejection.

    A language's limit lies in the middle between what its own held-back texts reach (all but the share tail of them) and what texts of a language that was
    never learned reach: held-back texts under the other languages' models, of which a share of tail lies below. Where the two meet, no text of its own is given up for them.
    With one language alone the price of a character never seen takes the place of the latter."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {
        r["lang"]: (r["n"], r["chars"]) for r in rows.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
        ).collect()
    }
    if not sizes:
        return LanguageModels([], [], np.zeros(0))
    share = F.coalesce(
        *[F.when(F.col("lang") == k, F.lit(min(1.0, docs_per_lang / n, chars_per_lang / max(1, chars)))) for k, (n, chars) in sizes.items()]
    )
    drawn = rows.where(fraction_of(F.col("key"), seed) < share)
    held = fraction_of(F.col("key"), seed + 1) < 0.25
    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    grams = drawn.where(~held).select("text", "lang").mapInArrow(_count(order), "lang string, gram string, n long")
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for a, g, n in zip(*(r.column(i).to_pylist() for i in range(3))):
            counts[a][g] = n
    langs = sorted(k for k in counts if counts[k])
    trained = LanguageModels(langs, [kneser_ney(counts[k], order) for k in langs], np.full(len(langs), np.inf))
    if not langs:
        return trained
    measured = drawn.where(held).select("text", "lang").mapInArrow(
        _entropies(spark.sparkContext.broadcast(trained)), "lang long, entropy double, other long, away double"
    )
    measured = stored(measured, "entropies")
    point = lambda c, share: F.percentile_approx(c, share, 10_000).alias("q")
    inside = {r[0]: r["q"] for r in measured.groupBy("lang").agg(point("entropy", 1 - tail)).collect()}
    outside = {r[0]: r["q"] for r in measured.where("away < double('infinity')").groupBy("other").agg(point("away", tail)).collect()}
    dropped(measured)
    for i, model in enumerate(trained.models):
        if i in inside:
            trained.limits[i] = max(inside[i], (inside[i] + outside.get(i, -model.floor)) / 2)
    return trained


FOUND = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def predict(docs: DataFrame, trained: LanguageModels, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds FOUND to the columns in keep (all of docs by default); columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND]
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    # a text that is kept goes to the workers once
    content = text if text in keep else free_name(docs, "content")
    if text not in keep:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(content))
    schema = T.StructType([rows.schema[c] for c in keep])
    for name, kind in FOUND.items():
        schema = schema.add(name, kind)

    def run(batches):
        models = shared.value
        score = models.scorer()
        for batch in slices(batches, content):
            n = batch.num_rows
            labels, points, entropy, out = ["und"] * n, np.zeros(n), [None] * n, np.ones(n, bool)
            if models.langs:
                found, chars = score(batch.column(content).to_pylist())
                best = found.argmin(axis=1)
                spread = np.exp(-SHARPNESS * (found - found.min(axis=1)[:, None]))
                for i in np.flatnonzero(chars):
                    k = int(best[i])
                    labels[i], points[i], entropy[i] = models.langs[k], 1.0 / spread[i].sum(), float(found[i, k])
                    out[i] = found[i, k] > models.limits[k]
            columns = [pa.array(labels, pa.string()), pa.array(points), pa.array(entropy, pa.float64()), pa.array(out)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=[*keep, *FOUND])

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """The rows that training never sees: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
