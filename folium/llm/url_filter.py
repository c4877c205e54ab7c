"""URL filter: rules first, then the ratio of two character language models.

Rules name a host and a path prefix and fit the host with its subdomains. Where none fits, variable-order Markov
models (Witten-Bell smoothed) of URLs that rules allow and of URLs that they block are compared: the difference of
their log-likelihoods per character, against a threshold. The models count every URL that a rule labels; for the threshold
each of these is judged by models of the other folds, which have not seen it.

Defined results: a null url, or one without ``://``, has empty host and path and so no rule; the models judge the url as it is, and a null or empty one
has the verdict ``allow`` with a null ratio (there is nothing to judge). Ties of equally long rules go to the first listed. If rules of one kind label no URL at all,
the models cannot be fitted and the method's verdict is ``allow``. Empty tables give no rows; repeated rows, null or repeated keys and keys of any type stay
apart, as rows are numbered first; URLs of any length are read whole; columns other than key and url are left aside, whatever their names.

Everything is counted, smoothed and summed up by joins and windows: neither a model nor a list of n-grams or ratios reaches the driver, and a table of values
is broadcast only if it is counted to be small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm import common
from folium.llm.charlm import ALPHABET, count_grams
from folium.llm.common import fraction_of, stored

DIGITS = re.compile(r"[0-9]+")
#: Parts of the labelled URLs: each is judged by models of the others.
FOLDS = 4
#: Rows of n-grams that a task hands on together.
ROWS_AT_ONCE = 1 << 16
#: Contexts seen less often than this have no say.
LEAST = 2
#: Log-probabilities are summed as whole numbers of this part of a nat, so that sums do not hang on their order.
UNIT = 1 << 32
#: Bins of a nat per character in which ratios are summed up before the best cut is looked for.
BINS = 1024
#: Parts into which the rows of an n-gram are dealt where values are joined by a shuffle.
SALTS = 16
SLOTS = [f"{verdict}{f}" for verdict in ("allow", "block") for f in range(FOLDS)]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """What stands behind the path, or all of a url without ``://``."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)).otherwise(url), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    cases = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        cases = F.when(fits, found) if cases is None else cases.when(fits, found)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(host: str, path: str, rest: str) -> str:
    """What the models read: the url without its scheme, in lower case, each number as one 0, blanks as _."""
    return DIGITS.sub("0", f"{host}{path}{rest}".lower()).replace(" ", "_")


@dataclass
class UrlModels:
    """counts: gram and how often each of SLOTS (class and fold) has it, a stored table; none if a class has no URL."""

    counts: DataFrame | None = None
    threshold: float = 0.0
    order: int = 6


def _numbered(pages: DataFrame, rules: list[Rule], key: str, url: str, seed: int) -> DataFrame:
    """A stored table: row (a number), key, host, path, rule, verdict, rest, slot (of SLOTS; null where no rule fits)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path"),
        fitting_rule(host, path, rules).alias("found"), rest_of(F.col(url)).alias("rest"),
        F.floor(fraction_of(F.col(key), seed) * FOLDS).cast("int").cast("string").alias("fold")
    )
    found = F.col("found")
    return stored(rows.select("row", "key", "host", "path", found["rule"].alias("rule"), found["verdict"].alias("verdict"), "rest", F.concat(found["verdict"], "fold").alias("slot")), "urls")


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """row, slot, gram, n of every url that is not empty."""

    names = ["row", "slot", "gram", "n"]

    def made(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(counts) for _, _, counts in parts]
        wide = [pa.array(column, kind).take(pa.array(np.repeat(np.arange(len(parts)), sizes))) for column, kind in (([p[0] for p in parts], pa.int64()), ([p[1] for p in parts], pa.string()))]
        grams = pa.array([g for *_, counts in parts for g in counts], pa.string())
        return pa.RecordBatch.from_arrays([*wide, grams, pa.array([n for *_, counts in parts for n in counts.values()], pa.int64())], names=names)

    def run(batches):
        for batch in batches:
            parts, size = [], 0
            columns = [batch.column(c).to_pylist() for c in ("row", "slot", "host", "path", "rest")]
            for row, slot, *url in zip(*columns):
                if text := shape(*url):
                    parts.append((row, slot, count_grams({text: 1}, order)))
                    size += len(parts[-1][2])
                if size >= ROWS_AT_ONCE:
                    yield made(parts)
                    parts, size = [], 0
            if parts:
                yield made(parts)

    return rows.select("row", "slot", "host", "path", "rest").mapInArrow(run, "row long, slot string, gram string, n long")


def _values(counts: DataFrame, asked: DataFrame, order: int, leave_out: list[int | None]) -> DataFrame:
    """gram and value of each asked n-gram: for each entry of leave_out, log P(last character | those before, blocked) less that of allowed URLs, in
    UNITs, by models of all folds but this one.

    Witten-Bell from the shortest context up: a level has each ending of the asked and the counted n-grams once; its contexts are the groups of a window, and
    the level below is joined by the ending one character shorter."""
    known = counts.unionByName(asked.select("gram", *[F.lit(0).cast("long").alias(s) for s in SLOTS]))
    models = [(verdict, f) for f in leave_out for verdict in ("block", "allow")]
    count = lambda verdict, f: reduce(lambda x, y: x + y, [F.col(s) for s in SLOTS if s.startswith(verdict) and s != f"{verdict}{f}"])
    below = None
    for k in range(1, order + 1):
        level = known.groupBy(F.substring("gram", order - k + 1, k).alias("gram")).agg(*[F.sum(s).alias(s) for s in SLOTS])
        level = level.select("gram", *[count(*m).alias(f"c{i}") for i, m in enumerate(models)])
        context = Window.partitionBy(F.substring("gram", 1, k - 1))
        level = level.select(
            "*", *[F.sum(f"c{i}").over(context).alias(f"t{i}") for i in range(len(models))],
            *[F.sum((F.col(f"c{i}") > 0).cast("int")).over(context).alias(f"d{i}") for i in range(len(models))]
        )
        if below is None:
            level = level.withColumns({f"q{i}": F.lit(1 / ALPHABET) for i in range(len(models))})
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        made = [
            F.when(
                F.col(f"t{i}") >= (LEAST if k > 1 else 1), (F.col(f"c{i}") + F.col(f"d{i}") * F.col(f"q{i}")) / (F.col(f"t{i}") + F.col(f"d{i}"))
            ).otherwise(F.col(f"q{i}")).alias(f"q{i}") for i in range(len(models))
        ]
        below = level.select("gram", *made)
    ratio = lambda i: F.round((F.log(f"q{2 * i}") - F.log(f"q{2 * i + 1}")) * UNIT).cast("long")
    return below.select("gram", F.array(*[ratio(i) for i in range(len(leave_out))]).alias("value"))


def _ratios(rows: DataFrame, models: UrlModels, leave_out: list[int | None]) -> DataFrame:
    """row, slot, ratio (per character) of every url that is not empty; for models of several folds left out, that of the url's own."""
    grams = _grams(rows, models.order)
    values = stored(_values(models.counts, grams.select("gram").distinct(), models.order, leave_out), "values")
    small = common.with_size(values, F.size("value") + 8)
    if small is values:  # too large: a frequent n-gram is dealt to several tasks
        small = values.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = grams.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(small, ["gram", "salt"])
    else:
        found = grams.join(small, "gram")
    at = F.lit(0) if leave_out == [None] else F.array_position(F.array(*map(F.lit, leave_out)), F.substring("slot", 6, 1).cast("int")).cast("int") - 1
    total = F.sum(F.get("value", at).cast("decimal(20,0)") * F.col("n"))
    return found.groupBy("row", "slot").agg((total.cast("double") / UNIT / F.sum("n")).alias("ratio"))


def best_cut(judged: DataFrame) -> float:
    """The threshold over rows of bad (boolean) and ratio with the best mean of both classes' shares judged right: the middle between two neighbouring ratios, the widest apart of equally good ones.

    Ratios are summed up in bins, whose number hangs on the range of ratios alone; the driver has the bins' sums, from which each ratio's own follows within its bin."""
    spark = judged.sparkSession
    bad = F.col("bad").cast("long")
    per = stored(judged.groupBy(F.floor(F.col("ratio") * BINS).alias("bin"), "ratio").agg(F.sum(1 - bad).alias("good"), F.sum(bad).alias("bad")), "ratios")
    bins = sorted(per.groupBy("bin").agg(F.sum("good"), F.sum("bad"), F.min("ratio"), F.max("ratio")).collect())
    goods, bads = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not goods or not bads:
        return 0.0
    before, given = (0, 0), []
    for i, (at, good, worse, low, high) in enumerate(bins):
        given.append((at, *before, bins[i - 1][4] if i else low - 1, bins[i + 1][3] if i + 1 < len(bins) else high + 1))
        before = (before[0] + good, before[1] + worse)
    offsets = spark.createDataFrame(given, "bin long, good0 long, bad0 long, last double, next double")
    upto = Window.partitionBy("bin").orderBy("ratio")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rows = per.join(offsets, "bin").select(
        "ratio", "good", "bad", F.coalesce(F.lead("ratio").over(upto), "next").alias("next"),
        (F.sum("good").over(upto) + F.col("good0")).alias("g"), (F.sum("bad").over(upto) + F.col("bad0")).alias("b")
    )
    # behind a ratio: the good ones up to it are judged right, the bad ones up to it wrong
    quality = big("g") * F.lit(bads).cast("decimal(19,0)") - big("b") * F.lit(goods).cast("decimal(19,0)")
    rows = rows.select(quality.alias("quality"), F.col("ratio").alias("low"), F.col("next").alias("high"))
    first = bins[0][3]
    rows = rows.unionByName(spark.createDataFrame([(first - 1, first)], "low double, high double").withColumn("quality", F.lit(0).cast("decimal(38,0)")))
    found = rows.orderBy(F.desc("quality"), F.desc(F.col("high") - F.col("low")), "low").select("low", "high").first()
    return (found["low"] + found["high"]) / 2


def fit(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", order: int = 6, seed: int = 11) -> UrlModels:
    """Models from all URLs that a rule labels, dealt into folds by the hash of key, and a threshold from all of them too."""
    rows = _numbered(pages, rules, key, url, seed).where(F.col("slot").isNotNull())
    slot = lambda s: F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(s)
    counts = stored(_grams(rows, order).groupBy("gram").agg(*map(slot, SLOTS)), "grams")
    held = counts.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SLOTS]).first().asDict()
    has = lambda verdict, without=None: any(n for s, n in held.items() if s.startswith(verdict) and s != f"{verdict}{without}")
    if not has("allow") or not has("block"):
        return UrlModels()
    out = UrlModels(counts, 0.0, order)
    if folds := [f for f in range(FOLDS) if has("allow", f) and has("block", f)]:
        judged = _ratios(rows.where(F.substring("slot", 6, 1).cast("int").isin(folds)), out, folds)
        out.threshold = best_cut(judged.select(F.startswith("slot", F.lit("block")).alias("bad"), "ratio"))
    return out


def judge(pages: DataFrame, rules: list[Rule], models: UrlModels, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, ratio."""
    rows = _numbered(pages, rules, key, url, 0)
    if models.counts is None:
        found = rows.withColumn("ratio", F.lit(None).cast("double"))
    else:
        found = rows.join(_ratios(rows, models, [None]).select("row", "ratio"), "row", "left")
    method = F.when(F.col("ratio") > models.threshold, "block").otherwise("allow")
    return found.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "ratio")
