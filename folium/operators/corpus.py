"""Corpus measures over rows of (file, engine, markdown): relational plans without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import columns as C


def token_rows(df: DataFrame, file: str, engine: str, text: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), F.col(engine).alias("engine"), F.explode(C.tokens(F.col(text))).alias("token")).distinct()


def _by_file(df: DataFrame, file: str, engine: str, text: str) -> DataFrame:
    """The same for files that are a few outputs each, and not made distinct: outputs are exchanged by file, tokens as one value; what is asked by file and token needs no exchange behind that."""
    outputs = df.select(F.col(file).alias("file"), F.col(engine).alias("engine"), C.tokens(F.col(text)).alias("tokens")).repartition("file")
    return outputs.select("file", "engine", F.explode("tokens").alias("token"))


def consensus(rows: DataFrame) -> DataFrame:
    """(file, token) that two engines or more give for a file."""
    return rows.groupBy("file", "token").agg(F.count(F.lit(1)).alias("engines")).where("engines >= 2").select("file", "token")


def _found(rows: DataFrame) -> DataFrame:
    """file, engine, hit, unique_tokens and consensus (of the file).

    One sort by file, token and engine: rows that repeat an engine for a token count not, and the first row of a token counts it for its file."""
    of_token = Window.partitionBy("file", "token").orderBy("engine")
    whole = of_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(of_token) == 1
    rows = rows.select("file", "token", "engine", first.alias("first"), (first | ~F.col("engine").eqNullSafe(F.lag("engine").over(of_token))).alias("new"))
    shared = F.sum(F.col("new").cast("int")).over(whole) >= 2
    marked = rows.select("file", "engine", "first", "new", shared.alias("shared")).where("new")
    own = marked.groupBy("file", "engine").agg(
        F.sum(F.col("shared").cast("long")).alias("hit"), F.sum((~F.col("shared")).cast("long")).alias("unique_tokens"),
        F.sum((F.col("shared") & F.col("first")).cast("long")).alias("first")
    )
    return own.withColumn("consensus", F.sum("first").over(Window.partitionBy("file"))).drop("first")


def _recall() -> Column:
    """Share of the consensus; 1 without one. An output without tokens has none of it."""
    return F.when(F.coalesce("consensus", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("hit", F.lit(0)) / F.col("consensus"))


def recall(rows: DataFrame) -> DataFrame:
    """file, engine, recall (share of the consensus it has; 1 without one), unique_tokens (that no other engine gives)."""
    return _found(rows).select("file", "engine", _recall().alias("recall"), "unique_tokens")


def table_stats(df: DataFrame, key: str, md: str) -> DataFrame:
    """key, tables, table_rows, broken_rows of each row of df; nothing is shuffled."""
    return df.select(key, C.table_stats(F.col(md)).alias("s")).select(key, "s.*")


COUNTS = (
    "headings", "list_items", "links", "images", "code_fences", "tables", "table_rows", "broken_rows", "blank_runs", "trailing_ws",
    "empty_links", "raw_html"
)


def measures(df: DataFrame, file: str = "file", engine: str = "engine", markdown: str = "markdown") -> DataFrame:
    """file, engine, recall, unique_tokens, bytes (characters) and COUNTS of every output."""
    counted = C.structure(F.col(markdown)) | C.hygiene(F.col(markdown))
    own = df.select(
        F.col(file).alias("file"), F.col(engine).alias("engine"), F.length(markdown).cast("long").alias("bytes"),
        *[counted[c].alias(c) for c in COUNTS]
    )
    joined = own.join(_found(_by_file(df, file, engine, markdown)), ["file", "engine"], "left")
    # an output without tokens has its file's consensus from the others
    return joined.withColumn("consensus", F.max("consensus").over(Window.partitionBy("file"))).withColumns(
        {"recall": _recall(), "unique_tokens": F.coalesce("unique_tokens", F.lit(0).cast("long"))}
    ).drop("hit", "consensus")


def totals(measured: DataFrame) -> DataFrame:
    """engine, files, mean_recall and the sums of COUNTS over its files."""
    return measured.groupBy("engine").agg(
        F.count(F.lit(1)).alias("files"), F.avg("recall").alias("mean_recall"), *[F.sum(c).alias(c) for c in COUNTS]
    )


def _percent(share: Column) -> Column:
    """With one place; of two equally near ones the even, as they print in Python (.25 and .75 are all the halves a double can hold)."""
    value = share * 100
    rest = value - F.floor(value)
    return F.concat(F.format_string("%.1f", value + F.when(rest == 0.25, -0.05).when(rest == 0.75, 0.05).otherwise(0.0)), F.lit("%"))


# Columns of the report's tables.
PER_FILE = {
    "engine": "engine", "recall": "recall", "unique": "unique_tokens", "bytes": "bytes", "headings": "headings", "lists": "list_items",
    "links": "links", "images": "images", "tables": "tables", "rows": "table_rows", "broken rows": "broken_rows",
    "blank runs": "blank_runs", "trail ws": "trailing_ws", "raw html": "raw_html"
}
IN_TOTAL = {
    "engine": "engine", "files": "files", "mean recall": "mean_recall", "headings": "headings", "tables": "tables",
    "broken rows": "broken_rows", "blank runs": "blank_runs", "trail ws": "trailing_ws"
}


def _listed(df: DataFrame, shown: dict[str, str]) -> Column:
    cells = [_percent(F.col(c)) if c.endswith("recall") else F.col(c).cast("string") for c in shown.values()]
    rows = F.sort_array(F.collect_list(F.struct("engine", F.array(*cells).alias("cells"))))
    return C.table(F.array(*map(F.lit, shown)), F.transform(rows, lambda r: r["cells"]))


def report(measured: DataFrame) -> DataFrame:
    """section, markdown, last (1 for the totals): a table of engines for each file, and ``Totals``. An engine is a row, so a section is as short as the list of engines."""
    files = measured.groupBy("file").agg(_listed(measured, PER_FILE).alias("table")).select(
        F.col("file").cast("string").alias("section"), "table", F.lit(0).alias("last")
    )
    whole = totals(measured)
    total = whole.agg(_listed(whole, IN_TOTAL).alias("table")).select(F.lit("Totals").alias("section"), "table", F.lit(1).alias("last"))
    both = files.unionByName(total)
    return both.select("section", F.concat(F.lit("## "), "section", F.lit("\n\n"), "table").alias("markdown"), "last")


def write_report(measured: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report as text files, in order: the files' sections, then the totals."""
    rows = report(measured).orderBy("last", "section")
    rows.select(F.concat("markdown", F.lit("\n")).alias("value")).write.mode(mode).text(path)


def recall_gate(df: DataFrame, key: str, reference: str, actual: str, least: float = 1.0) -> DataFrame:
    """key, similarity, missing (at most 20 tokens) of the outputs that keep less than least of the reference's tokens; no row: passed."""
    compared = df.select(key, C.compared_tokens(F.col(reference)).alias("r"), C.compared_tokens(F.col(actual)).alias("a"))
    found = compared.select(
        key, C.token_similarity(F.col("r"), F.col("a")).alias("similarity"),
        F.slice(C.missing_tokens(F.col("r"), F.col("a")), 1, 20).alias("missing")
    )
    return found.where(F.col("similarity") < least)


def best_of(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(seconds).alias("best"))


def ab_delta(df: DataFrame, case: str, binary: str, seconds: str, champion: str, candidate: str) -> DataFrame:
    """Best times of two binaries per case and their difference in percent of the champion's."""
    best = df.groupBy(case).agg(
        F.min(F.when(F.col(binary) == champion, F.col(seconds))).alias("champion"),
        F.min(F.when(F.col(binary) == candidate, F.col(seconds))).alias("candidate")
    )
    return best.withColumn("delta_percent", (F.col("candidate") - F.col("champion")) / F.col("champion") * 100)


def promoted(champions: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The champions' table after candidates took their places: a candidate replaces the champion of its keys, others stay."""
    return champions.join(candidates.select(*keys), keys, "left_anti").unionByName(candidates)


def cold_start(df: DataFrame, case: str, run: str, seconds: str) -> DataFrame:
    """Of each case the time of its first run, the best of the later ones, and what starting up cost (0 at least; null after a single run)."""
    first, best = F.min_by(seconds, run), F.min(F.when(F.col("__first") < F.col(run), F.col(seconds)))
    marked = df.withColumn("__first", F.min(run).over(Window.partitionBy(case)))
    out = marked.groupBy(case).agg(first.alias("cold"), best.alias("warm"))
    return out.withColumn("start_up", F.when(F.col("warm").isNotNull(), F.greatest(F.lit(0.0), F.col("cold") - F.col("warm"))))


def stage_split(df: DataFrame, convert: str, parse: str) -> DataFrame:
    return df.withColumn("render", F.greatest(F.lit(0.0), F.col(convert) - F.col(parse)))
