"""The corpus pipeline: documents -> language ID -> line dedup -> near-dedup -> mixing -> packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import language_id, line_dedup, minhash, mixing, packing, queries
from folium.llm.common import stored, table, with_size

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model takes: no letters, or a cross-entropy beyond the calibrated limit."""
    trained = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs.select(*COLUMNS), trained).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that had words and has lost them all goes with its last line."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), equal_chars=1)
    lost_all = (F.col("dropped_equal") + F.col("dropped_near") > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return found.where(~lost_all).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the lowest id of each group of near-duplicates; one of a null id where there is no other."""
    return minhash.keep_first(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source weights select, as often as they are selected."""
    # ids can be null, or shared by different texts
    named = docs.withColumn(
        "row", F.struct("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.length("text"), "text").alias("h2"))
    )
    chosen = queries.mixed(named, key="row").groupBy("row").agg(F.max("copies").alias("copies"))
    marked = named.join(with_size(stored(chosen, "chosen"), F.lit(3)), "row")
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and their offset there."""
    return packing.pack_documents(docs, queries.vocabulary(), queries.CAPACITY, queries.END_ID)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: A tokenizer and models fitted on the rows have no SQL form: tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
