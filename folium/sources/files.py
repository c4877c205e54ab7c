"""Documents from files and from columns; Markdown to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.datasources import write_files


def read_documents(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def from_column(df: DataFrame, text: Column, extension: str) -> DataFrame:
    """df with content (UTF-8) and detected, for text of a known format."""
    detected = F.struct(
        F.lit(None).cast("string").alias("mimetype"), F.lit(extension).alias("extension"), F.lit(None).cast("string").alias("filename")
    )
    return df.withColumn("content", F.encode(text, "UTF-8")).withColumn("detected", detected)


def write_markdown(df: DataFrame, path: str, mode: str = "errorifexists", format: str = "parquet") -> None:
    """Paths with their Markdown: as Parquet, or as text, a file .md for each document, named by its path."""
    if format == "text":
        write_files(df.select("path", F.col("markdown").alias("content")), path, ".md", mode)
    else:
        df.select("path", "markdown", "title", "error").write.mode(mode).parquet(path)
