"""Conversion of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folium.operators.convert import convert

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType())
    ]
)


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Start converting what arrives under path into Parquet under out; available files are done, then the query ends."""
    done = convert(document_stream(spark, path), **options).select("path", "converter", "markdown", "title", "error")
    return done.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
