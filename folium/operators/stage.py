"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode a temporary folder where none is set; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="folium-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own there, to be made; it goes with the application."""
    path = f"{shared_dir(spark)}/folium/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet, in folders of the columns by, and read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of at most so many rows and characters may be broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 1 << 18, 1 << 25


def small(df: DataFrame, name: str, chars: Column | None = None) -> DataFrame:
    """df written, and marked for broadcast if it is counted to have BROADCAST_ROWS and BROADCAST_CHARS at most; else Spark shuffles.

    chars: of a row, where it is more than a few numbers or short strings."""
    df = written(df, name)
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.lit(0) if chars is None else chars)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_CHARS else df


def parts(df: DataFrame, rows: int) -> int:
    """How many partitions hold so many rows of df each; as many as cores, or as rows, at least. It counts df."""
    n = df.count()
    return max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), -(-n // rows))
