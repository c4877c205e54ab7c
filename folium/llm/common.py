"""What the training-data operators share: shared-folder tables, batches of texts, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). In local mode, as in tests, a temporary one where none is set; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="folium-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost nothing. It goes with the application, or with dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._folium_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing lazy reads it any more."""
    where, files = _file_system(df.sparkSession, df._folium_path)
    files.delete(where, True)


def whole(df: DataFrame, key: str) -> Column:
    """The column key as long; other types than whole numbers are refused."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise ValueError(f"{key} must be a column of whole numbers, not of {kind.simpleString()}")
    return F.col(f"`{key}`").cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay near max_bytes; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= max_rows or size + n > max_bytes):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def fraction_of(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: A table of at most so many bytes, as counted, may be broadcast.
BROADCAST_BYTES = 64 << 20


def with_size(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """df, a stored table, marked for broadcast if it is counted to have BROADCAST_BYTES at most; else as it is, and Spark shuffles.

    A row counts 16 bytes and 8 a column, and 8 for each of entries, the number of values in its arrays."""
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if entries is None else entries), F.lit(0))).first()
    return F.broadcast(df) if rows * (16 + 8 * len(df.columns)) + 8 * held <= BROADCAST_BYTES else df
