"""A stored baseline of outputs: digests of buckets are compared first, only unequal buckets are opened, and a promotion swaps one name.

A baseline is a folder of versions. Each has its outputs in folders by bucket of the key's hash, and a row of digests for each bucket: the number of its rows and sums that don't hang on their order, so that
no bucket is ever gathered in one place. The file CURRENT names the version that counts; it is replaced in one step, so readers see the old one or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
DIGEST = ("rows", "total", "mixed", "other")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _digests(outputs: DataFrame) -> DataFrame:
    """bucket and DIGEST of key, output, bucket."""
    whole = F.sha2(F.concat_ws("|", F.length("key").cast("string"), "key", F.coalesce(F.sha2("output", 256), F.lit("none"))), 256)
    part = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    hashed = outputs.select("bucket", part(1).alias("a"), part(16).alias("b"), part(31).alias("c"))
    return hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).alias("total"), F.bit_xor("b").alias("mixed"), F.bit_xor("c").alias("other")
    )


def _outputs(df: DataFrame, key: str, output: str, buckets: int) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(output).cast("string").alias("output"), _bucket(key, buckets).alias("bucket"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that counts; None where none does."""
    where, files = _files(spark, f"{folder}/CURRENT")
    if not files.exists(where):
        return None
    return f"{folder}/{spark.read.text(f'{folder}/CURRENT').first()[0]}"


def store(df: DataFrame, folder: str, key: str, output: str, buckets: int = BUCKETS) -> str:
    """Write df's outputs as a version, which does not count yet; its name. Keys are told apart by their text and must not repeat."""
    name = f"version-{uuid.uuid4().hex}"
    _outputs(df, key, output, buckets).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}/outputs")
    written = df.sparkSession.read.schema("key string, output string, bucket int").parquet(f"{folder}/{name}/outputs")
    _digests(written).withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{folder}/{name}/digests")
    return name


def promote(spark: SparkSession, folder: str, version: str) -> None:
    """From now on this version counts: its name is written aside and moved over CURRENT."""
    aside, files = _files(spark, f"{folder}/.next-{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    overwrite[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    target, _ = _files(spark, f"{folder}/CURRENT")
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(aside), files.makeQualified(target), overwrite)


def unequal_buckets(df: DataFrame, folder: str, key: str, output: str) -> list[int]:
    """Buckets in which df and the baseline differ: as many numbers as the baseline has buckets, at most."""
    spark = df.sparkSession
    was = spark.read.parquet(f"{current(spark, folder)}/digests")
    found = was.agg(F.max("buckets")).first()[0]
    if found is None:  # an empty baseline: everything is new
        return list(range(BUCKETS))
    now = _digests(_outputs(df, key, output, found))
    pairs = was.alias("a").join(now.alias("b"), "bucket", "full")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in DIGEST]
    return sorted(r[0] for r in pairs.where(~(same[0] & same[1] & same[2] & same[3])).select("bucket").collect())


def changes(df: DataFrame, folder: str, key: str, output: str) -> DataFrame:
    """key (as text) and change of every output that is changed, missing or added against the baseline. Where all buckets are equal nothing is opened."""
    spark = df.sparkSession
    base = current(spark, folder)
    if base is None:
        raise FileNotFoundError(f"{folder} has no baseline that counts")
    buckets = spark.read.parquet(f"{base}/digests").agg(F.max("buckets")).first()[0] or BUCKETS
    open_ = unequal_buckets(df, folder, key, output)
    was = spark.read.schema("key string, output string, bucket int").parquet(f"{base}/outputs") if _any(spark, f"{base}/outputs") else spark.createDataFrame([], "key string, output string, bucket int")
    was = was.where(F.col("bucket").isin(open_)).select("bucket", "key", F.struct("output").alias("was"))
    now = _outputs(df, key, output, buckets).where(F.col("bucket").isin(open_)).select("bucket", "key", F.struct("output").alias("is"))
    both = was.join(now, ["bucket", "key"], "full")
    change = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select("key", change.alias("change")).where("change is not null")


def _any(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)
