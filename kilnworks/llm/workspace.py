"""Places for intermediate tables, id ranges and prefix sums shared by the operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1
#: Rows in a range of ids, about the least.
RANGE = 64

#: Lets a write delete its shuffle files as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two collections that release shuffle files.
SWEEP = 2.0
_swept = 0.0

_made: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and Spark runs in one process (tests), one of our own."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        said = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "kilnworks")
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def write_table(df: DataFrame, name: str) -> str:
    """Write df under the shared folder and return its path."""
    spark = df.sparkSession
    path, before = place(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # nothing else writes there: tasks put their files in place themselves, not the driver one by one
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing.

    Shuffle files of what came before are released soon, not at the next garbage collection.
    """
    global _swept
    spark = df.sparkSession
    path = write_table(df, name)
    out = spark.read.schema(df.schema).parquet(path)
    out._place = path
    del df
    if time.monotonic() > _swept + SWEEP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()
    return out


#: A key with more than one row in so many is dealt over several tasks by salted_join; so there are fewer such keys than this.
MANY = 4096


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """big joined with small (a row or few for each key) where one key may have a great share of big's rows.

    Rows of such a key are dealt by ``spread`` over as many tasks as their number asks for, and small's rows of it are sent to
    each. Which keys these are is counted over all rows, at once: fewer than MANY can be, so the driver gets their list, and
    without any the join is a plain one. big is read twice, so it should be a table; counts (key, count) may come from elsewhere.
    """
    counts = counts if counts is not None else big.groupBy(key).count()
    total = counts.agg(F.sum("count").alias("__all"))
    share = F.greatest(F.lit(1), F.col("__all") / MANY)
    hot = counts.join(F.broadcast(total)).where(F.col("count") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("count") / share).cast("int").alias("__parts"))
    hot = hot.where("__parts > 1")
    if not (found := hot.collect()):
        return big.join(small, key, how)
    hot = big.sparkSession.createDataFrame(found, hot.schema)
    salted = big.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int"))
    every = small.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return salted.drop("__hot", "__parts").join(every.drop("__hot", "__parts"), [key, "__salt"], how).drop("__salt")


def done(*tables: DataFrame) -> None:
    """Delete tables that cut() made and that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_place", None):
            drop_table(df.sparkSession, path)


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_table(spark, path)
        except Exception:  # the session may be gone already
            return


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches to Python hold this much at most, unless the session asks for less: long texts fill memory on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("-1", "64m", "67108864", "67108864b"):
        spark.conf.set(key, size)


def id_order(col: str = "doc_id"):
    """Sort key of ids as a long: a null id comes last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(MAX_ID))


def id_bounds(ids: DataFrame, col: str, parts: int) -> np.ndarray:
    """At most parts - 1 ascending split points of a long column, from its quantiles.

    Only this many numbers reach the driver. The quantiles are read as doubles, which keeps the order
    of longs, so equal ids always fall into the same range.
    """
    if parts < 2:
        return np.empty(0)
    at = ids.stat.approxQuantile(col, [i / parts for i in range(1, parts)], 0.25 / parts)
    return np.unique(np.array(at, dtype="float64"))


def bucket_of(bounds: np.ndarray, column):
    """Index of the range that a long falls into; a binary search, so there may be many ranges."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def bucket(x):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, x.to_numpy().astype("float64"), side="right").astype("int32"))

    return bucket(column)


def by_ranges(df: DataFrame, parts: int | None = None, ord_col: str = "ord") -> DataFrame:
    """df with ``ord`` (a long) dealt by ranges: adds ``bucket``; one shuffle, partitions sorted by bucket, ord.

    There are a few ranges for each partition, so that long texts even out, but no smaller ones than of about RANGE rows.
    """
    n = parts or partitions(df.sparkSession)
    bounds = id_bounds(df.select(ord_col), ord_col, min(3 * n, df.count() // RANGE + 1))
    return df.withColumn("bucket", bucket_of(bounds, F.col(ord_col))).repartition(n, "bucket")


def bucket_offsets(sums: DataFrame, value: str) -> DataFrame:
    """(bucket, base): the sum of value over all smaller buckets; a row a bucket, so one task does."""
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("bucket", F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias("base"))
