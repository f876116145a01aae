"""Shared by operators: bounded broadcasts and scalable ranks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def saved(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there, for tables that are used several times.

    The cluster names the folder in spark.checkpoint.dir; only a local session gets one made here.
    """
    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    return df.checkpoint(eager=True)


def hash_order(seed: int | str, *keys: str) -> Column:
    """A fixed random order: md5 of seed and keys, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def hash_number(seed: int | str, *keys: Column) -> Column:
    """A fixed random number of 32 bits: the first eight digits of md5 of seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_wide(seed: int | str, *keys: Column) -> Column:
    """A fixed random number of 60 bits: the first fifteen digits of md5 of seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_rank(df: DataFrame, seed: int | str, keys: list[str], by: list[str] = (), name: str = "rank") -> DataFrame:
    """df with its 1-based rank in hash order, overall or within `by`.

    Ranks are counted in 4,096 buckets of the hash: a window within each, and the counts of the buckets before.  So
    neither the whole table nor a group that holds most of it is sorted in one task.
    """
    by = list(by)
    marked = df.withColumn("_h", hash_order(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if not by:  # at most 4,096 rows
        counts = counts.withColumn("_all", F.lit(0))
        before = Window.partitionBy("_all").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inner = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    ranked = marked.withColumn("_r", F.row_number().over(inner)).join(start if by else F.broadcast(start), [*by, "_b"])
    return ranked.select(*df.columns, (F.col("_s") + F.col("_r")).cast("long").alias(name))


def hash_limit(df: DataFrame, seed: int | str, keys: list[str], n: int) -> DataFrame:
    """n rows in hash order (all if there are fewer): a uniform sample without replacement, kept as partial top-n."""
    return df.withColumn("_h", hash_order(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")
