"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The sum of products; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, floor: float = 1e-12) -> Column:
    """v over its length; a zero vector stays zero.  The length is bound by an outer lambda, so it is taken once a vector."""
    length = F.when(v.isNotNull(), F.array(F.greatest(norm(v), F.lit(floor))))
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: x / n)), F.lit(0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Squared Euclidean distance, or one less the cosine."""
    if metric == "euclidean":
        return squared_distance(a, b)
    if metric == "cosine":
        return F.lit(1.0) - dot(normalize(a), normalize(b))
    raise ValueError(f"unknown metric {metric}")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def word_vector(words: Column, index: Column) -> Column:
    """The normalized vector of the word at a 0-based index; null out of range."""
    v = F.when((index >= 0) & (index < F.size(words)), F.get(words, index))
    return normalize(v)


def mean_by(df: DataFrame, keys: list[str], vector: str = "vec", name: str = "vec") -> DataFrame:
    """The mean vector of each key, element by element with partial sums: no group is gathered."""
    parts = df.select(*keys, F.posexplode(vector).alias("_dim", "_x"))
    sums = parts.groupBy(*keys, "_dim").agg(F.avg("_x").alias("_m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_m"))), lambda x: x["_m"]).alias(name))


def masked_mean_by(df: DataFrame, keys: list[str], vector: str, mask: str, name: str = "vec") -> DataFrame:
    """The mean over rows whose mask is set; a zero vector for keys without one (the count is at least 1)."""
    parts = df.select(*keys, mask, F.posexplode(vector).alias("_dim", "_x"))
    total = F.sum(F.when(F.col(mask), F.col("_x")).otherwise(0.0)) / F.greatest(F.count_if(F.col(mask)), F.lit(1))
    sums = parts.groupBy(*keys, "_dim").agg(total.alias("_m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_m"))), lambda x: x["_m"]).alias(name))
