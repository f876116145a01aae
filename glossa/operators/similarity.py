"""Queries against a bounded set of vectors, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot
from .common import saved

#: Numbers (rows times dimensions) of the candidate vectors that are broadcast at once.
BLOCK_VALUES = 1 << 22
#: Similarities that a task holds at once.
STEP_VALUES = 1 << 21
#: Candidates that are fetched at once.
FEW_ROWS = 4096


def matrix(column, rows: int) -> np.ndarray:
    """float64 [rows, dimensions] of an Arrow list column without nulls."""
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def blocks(candidates: DataFrame, order: str, vector: str):
    """(order values, matrix) of the candidates, a block at a time, by order.  The driver holds one block."""
    keys, rows = [], []
    source = candidates.where(F.col(vector).isNotNull()).select(order, vector)
    few = source.limit(FEW_ROWS + 1).collect()  # one job, where a sorted stream takes one for each partition
    ordered = sorted(few) if len(few) <= FEW_ROWS else source.orderBy(order).toLocalIterator(prefetchPartitions=True)
    for key, vec in ordered:
        keys.append(key)
        rows.append(np.array(vec, np.float64))
        if len(rows) * len(vec) >= BLOCK_VALUES:
            yield keys, np.array(rows, np.float64)
            keys, rows = [], []
    if rows:
        yield keys, np.array(rows, np.float64)


def nearest(queries: DataFrame, candidates: DataFrame, key: str, order: str, vector: str = "vec", name: str = "sim") -> DataFrame:
    """queries with best_<order> and the similarity (as `name`) of the most similar candidate; ties go to the least order.

    Each block of candidates is broadcast; queries stream past it once a block, and the better of two blocks is kept.
    """
    parts, arrow_type = [], to_arrow_type(candidates.schema[order].dataType)
    for keys, table in blocks(candidates, order, vector):
        shared = queries.sparkSession.sparkContext.broadcast((np.array(keys), np.ascontiguousarray(table.T)))

        def run(batches, shared=shared):
            names, m = shared.value
            step = min(2048, max(1, STEP_VALUES // len(names)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    sims = matrix(part.column(vector), part.num_rows) @ m
                    best = sims.argmax(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], arrow_type), pa.array(sims[np.arange(len(best)), best])], [*part.schema.names, f"best_{order}", name])

        kind = dict(candidates.dtypes)[order]
        schema = ", ".join([f"`{c}` {t}" for c, t in queries.dtypes] + [f"best_{order} {kind}", f"{name} double"])
        parts.append(queries.mapInArrow(run, schema))
    if not parts:
        return queries.withColumn(f"best_{order}", F.lit(None).cast(dict(candidates.dtypes)[order])).withColumn(name, F.lit(None).cast("double"))
    out = parts[0]
    for other in parts[1:]:
        mine = out.groupBy(key).agg(F.max(name).alias("a"))
        theirs = other.groupBy(key).agg(F.max(name).alias("b"))
        wins = theirs.join(mine, key).where("b > a").select(key)
        out = out.join(wins, key, "left_anti").unionByName(other.join(wins, key, "left_semi"))
    return out


def ranks(queries: DataFrame, candidates: DataFrame, order: str = "row_no", vector: str = "vec") -> DataFrame:
    """row_no, rank: 1 + the number of candidates more similar to the query, by over 1e-12, than the candidate of its own number.

    Vectors must be normalized.  Candidates come in blocks, each of which is counted before the next one comes, and the counts of
    blocks add up.
    """
    own = queries.select(order, F.col(vector).alias("q")).join(candidates.select(order, F.col(vector).alias("c")), order)
    own, total = saved(own.select(order, "q", dot(F.col("q"), F.col("c")).alias("mine"))), None
    for keys, table in blocks(candidates, order, vector):
        shared = queries.sparkSession.sparkContext.broadcast((np.array(keys), np.ascontiguousarray(table.T)))

        def run(batches, shared=shared):
            names, m = shared.value
            step = min(1024, max(1, STEP_VALUES // len(names)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    above = matrix(part.column("q"), part.num_rows) @ m > np.asarray(part.column("mine"))[:, None] + 1e-12
                    above &= names[None, :] != np.asarray(part.column(order))[:, None]
                    yield pa.RecordBatch.from_arrays([part.column(order), pa.array(above.sum(1).astype(np.int64))], [order, "above"])

        part = saved(own.mapInArrow(run, f"{order} {dict(queries.dtypes)[order]}, above long"))
        shared.destroy()  # one block at a time, in the driver and in the tasks
        total = part if total is None else total.unionByName(part)
    if total is None:
        return queries.select(order, F.lit(1).cast("long").alias("rank")).limit(0)
    return total.groupBy(order).agg((F.sum("above") + 1).alias("rank"))


def nearest_distances(points: DataFrame, key: str, k: int, vector: str = "vec") -> DataFrame:
    """key, d2: the k least squared distances of each point to other points, ascending; points are a bounded sample."""
    n = points.count()
    k = min(max(k, 1), n - 1)
    parts = None
    for keys, table in blocks(points, key, vector):
        shared = points.sparkSession.sparkContext.broadcast((np.array(keys), table))

        def run(batches, shared=shared):
            names, m = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    q = matrix(part.column(vector), part.num_rows)
                    d2 = np.maximum((q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * (q @ m.T), 0)
                    d2[np.asarray(part.column(key))[:, None] == names[None, :]] = np.inf
                    best = np.sort(d2, 1)[:, :k]
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(best), pa.list_(pa.float64()))], [key, "d2"])

        part = points.select(key, vector).mapInArrow(run, f"{key} {dict(points.dtypes)[key]}, d2 array<double>")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("d2"))), 1, k).alias("d2"))
    return merged
