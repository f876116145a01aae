"""Shared pieces: lineage cuts, table reading, and vectorised hashing over Arrow string buffers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a longer text is one step of its own).
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 1 << 22

#: Rows of a partition in rounds of small tables.
ROUND_ROWS = 1 << 16

MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------------------------------------- Spark

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; only a local session gets one made here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossa-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: lost executors recompute nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets the driver's JVM collect garbage, as Spark itself does from time to time: its cleaner then deletes the
    checkpoints (with spark.cleaner.referenceTracking.cleanCheckpoints) and shuffles that no table needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles it however small it is: rounds of small joins would send a table each through the
    driver, which starts a thread and keeps a copy for each."""
    return df.hint("merge")


@contextmanager
def planned_once(spark: SparkSession, rows: int):
    """Plans that run inside are not adaptive, and their shuffles have as many partitions as tables of so many rows take.

    For rounds of small tables without skewed keys: an adaptive plan takes a job, a thread and a plan of what is left on
    the driver for each shuffle.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1 + rows // ROUND_ROWS))}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def partitions_for(df: DataFrame) -> int:
    """Reduce-side parallelism: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded(run):
    """run for mapInArrow, within bounds of memory.

    Batches are of at most BATCH_BYTES (of one row, if that is longer), unless the session has a lower bound.  After its
    task the Python worker, which Spark keeps, gives unused memory back to the system.
    """
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(-?\d+)b?", conf.get(key))
    if size and not 0 < int(size[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names compare without case, as Spark does)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---------------------------------------------------------------------------------------------- Arrow

def string_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    null = np.asarray(column.is_null())
    lo, hi = int(offsets[0]), int(offsets[-1])
    offsets, raw = offsets - lo, raw[lo:hi]
    if null.any():  # bytes under a null are not defined by the format
        size = np.diff(offsets)
        if size[null].any():
            keep = np.repeat(~null, size)
            raw = raw[keep]
            size = np.where(null, 0, size)
            offsets = np.concatenate([[0], np.cumsum(size)])
    return raw, offsets, null


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows whose bytes together stay near limit."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


# ---------------------------------------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of a byte array, from one prefix sum."""

    BASE = 0x5851F42D4C957F2D
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", self.BASE), ("inverse", self.INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


def fold_case_table() -> np.ndarray:
    """Bytes with A-Z as a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across rows, and the first word's number of each row.

    is_word: 256 booleans by byte value.  The third array has len(offsets) entries.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside & (~before | border))
    end = np.flatnonzero(before & (~inside | border))
    return start, end, np.searchsorted(start, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, at each start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = 1
    for k in range(n):
        out += words[k : k + m] * np.uint64(factor)
        factor = factor * 0x2545F4914F6CDD1D & MASK64
    return mix64(out)
