"""Document fingerprints: a quartile bucket digest of a text's byte triplets, and a bounded difference of two digests.

Each triplet of neighbouring UTF-8 bytes is hashed to one of 256 buckets.  A bucket's code (0 to 3) is the number of the
quartiles of all buckets' counts that its count exceeds.  A digest is the hex of a length code, of eight steps an octave,
and of the codes, four in a byte.  All arithmetic is on integers, so equal texts have equal digests everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, free_name, partitions_for, string_buffers, text_or_empty

BUCKETS = 256
MULTIPLIER = np.uint32(0x9E3779B1)
#: The share of the length in the difference, and the steps of the length code from which lengths count as wholly different.
LENGTH_SHARE, LENGTH_STEPS = 0.25, 16
#: Ranges of ids for each reduce task.
RANGES = 4


# ---------------------------------------------------------------------------------------------- the digest

def triplet_counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for first in range(0, len(data) - 2, CHUNK_BYTES):
        b = data[first : first + CHUNK_BYTES + 2].astype(np.uint32)
        value = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        counts += np.bincount((value * MULTIPLIER) >> np.uint32(24), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """n below 8, else eight steps for each doubling, at most 255."""
    return n if n < 8 else min(255, 8 * (n.bit_length() - 3) + (n >> (n.bit_length() - 4)) - 8)


def digest(data: np.ndarray) -> str:
    counts = triplet_counts(data)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).reshape(-1, 4)
    return f"{length_code(len(data)):02x}" + (codes << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8).tobytes().hex()


def codes_of(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length codes, and the bucket codes by row."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    return raw[:, 0].astype(np.int64), ((raw[:, 1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(digests), BUCKETS).astype(np.int64)


def likenesses(left: list[str], right: list[str]) -> np.ndarray:
    (n, a), (m, b) = codes_of(left), codes_of(right)
    apart, most = np.abs(a - b).sum(axis=1), np.maximum(a, b).sum(axis=1)
    length = np.minimum(np.abs(n - m), LENGTH_STEPS) / LENGTH_STEPS
    return 1.0 - ((1 - LENGTH_SHARE) * (apart / np.maximum(most, 1)) + LENGTH_SHARE * length)


def fingerprint(text: Column) -> Column:
    """The digest of a text; null counts as empty."""

    @F.arrow_udf("string")
    def digests(texts: pa.Array) -> pa.Array:
        raw, offsets, _ = string_buffers(texts)
        return pa.array([digest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())

    return digests(F.coalesce(text, F.lit("")))


def likeness(left: Column, right: Column) -> Column:
    """1 less the difference of two digests, from 0 to 1: the codes' distance over the most that it could be, and the
    lengths' distance by LENGTH_SHARE.  Null where a digest is null."""

    @F.arrow_udf("double")
    def scores(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = a.to_pylist(), b.to_pylist()
        out, rows = [None] * len(a), [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            for k, x in zip(part, likenesses([a[k] for k in part], [b[k] for k in part]).tolist()):
                out[k] = x
        return pa.array(out, pa.float64())

    return scores(left, right)


# ---------------------------------------------------------------------------------------------- the next document

def with_next(docs: DataFrame, columns: dict[str, str], id_column: str = "doc_id", tie_column: str = "text") -> DataFrame:
    """docs with columns of the next row, by descending id; after the last comes the first.  columns: new names by column.

    Equal ids are ordered by tie_column, null ids come last.  Rows go once to ranges of ids of equal size, whose bounds and
    first ids alone (RANGES a task) meet in the driver; the first row of a range visits the range before it too, so that no
    range needs another.
    """
    order, place, kept = free_name(docs, "order"), free_name(docs, "place"), docs.columns
    docs = docs.withColumn(order, F.coalesce(F.bitwise_not(F.col(f"`{id_column}`").cast("long")), F.lit((1 << 63) - 1)))
    n = RANGES * partitions_for(docs)
    bounds = np.unique(np.array(docs.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 100 * n)).first()[0] or [], np.int64))

    @F.arrow_udf("long")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False)).astype(np.int64))

    firsts = docs.select(order).groupBy(range_of(F.col(order)).alias("range")).agg(F.min(order).alias("first")).orderBy("range").collect()
    visited = {r["first"]: firsts[k - 1]["range"] for k, r in enumerate(firsts)}

    @F.arrow_udf("array<long>")
    def places(keys: pa.Array) -> pa.Array:
        keys = keys.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, keys).tolist()
        return pa.array([[2 * r, 2 * visited[k] + 1] if k in visited else [2 * r] for k, r in zip(keys.tolist(), own)], pa.list_(pa.int64()))

    rows = docs.withColumn(place, F.explode(places(F.col(order))))
    window = Window.partitionBy(F.floor(F.col(place) / 2)).orderBy(F.col(place) % 2, order, f"`{tie_column}`")
    rows = rows.withColumns({name: F.lead(f"`{c}`").over(window) for c, name in columns.items()})
    return rows.where(F.col(place) % 2 == 0).select(*(f"`{c}`" for c in kept), *columns.values())


def edited(text: Column, following: Column) -> Column:
    """text with its last third, by code points, replaced by the first as many (or all) of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to each other and to the next document's.

    A null text counts as empty; other columns are ignored; equal doc_ids are ordered by text; an only document is its
    own next; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), {"text": "next_text", "fingerprint": "next_fingerprint"})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = lambda c: F.round(likeness(F.col("fingerprint"), F.col(c)), 6)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
