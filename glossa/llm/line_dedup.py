"""Line deduplication by a deletion-neighbourhood join.

A line is dropped if an earlier one (by document id, then line number) is within the edit bound: at most one inserted,
deleted or replaced unit, a character or a byte of UTF-8.  Lines are compared without the white space around them; blank
ones stay.  One byte between two lines is one character between them, but not the other way round: o for ü is two bytes.

Two lines are within one edit just if both are one string v with at most one unit put into it, at one gap.  So a line
emits a hashed key for each of its variants: v = the line itself, or the line less one unit, with the gap.
Lines with equal keys are within the bound, hence the earliest line of each key is a sum that merges, and no pairs are
made.  Most lines have no neighbour; emitting all their variants would be a row per character.  Two coarser rounds with
the same keys come first, in which the gaps of a line fall into 2 and then 16 blocks, and a key holds what stands before
and after the block.  Equal variants have equal coarse keys, so only lines that share one go on to the next round.
Lines that are to be dropped for a near one are verified by their Levenshtein distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded, cut, free_name, mix64, string_buffers, text_or_empty

ROUNDS = (2, 16)
#: Units of lines whose variants are emitted in one step.
STEP_CHARS = 1 << 17
UNITS = ("character", "byte")


def lines_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc, xx (of the row's text), line_no, line, h1, h2: the lines that are not blank."""
    text, doc = text_or_empty(text_column), F.col(id_column).cast("long")
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("xx"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.expr(r"trim(BOTH ' \t\r\f\u000B' FROM line)")).where("line <> ''")
    return rows.select("doc", "xx", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def place():
    """doc and line_no as one number, which sums without sorting; a null id comes last."""
    doc = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (doc * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(33,0)")


def variant_keys(lines: DataFrame, blocks: int, single: bool = False, unit: str = UNITS[0]) -> DataFrame:
    """h1, h2, key and part of the variants of each line, its gaps in so many blocks; part is the block, negative (from -1
    down) for the line less a unit.

    single: a key for each gap instead, in the blocks that the column parts lists.
    """

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            text = batch.column("line")
            raw, _, _ = string_buffers(text)
            if unit == "byte":
                sizes, units = np.asarray(pc.binary_length(text)).astype(np.int64), raw
            else:
                sizes = np.asarray(pc.utf8_length(text)).astype(np.int64)
                units = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            points = mix64(units.astype(np.uint64) + np.uint64(11))
            begin = np.cumsum(sizes) - sizes
            if single:
                listed = np.asarray(batch.column("parts").flatten())
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("parts").value_lengths()))
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(begin, begin[i] + STEP_CHARS)))
                base, n = begin[i], sizes[i:j]
                prefix = rolling.prefix(points[base : base + n.sum()])
                at = begin[i:j] - base
                for sign, m in ((0, n), (1, n - 1)):
                    count = np.minimum(blocks, m + 1)
                    row = np.repeat(np.arange(j - i), count)
                    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    if single:  # the listed blocks only
                        row, k = owner[(owner >= i) & (owner < j) & (listed < 0 if sign else listed >= 0)] - i, listed[(owner >= i) & (owner < j) & (listed < 0 if sign else listed >= 0)]
                        k = -k - 1 if sign else k
                    gaps, parts = m[row] + 1, count[row]
                    lo, hi = -(-k * gaps // parts), -(-(k + 1) * gaps // parts) - 1
                    if single:
                        many = hi - lo + 1
                        lo = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        row, hi, k = np.repeat(row, many), lo, lo
                    start, end = at[row], at[row] + n[row]
                    head = rolling.of(prefix, start, start + lo)
                    tail = rolling.of(prefix, end - (m[row] - hi), end)
                    key = mix64(mix64(head + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + tail * np.uint64(0xD6E8FEB86659FD93) + m[row].astype(np.uint64))
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([batch.column("h1").take(take), batch.column("h2").take(take), pa.array(key.view(np.int64)), pa.array((-k - 1 if sign else k).astype(np.int32))], ["h1", "h2", "key", "part"])
                i = j

    return lines.select("h1", "h2", "line", *(["parts"] if single else [])).mapInArrow(bounded(run), "h1 long, h2 long, key long, part int")


def neighbours(lines: DataFrame, blocks: int, unit: str = UNITS[0]) -> DataFrame:
    """h1, h2, parts: lines that share a coarse key with a different line, and the blocks of these keys."""
    keys = variant_keys(lines, blocks, unit=unit)
    shared = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    return keys.join(shared, "key").groupBy("h1", "h2").agg(F.collect_set("part").alias("parts"))


def decisions(docs: DataFrame, id_column: str, text_column: str, unit: str = UNITS[0]) -> tuple[DataFrame, DataFrame]:
    """All lines, without their text, and best(h1, h2, best): the earliest place of an equal or near line, where there is
    an earlier one for some line."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}; there are {UNITS}")
    lines = lines_of(docs, id_column, text_column)
    exact = cut(lines.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")))
    single = lines.select("h1", "h2", "line")
    near = single.join(neighbours(single, ROUNDS[0], unit).select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    for blocks in ROUNDS[1:]:
        near = cut(near)
        near = near.select("h1", "h2", "line").join(neighbours(near, blocks, unit), ["h1", "h2"])
    near = cut(near.join(exact.select("h1", "h2", "first"), ["h1", "h2"]))
    keyed = variant_keys(near, ROUNDS[-1], single=True, unit=unit).join(near.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "key", "first")
    # Equal variants: the earliest line of a key decides, and it is never dropped for itself.
    earliest = keyed.groupBy("key").agg(F.min("first").alias("near"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "near")
    found = keyed.join(earliest, "key").where(F.col("near") < F.col("first")).groupBy("h1", "h2").agg(F.min("near").alias("near"))
    # A place has one line but for rows that repeat an id; one of its lines within the bound is enough.
    text = near.select("h1", "h2", "line")
    other = near.select(F.col("first").alias("near"), F.col("line").alias("other"))
    units = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1") if unit == "byte" else F.col(c)
    found = found.join(text, ["h1", "h2"]).join(other, "near").where(F.levenshtein(units("line"), units("other"), 1) >= 0).select("h1", "h2", "near").distinct()
    best = exact.join(found, ["h1", "h2"], "left").where("n > 1 or near is not null")
    return lines.drop("line"), best.select("h1", "h2", F.least("first", F.coalesce("near", "first")).alias("best"))


def dropped_lines(docs: DataFrame, id_column: str, text_column: str, unit: str = UNITS[0]) -> DataFrame:
    """doc, xx, dropped (sorted line numbers from 0) of the rows that lose lines."""
    lines, best = decisions(docs, id_column, text_column, unit)
    gone = lines.join(best, ["h1", "h2"]).where(F.col("best") < place())
    return gone.groupBy("doc", "xx").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = UNITS[0]) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (line numbers from 0); unit: what one edit changes.

    Null and empty texts have one blank line, which stays.  Rows that repeat an id have equal places, so they never drop
    each other's line of one number.  A null id comes after all ids.  Empty tables give no rows; extra columns are
    ignored; lines of any length are whole.
    """
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("xx"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    gone = dropped_lines(docs, id_column, text_column, unit)
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["xx"] == gone["xx"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = UNITS[0]) -> DataFrame:
    """docs with the dropped lines gone from text; all other columns as they are.  Cases as in report()."""
    doc, xx, dropped = (free_name(docs, c) for c in ("doc", "xx", "dropped"))
    gone = dropped_lines(docs, id_column, text_column, unit).select(F.col("doc").alias(doc), F.col("xx").alias(xx), F.col("dropped").alias(dropped))
    on = F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_or_empty(f"`{text_column}`")) == F.col(xx))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_column}`"), "\n"), lambda x, k: ~F.array_contains(dropped, k)), "\n")
    joined = docs.join(gone, on, "left")
    return joined.select(*[F.when(F.col(dropped).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
