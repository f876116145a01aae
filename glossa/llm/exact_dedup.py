"""Exact deduplication by a tree merge of digest runs, with DataFrame functions only.

Rows are dealt into runs by doc_id.  Each run holds, for every digest, the smallest or largest identifier and the number
of rows; runs then meet in binomial rounds, `fan_in` at a time, until one is left.  A digest that a third of all rows
carry is one row per run after the first step, so no round sees a hot key.  The surviving identifiers come down the
same tree: a row joins its own run's entry, never the digest alone, so the join is spread as widely as the runs are.

Two texts count as equal when SHA-256, xxHash64 and the length in bytes all agree; every level groups by all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, text_or_empty

KEYS = ["sha", "xx", "size"]


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 1024) -> DataFrame:
    body = text_or_empty(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"),
        F.xxhash64(body).alias("xx"),
        F.octet_length(body).alias("size"),
        F.pmod(F.xxhash64(F.col(id_column)), F.lit(runs)).cast("int").alias("run"),
    )


def merge_runs(runs_table: DataFrame, runs: int, keep: str = "largest", fan_in: int = 32) -> DataFrame:
    """(run, digest, keep_id, group_size) -> one row per digest, over log(runs)/log(fan_in) rounds."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    while runs > 1:
        runs_table = runs_table.groupBy(F.shiftright("run", fan_in.bit_length() - 1).alias("run"), *KEYS).agg(
            pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        runs = -(-runs // fan_in)
    return runs_table


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", runs: int = 1024, fan_in: int = 32
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so all null and empty texts are one group.  Repeated rows (same id, same text) are members
    of their group like any others, and all of them are kept if their id is the one kept.  A null id is kept only where a
    group has no other id (keep_id is then null).  An empty table gives no rows; extra columns are ignored.
    """
    if fan_in & (fan_in - 1) or fan_in < 2:
        raise ValueError("fan_in must be a power of two")
    pick = {"largest": F.max, "smallest": F.min}[keep]
    rows = cut(digests(docs, id_column, text_column, runs))
    level = rows.groupBy("run", *KEYS).agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = merge_runs(level, runs, keep, fan_in).where("group_size > 1").select(*KEYS, "keep_id", "group_size")
    # Down the tree: each run's entries of repeated digests, then each row its own run's entry.
    down = level.select("run", *KEYS).join(merged, KEYS).withColumn("found", F.lit(True))
    out = rows.join(down, ["run", *KEYS], "left")
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs whose text is the kept one of its group, with the columns of docs.

    Of repeated rows with one id and one text a single one is kept, whatever their other columns hold (the least by all
    columns' hash).  Cases are those of exact_groups().
    """
    digest, order = free_name(docs, "row_digest"), free_name(docs, "row_order")
    body = text_or_empty(text_column)
    marked = docs.withColumn(digest, F.sha2(body.cast("binary"), 256)).withColumn(order, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    groups = exact_groups(docs, id_column, text_column, keep).where("kept")
    # Each digest keeps one id: the join is on both, so both sides have one row per key but for repeated rows.
    kept = groups.select(F.col("doc_id").alias("keep_doc_id"), F.col("text_sha256").alias("keep_sha")).distinct()
    joined = marked.join(kept, (marked[digest] == kept.keep_sha) & marked[id_column].eqNullSafe(kept.keep_doc_id), "left_semi")
    return joined.dropDuplicates([id_column, digest]).drop(digest, order) if docs.columns else joined
