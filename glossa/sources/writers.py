"""Sinks.  Each overwrites its target, so nothing of an earlier run is left, but where it says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_name, file_name
from . import files


def chunks_as_text(chunks: DataFrame, path: str, order: list[str], doc_id: str = "id", title: str = "title", chunk: str = "chunk") -> None:
    """A file <id or title>.txt for each document, with a chunk a line, in order.  Equal names share a file."""
    rows = chunks.select(F.concat(document_name(F.col(doc_id), F.col(title)), F.lit(".txt")).alias("file"), F.regexp_replace(chunk, r"[\r\n]+", " ").alias("value"), *order)
    files.write(rows, path, order)


def pairs_as_text(pairs: DataFrame, path: str) -> None:
    """A file <config>_<row_no>.txt of two lines for each pair."""
    name = F.concat(file_name(F.col("config")), F.lit("_"), F.col("row_no").cast("string"), F.lit(".txt"))
    rows = pairs.select(name.alias("file"), F.posexplode(F.array(F.coalesce("sentence1", F.lit("")), F.coalesce("sentence2", F.lit("")))).alias("side", "value"))
    files.write(rows, path, ["side"])


def matches_as_text(lines: DataFrame, every: DataFrame, root: str, path: str) -> None:
    """The matched lines(file, line_no, line) of each source file under its name relative to root; a file of every(file)
    without a match is taken away, and files of other runs stay."""
    name = lambda c: F.regexp_replace(c, "^" + re.escape(root.rstrip("/")) + "/", "")
    rows = lines.select(name("file").alias("file"), F.col("line").alias("value"), F.col("line_no").cast("long").alias("line_no"))
    none = every.select("file").distinct().join(lines.select("file").distinct(), "file", "left_anti").select(name("file").alias("file"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("line_no"))
    files.write(rows.unionByName(none), path, ["line_no"], overwrite=False)


def tokens_as_json(sentences: DataFrame, path: str, order: list[str], tokens: str = "tokens") -> None:
    """The token lists of each source file (column file) as one JSON array in <name>.json, a list a line; a file without
    rows leaves none."""
    named = sentences.select(F.concat(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1), F.lit(".json")).alias("file"), F.to_json(tokens).alias("body"), *order)
    ends = named.groupBy("file").agg(F.max(F.struct(*order)).alias("_last"), F.min(F.struct(*order)).alias("_first"))
    marked = named.join(ends, "file").withColumn("_here", F.struct(*order))
    opening, closing = (F.when(F.col("_here") == F.col(c), F.lit(x)).otherwise(F.lit(y)) for c, x, y in (("_first", "[", ""), ("_last", "]", ",")))
    files.write(marked.select("file", F.concat(opening, "body", closing).alias("value"), *order), path, order)


def entries_as_json(entries: DataFrame, path: str) -> None:
    entries.select("tokens", "pos", "hard_neg").write.mode("overwrite").json(path)


def prototypes(tables: dict[str, DataFrame], path: str) -> None:
    """The tables prototypes, meta and params as Parquet."""
    for name in ("prototypes", "meta", "params"):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def assignments_as_json(groups: DataFrame, meta: DataFrame, path: str) -> None:
    """A JSON object a line for each group, and the run's meta beside it."""
    groups.write.mode("overwrite").json(f"{path}/groups")
    meta.write.mode("overwrite").json(f"{path}/meta")


def metrics(rows: DataFrame, path: str) -> None:
    """(epoch, name, value) rows, appended."""
    rows.select("epoch", "name", "value").write.mode("append").parquet(path)
