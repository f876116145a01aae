"""Sources: text, lexicons, token corpora, training entries, prototypes and document tables, read by Spark from any path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.common import hash_limit, small
from ..operators.sampling import limit_or_all

ROWS = "array<array<string>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """id, url, title, text of a Parquet dataset of articles; missing columns are null."""
    df = spark.read.parquet(path)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("id", "url", "title", "text")])


def numbered(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Parquet rows with row_no, from 0 by file name and the row's place in its file (within `by`).

    Only the files' row counts are summed up in order, so no row is sorted, and the numbers do not depend on partitions.
    """
    by = list(by)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = placed.groupBy(*by, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(small(starts), [*by, "_file"]).select(*rows.columns, (F.col("_start") + F.col("_at")).alias("row_no"))


def sentence_pairs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """config, row_no, sentence1, sentence2: the union of subsets, each a Parquet path by its name.

    row_no is the row's number in its subset, from 0.
    """
    parts = [numbered(spark.read.parquet(p)).select(F.lit(k).alias("config"), "row_no", *[F.col(c).cast("string").alias(c) for c in ("sentence1", "sentence2")]) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def text_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, line: the lines of all *.txt files that are not blank, stripped."""
    reader = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("line"))
    return lines.where("line <> ''")


def sample_lines(spark: SparkSession, path: str, limit: int = 0, seed: int = 42) -> DataFrame:
    """Lines of a tree of files; a limit takes that many in hash order, 0 takes all."""
    lines = text_lines(spark, path, recursive=True)
    return limit_or_all(lines, ["file", "line"], limit, seed)


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a lexicon file (read whole: it is one bounded file, and its line numbers matter)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "value"))


def _whole_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def token_sentences(spark: SparkSession, path: str, least: int = 3, limit: int | None = None, strict: bool = False, seed: int = 42) -> DataFrame:
    """file, row_no, tokens of token corpora in JSON: lists of tokens, or objects (one or a list) with `tokens`.

    Files that do not parse are skipped, and so are rows with fewer than `least` tokens.  strict raises if nothing is left.
    """
    files = _whole_files(spark, path)
    objects = F.coalesce(F.from_json("value", "array<struct<tokens:array<string>>>"), F.array(F.from_json("value", "struct<tokens:array<string>>")))
    rows = F.coalesce(F.from_json("value", ROWS), F.transform(objects, lambda x: x["tokens"]))
    out = files.select("file", F.posexplode(rows).alias("row_no", "tokens")).where((F.size("tokens") >= least) & F.col("tokens").isNotNull())
    if limit is not None:
        out = hash_limit(out, seed, ["file", "row_no"], limit)
    if strict and out.isEmpty():
        raise ValueError(f"no tokenized sentences under {path}")
    return out


def unparsable(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file: the JSON files that the readers of tokens and entries skip, for a warning or a report."""
    files = _whole_files(spark, path, recursive)
    parsed = F.coalesce(F.from_json("value", ROWS).isNotNull(), F.lit(False)) | F.from_json("value", "array<struct<tokens:array<string>>>").isNotNull() | F.from_json("value", "struct<tokens:array<string>>")["tokens"].isNotNull()
    return files.where(~parsed).select("file")


ENTRY = "array<struct<tokens:array<string>,pos:map<string,array<array<string>>>,hard_neg:map<string,array<array<string>>>>>"


def training_entries(spark: SparkSession, path: str, least: int = 3, most: int | None = None, recursive: bool = True) -> DataFrame:
    """file, row_no, tokens, pos, hard_neg of entry files; missing maps are empty."""
    rows = _whole_files(spark, path, recursive).select("file", F.posexplode(F.from_json("value", ENTRY)).alias("row_no", "e")).select("file", "row_no", "e.*")
    size = F.size("tokens")
    rows = rows.where((size >= least) if most is None else size.between(least, most))
    empty = F.create_map().cast("map<string,array<array<string>>>")
    return rows.select("file", "row_no", "tokens", *[F.coalesce(c, empty).alias(c) for c in ("pos", "hard_neg")])


def prototypes(spark: SparkSession, path: str) -> DataFrame:
    """group_id, vec: normalized again, whatever was written."""
    from ..functions.vectors import normalize

    return spark.read.parquet(f"{path}/prototypes").select("group_id", normalize(F.col("vec")).alias("vec"))
