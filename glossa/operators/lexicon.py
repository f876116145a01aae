"""A lexicon of coded word groups, one normalized table, and the views that the stages need of it.

A line is a code and words; the code's last character is its tag: `=` synonyms, `#` related words, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words


def parse(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """line_no, code, tag, sense_id, n_parts, ord, word: a row for each word, and one with null ord for a lone code."""
    parts = split_words(F.col(value))
    coded = lines.select(F.col(line_no).alias("line_no"), parts.alias("parts")).where(F.size("parts") > 0)
    code = F.get("parts", F.lit(0))
    rows = coded.select("line_no", code.alias("code"), F.size("parts").alias("n_parts"), F.posexplode_outer(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1)))).alias("ord", "word"))
    return rows.select("line_no", "code", F.expr("right(code, 1)").alias("tag"), F.expr("left(code, length(code) - 1)").alias("sense_id"), "n_parts", "ord", "word")


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """The table of a lexicon that is given as one string."""
    lines = list(enumerate(text.splitlines()))
    return parse(spark.createDataFrame(lines, "line_no int, value string"))


def _tagged(lexicon: DataFrame, *tags: str) -> DataFrame:
    return lexicon.where(F.col("tag").isin(*tags))


def senses(lexicon: DataFrame) -> DataFrame:
    """line_no, sense_id of each `=` or `#` line, repeats and lone codes included."""
    return _tagged(lexicon, "=", "#").select("line_no", "sense_id").distinct()


def word_senses(lexicon: DataFrame) -> DataFrame:
    """word, sense_id, duplicates kept: an occurrence counts once per row."""
    return _tagged(lexicon, "=", "#").where("word is not null").select("word", "sense_id")


def unique_senses(lexicon: DataFrame) -> DataFrame:
    """word, senses: its sorted distinct sense ids."""
    return word_senses(lexicon).groupBy("word").agg(F.array_sort(F.collect_set("sense_id")).alias("senses"))


def pairs(lexicon: DataFrame, tag: str) -> DataFrame:
    """word, cand: distinct other words of the word's groups with this tag."""
    rows = _tagged(lexicon, tag).where("n_parts >= 2").select("line_no", "word").distinct()
    other = rows.select("line_no", F.col("word").alias("cand"))
    return rows.join(other, "line_no").where("word <> cand").select("word", "cand").distinct()


def keys(lexicon: DataFrame, tag: str) -> DataFrame:
    """Words that have an entry under this tag, those of one-word groups too."""
    return _tagged(lexicon, tag).where("n_parts >= 2").select("word").distinct()


def vocabulary(lexicon: DataFrame) -> DataFrame:
    return keys(lexicon, "=").union(keys(lexicon, "#")).distinct()


def both_tag_words(lexicon: DataFrame) -> DataFrame:
    """Words with synonyms as well as related words."""
    return pairs(lexicon, "=").select("word").intersect(pairs(lexicon, "#").select("word"))


def raw_members(lexicon: DataFrame) -> DataFrame:
    """group_id, ord, word of `=` lines, repeats kept; of repeated codes the last line counts."""
    rows = _tagged(lexicon, "=").where("n_parts >= 2")
    last = rows.groupBy("code").agg(F.max("line_no").alias("line_no"))
    return rows.join(last, ["code", "line_no"]).select(F.col("code").alias("group_id"), "ord", "word")


def _group_lines(lexicon: DataFrame) -> DataFrame:
    """line_no, group_id, word, ord of `=` lines with at least two different words."""
    rows = _tagged(lexicon, "=").where("n_parts >= 2").groupBy("line_no", "code", "word").agg(F.min("ord").alias("ord"))
    wide = rows.groupBy("line_no").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("line_no")
    return rows.join(wide, "line_no").select("line_no", F.col("code").alias("group_id"), "word", "ord")


def groups(lexicon: DataFrame) -> DataFrame:
    """group_id, ord, word of the groups with at least two different words; of repeated codes the last line counts."""
    rows = _group_lines(lexicon)
    last = rows.groupBy("group_id").agg(F.max("line_no").alias("line_no"))
    return rows.join(last, ["group_id", "line_no"]).select("group_id", "ord", "word")


def mono_words(lexicon: DataFrame) -> DataFrame:
    """group_id, word: members that stand in one group line only (a repeated code counts twice)."""
    single = _group_lines(lexicon).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("word")
    return groups(lexicon).join(single, "word").select("group_id", "word")
