"""Sense counts over a stream of texts: the batch operators on a streaming source with a static lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import lexicon as lx
from ..operators.common import small

#: Words that may stand in a plan as literals.
LITERAL_WORDS = 10_000


def matched_stream(texts: DataFrame, lexicon: DataFrame, text: str = "value", mode: str = "regex") -> DataFrame:
    """Texts of the stream that hold a lexicon word.  Stateless: the words are a literal array; a lexicon of more than
    LITERAL_WORDS fails here."""
    words = [r[0] for r in lx.word_senses(lexicon).select("word").distinct().limit(LITERAL_WORDS + 1).collect()]
    if len(words) > LITERAL_WORDS:
        raise ValueError(f"the lexicon has more than {LITERAL_WORDS} words")
    return texts.where(F.arrays_overlap(tokenize(F.col(text), mode), F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")))


def sense_counts(texts: DataFrame, lexicon: DataFrame, text: str = "value", mode: str = "regex") -> DataFrame:
    """sense_id, n_occ so far; for output modes update and complete."""
    words = texts.select(F.explode(tokenize(F.col(text), mode)).alias("word"))
    return words.join(small(lx.word_senses(lexicon)), "word").groupBy("sense_id").agg(F.count(F.lit(1)).alias("n_occ"))


def windowed_sense_counts(texts: DataFrame, lexicon: DataFrame, time: str, delay: str = "10 minutes", width: str = "5 minutes", text: str = "value", mode: str = "regex") -> DataFrame:
    """window start, sense_id, n_occ per event-time window; windows close `delay` after their end, later rows are dropped."""
    words = texts.withWatermark(time, delay).select(time, F.explode(tokenize(F.col(text), mode)).alias("word"))
    counted = words.join(small(lx.word_senses(lexicon)), "word").groupBy(F.window(time, width).alias("w"), "sense_id").agg(F.count(F.lit(1)).alias("n_occ"))
    return counted.select(F.col("w.start").alias("start"), "sense_id", "n_occ")
