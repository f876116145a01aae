"""Corpus matching: which texts hold lexicon words, and how often each sense occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokenize
from . import automaton
from . import lexicon as lx
from .common import small


def tokens_of(texts: DataFrame, keys: list[str], text: str = "text", mode: str = "regex") -> DataFrame:
    """keys, tokens; texts without a character that is not white space, in Unicode's sense, are left out."""
    return texts.select(*keys, tokenize(F.col(text), mode).alias("tokens")).where(F.length(strip(F.coalesce(F.col(text), F.lit("")))) > 0)


def token_counts(tokens: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """word, n: partial sums before the shuffle, of the vocabulary's words only."""
    words = tokens.select(F.explode("tokens").alias("word"))
    if vocabulary is not None:
        words = words.join(small(vocabulary.select("word").distinct()), "word", "left_semi")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sense_counts(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """sense_id, n_occ: an occurrence counts once per lexicon row of its word.

    Words are counted first, so the join sees each word once and not each occurrence.
    """
    counts = token_counts(tokens, lx.word_senses(lexicon))
    rows = lx.word_senses(lexicon)
    return counts.join(small(rows), "word").groupBy("sense_id").agg(F.sum("n").alias("n_occ"))


def matched(tokens: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tokens with at least one lexicon word: a semi join on exploded distinct tokens."""
    words = small(lx.word_senses(lexicon).select("word").distinct())
    hit = tokens.select(*keys, F.explode(F.array_distinct("tokens")).alias("word")).join(words, "word", "left_semi").select(*keys).distinct()
    return tokens.join(hit, keys, "left_semi")


def n_matches(tokens: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_tokens, n_match: lexicon rows met by each row that has any."""
    words = small(lx.word_senses(lexicon))
    rows = tokens.select(*keys, F.size("tokens").cast("long").alias("n_tokens"), F.explode("tokens").alias("word")).join(words, "word")
    return rows.groupBy(*keys, "n_tokens").agg(F.count(F.lit(1)).alias("n_match"))


def match_summary(tokens: DataFrame, lexicon: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, total, kept: rows, and rows with a match."""
    hit = matched(tokens, lexicon, keys).select(*keys, F.lit(1).alias("hit"))
    return tokens.select(*keys, by).join(hit, keys, "left").groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("kept"))


def rare_senses(counts: DataFrame, lexicon: DataFrame, ratio: float = 0.5) -> DataFrame:
    """sense_id, n_occ of the rarest senses, unseen ones at 0: max(1, int(lines * ratio)) rows by (n_occ, sense_id).

    Lines count with repeats, as each is a sense of its own in the lexicon's order.
    """
    every = lx.senses(lexicon)
    k = max(1, int(every.count() * ratio))
    filled = every.select("sense_id").join(counts, "sense_id", "left").select("sense_id", F.coalesce("n_occ", F.lit(0)).alias("n_occ"))
    return filled.orderBy("n_occ", "sense_id").limit(k)


def substring_matches(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", lower: bool = True) -> DataFrame:
    """keys, words: lexicon words in reading order as substrings, the longest at each place, none overlapping."""
    return automaton.matches(texts, lx.word_senses(lexicon), keys, F.lower(text) if lower else F.col(text))
