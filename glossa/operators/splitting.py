"""Splitters and decoders that go through a sentence step by step."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONNECTORS, SOFT_PUNCTUATION, split_at_colon, split_sentences, token_length, tokenize


def chunk(tokens: list[str], limit: int = 60, target: str | None = None, window: int = 12, least: int = 6, connectors=frozenset(CONNECTORS), soft=frozenset(SOFT_PUNCTUATION)) -> list[str]:
    """Chunks of a token sequence that loses no text, greedily from the left.

    A cut goes before a connector or after soft punctuation (anywhere if the rest has neither), outside the protected
    window around the first target: the last one up to limit, else the first beyond, else at limit.  A chunk of fewer
    than `least` tokens (white space at its ends apart) is dropped unless it is the last.  Each cut is decided on the
    rest of the tokens, but the boundaries are found once.
    """
    n = len(tokens)
    if n <= limit:
        whole = "".join(tokens).strip()
        return [whole] if whole else []
    lo = hi = -1
    if target is not None and target in tokens:
        at = tokens.index(target)
        lo, hi = max(0, at - window), min(n - 1, at + window)
    free = lambda i, start: hi < start or lo >= n or not max(lo, start) <= i <= hi
    marks = [i for i in range(1, n) if tokens[i] in connectors or tokens[i - 1] in soft]
    out, start, first = [], 0, 0
    while n - start > limit:
        while first < len(marks) and marks[first] <= start:
            first += 1
        pool = map(marks.__getitem__, range(first, len(marks))) if first < len(marks) else range(start + 1, n)
        cut = None
        for i in pool:
            if not free(i, start):
                continue
            if i - start <= limit:
                cut = i
            else:
                cut = cut or i
                break
        cut = cut or start + limit
        a, b = start, cut
        while a < b and tokens[a].isspace():
            a += 1
        while a < b and tokens[b - 1].isspace():
            b -= 1
        if b > a and b - a >= least:
            out.append("".join(tokens[a:b]))
        start = cut
    tail = "".join(tokens[start:]).strip()
    return [*out, tail] if tail else out


def chunks(tokens: Column, **parameters) -> Column:
    """array<string> of chunk() for an array of tokens: each cut depends on the one before, so this is Arrow-batched Python."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else chunk(list(v), **parameters))

    return run(tokens)


def sentences(texts: DataFrame, keys: list[str], text: str = "text", ends: str | None = None, newline: bool = False, colon: str | None = None, colon_limit: int = 80, mode: str = "regex") -> DataFrame:
    """keys, sno, sentence: sentences of each text, long definitions split at their first colon if colon is given."""
    found = split_sentences(F.col(text), newline=newline, **({} if ends is None else {"ends": ends}))
    rows = texts.select(*keys, F.posexplode(found).alias("sno", "sentence"))
    if colon is None:
        return rows
    split = rows.select(*keys, "sno", F.posexplode(split_at_colon(F.col("sentence"), token_length(F.col("sentence"), mode), colon_limit, colon)).alias("part", "sentence"))
    return split.select(*keys, "sno", "part", "sentence")


def split_texts(texts: DataFrame, keys: list[str], text: str = "text", mode: str = "pieces", ends: str | None = None, newline: bool = False, **parameters) -> DataFrame:
    """keys, sno, part, chunk: sentences, then chunks of the long ones."""
    rows = sentences(texts, keys, text, ends, newline)
    return rows.select(*keys, "sno", F.posexplode(chunks(tokenize(F.col("sentence"), mode), **parameters)).alias("part", "chunk"))


def decode_labels(sentence: Column, labels: Column, offsets: Column) -> Column:
    """Words from begin/middle/end/single labels and character offsets (struct s, e), in time linear in the labels.

    S gives up the open word, then itself; B opens a word; M and I add to it; E adds and closes; any other label is an S.
    Offsets (0, 0) and empty pieces are skipped; a missing label is an S; an open word at the end counts.
    """
    pairs = F.zip_with(labels, offsets, lambda a, o: F.struct(F.coalesce(F.upper(F.substring(a, 1, 1)), F.lit("S")).alias("t"), o["s"].alias("s"), o["e"].alias("e")))
    real = F.filter(pairs, lambda p: p["s"].isNotNull() & ~((p["s"] == 0) & (p["e"] == 0)) & (p["e"] > p["s"]))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (value is computed once, not for each element)

    def words(chars, real):
        piece = lambda p: F.when(p["s"] >= 0, F.array_join(F.slice(chars, p["s"] + 1, p["e"] - p["s"]), "")).otherwise(F.substring(sentence, p["s"] + 1, p["e"] - p["s"]))
        first = lambda p, i: ~p["t"].isin("M", "I", "E") | ~F.coalesce(F.get(real, i - 1)["t"].isin("B", "M", "I"), F.lit(False))
        starts = F.filter(F.transform(real, lambda p, i: F.when(first(p, i), i)), lambda i: i.isNotNull())

        def word(part):
            closed = ~F.element_at(part, -1)["t"].isin("B", "M", "I")
            return F.struct(F.when(sentence.isNotNull(), F.array_join(F.transform(part, piece), "")).alias("w"), closed.alias("closed"))

        found = let(starts, lambda at: F.transform(at, lambda i, k: let(F.slice(real, i + 1, F.coalesce(F.get(at, k + 1), F.size(real)) - i), word)))
        return F.transform(F.filter(found, lambda x: x["closed"] | (x["w"] != "")), lambda x: x["w"])

    return let(F.struct(F.split(sentence, "").alias("chars"), real.alias("real")), lambda v: words(v["chars"], v["real"]))
