"""A positional inverted index: posting lists with gaps instead of numbers, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Document numbers that one block covers, and so the most documents of one posting list.
BLOCK = 1024


def _gaps(values: Column) -> Column:
    """The first value and the differences that follow."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def _sums(gaps: Column, kind: str) -> Column:
    zero = F.array().cast(f"array<{kind}>")
    return F.aggregate(gaps, zero, lambda s, x: F.concat(s, F.array((F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x).cast(kind))))


def partial_lists(tokens: DataFrame, key: str, block: int) -> DataFrame:
    """word, block, p: what each Arrow batch has of a posting list, documents and their positions in order."""
    place = pa.list_(pa.struct([("doc", pa.int64()), ("at", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            code = np.asarray(pc.fill_null(words.indices, -1)).astype(np.int64)
            doc = np.repeat(np.asarray(batch.column("doc")), n)
            pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            order = np.lexsort((pos, doc, code))
            order = order[code[order] >= 0]
            code, doc, pos = code[order], doc[order], pos[order]
            if not len(code):
                continue
            part = np.floor_divide(doc, block)
            new_list = np.r_[True, (np.diff(code) != 0) | (np.diff(part) != 0)]
            new_doc = new_list | np.r_[True, np.diff(doc) != 0]
            docs, lists = np.flatnonzero(new_doc), np.flatnonzero(new_list)
            at = pa.ListArray.from_arrays(pa.array(np.r_[docs, len(pos)].astype(np.int32)), pa.array(pos))
            both = pa.StructArray.from_arrays([pa.array(doc[docs]), at], fields=list(place.value_type))
            ends = np.r_[np.searchsorted(docs, lists), len(docs)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[lists])), pa.array(part[lists]), pa.ListArray.from_arrays(pa.array(ends), both)], ["word", "block", "p"])

    return tokens.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), "tokens").mapInArrow(run, "word string, block long, p array<struct<doc:bigint,at:array<int>>>")


def build(tokens: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """word, block, n_docs, n, last, docs, counts, places of tokens(key, tokens); key: an integer.

    A posting list covers the numbers of its block alone, so the list of a word that is in every document is as long as
    any other's block, and none is gathered whole.  docs are gaps of numbers, counts how often the word is in each, and
    places the gaps of its positions, anew from each document.  Rows with one number are one document whose positions
    follow each other's; null numbers and words are left out.  A task joins what its Arrow batch has of a list, so that
    a word is shuffled once for each block of a batch and not at each place.
    """
    parts = partial_lists(tokens, key, block)
    grouped = parts.groupBy("word", "block").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    numbers = F.array_distinct(F.transform("p", lambda x: x["doc"]))
    merged = F.transform(numbers, lambda d: F.struct(d.alias("doc"), F.array_sort(F.flatten(F.transform(F.filter("p", lambda x: x["doc"] == d), lambda x: x["at"]))).alias("at")))
    grouped = grouped.withColumn("p", F.when(F.size(numbers) < F.size("p"), merged).otherwise(F.col("p")))  # a number in several batches
    docs = F.transform("p", lambda x: x["doc"])
    return grouped.select(
        "word", "block", F.size("p").cast("long").alias("n_docs"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.size(x["at"])).alias("n"), F.get(docs, F.size(docs) - 1).alias("last"),
        _gaps(docs).alias("docs"), F.transform("p", lambda x: F.size(x["at"])).alias("counts"), F.flatten(F.transform("p", lambda x: _gaps(x["at"]))).alias("places"),
    )


def occurrences(index: DataFrame) -> DataFrame:
    """word, doc, pos: the index as rows again."""
    starts = F.aggregate("counts", F.array(F.lit(1)), lambda s, x: F.concat(s, F.array(F.get(s, F.size(s) - 1) + x)))
    rows = index.withColumns({"docs": _sums(F.col("docs"), "bigint"), "_from": starts})
    lists = rows.select("word", F.explode(F.transform("docs", lambda d, i: F.struct(d.alias("doc"), F.slice("places", F.get("_from", i), F.get("counts", i)).alias("gaps")))).alias("p"))
    return lists.select("word", F.col("p.doc").alias("doc"), F.explode(_sums(F.col("p.gaps"), "int")).alias("pos"))


def phrases(index: DataFrame, phrases: DataFrame, key: str = "phrase") -> DataFrame:
    """key, doc, start: where the words of phrases(key, slot, word) follow each other; slots count from 0.

    Only lists of the phrases' words are read.  A phrase's candidates are the places of its rarest word, however frequent
    the others are, and each other slot is confirmed by an equi-join on word, document and position.
    """
    words = small(phrases.select("word").distinct())
    lists = index.join(words, "word", "left_semi")
    rows = occurrences(lists)
    sizes = phrases.join(lists.groupBy("word").agg(F.sum("n").alias("n")), "word", "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("slots"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "slot", "word")).alias("rare"))
    rare = sizes.select(key, "slots", F.col("rare.slot").alias("slot"), F.col("rare.word").alias("word"))
    found = rows.join(small(rare), "word").select(key, "slots", "doc", (F.col("pos") - F.col("slot")).alias("start"))
    wanted = found.join(small(phrases.select(key, "slot", "word")), key).select(key, "slots", "doc", "start", "word", (F.col("start") + F.col("slot")).alias("pos"))
    hits = wanted.join(rows, ["word", "doc", "pos"]).groupBy(key, "slots", "doc", "start").agg(F.count(F.lit(1)).alias("hits"))
    return hits.where("hits = slots").select(key, "doc", F.col("start").cast("long").alias("start"))
