"""Many words sought at once in texts: the longest at each place from the left, none overlapping, in time linear in the text.

The words go to the tasks as an Aho-Corasick automaton; a lexicon over the bound is dealt into shards by hash, each of
which passes over the texts, and a text's matches of all shards meet before the choice.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved


def build(words: Iterable[str]):
    """The automaton of words, each stored with its length."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in words:
        machine.add_word(word, len(word))
    machine.make_automaton()
    return machine


def longest(machine, text: str) -> dict[int, int]:
    """Start and end of the longest word at each place where one begins."""
    best: dict[int, int] = {}
    if len(machine):
        for end, size in machine.iter(text):
            start = end + 1 - size
            if best.get(start, 0) <= end:
                best[start] = end + 1
    return best


def chosen(best: dict[int, int]) -> list[tuple[int, int]]:
    """From the left, the spans that do not overlap one taken before."""
    out, free = [], 0
    for start in sorted(best):
        if start >= free:
            free = best[start]
            out.append((start, free))
    return out


def _spans(shared):
    """The function of a text column that gives the longest span at each place, by one shard's words."""
    made = {}

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(column: pa.Array) -> pa.Array:
        if not made:
            made["of"] = build(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in longest(made["of"], t).items()] if t else [] for t in column.to_pylist()], kind)

    return find


def matches(texts: DataFrame, words: DataFrame, keys: list[str], text: str | Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys, words: the matches in each text, in reading order; texts without any, and null ones, are left out.

    words: word (null and empty ones are ignored).  At most `limit` words are in the driver and in a task at a time.
    """
    listed = words.select("word").where("word is not null and word <> ''").distinct()
    count, sc = listed.count(), texts.sparkSession.sparkContext
    shards = -(-count // limit)
    if shards <= 1:
        shared, made = sc.broadcast([r[0] for r in listed.collect()]), {}

        @F.arrow_udf("array<string>")
        def find(column: pa.Array) -> pa.Array:
            if not made:
                made["of"] = build(shared.value)
            return pa.array([[t[a:b] for a, b in chosen(longest(made["of"], t))] if t else [] for t in column.to_pylist()], pa.list_(pa.string()))

        return texts.select(*keys, find(F.col(text) if isinstance(text, str) else text).alias("words")).where(F.size("words") > 0)

    rows = saved(texts.select(*keys, (F.col(text) if isinstance(text, str) else text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))
    parts = None
    for k in range(2 * shards):  # twice as many as would hold if the hash dealt evenly
        part = listed.where(F.pmod(F.xxhash64("word"), F.lit(2 * shards)) == k).limit(limit + 1).collect()
        if len(part) > limit:
            raise ValueError("a shard has more words than the bound")
        if not part:
            continue
        find = _spans(sc.broadcast([r[0] for r in part]))
        found = rows.select("_row", find(F.col("_text")).alias("spans")).where(F.size("spans") > 0)
        parts = found if parts is None else parts.unionByName(found)

    @F.arrow_udf("array<string>")
    def choose(column: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(column.to_pylist(), spans.to_pylist()):
            best: dict[int, int] = {}
            for s in found:
                best[s["start"]] = max(best.get(s["start"], 0), s["end"])
            out.append([t[a:b] for a, b in chosen(best)])
        return pa.array(out, pa.list_(pa.string()))

    merged = parts.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kept = [c for c in rows.columns if c not in ("_row", "_text")]
    return rows.join(merged, "_row").select(*kept, choose(F.col("_text"), F.col("spans")).alias("words"))


def convert(texts: DataFrame, table: DataFrame, keys: list[str], text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys, text, n_converted: each text with the phrases of table(phrase, replacement) replaced, the longest at each place
    from the left, none overlapping; what is put in is not sought again.

    Of a phrase with several replacements the least counts; null or empty phrases are ignored, and a null text stays null.
    The table goes to the tasks; one of more than `limit` phrases fails here.
    """
    rows = table.where("phrase is not null and phrase <> ''").groupBy("phrase").agg(F.min(F.coalesce("replacement", F.lit(""))).alias("replacement")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the table has more than {limit} phrases")
    shared, made = texts.sparkSession.sparkContext.broadcast({r["phrase"]: r["replacement"] for r in rows}), {}

    @F.arrow_udf("struct<text:string,n:bigint>")
    def replaced(column: pa.Array) -> pa.Array:
        if not made:
            made["of"] = build(shared.value)
        out = []
        for t in column.to_pylist():
            spans = chosen(longest(made["of"], t)) if t else []
            ends = [0, *(b for _, b in spans)]
            parts = [t[e:a] + shared.value[t[a:b]] for e, (a, b) in zip(ends, spans)] if spans else []
            out.append({"text": "".join(parts) + t[ends[-1] :] if t else t, "n": len(spans)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64())]))

    return texts.select(*keys, replaced(F.col(text)).alias("_r")).select(*[k for k in keys], F.col("_r.text").alias("text"), F.col("_r.n").alias("n_converted"))
