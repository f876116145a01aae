"""Word segmentation by a dictionary with counts: the most probable path through the graph of dictionary words.

A text is cut into blocks of letters and digits; within a block, every dictionary word is an edge, and so is a character at
which none begins, with a count of 1.  The best path maximises the sum of log(n / total); of equal paths the one with the
longer first word wins.  Neighbouring words of one ASCII letter or digit come out as one token.  White space separates and
is dropped; other characters are tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved

#: Characters of the longest word of a dictionary; longer ones are left out of it.
MAX_WORD = 32
#: Words of a dictionary that goes to the tasks as hashes and logarithms, 16 bytes a word.
COMPACT_WORDS = 1 << 23
#: Characters of different blocks that a task looks up at once, characters of texts that it cuts at once, and blocks that
#: it keeps with their words.
STEP_CHARS, STEP_TEXT, KEPT_BLOCKS = 1 << 18, 1 << 22, 50_000
BLOCKS = re.compile(r"([^\W_]+)|\s+|([\W_])")
ASCII_TOKEN = re.compile(r"[A-Za-z0-9]")


def best_path(block: str, edges: Callable[[int], Iterable[tuple[int, float]]], lone: float) -> list[str]:
    """The words of the best path; edges(i): (length, log probability) of the dictionary words at i."""
    n, words, i, open_ascii = len(block), [], 0, False
    score, step = [0.0] * (n + 1), [1] * n
    for k in range(n - 1, -1, -1):
        score[k], step[k] = max([(value + score[k + size], size) for size, value in edges(k)], default=(lone + score[k + 1], 1))
    while i < n:
        piece = block[i : i + step[i]]
        single = bool(ASCII_TOKEN.fullmatch(piece))
        if single and open_ascii:
            words[-1] += piece
        else:
            words.append(piece)
        open_ascii, i = single, i + step[i]
    return words


class Dictionary:
    """Log probabilities of words, and the beginnings of words that end a search."""

    def __init__(self, counts: dict[str, int], total: int):
        self.lone = -math.log(total) if total else 0.0
        self.logs = {w: math.log(n) - math.log(total) for w, n in counts.items()}
        self.beginnings = {w[:k] for w in counts for k in range(1, len(w))}

    def cut(self, block: str) -> list[str]:
        logs, beginnings = self.logs, self.beginnings

        def edges(i):
            for k in range(i + 1, len(block) + 1):
                part = block[i:k]
                if part in logs:
                    yield k - i, logs[part]
                if part not in beginnings:
                    return

        return best_path(block, edges, self.lone)

    def tokens(self, text: str | None) -> list[str]:
        out = []
        for found in BLOCKS.finditer(text or ""):
            if found[1]:
                out += self.cut(found[1])
            elif found[2]:
                out.append(found[2])
        return out


class Hashes:
    """Hashes of 64 bits of the parts of an array of code points, from one prefix sum."""

    BASE = 0x5851F42D4C957F2D
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, points: np.ndarray):
        power, self.inverse = (np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(len(points), base, np.uint64)]) for base in (self.BASE, self.INVERSE))
        self.prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(self.mix(points.astype(np.uint64) + np.uint64(11)) * power[:-1])]

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return self.mix((self.prefix[start + size] - self.prefix[start]) * self.inverse[start] + np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def code_points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)


class CompactDictionary:
    """A dictionary as sorted hashes of its words and their log probabilities, with a bitmap that most other strings fail.

    Two strings have one hash with a chance of 5e-20 a pair.
    """

    BITS = 27

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, total = hashes[order], int(counts.sum())
        self.lone = -math.log(total) if total else 0.0
        values, place = np.unique(counts[order], return_inverse=True)
        self.logs = np.array([math.log(n) - math.log(total) for n in values.tolist()], np.float64)[place]
        self.bits, self.known = None, {}

    def near(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:  # made in each task's process
            places = self.hashes >> np.uint64(64 - self.BITS)
            self.bits = np.zeros(1 << (self.BITS - 3), np.uint8)
            np.bitwise_or.at(self.bits, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        places = hashes >> np.uint64(64 - self.BITS)
        return np.flatnonzero((self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1)

    def cut(self, blocks: list[str]) -> list[list[str]]:
        """The words of each block's best path; blocks have a character at least."""
        sizes = np.array([len(b) for b in blocks])
        ends = np.cumsum(sizes)
        hashes, left = Hashes(code_points(blocks)), np.repeat(ends, sizes) - np.arange(sizes.sum())
        at, size, value = [], [], []
        for k in range(1, MAX_WORD + 1):
            start = np.flatnonzero(left >= k)
            if not len(start) or not len(self.hashes):
                break
            part = hashes.of(start, k)
            some = self.near(part)
            start, part = start[some], part[some]
            place = np.minimum(np.searchsorted(self.hashes, part), len(self.hashes) - 1)
            found = self.hashes[place] == part
            at.append(start[found])
            size.append(np.full(found.sum(), k))
            value.append(self.logs[place[found]])
        at, size, value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, size, value))
        order = np.argsort(at, kind="stable")
        size, value = size[order].tolist(), value[order].tolist()
        bounds = np.searchsorted(at[order], np.arange(sizes.sum() + 1)).tolist()
        edges = lambda begin: lambda i: zip(size[bounds[begin + i] : bounds[begin + i + 1]], value[bounds[begin + i] : bounds[begin + i + 1]])
        return [best_path(b, edges(begin), self.lone) for b, begin in zip(blocks, (ends - sizes).tolist())]

    def tokens(self, texts: list[str | None]) -> list[list[str]]:
        """The tokens of each text; each different block is cut once, and blocks of texts before are known."""
        found, known = [[m[0] for m in BLOCKS.finditer(t or "") if m[1] or m[2]] for t in texts], self.known
        if len(known) > KEPT_BLOCKS:
            known.clear()
        step, chars = [], 0
        for b in dict.fromkeys(b for parts in found for b in parts if b not in known):
            if not b[0].isalnum():
                known[b] = [b]
                continue
            step.append(b)
            chars += len(b)
            if chars >= STEP_CHARS:
                known.update(zip(step, self.cut(step)))
                step, chars = [], 0
        if step:
            known.update(zip(step, self.cut(step)))
        return [[w for b in parts for w in known[b]] for parts in found]


def compact(words: DataFrame) -> CompactDictionary:
    """The compact form of a dictionary of words(word, n), which comes to the driver in 16 bytes a word."""

    def run(batches):
        for batch in batches:
            strings = batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in strings], np.int64)
            hashes = Hashes(code_points(strings)).of(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("n")], ["h", "n"])

    table = words.mapInArrow(run, "h long, n long").toArrow()
    return CompactDictionary(np.asarray(table["h"].combine_chunks()).view(np.uint64), np.asarray(table["n"].combine_chunks()))


def dictionary(counts: DataFrame) -> DataFrame:
    """word, n of counts(word, n): words of at most MAX_WORD characters, repeated ones added up."""
    rows = counts.where(F.col("word").isNotNull() & F.length("word").between(1, MAX_WORD) & (F.col("n") > 0))
    return rows.groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def dictionary_tokenizer(counts: DataFrame, limit: int = BROADCAST_ROWS) -> Callable[[Column], Column]:
    """A tokenizer for register_tokenizer: array<string> of a text column, by a dictionary of at most `limit` words, which
    is sent to the tasks; a larger one fails here (segment() takes any size)."""
    words = saved(dictionary(counts))
    if words.limit(limit + 1).count() > limit:
        raise ValueError(f"the dictionary has more than {limit} words")
    return compact_tokenizer(words)


def compact_tokenizer(words: DataFrame) -> Callable[[Column], Column]:
    shared = words.sparkSession.sparkContext.broadcast(compact(words))

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64))
        parts, i = [pa.array([], pa.list_(pa.string()))], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_TEXT, side="right")))
            parts.append(pa.array(shared.value.tokens(texts[i:j].to_pylist()), pa.list_(pa.string())))
            i = j
        return pa.concat_arrays(parts)

    return tokens


def segment(texts: DataFrame, counts: DataFrame, keys: list[str], text: str = "text", limit: int = COMPACT_WORDS) -> DataFrame:
    """keys, tokens of each text, by a dictionary of any size: counts(word, n).

    Up to `limit` words go to the tasks.  Of a larger dictionary, each different block's substrings meet their words in a
    shuffled join, and its best path is taken from the edges found; null texts have no tokens.
    """
    words = saved(dictionary(counts))
    if words.limit(limit + 1).count() <= limit:
        return texts.select(*keys, compact_tokenizer(words)(F.col(text)).alias("tokens"))
    total = words.agg(F.sum("n")).first()[0]
    lone = -math.log(total)

    @F.arrow_udf("array<string>")
    def parts(values: pa.Array) -> pa.Array:
        return pa.array([[found[0] for found in BLOCKS.finditer(t or "") if found[1] or found[2]] for t in values.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def paths(blocks: pa.Array, edges: pa.Array) -> pa.Array:
        out = []
        for block, found in zip(blocks.to_pylist(), edges.to_pylist()):
            at: dict[int, list] = {}
            for e in sorted(found or [], key=lambda e: e["size"]):
                at.setdefault(e["i"], []).append((e["size"], math.log(e["n"]) - math.log(total)))
            is_block = block[0].isalnum()
            out.append(best_path(block, lambda i, at=at: at.get(i, ()), lone) if is_block else [block])
        return pa.array(out, pa.list_(pa.string()))

    numbered = saved(texts.select(*keys, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))
    named = [c for c in numbered.columns if c not in ("_text", "_row")]
    rows = numbered.select(*named, "_row", F.posexplode_outer(parts(F.col("_text"))).alias("_no", "block"))
    blocks = rows.select("block").where("block is not null").distinct()
    starts = blocks.select("block", F.explode(F.sequence(F.lit(0), F.length("block") - 1)).alias("i"))
    subs = starts.select("block", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("block") - F.col("i")))).alias("size"))
    edges = subs.withColumn("word", F.substr("block", F.col("i") + 1, F.col("size"))).join(words, "word").groupBy("block").agg(F.collect_list(F.struct("i", "size", "n")).alias("edges"))
    cut = blocks.join(edges, "block", "left").select("block", paths(F.col("block"), F.col("edges")).alias("words"))
    again = rows.join(cut, "block", "left").groupBy(*named, "_row").agg(F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("_no", "words")))).alias("w"))
    return again.select(*named, F.flatten(F.transform("w", lambda x: x["words"])).alias("tokens"))
