"""Cross-tokenizer alignment: two tokenizations of each text, cut into groups where both end, linked where they overlap.

In Python, two pointers merge the cumulative ends of both token lists.  Where neither tokenizer can join what a space
divides, a text is merged word by word, and a bounded memory keeps the result of each word.  Spark then counts the linked
pairs of ids, and joins the counts and the highest count on each side back to the documents.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, free_name, string_buffers, text_or_empty
from .sentencepiece_codec import gather

#: Words, and their characters, that a task remembers before it forgets the rarer ones.
MEMORY, MEMORY_CHARS = 1 << 17, 1 << 21
#: Words that are encoded, and characters of texts that are aligned, at once (a longer text is a step of its own).
STEP, STEP_CHARS = 1 << 13, 1 << 19
#: Pairs of ids that may be broadcast: those with more than this part of all links.
HOT_PAIRS = 1 << 18
#: A space between a word and what follows it.
CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
PROBE = "é ﬁ  ①\t x"


# ---------------------------------------------------------------------------------------------- tokenizers

def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Files:
    """A byte-level vocabulary (JSON) and a SentencePiece model, read where they lie; they are sent to the tasks."""

    bytes_json: str
    piece_model: bytes

    @staticmethod
    def read(bytes_path: str, piece_path: str) -> Files:
        with open(bytes_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
            return Files(a.read(), b.read())


class Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, files: Files):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        spec, letters = json.loads(files.bytes_json), byte_letters()
        self.a = tokenizers.Tokenizer.from_str(files.bytes_json)
        self.a.encode_special_tokens = True
        vocabulary = spec["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.piece_model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.flat_a, self.flat_b = flat(self.bytes_a), flat(self.bytes_b)
        splitter = spec.get("pre_tokenizer") or {}
        by_words = spec.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        self.by_words = by_words and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.normalize(PROBE) == "▁" + PROBE.replace(" ", "▁")

    def encode(self, words: list[str], spaced: list[str]) -> tuple[Side, Side]:
        """The tokens by a and by b of a space and each word; spaced: these words with the space."""
        a = self.a.encode_batch_fast(spaced, add_special_tokens=False)
        return Side([x.ids for x in a], self.flat_a), Side(self.b.encode(words, num_threads=1), self.flat_b)


def flat(table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of a vocabulary, and where each id's begin."""
    return np.frombuffer(b"".join(table), np.uint8), np.r_[0, np.cumsum([len(x) for x in table])]


class Side:
    """One tokenizer's tokens of a list of words: ids, the word of each, and the cumulative ends of their bytes."""

    def __init__(self, listed: list[list[int]], table: tuple[np.ndarray, np.ndarray]):
        self.table, sizes = table, np.fromiter(map(len, listed), np.int64, len(listed))
        self.ids = np.fromiter(chain.from_iterable(listed), np.int64, int(sizes.sum()))
        self.word = np.repeat(np.arange(len(listed)), sizes)
        self.words = len(listed)
        self.length = np.diff(table[1])[self.ids]

    def same(self, whole: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The words whose tokens' joined bytes are those of whole from offset to offset."""
        size = np.bincount(self.word, self.length, self.words).astype(np.int64)
        same = size == np.diff(offsets)
        raw = gather(self.table[0], self.table[1][self.ids], self.length)
        begin = np.cumsum(size) - size
        inside = np.repeat(same, size)
        at = np.repeat(offsets[:-1] - begin, size)[inside] + np.flatnonzero(inside)
        differs = np.flatnonzero(inside)[whole[at] != raw[inside]]
        same[np.searchsorted(begin, differs, side="right") - 1] = False
        return same

    def keep(self, words: np.ndarray) -> None:
        """Only the tokens of these words (booleans); then the ends."""
        kept = words[self.word]
        self.ids, self.word, self.length = self.ids[kept], self.word[kept], self.length[kept]
        self.ends = np.cumsum(self.length)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links' tokens of a, of b, group of each token of a, of b) by the cumulative ends of two token lists of equal bytes.

    Both lists are sorted, so they are merged as two pointers would: up to each end that either has, exactly one token of
    a and one of b go on, and these are a link; a group ends where an end is in both.
    """
    place = np.searchsorted(ends_b, ends_a)  # of each end of a among those of b
    both = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a if len(ends_a) else np.empty(0, bool)
    every = np.sort(np.concatenate([ends_a[~both], ends_b]), kind="stable")
    common = ends_a[both]
    return np.searchsorted(ends_a, every), np.searchsorted(ends_b, every), np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


class Aligner:
    """Alignments of texts.  Each different word is encoded and merged once, until the memory of words is full."""

    def __init__(self, files: Files):
        self.tokenizers = Tokenizers(files)
        self.size_a, self.width = len(self.tokenizers.bytes_a), len(self.tokenizers.bytes_b)
        # A token of a as text with what follows it: the next of its group or the group's of b; of b also a group or a word.
        self.decimal = [f"{k}{c}" for k in range(self.size_a) for c in ",|"] + [f"{k}{c}" for k in range(self.width) for c in ",;\n"]
        self.forget()

    def forget(self) -> None:
        """Numbers of words; by number: uses; tokens of a (-1: bytes differ), of b, groups, links, first link; groups as text."""
        self.number, self.chars, self.shown, self.pairs = {}, 0, [], array("q")
        self.counts, self.uses = [array("q") for _ in range(5)], np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets the words used once or twice, and the rarer ones beyond half of the memory."""
        words, shown, pairs = list(self.number), self.shown, np.array(self.pairs, np.int64)
        counts, uses = [np.array(c, np.int64) for c in self.counts], np.r_[self.uses, np.zeros(len(words) - len(self.uses), np.int64)]
        kept = np.flatnonzero(uses > 2)
        kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: MEMORY // 2]])
        self.forget()
        size, start = counts[3][kept], counts[4][kept]
        begin = np.cumsum(size) - size
        self.pairs = array("q", pairs[np.repeat(start - begin, size) + np.arange(size.sum())].tobytes())
        self.counts = [array("q", c.tobytes()) for c in (*(c[kept] for c in counts[:4]), begin)]
        self.shown, self.uses = [shown[k] for k in kept.tolist()], uses[kept] // 2
        self.number = {words[k]: n for n, k in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.number))
        if self.chars > MEMORY_CHARS // 2:
            self.forget()

    def learn(self, words: list[str]) -> None:
        spaced = [" " + w for w in words]
        a, b = self.tokenizers.encode(words, spaced)
        whole, offsets, _ = string_buffers(pa.array(spaced, pa.large_string()))
        fine = a.same(whole, offsets) & b.same(whole, offsets)
        a.keep(fine)
        b.keep(fine)
        links_a, links_b, group_a, group_b = merge(a.ends, b.ends)
        last_a, last_b = (np.r_[x[1:] != x[:-1], True][: len(x)] for x in (group_a, group_b))
        count = lambda word: np.bincount(word, minlength=len(words))
        n_links = count(a.word[links_a])
        n_a, first = np.where(fine, count(a.word), -1), len(self.pairs) + np.cumsum(n_links) - n_links
        for column, values in zip(self.counts, (n_a, count(b.word), count(b.word[last_b]), n_links, first)):
            column.frombytes(values.astype(np.int64).tobytes())
        self.pairs.frombytes((a.ids[links_a] * self.width + b.ids[links_b]).tobytes())
        # In the text of a group the tokens of b follow those of a.
        groups = int(group_b[-1]) + 1 if len(group_b) else 0
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        codes = np.empty(len(a.ids) + len(b.ids), np.int64)
        codes[np.arange(len(a.ids)) + (np.cumsum(per_b) - per_b)[group_a]] = 2 * a.ids + last_a
        ends_word = np.r_[b.word[1:] != b.word[:-1], True][: len(b.word)]
        codes[np.arange(len(b.ids)) + np.cumsum(per_a)[group_b]] = 2 * self.size_a + 3 * b.ids + last_b + ends_word
        texts = "".join(map(self.decimal.__getitem__, codes.tolist())).split("\n")
        shown = iter(texts)
        self.shown += [next(shown) if ok else "" for ok in fine.tolist()]
        begin = len(self.number)
        self.number.update(zip(words, range(begin, begin + len(words))))
        self.chars += sum(map(len, words))

    def numbers(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = found < 0
        if not missing.any():
            return found
        sought = list(compress(words, missing.tolist()))
        new = list(dict.fromkeys(sought))
        if self.number and (len(self.number) + len(new) > MEMORY or self.chars + sum(map(len, new)) > MEMORY_CHARS):
            self.shrink()  # which numbers the words anew
            sought, missing = words, np.ones(len(words), bool)
            new = [w for w in dict.fromkeys(words) if w not in self.number]
        for k in range(0, len(new), STEP):
            self.learn(new[k : k + STEP])
        found[missing] = np.fromiter(map(self.number.get, sought), np.int64, len(sought))
        return found

    def texts(self, texts: list[str]) -> list[list]:
        """Columns n_a, n_b, n_groups, n_links, groups, pairs, times; 0 and empty for a text that does not come back."""
        words, first = [], [0]
        for text in texts:
            words += [] if not text else CUT.split(text) if self.tokenizers.by_words else [text]
            first.append(len(words))
        numbers, rows = self.numbers(words), len(texts)
        self.uses = np.bincount(numbers, minlength=len(self.number)) + np.r_[self.uses, np.zeros(len(self.number) - len(self.uses), np.int64)]
        row = np.repeat(np.arange(rows), np.diff(first))
        counts = [np.frombuffer(c, np.int64)[numbers] if len(c) else np.empty(0, np.int64) for c in self.counts]
        whole = np.ones(rows, bool)
        whole[row[counts[0] < 0]] = False
        sums = [np.where(whole, np.bincount(row, c, rows), 0).astype(np.int64) for c in counts[:4]]
        kept = whole[row]
        size, start, row = counts[3][kept], counts[4][kept], row[kept]
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]] if len(size) else start, size) + np.arange(size.sum())
        pairs = np.frombuffer(self.pairs, np.int64)[at] if len(at) else np.empty(0, np.int64)
        span = self.size_a * self.width
        key, times = np.unique(np.repeat(row, size) * span + pairs, return_counts=True)
        cuts = np.searchsorted(key // span, np.arange(1, rows))
        listed, shown = numbers.tolist(), self.shown
        groups = [";".join([shown[k] for k in listed[a:b]]) if ok else "" for a, b, ok in zip(first[:-1], first[1:], whole.tolist())]
        return [*sums, groups, np.split(key % span, cuts), np.split(times.astype(np.int64), cuts)]


_LOADED: dict[Files, Aligner] = {}


def loaded(files: Files) -> Aligner:
    """The aligner of these files, one a process: a worker's next tasks go on with the words of the last ones."""
    if files not in _LOADED:
        _LOADED.clear()
        _LOADED[files] = Aligner(files)
    return _LOADED[files]


def align(docs: DataFrame, files: Files, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links (long), groups (`a1,a2|b1;a3|b2,b3`), pairs and times: the linked pairs of ids,
    as a_id * (size of b's vocabulary) + b_id, and how many links of the text each has.

    Null and empty texts, and texts of which a tokenizer does not give the bytes back, have none.  Columns of docs with one
    of the new names are replaced; each row is aligned for itself, so ids may be null or repeated.  keep_text=False leaves
    the text itself out.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    names, body = [c for c in docs.columns if c.lower() not in made and (keep_text or c != text_column)], free_name(docs, "body")
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in names] + ["n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"])
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        aligner = loaded(shared.value)
        for batch in batches:
            texts, begin, size = batch[body].tolist(), 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= STEP_CHARS or k + 1 == len(texts):
                    part, done = batch.iloc[begin : k + 1], aligner.texts(texts[begin : k + 1])
                    yield part[names].assign(**{name: pd.Series(list(column), index=part.index, dtype=object if n > 3 else "int64") for n, (name, column) in enumerate(zip(made, done))})
                    begin, size = k + 1, 0

    return docs.select(*(f"`{c}`" for c in names), text_or_empty(f"`{text_column}`").alias(body)).mapInPandas(bounded(run), schema)


# ---------------------------------------------------------------------------------------------- counts

def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, n (links of all rows), best_a and best_b (whether no pair of the same a or b id has more); links: pair, times."""
    counts = cut(links.groupBy("pair").agg(F.sum("times").alias("n")))
    side = {"a": F.floor(F.col("pair") / width), "b": F.col("pair") % width}
    for name, key in side.items():
        most = counts.groupBy(key.alias("key")).agg(F.max("n").alias("most"))
        counts = counts.withColumn("key", key).join(most, "key").withColumn(f"best_{name}", F.col("n") == F.col("most")).drop("key", "most")
    return counts


def score(aligned: DataFrame, width: int) -> DataFrame:
    """aligned without pairs and times, with n_best (links whose pair is the most frequent of its b id, ties included) and
    count_sum (over links, the count of their pair).

    Pairs with more than a HOT_PAIRS-th of all links, at most HOT_PAIRS by that, are broadcast; all others meet the counts
    in a shuffle, in which no pair has more than that part of the links.
    """
    row = free_name(aligned, "row")
    kept = cut(aligned.withColumn(row, F.monotonically_increasing_id()))
    links = kept.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    counts = cut(pair_counts(links, width).select("pair", "n", "best_b"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_PAIRS > total)
    found = links.join(F.broadcast(hot), "pair", "left")
    near, far = found.where("n is not null"), found.where("n is null").select(row, "pair", "times").join(counts, "pair")
    sums = near.unionByName(far).groupBy(row).agg(F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    done = kept.drop("pairs", "times", "n_best", "count_sum").join(sums, row, "left").drop(row)
    return done.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def report(docs: DataFrame, files: Files) -> DataFrame:
    """Each document's counts of tokens, groups and links, the digest of its groups, and the counts of its links' pairs."""
    aligned = align(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), files, keep_text=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    width = len(Tokenizers(files).bytes_b)
    done = score(aligned.withColumn("groups_sha256", digest).drop("groups"), width)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
