"""SentencePiece encoding and decoding as a relational lattice.

A text is a sequence of words: spaces with the characters after them (pieces never reach across).  A word is cut further
between two neighbouring characters that no piece holds side by side.  Each block of documents keeps its distinct words,
so the corpus moves as one row per block and word, and as compact word numbers.  Distinct words then become a lattice in
SQL: their substrings of bounded length are exploded, equi-joined to the piece table (broadcast; its size is checked) and
gathered by word, and a higher-order aggregate folds the edges of a word:

- for a unigram model the fold is Viterbi, position by position;
- for a BPE model, Viterbi over its scores gives other pieces than the model's merges, so the fold merges symbols on a bit
  mask of their borders.  Up to the moment at which an edge can join two symbols, the merges inside of it are those of its
  piece alone.  So if the last two symbols of every piece have better scores than the piece (`late_pieces` looks at each),
  no merge makes a better one possible, and one pass over the edges from the best to the worst does what the model does,
  merge by merge.  Words with an edge of another piece take the best edge that fits step by step.

Words too long for a bit mask (over `MASK_CHARS` characters) and of BPE models are merged by a heap in Python.  The
finished piece ids return to their blocks and are laid out by word number; the ids are decoded and compared as well.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded, cut, list_array, mix64, partitions_for, spans, string_buffers, text_or_empty

SPACE = "▁"
MASK_CHARS = 60
#: Distinct words after which a block of documents ends.
BLOCK_WORDS = 1 << 21
#: Bytes of text of one row of word numbers (a longer text is a row of its own).
ROW_BYTES = 1 << 18
#: Bytes of a text's digest that a block keeps for the comparison with the decoded text.
DIGEST = 32
#: Places (blocks) of a word in one row.
PLACES = 4096
#: Pieces that may be broadcast.
MAX_PIECES = 1 << 20
WORD = re.compile(r" *[^ \n]+| +|\n")


# ---------------------------------------------------------------------------------------------- the model

@dataclass(frozen=True)
class Model:
    kind: str  # "unigram" or "bpe"
    pieces: tuple  # (piece, score) by id; a byte piece has its byte as bytes
    unknown: int

    @property
    def normal(self) -> list[tuple[str, int, float]]:
        return [(p, k, s) for k, (p, s) in enumerate(self.pieces) if isinstance(p, str) and p]

    @property
    def neighbours(self) -> set[str]:
        """Characters that some piece holds side by side; the model's mark for a space as a space."""
        return {a + b for p, _, _ in self.normal for a, b in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:])}

    @property
    def bytes_ids(self) -> list[int]:
        at = {p[0]: k for k, (p, _) in enumerate(self.pieces) if isinstance(p, bytes) and p}
        return [at.get(b, self.unknown) for b in range(256)]


def fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < n:
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 1:
            value, i = data[i : i + 8], i + 8
        elif tag & 7 == 5:
            value, i = data[i : i + 4], i + 4
        else:
            size = varint()
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def load_model(path: str) -> Model:
    """Pieces of a .model file: type 1 normal, 4 user-defined, 5 unused, 6 byte; others are never in a text."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, kind, unknown = [], "unigram", 0
    for number, value in fields(data):
        if number == 1:
            entry = dict(fields(value))
            piece, score, what = entry.get(1, b"").decode(), struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0, entry.get(3, 1)
            if what == 2:
                unknown = len(pieces)
            pieces.append((bytes([int(piece[3:5], 16)]) if what == 6 else piece if what in (1, 4) else "", score))
        elif number == 2:
            kind = {1: "unigram", 2: "bpe"}.get(dict(fields(value)).get(3, 1), "other")
    if kind == "other":
        raise ValueError("only unigram and BPE models are encoded")
    return Model(kind, tuple(pieces), unknown)


def merge_long(word: str, score: dict[str, float]) -> list[str]:
    """The BPE symbols of a word, best merge first, leftmost on ties; n log n."""
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (s := score.get(word[i : j + size[j]])) is not None:
            heapq.heappush(heap, (-s, i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if size[i] != a or after[i] >= n or size[after[i]] != b:
            continue
        j = after[i]
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [word[i : i + size[i]] for i in range(n) if size[i]]


def late_pieces(model: Model) -> set[str]:
    """Pieces of a BPE model with a part of no better score: of the two symbols that the piece alone is last joined from."""
    score, late = {p: s for p, _, s in model.normal}, set()
    for piece in score:
        symbols, worst = list(piece), []
        while len(symbols) > 1:
            best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score), default=None)
            if best is None:
                break
            k = -best[1]
            worst = [score[x] for x in symbols if len(x) > 1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        if len(symbols) == 1 and worst and min(worst) <= score[piece]:
            late.add(piece)
    return late


# ---------------------------------------------------------------------------------------------- the lattice

def piece_table(spark, model: Model) -> DataFrame:
    rows = model.normal
    if len(rows) > MAX_PIECES:
        raise ValueError(f"{len(rows)} pieces are too many to broadcast")
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": pa.array([r[2] for r in rows], pa.float64())}))


def gather_edges(edges: DataFrame, model: Model) -> DataFrame:
    """word, at, m, edges, joins, chars, late: the rows of a word, which follow each other, as one.

    The first row of a word, its first character, brings word and at.  All rows bring the word's number, so rows that do
    not follow each other fail.  For a BPE model joins has the edges of several characters, by cost and start, chars the
    ids of the characters (-1 without a piece), and late says if an edge is of a late piece; else edges has all of them.
    """
    bpe = model.kind == "bpe"
    single = {ord(p): k for p, k, _ in model.normal if len(p) == 1}
    points = np.array(sorted(single), np.uint32)
    ids_of = np.array([single[c] for c in points.tolist()] + [-1], np.int32)
    slow = late_pieces(model) if bpe else set()
    late = np.array([k for p, k, _ in model.normal if p in slow], np.int32)

    def run(batches):
        names = ["number", "word", "at", "s", "e", "id", "cost"]
        left = None

        def rows(t):
            word, end, number = t.column("word"), np.asarray(t.column("e")), np.asarray(t.column("number"))
            new = np.flatnonzero(np.asarray(word.is_valid()))
            size = np.diff(np.r_[new, t.num_rows])
            if not np.array_equal(np.repeat(number[new], size), number):
                raise ValueError("the edges of a word do not follow each other")
            heads, owner = word.take(pa.array(new)), np.repeat(np.arange(len(new)), size)
            text = pa.compute.replace_substring(heads, " ", SPACE)
            m = np.asarray(pa.compute.utf8_length(text)).astype(np.int32)
            s, e, ident, cost = np.asarray(t.column("s")).astype(np.int64), end.astype(np.int64), t.column("id"), np.asarray(t.column("cost").fill_null(np.inf))
            if not bpe:
                order = pa.array(np.lexsort((s, cost, owner)))
                items = pa.StructArray.from_arrays([t.column(c).take(order) for c in ("cost", "s", "e", "id")], ["cost", "s", "e", "id"])
                empty = list_array(pa.array([], JOIN), np.zeros(len(new), np.int64))
                return pa.RecordBatch.from_arrays([heads, t.column("at").take(pa.array(new)), pa.array(m), list_array(items, size), empty, list_array(pa.array([], pa.int32()), np.zeros(len(new), np.int64)), pa.array(np.zeros(len(new), bool))], NAMES)
            pick = np.flatnonzero(e - s > 1)
            pick = pick[np.lexsort((s[pick], cost[pick], owner[pick]))]
            s, e, owner = s[pick], e[pick], owner[pick]
            ident = np.asarray(ident.take(pa.array(pick)).fill_null(-1))
            bit = lambda k: np.int64(1) << np.minimum(k, 62)
            parts = [pa.array(s.astype(np.int32)), pa.array(ident), pa.array(bit(s) | bit(e)), pa.array((bit(e) - 1) & ~(bit(s + 1) - 1))]
            joins = list_array(pa.StructArray.from_arrays(parts, fields=list(JOIN)), np.bincount(owner, minlength=len(new)))
            code = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.searchsorted(points, code)
            known = points[np.minimum(place, len(points) - 1)] == code if len(points) else np.zeros(len(code), bool)
            chars = list_array(pa.array(ids_of[np.where(known, place, -1)]), m)
            odd = np.bincount(owner, weights=np.isin(ident, late), minlength=len(new)) > 0
            return pa.RecordBatch.from_arrays([heads, t.column("at").take(pa.array(new)), pa.array(m), list_array(pa.array([], EDGE), np.zeros(len(new), np.int64)), joins, chars, pa.array(odd)], NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([left.column(c), batch.column(c)]) for c in names], names)
            begin = int(np.flatnonzero(np.asarray(batch.column("word").is_valid()))[-1])
            left = batch.slice(begin)
            if begin:
                yield rows(batch.slice(0, begin))
        if left is not None and left.num_rows:
            yield rows(left)

    NAMES = ["word", "at", "m", "edges", "joins", "chars", "late"]
    JOIN = pa.struct([("s", pa.int32()), ("id", pa.int32()), ("ends", pa.int64()), ("inside", pa.int64())])
    EDGE = pa.struct([("cost", pa.float64()), ("s", pa.int32()), ("e", pa.int32()), ("id", pa.int32())])
    return edges.mapInArrow(bounded(run), "word string, at array<long>, m int, edges array<struct<cost:double,s:int,e:int,id:int>>, joins array<struct<s:int,id:int,ends:long,inside:long>>, chars array<int>, late boolean")


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """Distinct words (word, at; their spaces as plain spaces) -> word, at, ids."""
    spark = words.sparkSession
    longest, bpe = max((len(p) for p, _, _ in model.normal), default=1), model.kind == "bpe"
    short = words.where(F.length("word") <= MASK_CHARS) if bpe else words
    # Of a BPE model's characters only the first gets a row: it brings the word.  The others' ids need no join.
    starts, sizes = ("sequence(0, greatest(m - 2, 0))", "sequence(if(s = 0, 1, 2), least(%d, m - s))" % max(longest, 2)) if bpe else ("sequence(0, m - 1)", "sequence(1, least(%d, m - s))" % longest)
    numbered = short.select(F.monotonically_increasing_id().alias("number"), "word", "at", F.translate("word", " ", SPACE).alias("w"), F.length("word").alias("m"))
    at_starts = numbered.withColumn("s", F.explode(F.expr(starts)))
    parts = at_starts.withColumn("n", F.explode(F.expr(sizes))).withColumn("piece", F.expr("substring(w, s + 1, n)"))
    # A broadcast join streams past the pieces, so the edges of a word stay together and are not shuffled or sorted.
    edges = parts.join(F.broadcast(piece_table(spark, model)), "piece", "left").where("id is not null or n = 1")
    head = (F.col("s") == 0) & (F.col("n") == 1)
    grouped = gather_edges(edges.select("number", F.when(head, F.col("word")).alias("word"), F.when(head, F.col("at")).alias("at"), "s", (F.col("s") + F.col("n")).alias("e"), "id", (-F.col("score")).alias("cost")), model)
    codes = ", ".join(map(str, model.bytes_ids))
    fallback = "transform(sequence(1, octet_length(substring(word, {0} + 1, 1))), k -> element_at(array(%s), cast(conv(substring(hex(substring(word, {0} + 1, 1)), 2 * k - 1, 2), 16, 10) as int) + 1))" % codes
    if bpe:
        # Borders are bits 0..m.  An edge joins two symbols if both its ends are borders with one between them; `ends`
        # and `inside` hold these bits.
        once = "aggregate(joins, shiftleft(1L, m + 1) - 1L, (mask, x) -> if((mask & x.ends) = x.ends and bit_count(mask & x.inside) = 1, mask & ~x.inside, mask))"
        fits = "filter(joins, x -> (mask & x.ends) = x.ends and bit_count(mask & x.inside) = 1)"
        steps = f"aggregate(sequence(1, least(greatest(m - 1, 1), greatest(size(joins), 1))), shiftleft(1L, m + 1) - 1L, (mask, k) -> mask & ~coalesce(get({fits}, 0).inside, 0L))"
        masked = grouped.select("word", "at", "joins", "chars", "m", F.expr(f"if(late, {steps}, {once})").alias("mask"))
        joined = "transform(filter(joins, x -> (mask & x.ends) = x.ends and (mask & x.inside) = 0L), x -> named_struct('s', x.s, 'id', x.id))"
        alone = "transform(filter(sequence(0, m - 1), i -> (shiftright(mask, i) & 3L) = 3L), i -> named_struct('s', i, 'id', get(chars, i)))"
        best = masked.select("word", "at", F.expr(f"array_sort(concat({joined}, {alone}))").alias("best"))
        missing = "x.id < 0"
    else:
        least = min((s for _, _, s in model.normal), default=0.0) - 10.0
        step = (
            "transform(filter(edges, x -> x.e = k), x -> named_struct('cost', element_at(state, x.s + 1).cost + coalesce(x.cost, %rD), 's', x.s, 'e', x.e, 'id', x.id))" % -least
        )
        fold = f"aggregate(sequence(1, m), array(named_struct('cost', 0D, 's', -1, 'e', 0, 'id', cast(null as int))), (state, k) -> concat(state, array(array_min({step}))))"
        back = "aggregate(sequence(1, m), named_struct('k', m, 'path', cast(array() as array<struct<s:int,e:int,id:int>>)), (b, i) -> if(b.k = 0, b, named_struct('k', element_at(state, b.k + 1).s, 'path', concat(array(named_struct('s', element_at(state, b.k + 1).s, 'e', element_at(state, b.k + 1).e, 'id', element_at(state, b.k + 1).id)), b.path))), b -> b.path)"
        best = grouped.select("word", "at", "m", F.expr(fold).alias("state")).select("word", "at", F.expr(back).alias("best"))
        missing = "x.id is null"
    done = best.select("word", "at", F.expr(f"flatten(transform(best, x -> if({missing}, {fallback.format('x.s')}, array(x.id))))").alias("ids"))
    if not bpe:
        return done
    scores = spark.sparkContext.broadcast({p: (s, k) for p, k, s in model.normal})
    byte_ids = model.bytes_ids

    def merge(batches):
        score = {p: s for p, (s, _) in scores.value.items()}
        for batch in batches:
            ids = []
            for word in batch.column("word").to_pylist():
                out = []
                for symbol in merge_long(word.replace(" ", SPACE), score):
                    out += [scores.value[symbol][1]] if symbol in scores.value else [byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]
                ids.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("at"), pa.array(ids, pa.list_(pa.int32()))], ["word", "at", "ids"])

    return done.unionByName(words.where(F.length("word") > MASK_CHARS).mapInArrow(bounded(merge), "word string, at array<long>, ids array<int>"))


# ---------------------------------------------------------------------------------------------- blocks

def pack(numbers: np.ndarray) -> bytes:
    """Base-128 varints of numbers below 2**28."""
    numbers = numbers.astype(np.uint32)
    size = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        has = size > k
        out[(end - size)[has] + k] = (numbers[has] >> np.uint32(7 * k)) & np.uint32(127) | ((size[has] > k + 1).astype(np.uint32) << np.uint32(7))
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    stop = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)[: len(stop)]
    out = np.zeros(len(stop), np.int64)
    for k in range(4):
        has = start + k <= stop
        out[has] |= (raw[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class Numbers(dict):
    """Words by number, in order of appearance; 0 is the line feed."""

    def __missing__(self, word):
        self[word] = k = len(self)
        return k


class Cutter:
    """Starts of the words of joined texts, by code points.

    A word is a run of spaces with what follows them up to the next space or line feed, or a line feed, and is cut between
    characters that are not in neighbours.
    """

    def __init__(self, neighbours: set[str]):
        letters = sorted({c for pair in neighbours for c in pair})
        self.size = len(letters) + 1
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.size)
        self.pairs = np.sort(np.array([self.kind[ord(a)] * self.size + self.kind[ord(b)] for a, b in neighbours], np.int64))
        self.matrix, self.rolling = None, Rolling()
        if self.size**2 <= 1 << 26:
            self.matrix = np.zeros(self.size**2, bool)
            self.matrix[self.pairs] = True

    def starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """points: of texts that follow each other, each with a space before it; firsts: where they start."""
        kind = self.kind[points]
        pair = kind[:-1].astype(np.int64) * self.size + kind[1:]
        border = np.ones(len(points), bool)
        border[1:] = ~(self.matrix[pair] if self.matrix is not None else np.isin(pair, self.pairs))
        line, space = points == 10, points == 32
        border |= line
        border[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        border[firsts] = True
        return np.flatnonzero(border)

    def number(self, joined: str, points: np.ndarray, starts: np.ndarray, table: Numbers) -> np.ndarray:
        """The number in table of each word; new words get theirs in the order of appearance."""
        ends = np.r_[starts[1:], len(points)]
        value = mix64(points.astype(np.uint64) + np.uint64(0x5BD1E995))
        code = self.rolling.of(self.rolling.prefix(value), starts, ends)
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        size, model = ends - starts, starts[first][inverse]
        at = np.arange(len(points)) - np.repeat(starts, size)  # each word is the one that stands for its hash
        if not (np.array_equal(size, size[first][inverse]) and np.array_equal(points, points[np.repeat(model, size) + at])):
            return np.fromiter((table[joined[a:b]] for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        numbers = np.empty(len(first), np.int64)
        order = np.argsort(first)
        numbers[order] = np.fromiter((table[joined[a:b]] for a, b in zip(starts[first[order]].tolist(), ends[first[order]].tolist())), np.int64, len(order))
        return numbers[inverse]


TABLE = "block long, kind int, payload binary, ids array<long>"


def to_blocks(rows: DataFrame, block_words: int, neighbours: set[str], buckets: int) -> DataFrame:
    """kind 1: words of a block and a bucket by hash (ids), with their numbers, zipped; kind 2: rows of a block.

    A row of kind 2 has the count of words before it, the texts' sizes and digests, and their word numbers, where 0 stands
    for the next new word and any other number is one more than the word's.
    """
    shared = rows.sparkSession.sparkContext.broadcast(neighbours)

    def run(batches):
        from pyspark import TaskContext

        first = block = TaskContext.get().partitionId() << 15
        table, cutter = Numbers({"\n": 0}), Cutter(shared.value)

        def row(kind, blob, ids):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([zlib.compress(blob, 1)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], NAMES)

        def row_of(docs, texts):
            before, digests = len(table), [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:DIGEST] for t in texts]
            sizes, packed = np.zeros(len(texts), np.uint32), b""
            filled = np.flatnonzero([len(t) > 0 for t in texts])
            if len(filled):
                joined = "".join([" " + texts[k] for k in filled.tolist()])
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                firsts = np.cumsum([0] + [len(texts[k]) + 1 for k in filled.tolist()])[:-1]
                starts = cutter.starts(points, firsts)
                numbers = cutter.number(joined, points, starts, table)
                top = np.maximum.accumulate(np.r_[before - 1, numbers])
                coded = np.where(numbers > top[:-1], 0, numbers + 1)
                packed, width = pack(coded), 1 + sum((coded >= 1 << k).astype(np.int64) for k in (7, 14, 21))
                sizes[filled] = np.add.reduceat(width, np.searchsorted(starts, firsts))
            return row(2, struct.pack("<II", len(docs), before) + sizes.tobytes() + b"".join(digests) + packed, docs)

        def words_out():
            words = list(table)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
            bucket[0] = -1  # the line feed needs no lattice, and is the separator here
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
            for a, b in zip(edges[1:].tolist(), np.r_[edges[2:], len(order)].tolist()):
                numbers = pack(np.diff(order[a:b], prepend=0))
                body = "\n".join([words[k] for k in order[a:b].tolist()]).encode("utf-8", "surrogatepass")
                yield row(1, struct.pack("<I", len(numbers)) + numbers + body, [int(bucket[order[a]])])

        for batch in batches:
            _, offsets, _ = string_buffers(batch.column("text"))
            for i, j in spans(offsets, ROW_BYTES):
                yield row_of(batch.column("doc_id").slice(i, j - i).to_pylist(), [t.replace(SPACE, " ") for t in batch.column("text").slice(i, j - i).to_pylist()])
                if len(table) > block_words:
                    yield from words_out()
                    table, block = Numbers({"\n": 0}), block + 1
                    if block - first >= 1 << 15:
                        raise ValueError("a partition has too many blocks; read the table in smaller partitions")
        yield from words_out()

    NAMES = ["block", "kind", "payload", "ids"]
    return rows.mapInArrow(bounded(run), TABLE)


def words_of_blocks(table: DataFrame, partitions: int) -> DataFrame:
    """word, at: each distinct word with its places (block << 28 | number), at most PLACES in a row.

    A task holds one bucket at a time.  A word of more blocks has several rows, which follow each other.
    """

    def rows(found):
        words, at = pa.concat_arrays([w for w, _ in found]), np.concatenate([a for _, a in found])
        coded = words.dictionary_encode()
        index = np.asarray(coded.indices)
        order = np.argsort(index, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
        size = np.diff(np.r_[new, len(index)])
        first = np.concatenate([np.arange(a, a + n, PLACES) for a, n in zip(new.tolist(), size.tolist())]) if (size > PLACES).any() else new
        heads, count, at = coded.dictionary.take(pa.array(index[order][first])), np.diff(np.r_[first, len(index)]), pa.array(at[order])
        out = pa.RecordBatch.from_arrays([heads, list_array(at, count)], ["word", "at"])
        for k in range(0, out.num_rows, 10_000):
            yield out.slice(k, 10_000)

    def run(batches):
        held, found = None, []
        for batch in batches:
            for bucket, block, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "payload"))):
                if bucket != held and found:
                    yield from rows(found)
                    found = []
                held, blob = bucket, zlib.decompress(payload)
                (n,) = struct.unpack_from("<I", blob)
                words = pa.array(blob[4 + n :].decode("utf-8", "surrogatepass").split("\n"), pa.string())
                found.append((words, (block << 28) + np.cumsum(unpack(blob[4 : 4 + n]))))
        if found:
            yield from rows(found)

    moved = table.where("kind = 1").select(F.col("ids")[0].alias("bucket"), "block", "payload").repartition(partitions, "bucket")
    return moved.sortWithinPartitions("bucket").mapInArrow(bounded(run), "word string, at array<long>")


def packed_ids(found: DataFrame) -> DataFrame:
    """at (places), ids -> a row of the blocks' table (kind 0) for each block and batch."""

    def run(batches):
        for batch in batches:
            ids, places = batch.column("ids"), batch.column("at")
            sizes, flat = np.asarray(ids.value_lengths()).astype(np.int64), np.asarray(ids.flatten()).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(places.value_lengths()))
            block, number = np.asarray(places.flatten()) >> 28, np.asarray(places.flatten()) & 0xFFFFFFF
            start, sizes = (np.cumsum(sizes) - sizes)[row], sizes[row]
            order = np.lexsort((number, block))
            edges = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
            for a, b in zip(edges, np.r_[edges[1:], len(order)]):
                k = order[a:b]
                at = np.repeat(start[k] - (np.cumsum(sizes[k]) - sizes[k]), sizes[k]) + np.arange(sizes[k].sum())
                bodies = [pack(np.diff(number[k], prepend=0)), pack(sizes[k]), pack(flat[at])]
                blob = struct.pack("<II", len(bodies[0]), len(bodies[1])) + b"".join(bodies)
                yield pa.RecordBatch.from_arrays([pa.array([int(block[k[0]])], pa.int64()), pa.array([0], pa.int32()), pa.array([zlib.compress(blob, 1)], pa.binary()), pa.array([[]], pa.list_(pa.int64()))], ["block", "kind", "payload", "ids"])

    return found.mapInArrow(bounded(run), TABLE)


def piece_bytes(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the pieces stand for, joined, and their offsets."""
    out = [p if isinstance(p, bytes) else p.replace(SPACE, " ").encode() for p, _ in model.pieces]
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in out])])


def gather(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return flat[at]


def assemble(stream: DataFrame, model: Model) -> DataFrame:
    """The blocks' table, by block and kind -> doc_id, n_tokens, ids, decoded_sha256, round_trip."""
    shared = stream.sparkSession.sparkContext.broadcast((*piece_bytes(model), [model.bytes_ids[10]]))

    def run(batches):
        text, offsets, newline = shared.value
        block, finished, parts = None, None, []
        for batch in batches:
            for at, kind, payload, docs in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "payload", "ids"))):
                if at != block:
                    block, finished, parts = at, None, []
                blob = zlib.decompress(payload)
                if kind == 0:
                    a, b = struct.unpack_from("<II", blob)
                    number, sizes, flat = np.cumsum(unpack(blob[8 : 8 + a])), unpack(blob[8 + a : 8 + a + b]), unpack(blob[8 + a + b :])
                    parts.append((number, sizes, flat.astype(np.int32)))
                    continue
                if finished is None:
                    number, sizes, flat = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
                    n = int(number.max()) + 1 if len(number) else 1
                    start_of, size_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    start_of[number] = np.cumsum(sizes) - sizes
                    size_of[number] = sizes
                    start_of[0], size_of[0] = len(flat), 1
                    finished, parts = (np.concatenate([flat, newline]).astype(np.int32), start_of, size_of), []
                flat, start_of, size_of = finished
                n, before = struct.unpack_from("<II", blob)
                sizes = np.frombuffer(blob, np.uint32, n, 8).astype(np.int64)
                base = 8 + (4 + DIGEST) * n
                digests = [blob[k : k + DIGEST] for k in range(8 + 4 * n, base, DIGEST)]
                words = unpack(blob[base:])
                words = np.where(words == 0, before - 1 + np.cumsum(words == 0), words - 1)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(blob, np.uint8, offset=base) < 128)])[np.concatenate([[0], np.cumsum(sizes)])]
                tokens = gather(flat, start_of[words], size_of[words])
                per_word = np.concatenate([[0], np.cumsum(size_of[words])])
                bounds = per_word[ends]
                length = (offsets[1:] - offsets[:-1])[tokens]
                raw = gather(text, offsets[tokens], length)
                cut_at = np.concatenate([[0], np.cumsum(length)])[bounds].tolist()
                sha = [hashlib.sha256(raw[a + 1 : b].tobytes() if b > a else b"").digest() for a, b in zip(cut_at[:-1], cut_at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(np.diff(bounds)), list_array(pa.array(tokens, pa.int32()), np.diff(bounds)), pa.array([x.hex() for x in sha]), pa.array([x[:DIGEST] == y for x, y in zip(sha, digests)])],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )

    return stream.mapInArrow(bounded(run), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def encode(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, decoded_sha256 (of the decoded text), round_trip.

    Null and empty texts have no tokens.  round_trip compares the SHA-256 with that of the text in which U+2581, the model's
    own mark for a space, is a space.  Rows are encoded one by one, so ids may be null or repeated; empty tables give no rows; extra
    columns are ignored.  Characters without a piece become byte pieces.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    parts = rows.rdd.getNumPartitions() if not rows.isStreaming else 1
    n = partitions_for(docs)
    table = cut(to_blocks(rows.coalesce(max(1, parts // 2)), block_words, model.neighbours, 4 * n))  # fewer blocks share more words
    codes = encode_words(words_of_blocks(table, n), model)
    stream = packed_ids(codes.select("at", "ids")).unionByName(table.where("kind = 2"))
    return assemble(stream.repartition("block").sortWithinPartitions("block", "kind"), model)


def decode(encoded: DataFrame, model: Model, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """encoded with the text of its piece ids.  Null ids give a null text; no ids give an empty one; an id outside the
    model fails; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_bytes(model))
    names = [c for c in encoded.columns if c != text_column]
    schema = ", ".join([f"`{c}` {t}" for c, t in encoded.dtypes if c != text_column] + [f"`{text_column}` string"])

    def run(batches):
        text, offsets = shared.value
        for batch in batches:
            out = []
            for ids in batch.column(ids_column).to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                k = np.array(ids, np.int64)
                out.append(gather(text, offsets[k], offsets[k + 1] - offsets[k]).tobytes()[1:].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, text_column])

    return encoded.mapInArrow(bounded(run), schema)
