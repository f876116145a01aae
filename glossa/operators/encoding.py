"""Contextual vectors of tokenized sentences, from a model that each Python worker loads once.

The model is injected as a function without arguments that gives an Encoder; it travels to the tasks and is called there
on first use.  Sentences come in Arrow batches, are sorted by length within one, and go through the model in steps of
bounded size; a step that does not fit into memory is halved, and later steps grow again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder
from .common import BROADCAST_ROWS

Load = Callable[[], Encoder]

#: Pieces, padding included, that go through the model at once.
STEP = 1 << 14
MAX_LEN = 64

_LOADED: dict[bytes, Encoder] = {}


def loaded(pickled: bytes) -> Encoder:
    """The model of a pickled loader, one a process."""
    if pickled not in _LOADED:
        _LOADED.clear()
        _LOADED[pickled] = cloudpickle.loads(pickled)()
    return _LOADED[pickled]


class Sequences:
    """Token lists as piece ids between the model's marks, cut at max_len (None: whole), with the word of each piece (-1 for marks)."""

    def __init__(self, encoder: Encoder, sentences: list[list[str]], max_len: int | None):
        known: dict[str, list[int]] = {}
        most = None if max_len is None else max_len - 2
        self.encoder, self.ids, self.words = encoder, [], []
        for tokens in sentences:
            ids, words = [], []
            for k, token in enumerate(tokens):
                if most is not None and len(ids) > most:
                    break
                pieces = known.get(token)
                if pieces is None:
                    pieces = known[token] = encoder.pieces(token) if token else []
                ids += pieces
                words += [k] * len(pieces)
            self.ids.append([encoder.first, *ids[:most], encoder.last])
            self.words.append([-1, *words[:most], -1])

    def run(self, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, hidden states of its pieces, pooled output), shorter rows first."""
        order, at, size = sorted(range(len(self.ids)), key=lambda k: len(self.ids[k])), 0, step
        while at < len(order):
            n = at + 1
            while n < len(order) and (n + 1 - at) * len(self.ids[order[n]]) <= size:
                n += 1
            rows = order[at:n]
            width = len(self.ids[rows[-1]])
            ids = np.full((len(rows), width), self.encoder.padding, np.int64)
            mask = np.zeros(ids.shape, bool)
            for k, row in enumerate(rows):
                ids[k, : len(self.ids[row])], mask[k, : len(self.ids[row])] = self.ids[row], True
            try:
                hidden, pooled = self.encoder.forward(ids, mask)
            except MemoryError:
                if len(rows) == 1:
                    raise
                size = max(width, len(rows) * width // 2)
                continue
            for k, row in enumerate(rows):
                yield row, hidden[k, : len(self.ids[row])], pooled[k]
            at, size = n, min(step, 2 * size)


def pooled_words(encoder: Encoder, tokens: pa.ListArray, max_len: int, wanted: np.ndarray | None = None, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in the row, vector) of the words of an Arrow list column, as Sequences and pool_words() give them.

    Whole arrays at a time: a different token is cut once a batch, and the pieces of a step's words are summed at once.
    wanted: of each element of tokens.flatten(), whether its vector is asked for; only rows with such an element run.
    """
    size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    cut = [encoder.pieces(t) if t else [] for t in coded.dictionary.to_pylist()] + [[]]
    long = np.array([len(c) for c in cut], np.int64)
    flat, begins = np.array([x for c in cut for x in c], np.int64), np.cumsum(long) - long
    code = np.asarray(coded.indices.fill_null(len(cut) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    asked = np.ones(len(row), bool) if wanted is None else wanted
    runs = np.bincount(row[asked], minlength=len(size)) > 0
    kept = runs[row]
    row, place, code, asked = row[kept], place[kept], code[kept], asked[kept]

    n = long[code]
    before = np.cumsum(n) - n
    first = np.searchsorted(row, np.arange(len(size)))
    start = before - np.r_[before, n.sum()][first[row]]  # pieces of the row before the word
    n = np.clip(max_len - 2 - start, 0, n)
    length = np.bincount(row, weights=n, minlength=len(size)).astype(np.int64) + 2
    order, at, bound = np.flatnonzero(runs)[np.argsort(length[runs], kind="stable")], 0, step
    last = np.searchsorted(row, np.arange(len(size)), side="right")
    while at < len(order):
        upto = at + max(1, int(np.searchsorted(np.arange(1, len(order) - at + 1) * length[order[at:]], bound, side="right")))
        rows = order[at:upto]
        width = int(length[rows[-1]])
        own = np.repeat(first[rows], (last - first)[rows]) + np.arange((last - first)[rows].sum()) - np.repeat(np.cumsum((last - first)[rows]) - (last - first)[rows], (last - first)[rows])
        line = np.repeat(np.arange(len(rows)), (last - first)[rows])
        many = n[own]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids, mask = np.full((len(rows), width), encoder.padding, np.int64), np.arange(width) < length[rows][:, None]
        ids[:, 0], ids[np.arange(len(rows)), length[rows] - 1] = encoder.first, encoder.last
        x, y = np.repeat(line, many), np.repeat(start[own] + 1, many) + inner
        ids[x, y] = flat[np.repeat(begins[code[own]], many) + inner]
        try:
            hidden = encoder.forward(ids, mask)[0]
        except MemoryError:
            if len(rows) == 1:
                raise
            bound = max(width, len(rows) * width // 2)
            continue
        found = asked[own] & (many > 0)
        if found.any():
            pieces = np.repeat(found, many)
            sizes = many[found]
            sums = np.add.reduceat(hidden[x[pieces], y[pieces]], np.cumsum(sizes) - sizes, axis=0)
            yield row[own[found]], place[own[found]], unit(sums / sizes[:, None])
        at, bound = upto, min(step, 2 * bound)


def pool_words(hidden: np.ndarray, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The words that have pieces, and the normalized mean state of each one's pieces."""
    words = np.asarray(words)
    inside = words >= 0
    found, place = np.unique(words[inside], return_inverse=True)
    sums = np.zeros((len(found), hidden.shape[1]))
    np.add.at(sums, place, hidden[inside])
    return found, unit(sums / np.bincount(place, minlength=len(found))[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=-1, keepdims=True)), 1e-12)


def _encoded(sentences: DataFrame, columns: list[str], schema: str, load: Load, max_len: int, results) -> DataFrame:
    """columns of sentences, each row's repeated for the rows that results(sequence, row, hidden, pooled, batch) gives."""
    pickled = cloudpickle.dumps(load)
    made = [part.rsplit(" ", 1)[0].strip("` ") for part in schema.split(", ")]
    kinds = {"vec": pa.list_(pa.float64()), "pos": pa.int32(), "word": pa.string(), "source": pa.string(), "idx": pa.int32()}
    types = ", ".join([f"`{c}` {t}" for c, t in sentences.dtypes if c in columns] + [schema])

    def run(batches):
        encoder = loaded(pickled)
        for batch in batches:
            sequences = Sequences(encoder, [tokens or [] for tokens in batch.column("tokens").to_pylist()], max_len)
            rows, values = [], [[] for _ in made]
            for row, hidden, pooled in sequences.run():
                for got in results(sequences, row, hidden, pooled, batch):
                    rows.append(row)
                    for k, x in enumerate(got):
                        values[k].append(x)
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, kinds[c]) for c, v in zip(made, values))], [*columns, *made])

    return sentences.select(*dict.fromkeys([*columns, "tokens", *(["idxs"] if "idxs" in sentences.columns else [])])).mapInArrow(run, types)


def word_vectors(sentences: DataFrame, keys: list[str], load: Load, max_len: int = MAX_LEN, only: DataFrame | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys, pos, word, vec: the normalized vector of each word of `tokens` in its context.

    A word's vector is the mean state of its pieces; words without a piece, and those wholly behind max_len, are absent.
    only: (word) of the words whose vectors are asked for.  Up to `limit` of them go to the tasks, where sentences without
    one do not run through the model; more are joined to the vectors.
    """
    names = None
    if only is not None:
        listed = only.where("word is not null").select("word").distinct().limit(limit + 1).collect()
        if len(listed) > limit:
            return word_vectors(sentences, keys, load, max_len).join(only, "word", "left_semi").select(*keys, "pos", "word", "vec")
        names = sentences.sparkSession.sparkContext.broadcast(pa.array([r["word"] for r in listed], pa.string()))
    pickled, source = cloudpickle.dumps(load), sentences.select(*dict.fromkeys([*keys, "tokens"]))

    def run(batches):
        encoder = loaded(pickled)
        for batch in batches:
            tokens = batch.column("tokens")
            flat, size = tokens.flatten(), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            wanted = None if names is None else np.asarray(pc.is_in(flat, value_set=names.value))
            for row, place, vectors in pooled_words(encoder, tokens, max_len, wanted):
                word = flat.take(pa.array((np.cumsum(size) - size)[row] + place))
                ends = np.arange(len(row) + 1, dtype=np.int32) * vectors.shape[1]
                vec = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keys), pa.array(place.astype(np.int32)), word, vec], [*keys, "pos", "word", "vec"])

    types = ", ".join([f"`{c}` {t}" for c, t in source.dtypes if c in keys] + ["`pos` int, `word` string, `vec` array<double>"])
    return source.mapInArrow(run, types)


def sentence_vectors(sentences: DataFrame, keys: list[str], load: Load, pooling: str = "cls", max_len: int = MAX_LEN) -> DataFrame:
    """keys, vec: the normalized vector of each sentence, the model's pooled output (cls) or the mean state (mean)."""
    if pooling not in ("cls", "mean"):
        raise ValueError(f"unknown pooling {pooling}")

    def results(sequences, row, hidden, pooled, batch):
        return [(unit(pooled if pooling == "cls" else hidden.mean(axis=0)),)]

    return _encoded(sentences, keys, "`vec` array<double>", load, max_len, results)


def vectors_at(requests: DataFrame, keys: list[str], load: Load, max_len: int = MAX_LEN) -> DataFrame:
    """keys, idx, vec, source: the vector of the word at idx of `tokens`, one row per request.

    source is "word"; "cls" where the word has no piece or lies behind max_len, whose vector is the first mark's; and
    "text" where idx is null or outside of the tokens, whose vector is the first piece's of the tokens joined as one word
    (the mark's if there is none).  Each different sentence goes through the model once, whatever the number of requests:
    requests meet its vectors by the SHA-256 of the sentence and the index.
    """
    valid = F.coalesce((F.col("idx") >= 0) & (F.col("idx") < F.size("tokens")), F.lit(False))
    rows = requests.select(*keys, "idx", F.when(valid, F.col("idx")).otherwise(-1).cast("int").alias("_at"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    rows = rows.withColumn("tokens", F.when(F.col("_at") >= 0, F.col("tokens")).otherwise(F.array(F.array_join("tokens", ""))))
    rows = rows.withColumn("_key", F.sha2(F.to_json("tokens"), 256))
    single = rows.groupBy("_key").agg(F.first("tokens").alias("tokens"), F.collect_set("_at").alias("idxs"))

    def results(sequences, row, hidden, pooled, batch):
        found, vectors = pool_words(hidden, sequences.words[row])
        place, out = {k: n for n, k in enumerate(found.tolist())}, []
        for k in batch.column("idxs")[row].as_py():
            if k < 0:
                out.append((k, unit(hidden[1 if len(found) else 0]), "text"))
            else:
                out.append((k, vectors[place[k]], "word") if k in place else (k, unit(hidden[0]), "cls"))
        return out

    done = _encoded(single, ["_key"], "`idx` int, `vec` array<double>, `source` string", load, max_len, results).withColumnRenamed("idx", "_at")
    return rows.drop("tokens").join(done, ["_key", "_at"]).select(*keys, "idx", "vec", "source")
