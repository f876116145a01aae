"""Words as pieces of a vocabulary, static word vectors made of piece vectors, and the probabilities of a masked model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_by, normalize
from .common import BROADCAST_ROWS, small
from .encoding import MAX_LEN, Load, Sequences, loaded

#: Longer words are unknown as a whole.
MAX_CHARS = 100
#: Logits that a task holds at once.
STEP_LOGITS = 1 << 20
#: Bytes of tokens that a task makes sequences of at once.
STEP_BYTES = 1 << 24
CONTINUED, UNKNOWN, MASK = "##", "[UNK]", "[MASK]"


def segment(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, pieces of each different word: from the left, always the longest piece of vocabulary(piece) that fits.

    A piece after the first bears the mark of a continued one.  Where no piece fits, and for words over MAX_CHARS, pieces is
    [UNKNOWN] if the vocabulary has it, else null.  Substrings meet the vocabulary in a join, whatever its size; of those at
    one place only the longest goes on, and a fold over the places takes the path.
    """
    known = vocabulary.where("piece is not null").select("piece").distinct()
    longest = known.agg(F.max(F.length("piece"))).first()[0] or 0
    single = words.select("word").where("word is not null and word <> ''").distinct()
    short = single.where(F.length("word") <= MAX_CHARS)
    starts = short.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    subs = starts.select("word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("word") - F.col("i")))).alias("size"))
    piece = F.concat(F.when(F.col("i") > 0, F.lit(CONTINUED)).otherwise(F.lit("")), F.substr("word", F.col("i") + 1, F.col("size")))
    best = subs.withColumn("piece", piece).join(known, "piece", "left_semi").groupBy("word", "i").agg(F.max("size").alias("size"))
    listed = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("i", "size"))).alias("sizes"))
    fold = F.expr(f"""aggregate(sequence(0, length(word) - 1), named_struct('at', 0, 'found', cast(array() as array<string>)),
        (s, i) -> if(s.at = i and map_contains_key(sizes, i),
            named_struct('at', i + sizes[i], 'found', concat(s.found, array(concat(if(i > 0, '{CONTINUED}', ''), substr(word, i + 1, sizes[i]))))), s))""")
    path = F.when((F.length("word") <= MAX_CHARS) & F.col("sizes").isNotNull(), fold)
    unknown = known.where(F.col("piece") == UNKNOWN).limit(1).count() == 1
    other = F.array(F.lit(UNKNOWN)) if unknown else F.lit(None).cast("array<string>")
    rows = single.join(listed, "word", "left").withColumn("path", path)
    return rows.select("word", F.when(F.col("path.at") == F.length("word"), F.col("path.found")).otherwise(other).alias("pieces"))


def word_vectors(words: DataFrame, piece_vectors: DataFrame) -> DataFrame:
    """word, vec: the normalized mean of the normalized vectors of a word's pieces, a repeated piece counted as often.

    piece_vectors: piece, vec.  Words without pieces have no row.
    """
    cut = segment(words, piece_vectors).select("word", F.explode("pieces").alias("piece"))
    table = piece_vectors.select("piece", normalize(F.col("vec")).alias("vec"))
    return mean_by(cut.join(table, "piece"), ["word"]).select("word", normalize(F.col("vec")).alias("vec"))


def word_table(piece_vectors: DataFrame, limit: int = BROADCAST_ROWS):
    """word_vectors() as a function for tasks, from an Arrow array of different words to (whether each has a vector, vectors).

    The pieces go to the tasks; None if they are more than limit.
    """
    rows = piece_vectors.where("piece is not null and vec is not null").select("piece", normalize(F.col("vec")).alias("vec")).limit(limit + 1).collect()
    if not rows or len(rows) > limit or len({r["piece"] for r in rows}) < len(rows):
        return None
    known = {r["piece"]: k for k, r in enumerate(rows)}
    shared = piece_vectors.sparkSession.sparkContext.broadcast((known, np.array([r["vec"] for r in rows], np.float64), max(map(len, known))))

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known, table, longest = shared.value
        other, found, sizes = [known[UNKNOWN]] if UNKNOWN in known else [], [], []
        for word in words.to_pylist():
            path, at, n = [], 0, len(word or "")
            while at < n <= MAX_CHARS:
                mark = CONTINUED if at else ""
                for size in range(min(longest, n - at), 0, -1):
                    piece = known.get(mark + word[at : at + size])
                    if piece is not None:
                        break
                else:
                    break
                path.append(piece)
                at += size
            path = path if at == n else other
            found += path
            sizes.append(len(path))
        sizes = np.array(sizes, np.int64)
        has, vectors = sizes > 0, np.zeros((len(sizes), table.shape[1]))
        if has.any():
            mean = np.add.reduceat(table[found], (np.cumsum(sizes) - sizes)[has], axis=0) / sizes[has, None]
            vectors[has] = mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)
        return has, vectors

    return run


# ---------------------------------------------------------------------------------------------- masked model

def mask_inputs(requests: DataFrame, vocabulary: DataFrame, most: int):
    """The pieces and vectors of a model's vocabulary, by piece, for the tasks."""
    rows = vocabulary.select("piece", "vec").orderBy("piece").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} pieces")
    return requests.sparkSession.sparkContext.broadcast((pa.array([r["piece"] for r in rows], pa.string()), np.array([r["vec"] for r in rows], np.float64)))


def masked_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, tokens with the mask at idx; requests outside of the tokens are left out."""
    inside = requests.where((F.col("idx") >= 0) & (F.col("idx") < F.size("tokens")))
    return inside.select(*keys, F.col("idx").cast("int").alias("idx"), F.transform("tokens", lambda t, i: F.when(i == F.col("idx"), F.lit(MASK)).otherwise(t)).alias("tokens"))


def slices(batches, limit: int = STEP_BYTES):
    """Arrow batches in slices of at most limit bytes of tokens, or of one row."""
    for batch in batches:
        tokens = batch.column("tokens")
        size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
        length = np.asarray(pc.fill_null(pc.binary_length(tokens.flatten()), 0)).astype(np.int64)
        before = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(size)]]
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(before, before[at] + limit, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def mask_logits(requests: DataFrame, keys: list[str], load: Load, vocabulary: DataFrame, max_len: int | None = MAX_LEN, most: int = 1 << 17) -> DataFrame:
    """keys, idx, piece, logit: for each request(keys, tokens, idx) the products of the hidden state at the masked word with
    the piece vectors of vocabulary(piece, vec), over the root of their dimension.

    An index outside of the tokens and a mask behind max_len (None: sequences are whole) have no rows.  The vocabulary is a
    model's own (at most `most` pieces, or this fails) and goes to the tasks.
    """
    shared, masked, pickled = mask_inputs(requests, vocabulary, most), masked_requests(requests, keys), cloudpickle.dumps(load)

    def run(batches):
        names, table = shared.value
        encoder = Masked(loaded(pickled))
        for batch in slices(batches):
            sequences, at = Sequences(encoder, batch.column("tokens").to_pylist(), max_len), batch.column("idx").to_pylist()
            for row, hidden, _ in sequences.run():
                if at[row] not in sequences.words[row] or not len(names):
                    continue
                logits = np.einsum("jd,d->j", table, hidden[sequences.words[row].index(at[row])]) / np.sqrt(table.shape[1])
                same = pa.array([row] * len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in [*keys, "idx"]), names, pa.array(logits)], [*keys, "idx", "piece", "logit"])

    kinds = dict(masked.dtypes)
    return masked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "idx int, piece string, logit double"]))


def mask_probabilities(requests: DataFrame, keys: list[str], load: Load, vocabulary: DataFrame, max_len: int | None = MAX_LEN, top: int = 50, most: int = 1 << 17) -> DataFrame:
    """keys, idx, best: for each request(keys, tokens, idx) the `top` best pieces (struct cand, p, rank; best first).

    probabilities() of mask_logits(), but the softmax is taken in the task that has the logits, STEP_LOGITS at a time, so
    that no row is made for each piece of the vocabulary at each position.
    """
    shared, masked = mask_inputs(requests, vocabulary, most), masked_requests(requests, keys)
    pickled, kinds = cloudpickle.dumps(load), dict(masked.dtypes)
    kind = pa.struct([("cand", pa.string()), ("p", pa.float64()), ("rank", pa.int64())])

    def run(batches):
        names, table = shared.value
        encoder = Masked(loaded(pickled))
        for batch in slices(batches):
            sequences, at = Sequences(encoder, batch.column("tokens").to_pylist(), max_len), batch.column("idx").to_pylist()
            rows, states = [], []
            for row, hidden, _ in sequences.run():
                if at[row] in sequences.words[row] and len(names):
                    rows.append(row)
                    states.append(hidden[sequences.words[row].index(at[row])].copy())  # a view would hold all states of the step
            step = max(1, STEP_LOGITS // max(1, len(names)))
            for i in range(0, len(rows), step):
                logits = np.einsum("id,jd->ij", np.array(states[i : i + step]), table) / np.sqrt(table.shape[1])  # equal vectors have equal products
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                least = np.partition(logits, -min(top, len(names)), axis=1)[:, -min(top, len(names))]
                chosen = []
                for one, bound in zip(logits, least):  # names are sorted, and equal logits rank by piece
                    inside = np.flatnonzero(one >= bound)
                    chosen.append(inside[np.argsort(-one[inside], kind="stable")][:top])
                picked, n = np.concatenate(chosen), np.array([len(c) for c in chosen])
                owner = np.repeat(np.arange(len(chosen)), n)
                ends = np.cumsum(n)
                rank = np.arange(len(picked)) - np.repeat(ends - n, n) + 1
                best = pa.StructArray.from_arrays([names.take(pa.array(picked)), pa.array(p[owner, picked]), pa.array(rank.astype(np.int64))], fields=list(kind))
                same = pa.array(rows[i : i + step], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in [*keys, "idx"]), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), best)], [*keys, "idx", "best"])

    return masked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "idx int, best array<struct<cand:string,p:double,rank:bigint>>"]))


class Masked:
    """An encoder for which the mask is one piece."""

    def __init__(self, encoder):
        self.encoder, self.first, self.last, self.padding = encoder, encoder.first, encoder.last, encoder.padding
        self.forward = encoder.forward

    def pieces(self, word: str) -> list[int]:
        pieces = self.encoder.pieces(word)
        return pieces[:1] if word == MASK else pieces


def probabilities(logits: DataFrame, keys: list[str], top: int = 50) -> DataFrame:
    """keys, idx, cand, p, rank: the softmax of each position's logits and the rank in it, for its `top` best pieces.

    Equal logits rank by piece.  One pass: every batch gives each of its positions' greatest logit, the sum of exponents
    under it, and the best pieces; these partials merge, so that a position's logits are gathered nowhere.
    """
    by, kinds = [*keys, "idx"], dict(logits.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "most double, total double, best array<struct<minus:double,piece:string>>"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for c in by:
                one = batch.column(c).dictionary_encode()
                code = np.unique(code * (len(one.dictionary) + 1) + np.asarray(one.indices.fill_null(len(one.dictionary))), return_inverse=True)[1]
            value, piece = np.asarray(batch.column("logit")), np.asarray(batch.column("piece"), object)
            order = np.lexsort((piece.astype(str), -value, code))
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            ends = np.r_[starts[1:], len(order)]
            most = value[order[starts]]
            total = np.add.reduceat(np.exp(value[order] - np.repeat(most, ends - starts)), starts)
            best = [[{"minus": -value[k], "piece": piece[k]} for k in order[a : min(b, a + top)].tolist()] for a, b in zip(starts.tolist(), ends.tolist())]
            first = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in by), pa.array(most), pa.array(total), pa.array(best, pa.list_(pa.struct([("minus", pa.float64()), ("piece", pa.string())])))], [*by, "most", "total", "best"])

    parts = logits.select(*by, "piece", F.col("logit").cast("double").alias("logit")).mapInArrow(run, schema)
    merged = parts.groupBy(*by).agg(F.max("most").alias("most"), F.collect_list(F.struct("most", "total")).alias("sums"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best"))
    total = F.aggregate("sums", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["most"] - F.col("most")))
    ranked = merged.select(*by, "most", total.alias("total"), F.posexplode("best").alias("n", "b"))
    return ranked.select(*by, F.col("b.piece").alias("cand"), (F.exp(-F.col("b.minus") - F.col("most")) / F.col("total")).alias("p"), (F.col("n") + 1).cast("long").alias("rank"))


def masked_filter(rows: DataFrame, probabilities: DataFrame, vocabulary: DataFrame, keys: list[str], least: float = 0.01, top: int = 50) -> DataFrame:
    """Candidates (keys, idx, cand, ...) that are one piece of the vocabulary, and to which the model gives a probability of
    at least `least` and a rank of at most `top`; positions without probabilities keep none."""
    single = segment(rows.select(F.col("cand").alias("word")), vocabulary).where(F.size("pieces") == 1).select(F.col("word").alias("cand"), F.get("pieces", F.lit(0)).alias("_piece"))
    table = probabilities.where((F.col("p") >= F.lit(least)) & (F.col("rank") <= top)).select(*keys, "idx", F.col("cand").alias("_piece"))
    table = table.join(small(single.select("_piece").distinct()), "_piece", "left_semi")  # others can't be met
    return rows.join(single, "cand").join(table, [*keys, "idx", "_piece"], "left_semi").drop("_piece").select(*rows.columns)
