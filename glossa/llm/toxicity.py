"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its sequence of words (runs of letters and digits, lower case).  A word's inputs are embeddings that the
network learns: a vector of the hashed word, and, coordinate by coordinate, the greatest of the vectors of its hashed
character n-grams.  The network reads windows of `WINDOW` words that overlap by `WINDOW - STRIDE`; attention pools the
states of both directions and the inputs; a document's score is that of its most toxic window.  Every word of every text
is in some window.

Training runs in one task and sees a bounded sample of labelled rows (`max_positive`, `max_negative`, `MAX_BYTES`), taken
in the order of a hash of the document id.  Embeddings start at random but for one coordinate, of a word, or of a
character n-gram's order, which starts at the signed root of the likelihood ratio of toxic and other training documents;
for a training document without its own count.  All of them, and all weights, are then trained by gradients.
Documents are labelled, windows are not: training uses the window of each document that scores highest so far, chosen
anew every `RESELECT` steps, first by the starting embeddings.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, mix64, spans, string_buffers

WINDOW, STRIDE = 64, 48
ORDERS = (3, 4, 5, 6)
WORD_DIM = CHAR_DIM = len(ORDERS)
INPUTS = WORD_DIM + CHAR_DIM
BITS = 18
HIDDEN, ATTENTION = 8, 8
#: Labelled rows that a model is fitted on, at most, and the bytes of their texts.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000
MAX_BYTES = 1 << 26
STEPS, BATCH, RATE, EMBED_RATE, RESELECT = 400, 96, 0.02, 0.003, 100
#: Bytes of text, distinct words and windows in one scoring step.
STEP_BYTES, STEP_WORDS, STEP_WINDOWS = 1 << 20, 1 << 13, 1 << 9


# ---------------------------------------------------------------------------------------------- inputs

def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows and the number of words of each row."""
    spaced = pc.replace_substring_regex(pc.fill_null(pc.utf8_lower(column), ""), pattern=r"[^\pL\pM\pN]+", replacement=" ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    words, sizes = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
    filled = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not filled.all():
        rows = np.repeat(np.arange(len(sizes)), sizes)[filled]
        words, sizes = words.filter(pa.array(filled)), np.bincount(rows, minlength=len(sizes))
    return words, sizes


def word_slots(words: pa.Array):
    """Slot of each word, and (n, slots, word numbers) of its n-grams of each order; words are padded by a space."""
    text = pc.binary_join_element_wise("", words, "", " ")
    raw, _, _ = string_buffers(text)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lengths = np.asarray(pc.utf8_length(text)).astype(np.int64)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    value = mix64(points.astype(np.uint64) + np.uint64(0xABCDEF))
    place = (np.arange(len(points)) - np.repeat(ends - lengths, lengths)).astype(np.uint64)
    whole = np.add.reduceat(mix64(value + place * np.uint64(0x9E3779B97F4A7C15)), ends - lengths) if len(points) else np.empty(0, np.uint64)
    shift = np.uint64(64 - BITS)
    out, code = [], value
    for n in range(2, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            out += [(k, np.empty(0, np.int32), np.empty(0, np.int32)) for k in ORDERS if k >= n]
            break
        code = code[:m] * np.uint64(0x5851F42D4C957F2D) + value[n - 1 :]
        if n in ORDERS:
            same = np.flatnonzero(row[:m] == row[n - 1 :])
            out.append((n, (mix64(code[same] + np.uint64(n)) >> shift).astype(np.int32), row[same]))
    return (mix64(whole) >> shift).astype(np.int64), out


def flat_grams(slots, size: int):
    """(slots, first, of) of the n-grams of all orders by word: word of[k] has those from first[k] on."""
    word = np.concatenate([w for _, _, w in slots[1]])
    order = np.argsort(word, kind="stable")
    word, slot = word[order], np.concatenate([s for _, s, _ in slots[1]])[order]
    of = np.flatnonzero(np.bincount(word, minlength=size)) if len(word) else np.empty(0, np.int64)
    return slot, np.searchsorted(word, of), of


def inputs_of(whole: np.ndarray, grams, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
    """float32 [words, INPUTS]; a word too short for n-grams has 0 in their places."""
    slot, first, of = grams
    x = np.zeros((len(whole), INPUTS), np.float32)
    x[:, :WORD_DIM] = word_table[whole]
    if len(slot):
        x[of, WORD_DIM:] = np.maximum.reduceat(gram_table[slot], first, axis=0)
    return x


def signed_root(c1: np.ndarray, c0: np.ndarray, share: float) -> np.ndarray:
    """Signed root of twice the log likelihood ratio of c1 against c0, given the share of class 1; scaled and clipped."""
    c1, c0 = np.maximum(c1, 0.0), np.maximum(c0, 0.0)
    n = c1 + c0
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(c1 > 0, c1 * np.log(c1 / (n * share)), 0) + np.where(c0 > 0, c0 * np.log(c0 / (n * (1 - share))), 0)
    return np.clip(np.where(c1 > n * share, 1, -1) * np.sqrt(2 * np.maximum(g, 0)) / 4, -1.5, 3).astype(np.float32)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, length) of the windows of rows of these sizes; rows without words have none."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(sizes) - sizes
    return row, base[row] + k * STRIDE, np.minimum(WINDOW, sizes[row] - k * STRIDE)


# ---------------------------------------------------------------------------------------------- network

def sigmoid(x):
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    out = {}
    for d in "fb":
        out |= {f"W{d}": w(INPUTS, 3 * HIDDEN), f"U{d}": w(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    wide = 2 * HIDDEN + INPUTS
    return out | {"A": w(wide, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": w(ATTENTION), "o": w(wide), "c": np.zeros(1, np.float32)}


def run_direction(gates, mask, U, reverse, keep):
    """gates: [T, B, 3H] input projections.  Returns states [T, B, H] and, if kept, what the gradient needs."""
    T, B, _ = gates.shape
    h, states, tape = np.zeros((B, HIDDEN), np.float32), np.empty((T, B, HIDDEN), np.float32), []
    for t in range(T - 1, -1, -1) if reverse else range(T):
        s = h @ U
        zr = sigmoid(gates[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        new = h + m * (new - h)
        if keep:
            tape.append((t, h, z, r, n, s[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states, tape


def forward(p, x, mask, keep=False, gates=None):
    """x: [T, B, INPUTS], mask: [T, B] float32.  Logits, and the tape."""
    gf, gb = gates if gates is not None else (x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"])
    hf, tf = run_direction(gf, mask, p["Uf"], False, keep)
    hb, tb = run_direction(gb, mask, p["Ub"], True, keep)
    wide = np.concatenate([hf, hb, x], 2)
    u = np.tanh(wide @ p["A"] + p["a"])
    e = u @ p["v"] + (mask - np.float32(1)) * np.float32(1e4)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tb,tbd->bd", alpha, wide)
    return pooled @ p["o"] + p["c"][0], (wide, u, alpha, pooled, tf, tb, hf, hb)


def gradient(p, x, mask, y, decay=1e-4):
    """Gradients of the mean loss by the weights, and by the inputs (x)."""
    logit, (wide, u, alpha, pooled, tf, tb, hf, hb) = forward(p, x, mask, True)
    B = len(y)
    d = (sigmoid(logit) - y) / np.float32(B)
    g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["o"]
    dwide = alpha[:, :, None] * dp
    da = np.einsum("bd,tbd->tb", dp, wide)
    de = alpha * (da - (alpha * da).sum(0))
    g["v"] = np.einsum("tb,tbk->k", de, u)
    du = de[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["a"] = np.einsum("tbd,tbk->dk", wide, du, optimize=True), du.sum((0, 1))
    dwide = dwide + du @ p["A"].T
    dx = dwide[:, :, 2 * HIDDEN :].copy()
    for name, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
        U, dh = p[f"U{name}"], np.zeros((B, HIDDEN), np.float32)
        dgates, gU = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(U)
        for t, h, z, r, n, sn in reversed(tape):
            dh = dh + dwide[t, :, lo : lo + HIDDEN]
            m = mask[t][:, None]
            dnew = dh * m
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            ds = np.concatenate([dz, dr, dn * r], 1)
            dgates[t] = np.concatenate([dz, dr, dn], 1)
            gU += h.T @ ds
            dh = dh * (1 - m) + dnew * z + ds @ U.T
        g[f"U{name}"], g[f"b{name}"] = gU, dgates.sum((0, 1))
        g[f"W{name}"] = np.einsum("tbd,tbk->dk", x, dgates, optimize=True)
        dx += dgates @ p[f"W{name}"].T
    return {k: v + np.float32(decay) * p[k] for k, v in g.items()} | {"x": dx}


def places(index: np.ndarray, first: np.ndarray, length: np.ndarray):
    """Time-major entries of index for the windows, and their mask."""
    t = np.arange(int(length.max()))[:, None]
    return index[np.minimum(first + t, len(index) - 1)], (t < length).astype(np.float32)


class Embeddings:
    """The tables of a training sample.  A word number counts twice: + size for the words of toxic documents, whose
    starting values leave one toxic document out, where those of the others leave out one of these."""

    CHUNK = 1 << 13

    def __init__(self, words: pa.Array, df1: np.ndarray, df0: np.ndarray, seed: int):
        rng, self.words, self.size = np.random.default_rng(seed + 1), words, len(words)
        share = float(np.clip(df1.sum() / max(1.0, df1.sum() + df0.sum()), 0.01, 0.99))
        n = 1 << BITS
        self.word, self.gram = (rng.standard_normal((n, d)).astype(np.float32) * np.float32(0.05) for d in (WORD_DIM, CHAR_DIM))
        self.column, word_c, gram_c = np.zeros(n, np.int8), np.zeros((2, n)), np.zeros((2, n))
        for i in range(0, self.size, self.CHUNK):
            whole, orders = word_slots(words.slice(i, self.CHUNK))
            for c, df in enumerate((df0, df1)):
                d = df[i : i + self.CHUNK]
                word_c[c] += np.bincount(whole, weights=d, minlength=n)
                for _, slot, w in orders:
                    gram_c[c] += np.bincount(slot, weights=d[w], minlength=n)
            for k, (_, slot, _) in enumerate(orders):
                self.column[slot] = k  # the order that starts as evidence in this slot
        start = lambda less: [signed_root(c[1] - (less == 1), c[0] - (less == 0), share) for c in (word_c, gram_c)]
        self.start = {less: start(less) for less in (None, 0, 1)}
        self.seen = np.zeros((n, WORD_DIM), np.float32), np.zeros((n, CHAR_DIM), np.float32)

    def final(self) -> tuple[np.ndarray, np.ndarray]:
        word, gram = self.word.copy(), self.gram.copy()
        word[:, 0] += self.start[None][0]
        gram[np.arange(len(gram)), self.column] += self.start[None][1]
        return word, gram

    def look(self, numbers: np.ndarray):
        """x of these word numbers, and what learn() needs."""
        toxic = numbers >= self.size
        slots = word_slots(self.words.take(pa.array(numbers % self.size)))
        whole, (taken, heads, has) = slots[0], flat_grams(slots, len(numbers))
        x = np.zeros((len(numbers), INPUTS), np.float32)
        x[:, :WORD_DIM] = self.word[whole]
        x[:, 0] += np.where(toxic, self.start[1][0][whole], self.start[0][0][whole])
        if not len(taken):
            return x, (whole, None)
        lengths = np.diff(np.r_[heads, len(taken)])
        v = self.gram[taken]
        v[np.arange(len(taken)), self.column[taken]] += np.where(np.repeat(toxic[has], lengths), self.start[1][1][taken], self.start[0][1][taken])
        best = np.maximum.reduceat(v, heads, axis=0)
        x[has, WORD_DIM:] = best
        return x, (whole, (has, taken, lengths, v >= np.repeat(best, lengths, axis=0)))

    def learn(self, kept, dx: np.ndarray, rate: float) -> None:
        """A step of AdaGrad for the rows that were looked up."""
        whole, grams = kept
        for table, seen, slot, d in ((self.word, self.seen[0], whole, dx[:, :WORD_DIM]), (self.gram, self.seen[1], *self._to_grams(grams, dx))):
            if slot is None:
                continue
            rows, of = np.unique(slot, return_inverse=True)
            g = np.zeros((len(rows), d.shape[1]), np.float32)
            np.add.at(g, of, d)
            seen[rows] += g * g
            table[rows] -= np.float32(rate) * g / (np.sqrt(seen[rows]) + np.float32(1e-6))

    @staticmethod
    def _to_grams(grams, dx):
        if grams is None:
            return None, None
        has, taken, lengths, top = grams
        d = np.repeat(dx[has, WORD_DIM:], lengths, axis=0) * top
        some = d.any(1)
        return taken[some], d[some]


def numbered(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word in the texts' order, and the words of each text."""
    chunks, sizes = [], []
    for i in range(0, len(texts), 256):
        words, n = tokens(pa.array(texts[i : i + 256], pa.string()))
        chunks.append(words.dictionary_encode())
        sizes.append(n)
    coded = pa.chunked_array(chunks).unify_dictionaries()
    index = np.concatenate([np.asarray(c.indices) for c in coded.chunks])
    return coded.chunk(0).dictionary, index, np.concatenate(sizes)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict:
    """The model of these documents: embeddings and weights.  Without both classes the score is constant."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    vocabulary, index, sizes = numbered(texts)
    size = len(vocabulary)
    w_row, first, length = windows(sizes)
    if not len(w_row):
        return {"constant": float(y.mean())}
    row, at = np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.r_[0, np.cumsum(sizes)]
    df1, df0 = np.zeros(size), np.zeros(size)
    for i in range(0, len(y), 256):
        k = slice(at[i], at[min(i + 256, len(y))])
        pair = np.unique(row[k].astype(np.int64) * size + index[k])
        toxic = y[pair // size] == 1
        df1 += np.bincount((pair % size)[toxic], minlength=size)
        df0 += np.bincount((pair % size)[~toxic], minlength=size)
    tables = Embeddings(vocabulary, df1, df0, seed)
    index = index + np.int32(size) * (y[row] == 1)
    del row
    p, rng = start_weights(seed), np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    starts = np.flatnonzero(np.r_[True, w_row[1:] != w_row[:-1]])
    pending = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if step % RESELECT == 1:  # the first time, the window with the strongest word
            used = np.unique(index)
            x = np.empty((len(used), INPUTS), np.float32)
            for k in range(0, len(used), tables.CHUNK):
                x[k : k + tables.CHUNK] = tables.look(used[k : k + tables.CHUNK])[0]
            at, score = np.searchsorted(used, index), []
            for k in range(0, len(first), 512):
                place, mask = places(at, first[k : k + 512], length[k : k + 512])
                score.append((np.maximum(x, 0).sum(1)[place] * mask).max(0) if step == 1 else forward(p, x[place] * mask[:, :, None], mask)[0])
            chosen = np.lexsort((-np.concatenate(score), w_row))[starts]
            del x, at, score
        while len(pending) < BATCH:
            pending = np.concatenate([pending, rng.permutation(len(chosen))])
        k, pending = chosen[pending[:BATCH]], pending[BATCH:]
        numbers, mask = places(index, first[k], length[k])
        used, at = np.unique(numbers, return_inverse=True)
        x, kept = tables.look(used)
        at = at.reshape(numbers.shape)
        g = gradient(p, x[at] * mask[:, :, None], mask, y[w_row[k]])
        dx = g.pop("x")
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for name, v in g.items():
            v = v * np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
            a, b = moment[name]
            a += np.float32(0.1) * (v - a)
            b += np.float32(0.001) * (v * v - b)
            rate = np.float32(RATE * (1 - step / steps) + 1e-4)
            p[name] -= rate * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        d = np.zeros_like(x)
        np.add.at(d, at.ravel(), (dx * mask[:, :, None]).reshape(-1, INPUTS))
        tables.learn(kept, d, EMBED_RATE * (1 - step / steps))
    word, gram = tables.final()
    return {"weights": p, "word": word, "gram": gram}


def score_texts(model: dict, column: pa.Array) -> np.ndarray:
    """Scores of an Arrow column of texts; texts without words (null, empty) have 0."""
    if "constant" in model:
        return np.full(len(column), model["constant"])
    p, out = model["weights"], np.zeros(len(column))
    _, offsets, _ = string_buffers(column)
    for i, j in spans(offsets, STEP_BYTES):
        words, sizes = tokens(column.slice(i, j - i))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        x = np.empty((len(coded.dictionary), INPUTS), np.float32)
        for k in range(0, len(x), STEP_WORDS):
            slots = word_slots(coded.dictionary.slice(k, STEP_WORDS))
            x[k : k + STEP_WORDS] = inputs_of(slots[0], flat_grams(slots, len(slots[0])), model["word"], model["gram"])
        index = np.asarray(coded.indices).astype(np.int64)
        gates = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
        row, first, length = windows(sizes)
        logit = np.empty(len(row), np.float32)
        for k in range(0, len(row), STEP_WINDOWS):
            at, mask = places(index, first[k : k + STEP_WINDOWS], length[k : k + STEP_WINDOWS])
            logit[k : k + STEP_WINDOWS] = forward(p, x[at], mask, gates=(gates[0][at], gates[1][at]))[0]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[i + row[starts]] = sigmoid(np.maximum.reduceat(logit, starts).astype(np.float64))
    return out


# ---------------------------------------------------------------------------------------------- Spark

def held_out(id_column: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES) -> dict:
    """A model of the labelled rows that are not held out, trained in one task.

    A document counts as toxic if any of its label rows says so; null labels and ids say nothing.  Of rows with one id,
    the greatest text teaches.  Texts of the sample that exceed max_bytes together, in the order of the hash, are left out.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.md5(F.concat_ws(":", F.lit("toxicity"), F.col("doc_id").cast("string")).cast("binary"))
    picked = [known.where(F.col("toxic") == k).withColumn("at", order).orderBy("at", "doc_id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most max_positive + max_negative ids
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(sample, "doc_id").groupBy("doc_id", "toxic", "at").agg(F.max("text").alias("text"))

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for doc, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
                size += len(text.encode("utf-8", "replace"))
                if size <= max_bytes:
                    found.append((doc, text, label))
        found.sort()
        kinds, texts = np.array([k for _, _, k in found], np.float32), [t for _, t, _ in found]
        del found
        model = train(texts, kinds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # One task, of a bounded sample.  Its model, of a fixed size, is all that reaches the driver.
    (row,) = rows.repartition(1).sortWithinPartitions("at", "doc_id").select("doc_id", "text", "toxic").mapInArrow(bounded(run), "model binary").collect() or [None]
    return pickle.loads(row["model"]) if row else train([], np.empty(0))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score and predicted added; columns of these names get an underscore before them instead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, free_name(docs, "score"), free_name(docs, "predicted")]
    kinds = [*(f.dataType.simpleString() for f in docs.schema), "double", "int"]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, kinds))

    def run(batches):
        for batch in batches:
            s = score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    return docs.mapInArrow(bounded(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Null, empty and wordless texts score 0, however the model is (all texts score the labels' mean where one class is
    missing).  A null id counts as not held out and is never in the sample; repeated rows are scored one by one; empty
    tables give no rows; extra columns are ignored.
    """
    model = fit(docs, labels, max_positive, max_negative)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs whose score is under 0.5, in the columns of docs."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch.column("text")) < 0.5))

    return docs.mapInArrow(bounded(run), schema)
