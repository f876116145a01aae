"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams of 1 to 4 characters of a text's letter runs (lower case, a space before and after) fall into
2**`bits` slots.  Training counts them per language in one pass over all training rows, merged by slot in Spark, so that
only the finished matrix of slots by languages (bounded by `bits` and `max_languages`) reaches the driver.  Scoring
broadcasts that matrix of log probabilities.  A batch is scored as sparse rows: its distinct words get one vector each,
the sum of their n-grams' log probabilities, and a document is the sum of its words' vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, free_name, mix64, spans, string_buffers

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Languages in the model; more are refused rather than dropped.
MAX_LANGUAGES = 1000
SMOOTHING = 0.1
UNKNOWN = "und"


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and their marks of all rows, and each row's number of them; marks alone are no run."""
    spaced = pc.replace_substring_regex(pc.fill_null(pc.utf8_lower(column), ""), pattern=r"[^\pL\pM]+", replacement=" ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    words, sizes = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
    filled = np.asarray(pc.match_substring_regex(words, r"\pL"))
    if not filled.all():
        rows = np.repeat(np.arange(len(sizes)), sizes)[filled]
        words, sizes = words.filter(pa.array(filled)), np.bincount(rows, minlength=len(sizes))
    return words, sizes


def slots_of(words: pa.Array, bits: int, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of each n-gram of each word; a word is padded by one space on either side."""
    text = pc.binary_join_element_wise("", words, "", " ")
    raw, offsets, _ = string_buffers(text)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.asarray(pc.utf8_length(text)).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out_slot, out_row, value = [], [], mix64(points + np.uint64(0x1234567))
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x5851F42D4C957F2D) + value[n - 1 :]
        if n not in orders:
            continue
        same = row[:m] == row[n - 1 :]
        if n == 1:
            same = points != 32
        out_slot.append((mix64(code[same] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        out_row.append(row[:m][same])
    if not out_slot:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_slot), np.concatenate(out_row)


def fit(labelled: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING, max_languages: int = MAX_LANGUAGES):
    """(languages, float32 matrix [2**bits + 1, languages]) from text and lang; the last row has the log priors.

    Rows with a null lang or no letters teach nothing.
    """
    languages = [r[0] for r in labelled.where("lang is not null").groupBy("lang").count().orderBy("lang").select("lang").limit(max_languages + 1).collect()]
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    number = {x: k for k, x in enumerate(languages)}
    if not languages:
        return [], np.zeros(((1 << bits) + 1, 1), np.float32)

    def count(batches):
        table = np.zeros((len(number), 1 << bits), np.int64)
        rows = np.zeros(len(number), np.int64)
        for batch in batches:
            _, offsets, _ = string_buffers(batch.column("text"))
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()])
            for i, j in spans(offsets):
                words, sizes = words_in(batch.column("text").slice(i, j - i))
                label = np.repeat(lang[i:j], sizes)
                rows += np.bincount(lang[i:j][sizes > 0], minlength=len(number))[: len(number)]
                coded = words.dictionary_encode()
                slot, word = slots_of(coded.dictionary, bits)
                index = np.asarray(coded.indices)
                for k in range(len(number)):
                    weight = np.bincount(index[label == k], minlength=len(coded.dictionary))
                    if weight.any():
                        table[k] += np.bincount(slot, weights=weight[word], minlength=1 << bits).astype(np.int64)
        for k in range(len(number)):
            used = np.flatnonzero(table[k])
            yield pd.DataFrame({"k": k, "slot": np.append(used, -1).astype(np.int32), "n": np.append(table[k][used], rows[k])})

    def arrow(batches):
        for frame in count(batches):
            yield pa.RecordBatch.from_pandas(frame.astype({"k": "int32", "slot": "int32", "n": "int64"}), preserve_index=False)

    # At most languages * 2**bits sums reach the driver.
    sums = labelled.where("lang is not null").select("text", "lang").mapInArrow(bounded(arrow), "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts, rows = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    grams = sums[sums.slot >= 0]
    counts[grams.slot, grams.k] = grams.n
    prior = sums[sums.slot < 0]
    rows[prior.k] = prior.n
    log = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * (1 << bits))
    return languages, np.vstack([log, np.log(rows + 1) - np.log((rows + 1).sum())]).astype(np.float32)


def predict(docs: DataFrame, model, bits: int = BITS) -> DataFrame:
    """docs without text, with lang_pred and score, the posterior of lang_pred; columns of these names in docs get an
    underscore before the new ones instead."""
    languages, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "text"] + [f"`{free_name(docs, 'lang_pred')}` string", f"`{free_name(docs, 'score')}` double"])
    out = [*others, free_name(docs, "lang_pred"), free_name(docs, "score")]
    names = np.array([*languages, UNKNOWN], object)

    def run(batches):
        log = shared.value
        for batch in batches:
            text = batch.column("text")
            _, offsets, _ = string_buffers(text)
            best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            for i, j in spans(offsets, CHUNK_BYTES):
                words, sizes = words_in(text.slice(i, j - i))
                if not len(words) or not languages:
                    continue
                coded = words.dictionary_encode()
                slot, word = slots_of(coded.dictionary, bits)
                size = len(coded.dictionary)
                index, row = np.asarray(coded.indices), np.repeat(np.arange(j - i), sizes)
                total = np.stack([np.bincount(row, weights=np.bincount(word, weights=log[slot, k], minlength=size)[index], minlength=j - i) for k in range(len(languages))], 1)
                total += log[-1]
                best[i:j] = np.where(sizes > 0, total.argmax(1), len(languages))
                odds = np.exp(total - total.max(1, keepdims=True))
                score[i:j] = np.where(sizes > 0, 1 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], out
            )

    return docs.mapInArrow(bounded(run), schema)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score; learned from the rows that are not held out.

    A row is held out if crc32(doc_id as text) mod folds is held_fold; a null id counts as not held out.  A null text and
    one without letters is `und` with score 0, as is everything if no row teaches a language.  Repeated rows are
    predicted, and teach, one by one; ties go to the language that sorts first; empty tables give no rows; extra columns
    are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.where("not held_out"))
    return predict(rows.drop("lang"), model)
