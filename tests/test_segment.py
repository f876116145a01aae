"""Dictionary words, pieces and masked probabilities against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.functions.encoders import HashEncoder, hash_encoder
from glossa.operators import augment, pieces, segment

COUNTS = {"研究": 50, "研究生": 20, "生命": 30, "命": 5, "起源": 12, "the": 9, "he": 9, "cat": 4, "a": 7, "ab": 3, "b": 3, "x" * 33: 9}


def every_cut(block, words):
    """All segmentations: at each place the words there, or one character where there is none."""
    if not block:
        yield []
        return
    here = [w for w in words if block.startswith(w)] or [block[0]]
    for w in here:
        for rest in every_cut(block[len(w) :], words):
            yield [w, *rest]


def best(block, counts):
    total = sum(counts.values())

    def score(cut):
        value = 0.0
        for w in reversed(cut):  # summed from the right, as the path is
            value = (math.log(counts[w]) - math.log(total) if w in counts else -math.log(total)) + value
        return value

    return max(every_cut(block, counts), key=lambda cut: (score(cut), [len(w) for w in cut]))


def glued(cut):
    out, open_ascii = [], False
    for w in cut:
        lone = len(w) == 1 and w.isascii() and w.isalnum()
        if lone and open_ascii:
            out[-1] += w
        else:
            out.append(w)
        open_ascii = lone
    return out


def test_best_path_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 6) for _ in range(rng.randint(1, 8))}
        block = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        got = segment.Dictionary(counts, sum(counts.values())).cut(block)
        want = best(block, counts)
        assert "".join(got) == block
        assert got == glued(want), (block, counts)


def table(spark, counts=COUNTS):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


TEXTS = [(1, "研究生命起源, the cat!"), (2, None), (3, ""), (4, " a b ab12 \n thecat"), (5, "x" * 40 + "研究"), (1, "研究生命起源, the cat!"), (6, "a_b")]


def test_segment_with_and_without_broadcast(spark):
    texts = spark.createDataFrame(TEXTS, "k int, text string").repartition(3)
    near = sorted((r["k"], r["tokens"]) for r in segment.segment(texts, table(spark), ["k"]).collect())
    far = sorted((r["k"], r["tokens"]) for r in segment.segment(texts, table(spark), ["k"], limit=2).collect())
    assert near == far and len(near) == len(TEXTS)
    got = dict(near)
    assert got[1] == ["研究", "生命", "起源", ",", "the", "cat", "!"] and got[2] == got[3] == [] and got[6] == ["a", "_", "b"]
    assert got[4] == ["a", "b", "ab", "12", "the", "cat"] and "".join(got[5]) == "x" * 40 + "研究"
    assert segment.segment(texts.limit(0), table(spark), ["k"]).count() == 0


def test_registered_dictionary_mode(spark):
    tx.register_tokenizer("dict-test", segment.dictionary_tokenizer(table(spark)))
    rows = spark.createDataFrame([("thecat",)], "text string")
    assert rows.select(tx.tokenize(F.col("text"), "dict-test").alias("t")).first()["t"] == ["the", "cat"]
    assert rows.select(tx.token_length(F.col("text"), "dict-test").alias("n")).first()["n"] == 2
    with pytest.raises(ValueError, match="more than 2"):
        segment.dictionary_tokenizer(table(spark), limit=2)
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tx.tokenize(F.col("text"), "none")


# ---------------------------------------------------------------------------------------------- pieces

VECTORS = {"un": [1.0, 0.0, 0.0], "una": [0.0, 2.0, 0.0], "##ffable": [0.0, 0.0, 3.0], "##ff": [1.0, 1.0, 0.0], "##able": [0.0, 1.0, 1.0], "a": [1.0, 1.0, 1.0], "##a": [0.0, 0.0, 1.0]}


def greedy(word, vocabulary):
    out, i = [], 0
    while i < len(word):
        for k in range(len(word), i, -1):
            part = ("##" if i else "") + word[i:k]
            if part in vocabulary:
                break
        else:
            return ["[UNK]"] if "[UNK]" in vocabulary else None
        out.append(part)
        i = k
    return out if len(word) <= 100 else (["[UNK]"] if "[UNK]" in vocabulary else None)


def test_the_compact_dictionary_cuts_as_the_plain_one(spark, monkeypatch):
    rng = random.Random(8)
    counts = {"".join(rng.choice("abé1𝒳") for _ in range(rng.randint(1, 6))): rng.randint(1, 9) for _ in range(150)} | {"a" * 32: 5, "a" * 30: 3}
    texts = ["".join(rng.choice("abé1𝒳 ,\n") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "a" * 100]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    plain, made = segment.Dictionary(counts, sum(counts.values())), segment.compact(words)
    assert made.tokens(texts) == [plain.tokens(t) for t in texts] == made.tokens(texts)
    assert made.hashes.nbytes + made.logs.nbytes == 16 * len(counts)
    monkeypatch.setattr(segment, "STEP_CHARS", 10)
    monkeypatch.setattr(segment, "KEPT_BLOCKS", 3)
    assert [made.tokens([t])[0] for t in texts] == [plain.tokens(t) for t in texts]


@pytest.mark.parametrize("unknown", [False, True])
def test_pieces_and_static_vectors(spark, unknown):
    vectors = VECTORS | ({"[UNK]": [0.0, -1.0, 0.0]} if unknown else {})
    words = ["unaffable", "unable", "un", "una", "aaa", "a" * 100, "a" * 101, "zebra", "unz", "a"]
    rows = spark.createDataFrame([(w,) for w in [*words, "a", None, ""]], "word string")
    vocabulary = spark.createDataFrame(list(vectors.items()), "piece string, vec array<double>")
    got = {r["word"]: r["pieces"] for r in pieces.segment(rows, vocabulary).collect()}
    assert got == {w: greedy(w, vectors) for w in words}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {w: unit(np.mean([unit(vectors[p]) for p in cut], axis=0)) for w, cut in got.items() if cut}
    made = {r["word"]: r["vec"] for r in pieces.word_vectors(rows, vocabulary).collect()}
    assert set(made) == set(want) and all(np.allclose(made[w], want[w]) for w in want)


def test_an_empty_vocabulary(spark):
    none = spark.createDataFrame([], "piece string, vec array<double>")
    rows = spark.createDataFrame([("a",)], "word string")
    assert [r["pieces"] for r in pieces.segment(rows, none).collect()] == [None] and pieces.word_vectors(rows, none).count() == 0


# ---------------------------------------------------------------------------------------------- masked model

def test_probabilities_merge_over_partitions(spark):
    rng = np.random.default_rng(5)
    names = [f"p{k}" for k in range(120)]
    logits = {(s, i): np.round(rng.normal(0, 30, 120), 1) for s in ("a", "b", None) for i in (0, 3)}
    logits[("a", 0)][:] = 7.0  # all equal: ranks by piece
    logits[("b", 0)][5] = 900.0
    rows = [(s, i, p, float(x)) for (s, i), row in logits.items() for p, x in zip(names, row)]
    random.Random(1).shuffle(rows)
    got = {}
    for r in pieces.probabilities(spark.createDataFrame(rows, "s string, idx int, piece string, logit double").repartition(7), ["s"], 10).collect():
        got.setdefault((r["s"], r["idx"]), {})[r["rank"]] = (r["cand"], r["p"])
    assert set(got) == set(logits)
    for key, row in logits.items():
        p = np.exp(row - row.max()) / np.exp(row - row.max()).sum()
        order = sorted(range(120), key=lambda k: (-row[k], names[k]))[:10]
        assert [got[key][n + 1][0] for n in range(10)] == [names[k] for k in order]
        assert np.allclose([got[key][n + 1][1] for n in range(10)], p[order])


def test_masks_out_of_reach_have_no_logits(spark):
    rows = [("in", ["the", "cat", "sat"], 1), ("cut", ["word"] * 9, 8), ("out", ["a", "b"], 2), ("under", ["a"], -1), ("none", None, 0), ("index", ["a"], None)]
    vocabulary = spark.createDataFrame([("cat", [1.0] * 12), ("dog", [-1.0] * 12)], "piece string, vec array<double>")
    requests = spark.createDataFrame(rows, "s string, tokens array<string>, idx int")
    got = pieces.mask_logits(requests, ["s"], hash_encoder, vocabulary, max_len=8).collect()
    assert {r["s"] for r in got} == {"in"} and len(got) == 2
    e = HashEncoder()
    ids = np.array([[e.first, *e.pieces("the"), e.pieces("[MASK]")[0], *e.pieces("sat"), e.last]])
    hidden = e.forward(ids, np.ones_like(ids, bool))[0][0, 2]
    assert np.allclose({r["piece"]: r["logit"] for r in got}["cat"], hidden.sum() / np.sqrt(12))


def test_best_pieces_come_from_the_task_that_has_the_logits(spark):
    rng, n = random.Random(4), 70
    words = ["the", "cat", "sat", "longerword", "on", "a"]
    rows = [(f"s{k % 9}", k, [rng.choice(words) for _ in range(rng.randint(1, 9))], rng.randint(-1, 8)) for k in range(60)] + [("none", 99, None, 0)]
    vocabulary = spark.createDataFrame([(f"p{k}", [float((k // 2 * d) % 7 - 3) for d in range(12)]) for k in range(n)], "piece string, vec array<double>")  # pairs of equal vectors
    requests = spark.createDataFrame(rows, "s string, r int, tokens array<string>, idx int")
    made = pieces.mask_probabilities(requests, ["s", "r"], hash_encoder, vocabulary, max_len=8, top=5)
    want = {}
    for r in pieces.probabilities(pieces.mask_logits(requests, ["s", "r"], hash_encoder, vocabulary, max_len=8), ["s", "r"], 5).collect():
        want.setdefault((r["s"], r["r"], r["idx"]), {})[r["rank"]] = (r["cand"], r["p"])
    got = {(r["s"], r["r"], r["idx"]): {b["rank"]: (b["cand"], b["p"]) for b in r["best"]} for r in made.collect()}
    assert set(got) == set(want) and len(got) == 20 and made.count() == len(got)
    for key, best in want.items():
        assert {k: c for k, (c, _) in got[key].items()} == {k: c for k, (c, _) in best.items()}
        assert np.allclose([got[key][k][1] for k in best], [best[k][1] for k in best])


def test_only_candidates_of_one_piece_pass(spark):
    rows = spark.createDataFrame([("s", 0, "w", c) for c in ("a", "una", "unable", "zebra", "un")], "s string, idx int, word string, cand string")
    vocabulary = spark.createDataFrame([(p,) for p in VECTORS], "piece string")
    table = spark.createDataFrame([("s", 0, "a", 0.5, 1), ("s", 0, "una", 0.005, 2), ("s", 0, "un", 0.3, 51), ("s", 0, "unable", 0.4, 3), ("s", 1, "a", 0.9, 1)], "s string, idx int, cand string, p double, rank long")
    assert [r["cand"] for r in pieces.masked_filter(rows, table, vocabulary, ["s"]).collect()] == ["a"]


@pytest.mark.parametrize("unknown", [False, True])
def test_variants_by_vectors_made_in_the_tasks(spark, unknown):
    """vectors of words made where the sentences are equal those of the joins, and no table of all words is made."""
    parts = [("a", [1.0, 0.5]), ("ab", [0.2, 1.0]), ("##b", [0.0, 3.0]), ("##ca", [2.0, -1.0]), ("é", [1.0, 1.0]), ("zero", [0.0, 0.0])] + [("[UNK]", [1.0, -2.0])] * unknown
    table = spark.createDataFrame(parts, "piece string, vec array<double>")
    words = ["a", "ab", "abb", "abca", "é", "éb", "zero", "ax", "q", "a" + "b" * 120, ""]
    vectors = pieces.word_vectors(spark.createDataFrame([(w,) for w in words], "word string"), table)
    want = {r["word"]: r["vec"] for r in vectors.collect()}
    has, made = pieces.word_table(table)(pa.array(words))
    assert {w for w, x in zip(words, has) if x and w} == set(want) and all(np.allclose(v, want[w]) for w, v in zip(words, made) if w in want)
    assert pieces.word_table(table, limit=3) is None

    rows = [(1, ["a", "ab", "q", "éb"]), (2, ["abb", None, "zero"]), (3, ["é"]), (4, []), (5, None), (6, ["ax", "abca", "abca"]), (7, ["éb", "q"]), (8, ["ab"])]
    sentences = spark.createDataFrame(rows, "k int, tokens array<string>").coalesce(1)
    pairs = spark.createDataFrame([("pos", "ab", "a"), ("pos", "ab", "abb"), ("pos", "a", "q"), ("pos", "abca", "é"), ("pos", "é", "ab"), ("pos", "ab", None)], "kind string, word string, cand string")
    plain = {r["k"]: r["v"] for r in augment.listed_variants(sentences, pairs, vectors, ["k"], -1.0, -1.0).collect()}
    failing = vectors.where(F.raise_error(F.lit("the table of all words is made")).isNull())
    got = {r["k"]: r["v"] for r in augment.listed_variants(sentences, pairs, failing, ["k"], -1.0, -1.0, make=pieces.word_table(table)).collect()}
    rounded = lambda v: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in v]
    assert {k: rounded(v) for k, v in got.items()} == {k: rounded(v) for k, v in plain.items()} and sum(map(len, got.values())) > 5
    none = augment.listed_variants(sentences, pairs.limit(0), failing, ["k"], make=pieces.word_table(table)).collect()
    assert len(none) == len(rows) and not any(r["v"] for r in none)
