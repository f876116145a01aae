import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.functions import vectors as vc
from glossa.operators import augment, lexicon, metrics, sampling, similarity, splitting
from glossa.operators.prototypes import trimmed_center


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_sentences_keep_their_marks(spark):
    assert one(spark, tx.split_sentences(F.col("t")), t="甲。乙！！丙") == ["甲。", "乙！", "！", "丙"]
    assert one(spark, tx.split_sentences(F.col("t")), t="") == []
    assert one(spark, tx.split_sentences(F.col("t"), ".", newline=True), t="a b. c\n d ") == ["a b.", "c", "d"]


def test_colon(spark):
    split = lambda t, n: one(spark, tx.split_at_colon(F.col("t"), F.lit(n), 80), t=t)
    assert split("甲：乙", 81) == ["甲：", "乙"]
    assert split("甲：乙", 80) == ["甲：乙"]
    assert split("：乙", 81) == ["乙"]
    assert split("甲：", 81) == ["甲："]


def test_names(spark):
    name = lambda t, n=120: one(spark, tx.file_name(F.col("t"), n), t=t)
    assert name('a/b:c*?"d  e ') == "a_b_c_d e"
    assert name("   ") == "untitled"
    assert name("ab  cd", 3) == "ab"


def test_unicode_space(spark):
    assert one(spark, tx.split_words(F.col("t")), t="﻿a　b  c ") == ["a", "b", "c"]
    assert one(spark, tx.split_words(F.col("t")), t=" ") == []


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        tx.tokenize(F.lit("a"), "none")


def test_spans(spark):
    assert tuple(one(spark, tx.protected_span(F.col("t"), F.lit("x"), 1), t=["a", "x", "b"])) == (0, 2)
    assert one(spark, tx.protected_span(F.col("t"), F.lit("q"), 1), t=["a"]) is None
    offsets = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")), F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(4).alias("e")))
    assert one(spark, tx.first_overlap(offsets, F.lit(3), F.lit(4))) == 2
    assert one(spark, tx.first_overlap(offsets, F.lit(9), F.lit(10))) == 0


def test_chunks():
    words = [f"w{k}" for k in range(10)]
    assert splitting.chunk(words, limit=10) == ["".join(words)]
    assert splitting.chunk(words, limit=4, least=1) == ["w0w1w2w3", "w4w5w6w7", "w8w9"]
    marked = ["a", "，", "b", "c", "d", "e"]
    assert splitting.chunk(marked, limit=4, least=1) == ["a，", "bcde"]
    assert splitting.chunk(marked, limit=4, least=3) == ["bcde"]  # a short chunk that is not the last goes
    assert splitting.chunk(["a", "b", "x", "d", "e"], limit=2, target="x", window=9, least=1) == ["ab", "xd", "e"]
    assert splitting.chunk([], limit=2) == []


def test_decode_labels(spark):
    offsets = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    decode = lambda labels: one(spark, splitting.decode_labels(F.lit("abcdef"), F.array(*[F.lit(x) for x in labels]), offsets))
    assert decode("SBMESS") == ["a", "bcd", "e", "f"]
    assert decode("BBEXIM") == ["a", "bc", "d", "ef"]
    assert decode("BIIIII") == ["abcdef"]


def test_vectors(spark):
    assert one(spark, vc.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vc.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 2.0
    with pytest.raises(ValueError):
        vc.distance(F.lit(None), F.lit(None), "city")


def test_trimmed_center(spark):
    rows = [(0, k, v) for k, v in enumerate([[1.0, 0.0], [0.8, 0.6], [0.6, 0.8], [-1.0, 0.0], [0.0, 1.0]])]
    mu = trimmed_center(spark.createDataFrame(rows, "g int, item int, vec array<double>"), ["g"], "item").first()["mu"]
    assert mu == pytest.approx([0.503871, 0.863779], abs=1e-6)


def test_golden_metrics(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "row_no long, vec array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 0.6, 0.8])], "row_no long, vec array<double>")
    out = metrics.retrieval(q, c, (0, 1)).first()
    assert (out["n"], round(out["mrr"], 6), round(out["r_at_1"], 6)) == (3, 0.833333, 0.666667)
    assert metrics.retrieval(q.limit(0), c).first()["mrr"] == 0.0
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "k long, vec array<double>")
    assert metrics.local_uniformity(p, "k", 1).first()[0] == pytest.approx(-4.0)
    assert metrics.local_uniformity(p, "k", 9).first()[0] == pytest.approx(-4.449998, abs=1e-6)
    assert metrics.local_uniformity(p.limit(1), "k", 1).first()[0] == 0.0
    z = spark.createDataFrame([(0, 0, [1.0, 0.0], [0.8, 0.6]), (0, 1, [0.0, 1.0], [0.6, 0.8])], "batch_id int, row_no int, z1 array<double>, z2 array<double>")
    assert metrics.infonce(z).first()["loss"] == pytest.approx(1.629410, abs=1e-6)
    t = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6], [0.6, 0.8])], "anchor array<double>, pos array<double>, neg array<double>")
    assert metrics.triplet(t).first()[0] == 0.0
    assert metrics.triplet(t, metric="cosine").first()[0] == pytest.approx(0.1)
    assert metrics.triplet(t, positive="neg", negative="pos").first()[0] == pytest.approx(0.7)
    assert metrics.retrofit(t.limit(0), a="anchor", b="pos").first()[0] == 0.0


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_VALUES", 2)
    q = spark.createDataFrame([(k, [float(k == 0), float(k == 1), float(k == 2)]) for k in range(3)], "item int, vec array<double>")
    c = spark.createDataFrame([(k, [float(k == 0), float(k == 1), float(k >= 2)]) for k in range(4)], "g int, vec array<double>")
    assert {r["item"]: (r["best_g"], r["sim"]) for r in similarity.nearest(q, c, "item", "g").collect()} == {0: (0, 1.0), 1: (1, 1.0), 2: (2, 1.0)}


def test_adversarial_lexicon(spark):
    lex = lexicon.from_text(spark, "﻿A01= a b　c\n\nD01=\nA01= a d\nE01@ x y\nF01# a").cache()
    assert {r[1] for r in lexicon.senses(lex).collect()} == {"A01", "D01", "F01"}
    assert sorted(tuple(r) for r in lexicon.groups(lex).select("group_id", "word").collect()) == [("A01=", "a"), ("A01=", "d")]
    assert sorted(r["word"] for r in lexicon.mono_words(lex).collect()) == ["d"]  # a stands in two lines of one code
    assert "a" in {r[0] for r in lexicon.keys(lex, "#").collect()} and lexicon.pairs(lex, "#").count() == 0


def test_batches_are_checked():
    for size, k in ((4, 0), (5, 2), (2, 4)):
        with pytest.raises(ValueError):
            sampling.check_batches(size, k)


def test_few_groups_are_drawn_with_replacement(spark):
    index = spark.createDataFrame([("s", 1), ("s", 2)], "sense_id string, id long")
    rows = sampling.two_stage_batches(index, "id", 8, 4, 4).collect()
    assert len(rows) == 8 and {r["sense_id"] for r in rows} == {"s"}


def test_numeric_order_and_bad_keys(spark):
    e = spark.createDataFrame([(1, ["a", "b"] * 6, {"10": [["x"] * 12], "9": [["y"] * 12], "no": [["z"]]}, None)], "id int, tokens array<string>, pos map<string,array<array<string>>>, hard_neg map<string,array<array<string>>>")
    v = augment.normal_form(e, ["id"])
    assert v.count() == 2
    assert sampling.first_positive(v, ["id"]).first()["idx"] == 9
    s = sampling.samples(e, v.where("idx > 99"), ["id"]).first()
    assert (s["word_idx"], s["has_retrofit"], s["s_pos_tokens"]) == (-1, 0, s["s_tokens"])


def test_fallback_to_templates(spark):
    row = lambda *x: spark.createDataFrame([x], "csc double, mu_same double, mu_related double, margin double")
    template = row(0.9, 0.8, 0.3, 0.5)
    got = lambda *x: tuple(metrics.with_fallback(row(*x), template).first())
    assert got(0.5, 0.4, 0.1, 0.3) == (0.5, 0.4, 0.1, 0.3)
    assert got(0.0, 0.4, 0.1, 0.3) == (0.9, 0.4, 0.1, 0.3)
    assert got(0.5, 0.0, 0.0, 0.0) == (0.5, 0.8, 0.3, 0.5)
    assert got(0.5, 0.0, 0.1, -0.1) == (0.5, 0.0, 0.1, -0.1)


def test_triplets_without_negatives_are_left_out(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6], [0.6, 0.8]), ([1.0, 0.0], [0.6, 0.8], [0.8, 0.6]), ([1.0, 0.0], [0.6, 0.8], None)], "anchor array<double>, pos array<double>, neg array<double>")
    assert abs(metrics.triplet(rows).first()["loss"] - 0.35) < 1e-12  # 0.0 and 0.7


def test_chunks_of_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        words = ["w", " "] * n
        began = time.perf_counter()
        assert splitting.chunk(["w", ","] * n, soft=frozenset(",")) and splitting.chunk([" "] * 59 + words)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize("block, step", [(1 << 22, 7), (40, 3)])
def test_ranks_in_small_steps(spark, monkeypatch, block, step):
    monkeypatch.setattr(similarity, "BLOCK_VALUES", block)
    monkeypatch.setattr(similarity, "STEP_VALUES", step)
    rng = np.random.default_rng(2)
    q, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(23, 4)), rng.normal(size=(23, 4))))
    c[5] = c[9]  # equal candidates favour the query's own
    made = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "row_no long, vec array<double>").repartition(3)
    sims = q @ c.T
    want = {k: 1 + int((sims[k] > sims[k, k] + 1e-12).sum()) for k in range(23)}
    assert {r["row_no"]: r["rank"] for r in similarity.ranks(made(q), made(c)).collect()} == want
    near = similarity.nearest(made(q).withColumnRenamed("row_no", "item"), made(c), "item", "row_no")
    assert {r["item"]: r["best_row_no"] for r in near.collect()} == {k: int(sims[k].argmax()) for k in range(23)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_listed_variants_equal_joined_ones(spark, limit):
    rng, words = np.random.default_rng(3), [f"w{k}" for k in range(12)]
    sentences = spark.createDataFrame([(k, [str(rng.choice([*words, "x", "y"])) for _ in range(int(rng.integers(0, 9)))]) for k in range(60)] + [(99, None), (100, ["w1"])], "s int, tokens array<string>")
    vec = spark.createDataFrame([(w, rng.normal(size=5).tolist()) for w in words[:10]], "word string, vec array<double>")
    rows = sorted({(str(rng.choice(["a", "b"])), str(rng.choice(words)), str(rng.choice(words))) for _ in range(90)})
    pairs = spark.createDataFrame([r for r in rows if r[1] != r[2]], "kind string, word string, cand string")
    made = augment.listed_variants(sentences, pairs, vec, ["s"], -0.2, -0.3, most=2, limit=limit)
    got = {(r["s"], r["kind"], r["idx"], r["word"], r["cand"], r["cand_ord"]): (r["word_sim"], r["ctx_sim"]) for r in made.select("s", F.inline("v")).collect()}
    want, contexts = {}, augment.context_vectors(sentences, vec, ["s"])
    for kind in ("a", "b"):
        joined = augment.embedding_filter(contexts, pairs.where(F.col("kind") == kind).select("word", "cand"), vec, -0.2, -0.3)
        for r in augment.first_candidates(joined, ["s"], 2).collect():
            want[(r["s"], kind, r["idx"], r["word"], r["cand"], r["cand_ord"])] = (r["word_sim"], r["ctx_sim"])
    assert set(got) == set(want) and len(want) > 50 and made.count() == 62
    for key, sims in want.items():
        assert got[key] == tuple(None if x is None else pytest.approx(x) for x in sims)
