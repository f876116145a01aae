"""Mechanisms that stand in for whole-table or whole-group work, against the plain definitions."""

import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.operators import automaton, postings, prototypes, sampling


# ---------------------------------------------------------------------------------------------- many words

def regex_matches(text, words):
    pattern = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return re.findall(pattern, text) if pattern else []


@pytest.mark.parametrize("limit", [1000, 3])
def test_matches_equal_the_regex(spark, limit):
    rng = random.Random(2)
    for _ in range(3):
        words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(9)}
        texts = [(k, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(40, None), (41, ""), (0, "abcab")]
        table = spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
        got = automaton.matches(spark.createDataFrame(texts, "k int, text string").repartition(3), table, ["k"], "text", limit=limit).collect()
        want = [(k, regex_matches(t, words)) for k, t in texts if t]
        assert sorted((r["k"], r["words"]) for r in got) == sorted((k, w) for k, w in want if w)


def test_no_words(spark):
    none = spark.createDataFrame([], "word string")
    assert automaton.matches(spark.createDataFrame([(1, "a")], "k int, text string"), none, ["k"], "text").count() == 0


def test_many_words_take_time_in_proportion_to_the_text():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12))) for _ in range(100_000)}
    machine = automaton.build(words)
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        spans = automaton.chosen(automaton.longest(machine, text[:n]))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.2
    small = text[:3000]  # by definition: at each free place the longest word
    want, at = [], 0
    while at < len(small):
        size = next((k for k in range(12, 2, -1) if small[at : at + k] in words and at + k <= len(small)), 0)
        want += [(at, at + size)] * (size > 0)
        at += size or 1
    assert [x for x in automaton.chosen(automaton.longest(machine, small))] == want and spans


# ---------------------------------------------------------------------------------------------- shares of groups

@pytest.mark.parametrize("q", [0.05, 0.5, 0.6, 1.0])
def test_top_share_by_definition(spark, q):
    rng = random.Random(6)
    rows = [(g, k, s) for g, n in (("a", 500), ("b", 1), ("c", 37), (None, 3)) for k in range(n) for s in [rng.choice([rng.uniform(-1, 1), 0.25, 5.0, -7.0, None])]]
    rows += [("tied", k, 0.5) for k in range(90)]
    table = spark.createDataFrame(rows, "g string, item int, s double").repartition(5)
    got = sorted((r["g"], r["item"]) for r in prototypes.top_share(table, ["g"], "item", "s", q).where("g is not null").collect())
    want = []
    for g in ("a", "b", "c", "tied"):
        own = sorted(((k, s) for h, k, s in rows if h == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        want += [(g, k) for k, _ in own[: max(1, -(-int(round(len(own) * q * 1000)) // 1000))]]
    assert got == sorted(want)


def test_top_share_ranks_the_border_only(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"), (F.col("id") / 2000 - 1).alias("s"))
    chosen = prototypes.top_share(rows, ["g"], "item", "s", 0.5)
    assert chosen.count() == 2000 and chosen.agg(F.min("s")).first()[0] == 0.0
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and re.search(r"Window.*row_number.*\n.*\n?.*Join Inner, .*_step#\d+ = _end", plan)


# ---------------------------------------------------------------------------------------------- draws

def test_different_draws_are_uniform_sets(spark):
    draws = spark.range(6000).select(sampling.different_draws(F.lit(5).cast("long"), 2, "t", F.col("id")).alias("d")).collect()
    sets = Counter(frozenset(r["d"]) for r in draws)
    assert set(sets) == {frozenset(x) for x in itertools.combinations(range(5), 2)}
    assert sum((n - 600) ** 2 / 600 for n in sets.values()) < 28  # chi-square of 9 degrees at 0.001
    every = spark.range(50).select(sampling.different_draws(F.lit(4).cast("long"), 4, "t", F.col("id")).alias("d")).collect()
    assert all(sorted(r["d"]) == [0, 1, 2, 3] for r in every)


def test_batches_have_different_rows_and_no_cross_join(spark):
    index = spark.createDataFrame([(s, k) for s, n in (("a", 40), ("b", 3), ("c", 8), ("d", 9), ("e", 100)) for k in range(n)], "sense_id string, doc int")
    out = sampling.two_stage_batches(index, "doc", 400, 16, 4)
    rows = out.collect()
    assert len(rows) == 400 // 16 * 16
    for batch in range(25):
        own = [r for r in rows if r["batch"] == batch]
        assert len({r["sense_id"] for r in own}) == 4
        for s in {r["sense_id"] for r in own}:
            docs = [r["doc"] for r in own if r["sense_id"] == s]
            assert len(docs) == 4 and (s == "b" or len(set(docs)) == 4)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    few = sampling.two_stage_batches(index.where("sense_id in ('a', 'e')"), "doc", 64, 16, 4).collect()
    assert len(few) == 64
    with pytest.raises(ValueError, match="no group"):
        sampling.two_stage_batches(index.limit(0), "doc", 64, 16, 4)


# ---------------------------------------------------------------------------------------------- postings

def test_postings_come_back_and_stay_in_blocks(spark):
    rng = random.Random(8)
    rows = [(rng.randint(-50, 400), [rng.choice(["the", "a", "b", "c", None]) for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    rows = list({k: t for k, t in rows}.items()) + [(None, ["x"])]
    table = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4)
    index = postings.build(table, block=16)
    assert index.agg(F.max("n_docs")).first()[0] <= 16
    assert all(sum(r["docs"]) == r["last"] and len(r["places"]) == r["n"] == sum(r["counts"]) for r in index.collect())
    want = sorted((w, d, p) for d, t in rows if d is not None for p, w in enumerate(t) if w)
    assert sorted((r["word"], r["doc"], r["pos"]) for r in postings.occurrences(index).collect()) == want
    wanted = [(1, ["the", "a"]), (2, ["a", "a", "b"]), (3, ["the", "missing"]), (4, ["c"])]
    asked = spark.createDataFrame([(k, n, w) for k, ws in wanted for n, w in enumerate(ws)], "phrase int, slot int, word string")
    scan = sorted((k, d, p) for k, ws in wanted for d, t in rows if d is not None for p in range(len(t)) if t[p : p + len(ws)] == ws)
    assert sorted(tuple(r) for r in postings.phrases(index, asked).collect()) == scan
    assert postings.build(table.limit(0)).count() == 0


def test_a_word_is_shuffled_once_for_each_block_of_a_batch(spark):
    rows = [(7, ["a", "b", "a"]), (7, ["a"]), (None, ["a"]), (8, None), (9, ["b", None, "a"]), (-1, ["a"]), (20, ["a"])]
    table = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    one = table.coalesce(1)
    assert postings.partial_lists(one, "doc_id", 16).count() == 4  # a in three blocks, b in one
    want = [("a", -1, 0), ("a", 7, 0), ("a", 7, 0), ("a", 7, 2), ("a", 9, 2), ("a", 20, 0), ("b", 7, 1), ("b", 9, 0)]
    for t in (one, table.repartition(7)):
        index = postings.build(t, block=16)
        assert sorted((r["word"], r["doc"], r["pos"]) for r in postings.occurrences(index).collect()) == sorted(want)
        assert {(r["word"], r["block"]): (r["n_docs"], r["n"], r["last"]) for r in index.collect()} == {("a", -1): (1, 1, -1), ("a", 0): (2, 4, 9), ("a", 1): (1, 1, 20), ("b", 0): (2, 2, 9)}
