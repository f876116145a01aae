"""Groups of near-duplicates that a star of comparisons does not settle, against brute force over full sets."""

import random
import re

import pytest

from glossa.llm import components as merging
from glossa.llm import near_dedup


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"e{rng.randrange(40)}"
    return out


def ring(rng, base):
    """Copies on both sides of the bound, some of them copies of copies."""
    out = [edited(rng, base, rng.randint(0, 14)) for _ in range(90)]
    return out + [edited(rng, rng.choice(out), rng.randint(1, 3)) for _ in range(60)]


def cuts(rng, base):
    """Beginnings, endings and middles of one text, of many lengths: most are linked without a word of their own."""
    out = []
    for _ in range(100):
        n = rng.randint(40, len(base))
        a = rng.choice([0, len(base) - n, rng.randint(0, len(base) - n)])
        out.append(base[a : a + n])
    return out


def growing(rng, base):
    """Each a little longer than the one before: a chain whose ends have little in common."""
    return [base[: 40 + 4 * k] for k in range(25)] + [edited(rng, base[: 40 + 4 * k], 2) for k in range(0, 25, 3)]


@pytest.mark.parametrize("shape", [ring, cuts, growing])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, shape, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    made = shape(rng, base)
    rng.shuffle(made)
    rows = [(k, " ".join(w)) for k, w in enumerate(made)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7), (None, "a b c", 5, 6, 7)], "doc_id long, text string, kept_id long, kept long, component_id long")
    kept = near_dedup.dedup(rows)
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_components_send_no_table_through_the_driver(spark, monkeypatch):
    """The plans that ran, small as their tables are: each join of two tables is a shuffle."""
    plans, cut = [], merging.cut

    def noted(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(merging, "cut", noted)
    labels = spark.createDataFrame([(i, i) for i in range(40)], "id long, comp long")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 35), (35, 39)], "a long, b long")
    got = {r.id: r.comp for r in merging.merge_labels(labels, links).collect()}
    assert got == {i: 0 if i <= 20 else 30 if i in (30, 35, 39) else i for i in range(40)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_rounds_of_components_are_single_jobs(spark):
    """A hub with many members takes one round, whose plans are no adaptive ones; the session's setting is as before."""
    labels = spark.createDataFrame([(i, i) for i in range(200)], "id long, comp long")
    links = spark.createDataFrame([(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(150, 154)], "a long, b long")
    before, sc = spark.conf.get("spark.sql.adaptive.enabled"), spark.sparkContext
    sc.setJobGroup("merge", "merge")
    merged = merging.merge_labels(labels, links)
    sc.setJobGroup("after", "after")
    got = {r.id: r.comp for r in merged.collect()}
    assert got == {i: 0 if i < 150 else 150 if i <= 154 else i for i in range(200)}
    assert len(sc.statusTracker().getJobIdsForGroup("merge")) <= 16
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_dense_group_is_settled_by_neighbours(spark, monkeypatch):
    """Copies around one text, each linked with many others: few pairs are left to the comparison of all that are apart."""
    rng, compared, agreement = random.Random(5), [], near_dedup.agreement

    def noted(pairs, sets):
        compared.append(pairs.count())
        return agreement(pairs, sets)

    monkeypatch.setattr(near_dedup, "agreement", noted)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    variants = [(rng.randrange(len(base)), f"e{k}") for k in range(12)]
    rows = []
    for i in range(300):
        words = list(base)
        for k, word in rng.sample(variants, 4):
            words[k] = word
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)
    assert sum(compared) < 3 * len(rows)
