"""Fingerprints, fill-in-middle and token alignment on small tables, against brute force and their SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from glossa.llm import fill_middle, fingerprint, token_alignment
from glossa.llm.oracles import ORACLES
from glossa.llm.queries import alignment_files
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n long, form string, pairs string, `order` string, place string, body string"


def words(seed, n, letters="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


ROWS = [
    (1, words(1, 60)), (2, words(1, 60)), (2, words(1, 60)), (2, words(9, 7)), (3, None), (4, ""), (5, "   "), (6, "a"), (7, "été 日本 \U0001F600 " * 30), (8, "x" * 30000), (9, "a <P> b"), (10, "<S"),
    (11, words(2, 4000)), (12, "P>< <M <P\n\n  of the,  and\t the <|endoftext|> <s> it's"), (13, "a▁b and the rest"), (14, " lead and trail "), (15, "one\n two\r\n  three  four　 five"),
    (16, "nul \x00 and <0x41> ﻿ bom"), (None, words(3, 20)), (17, "ab1"), (-5, words(4, 30)),
]


def docs(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(i, t, 7, "f", "p", "o", "q", "b") for i, t in rows], SCHEMA).repartition(parts)


def table(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def by_sql(name, rows=ROWS):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=str)


# ---------------------------------------------------------------------------------------------- fill in the middle

def test_fill_middle_equals_its_sql_on_odd_texts(spark):
    rows = ROWS + [(k, words(k, 12) + " é1é") for k in range(100, 200)]
    got = fill_middle.report(docs(spark, rows))
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert table(got) == by_sql("op12_fill_middle", rows)


def test_fill_middle_restores_every_text(spark):
    rows = ROWS + [(k, "<" * (k % 3) + "S>" + words(k, 3) + ">P><" ) for k in range(100, 160)]
    out = fill_middle.transform(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "pairs", "order", "place", "body", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect():
        assert r["back"] == (r["text"] or "")
        assert (r["prefix_chars"] is None) == (r["form"] == "plain")
    assert fill_middle.report(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "abc", "a1b", "  ab  é\U0001F600cd..e", "1" * 9, "é" * 3 + "Zz"])
def test_cuts_lie_between_units(text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    runs = fill_middle.Runs(text)
    assert runs.units == len(units)
    assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


# ---------------------------------------------------------------------------------------------- fingerprints

@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [(k, words(k % 7, 30)) for k in range(300)]])
def test_fingerprints_equal_their_sql(spark, rows):
    assert table(fingerprint.report(docs(spark, rows))) == by_sql("op11_fingerprint", rows)


def test_fingerprint_of_an_empty_table(spark):
    assert fingerprint.report(docs(spark).limit(0)).count() == 0


def test_digest_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 500, fingerprint.CHUNK_BYTES + 5):
        data = rng.integers(0, 256 if n < 1000 else 4, n).astype(np.uint8)
        raw = data.tobytes()
        seen = Counter(((int.from_bytes(raw[k : k + 3], "little") * 0x9E3779B1) % 2**32) >> 24 for k in range(n - 2))
        counts = [seen[k] for k in range(256)]
        q = sorted(counts)
        codes = [sum(c > q[k] for k in (63, 127, 191)) for c in counts]
        size = n if n < 8 else 8 * (n.bit_length() - 4) + (n >> (n.bit_length() - 4))
        assert fingerprint.digest(data) == f"{size:02x}" + "".join(f"{a + 4 * b + 16 * c + 64 * d:02x}" for a, b, c, d in zip(*[iter(codes)] * 4))


def test_likeness_is_bounded_and_tells_edits_from_others(spark):
    rows = [(k, words(k, 200)) for k in range(60)]
    got = fingerprint.report(docs(spark, rows)).collect()
    assert all(0 <= r["near_next"] < r["near_edited"] <= 1 for r in got)
    pairs = spark.createDataFrame([("00" * 65, "00" * 65), ("ff" * 65, "00" * 65), (None, "00" * 65)], "a string, b string")
    assert [r[0] for r in pairs.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


def test_next_of_all_ids(spark):
    ids = random.Random(5).sample(range(-10**6, 10**6), 500)
    got = fingerprint.with_next(docs(spark, [(i, f"t{i}") for i in ids], 7), {"doc_id": "next_id", "text": "next_text"})
    order = sorted(ids, reverse=True)
    want = dict(zip(order, order[1:] + order[:1]))
    assert {r["doc_id"]: r["next_id"] for r in got.collect()} == want
    assert all(r["next_text"] == f"t{r['next_id']}" for r in got.collect()) and got.count() == 500


# ---------------------------------------------------------------------------------------------- token alignment

def brute(rows, t):
    """n_a, n_b, n_groups, groups and links of whole texts, by sets of ends."""
    out = []
    for _, text in rows:
        a = t.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = t.b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t.bytes_a[k] for k in a) != whole or b"".join(t.bytes_b[k] for k in b) != whole:
            out.append((0, 0, 0, "", []))
            continue
        spans = []
        for ids, table in ((a, t.bytes_a), (b, t.bytes_b)):
            at = np.cumsum([0] + [len(table[k]) for k in ids])
            spans.append(list(zip(at[:-1].tolist(), at[1:].tolist(), ids)))
        both = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, x = [], 0
        for y in both:
            groups.append("|".join(",".join(str(k) for s, e, k in side if x <= s and e <= y) for side in spans))
            x = y
        links, first = [], 0
        for s, e, k in spans[0]:
            while spans[1][first][1] <= s:
                first += 1
            for s2, e2, k2 in spans[1][first:]:
                if s2 >= e:
                    break
                links.append((k, k2))
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    return out


def test_alignment_by_brute_force(spark):
    files = alignment_files()
    t = token_alignment.Tokenizers(files)
    assert t.by_words
    rows = ROWS + [(k, words(k, 40, "etaoin shrdlué,.\n'") + "  x \n y") for k in range(100, 160)]
    want = brute(rows, t)
    assert want[ROWS.index((13, "a▁b and the rest"))][0] == 0
    counts = Counter(x for w in want for x in w[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    full = sorted(((i, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha(s)) for (i, _), (a, b, g, s, x) in zip(rows, want)), key=str)
    got = token_alignment.report(docs(spark, rows), files)
    assert sorted((tuple(r) for r in got.collect()), key=str) == full


def test_alignment_keeps_columns_and_counts_far_pairs(spark, monkeypatch):
    files = alignment_files()
    rows = ROWS[:4] + [(20, "the of and the")]
    whole = table(token_alignment.report(docs(spark, rows), files))
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", 20)  # most pairs then meet their counts in a shuffle
    assert table(token_alignment.report(docs(spark, rows), files)) == whole
    out = token_alignment.align(docs(spark, rows), files)
    assert out.columns == ["doc_id", "text", "n", "form", "order", "place", "body", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    assert token_alignment.report(docs(spark).limit(0), files).count() == 0


def two_pointers(ends_a, ends_b):
    """Links and groups of two lists of ends, one step at a time."""
    links, group_a, group_b, i, j, g = [], [], [], 0, 0, 0
    while i < len(ends_a):
        links.append((i, j))
        x, y = ends_a[i], ends_b[j]
        if x <= y:
            group_a.append(g)
            i += 1
        if y <= x:
            group_b.append(g)
            j += 1
        g += x == y
    return links, group_a, group_b


def test_merge_equals_two_pointers():
    rng = random.Random(7)
    for n in [1, 2, 5, 40] * 50:
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2)]
        links_a, links_b, group_a, group_b = token_alignment.merge(*(np.array(e) for e in ends))
        assert (list(zip(links_a.tolist(), links_b.tolist())), group_a.tolist(), group_b.tolist()) == two_pointers(*ends)


def test_aligner_forgets_within_its_bound(monkeypatch):
    aligner, texts = token_alignment.Aligner(alignment_files()), [words(k, 50) for k in range(20)]
    plain = lambda columns: [list(map(list, c)) if k > 4 else list(c) for k, c in enumerate(columns)]
    want = plain(aligner.texts(texts))
    monkeypatch.setattr(token_alignment, "MEMORY", 60)
    aligner = token_alignment.Aligner(alignment_files())
    got = [plain(aligner.texts([t])) for t in texts]
    assert len(aligner.number) <= 60 and [[g[k][0] for g in got] for k in range(7)] == want
    assert plain(aligner.texts([""])) == [[0], [0], [0], [0], [""], [[]], [[]]]
