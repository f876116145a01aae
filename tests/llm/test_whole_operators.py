"""Operators without cuts: what is rare or of another kind is in the results too."""

import json
import random
import time

import pytest

from glossa.llm import chat_format, html_extract, line_dedup, near_dedup, suffix_dedup
from glossa.llm.queries import QUERIES

from oracle import DATA


@pytest.mark.parametrize("lists", [{1: (1, 2)}, {1: (1, 2, 3), 2: (1, 2, 3), 3: (1, 2, 4), 4: (1, 2, 4)}])
def test_last_step_compares_pairs_of_few_common_lists(spark, lists):
    """Documents 1 and 2 are similar; 3 is of the component of 1, and 4 of that of 2."""
    text = [f"w{k}" for k in range(60)]
    rows = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(text[:40])), (4, " ".join(text[20:]))], "doc_id long, text string")
    comp = {1: 1, 2: 2, 3: 1, 4: 2}
    prefix = spark.createDataFrame([(t, i) for t, ids in lists.items() for i in ids], "token long, id long")
    labels = spark.createDataFrame(list(comp.items()), "id long, comp long")
    sets = near_dedup.full_sets(rows, labels.select("id"), near_dedup.SHINGLE, near_dedup.COORDINATES)
    got = near_dedup.the_rest(prefix, labels, sets, near_dedup.MATCHES, near_dedup.PERCENT)
    assert {r["comp"] for r in got.collect()} == {1}


def texts(line):
    """The texts of a conversation's JSON."""
    got = json.loads(line)
    calls = [t for c in got["calls"] for t in (c["arguments"].get("prompt"), c["result"])]
    return sorted(t for t in [*calls, *(x["text"] for x in got.get("turns", []))] if t is not None)


def test_chat_format_has_every_turn(spark):
    rows = [("a", 0, "system", "be \"kind\""), ("a", 1, "user", "q"), ("a", 2, "assistant", "r"), ("a", 4, "assistant", "late"), ("a", 1, "user", "again"), ("a", 2, "assistant", "s"), ("b", 0, "tool", None), ("b", 1, None, "x")]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.link_tools(*chat_format.conversations_as_calls(table)).collect()}
    assert texts(got["a"]["json"]) == sorted(t for c, _, _, t in rows if c == "a") and got["a"]["n_orphans"] == 1
    assert got["b"]["json"] == '{"calls":[],"turns":[{"role":"tool","text":null,"turn":0},{"role":null,"text":"x","turn":1}]}'


def test_op7_has_every_turn(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        want.setdefault(r["conv_id"], []).append(r["text"])
    assert {r["conv_id"]: texts(r["json"]) for r in QUERIES["op7_chat_format"](spark, DATA).collect()} == {c: sorted(t) for c, t in want.items()}


def near(a, b):
    """At most one character put in, taken out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k:] == b[k:] or a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def test_lines_of_all_lengths_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join("".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 4, 6, 30]))) for _ in range(4))) for k in range(50)]
    rows += [(60, "x" * 50_000 + "\n" + "x" * 49_999), (61, None), (62, ""), (3, rows[3][1])]
    table = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, doc string, xx string, dropped string, gone_doc string")
    first, want = {}, {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line:
                first[line] = min(first.get(line, (i, n)), (i, n))
    for i, t in rows:
        want[i] = [n for n, line in enumerate((t or "").split("\n")) if line and any(first[o] < (i, n) and near(line, o) for o in first)]
    assert {r["doc_id"]: list(r["dropped"]) for r in line_dedup.report(table).collect()} == want
    out = line_dedup.dedup(table)
    assert out.columns == table.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}


def test_lines_by_bytes(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join("".join(rng.choice("aäöü€") for _ in range(rng.choice([1, 2, 3, 20]))) for _ in range(4))) for k in range(40)]
    rows += [(50, "Für."), (51, "For."), (52, "För."), (53, "Fär.")]
    first, want = {}, {}
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            first.setdefault(line.encode(), (i, n))
    for i, t in rows:
        want[i] = [n for n, line in enumerate(t.split("\n")) if any(first[o] < (i, n) and near(line.encode(), o) for o in first)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: list(r["dropped"]) for r in line_dedup.report(table, unit="byte").collect()} == want
    assert want[51] == [] and want[52] == [0]


def test_suffix_dedup_keeps_all_columns(spark):
    shared = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    rows = [(1, "x" + shared + "yé", "l"), (2, shared, "m"), (2, shared, "n"), (3, None, "o"), (None, "short", "p")]
    table = spark.createDataFrame([(i, t, a, a, a) for i, t, a in rows], "doc_id long, text string, left string, key string, xx string")
    got = sorted(((r["left"], r["text"]) for r in suffix_dedup.dedup(table).collect()), key=str)
    assert suffix_dedup.dedup(table).columns == table.columns
    assert got == [("l", "xyé"), ("m", ""), ("n", ""), ("o", None), ("p", "short")]


def chained(spark, n, forward=()):
    calls = spark.createDataFrame([("c", f"i{k}", k, "t", "{}", [f"i{k - 1}", *[f"i{b}" for a, b in forward if a == k]]) for k in range(n)], "conv_id string, call_id string, turn long, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([("c", "i0", "r")], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([("t", "x", "integer", False, None, None)], "tool string, field string, type string, required boolean, minimum double, maximum double")
    return chat_format.link_tools(calls, results, schemas)


def test_chains_of_calls_take_seconds(spark):
    chained(spark, 10).collect()
    began = time.perf_counter()
    row = chained(spark, 10_000).first()
    assert time.perf_counter() - began < 60
    assert [c["id"] for c in json.loads(row["json"])["calls"]] == [f"i{k}" for k in range(10_000)] and row["n_cyclic"] == 0


def test_calls_that_depend_on_later_ones(spark):
    calls = spark.createDataFrame([("c", "a", 0, "t", "{}", ["b"]), ("c", "b", 1, "t", "{}", []), ("d", "a", 0, "t", "{}", ["a"]), ("d", "b", 1, "t", "{}", ["gone"])], "conv_id string, call_id string, turn long, name string, arguments string, depends array<string>")
    none = spark.createDataFrame([], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([], "tool string, field string, type string, required boolean, minimum double, maximum double")
    got = {r["conv_id"]: ([c["id"] for c in json.loads(r["json"])["calls"]], r["n_cyclic"]) for r in chat_format.link_tools(calls, none, schemas).collect()}
    assert got == {"c": (["b", "a"], 0), "d": (["b", "a"], 1)}


def test_formulas_and_drawings_keep_their_text(spark):
    long = "The long sentence of the article goes on for a while, so that it is plainly text of the page. " * 3
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{long}</p><p>The energy is <math><mi>E</mi></math> as known, and <svg><text>so</text></svg> on. {long}</p></article></body></html>"
    text = html_extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert "The energy is E as known, and so on." in text
