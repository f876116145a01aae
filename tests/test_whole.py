"""Queries over whole tables: no row is left out before the operator."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions.encoders import HashEncoder
from glossa.operators import metrics, pieces, prototypes, splitting
from glossa.plans.oracles import ORACLES
from glossa.plans.queries import LEXICON, QUERIES

from oracle import DATA, TABLES, same


def test_bmes_decode_of_all_documents(spark):
    same(spark, QUERIES["bmes_decode"], ORACLES["bmes_decode"])
    assert QUERIES["bmes_decode"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def folded(text, labels):
    """decode_labels by its definition, one character a label."""
    words, held = [], ""
    for c, t in zip(text, labels):
        if t == "B":
            words, held = words + [held] * (held != ""), c
        elif t in "MI":
            held += c
        elif t == "E":
            words, held = words + [held + c], ""
        else:
            words, held = words + [held] * (held != "") + [c], ""
    return words + [held] * (held != "")


def test_decode_labels_by_brute_force(spark):
    rows = [("aé\U0001F600d", list(t)) for t in itertools.product("BMEISX", repeat=4)]
    offsets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    table = spark.createDataFrame(rows, "text string, labels array<string>")
    for r in table.select("text", "labels", splitting.decode_labels(F.col("text"), F.col("labels"), offsets).alias("words")).collect():
        assert r["words"] == folded(r["text"], r["labels"]), r["labels"]


@pytest.mark.parametrize("name", ["safe_groups", "prototype_status", "prototype_params", "prototype_quality", "prototype_vectors", "status_counts"])
def test_prototypes_of_all_vectors(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_every_vector_is_an_occurrence(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert QUERIES["prototype_status"](spark, DATA).agg(F.sum("n_occ")).first()[0] == n


def test_status_of_small_groups(spark):
    rows = [(g, f"{g}_{k % 3}", 100 * g + k, [1.0, 0.01 * k]) for g, n in ((1, 60), (2, 19)) for k in range(n)]
    occ = spark.createDataFrame(rows, "group_id int, word string, item long, vec array<double>")
    groups = spark.createDataFrame([(1,), (2,), (3,)], "group_id int")
    meta = prototypes.build(occ, groups, occ.select("group_id", "word").distinct(), prototypes.Parameters())["meta"]
    status = {r["group_id"]: r["status"] for r in meta.collect()}
    assert status == {1: "anchor_proto", 2: "too_small_or_empty", 3: "too_small_or_empty"}


def test_document_names_of_whole_texts(spark):
    same(spark, QUERIES["document_names"], ORACLES["document_names"])
    assert QUERIES["document_names"](spark, DATA).agg(F.max(F.length("name"))).first()[0] > 50


def test_csc_template_of_all_pairs(spark):
    same(spark, QUERIES["csc_template"], ORACLES["csc_template"])


def test_csc_template_samples(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "a")], "word string, cand string")
    vectors = spark.createDataFrame([(w, 0, [1.0, 0.0]) for w in "abc"], "word string, template_no int, vec array<double>")
    assert [metrics.csc_template(pairs, vectors, n).first()["n"] for n in (2, 200)] == [2, 3]


# ---------------------------------------------------------------------------------------------- masked positions of whole sequences

FAR = {1: f"The {'x' * 500} of the", 2: "internationalization " * 13 + "le La", 3: "the cat sat", 4: None, 5: "", 6: f"{'研究' * 300} la de", 7: f"in {'y' * 20_000} en dans"}


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The tables with documents whose last words stand behind many pieces of long words."""
    path = str(tmp_path_factory.mktemp("far"))
    for t in set(TABLES) - {"documents", "benchmark"}:
        os.symlink(f"{DATA}/{t}.parquet", f"{path}/{t}.parquet")
    spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in FAR.items()], "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "some longer words")], "item_id long, text string").toPandas().to_parquet(f"{path}/benchmark.parquet")
    return path


def synonyms():
    found = {}
    for code, *words in map(str.split, LEXICON.splitlines()):
        for a, b in itertools.permutations(words if code.endswith("=") else [], 2):
            if a != b:
                found.setdefault(a, set()).add(b)
    return found


def plain_masks():
    """(doc_id, idx): the word and its best pieces with their probabilities, from whole sequences."""
    words = {*"some longer words".split(), *(w for line in LEXICON.splitlines() for w in line.split()[1:])}
    names, pairs, out = sorted({("##" if k else "") + w[k : k + 4] for w in words for k in range(0, len(w), 4)}), synonyms(), {}
    vector = lambda piece: np.array([((HashEncoder.id_of(piece) >> (5 * d)) & 31) - 15.5 for d in range(12)])
    table = np.array([vector(p) for p in names]) / 32
    for doc, text in FAR.items():
        tokens = (text or "").lower().split()
        for idx in (k for k, t in enumerate(tokens) if t in pairs):
            cut = ["[CLS]", *(p for k, t in enumerate(tokens) for p in (["[MAS"] if k == idx else [("##" if i else "") + t[i : i + 4] for i in range(0, len(t), 4)])), "[SEP]"]
            known = {p: vector(p) for p in set(cut)}
            logits = table @ (known["[MAS"] + 0.5 * sum(known[p] for p in cut) / len(cut)) / np.sqrt(12)
            p = np.exp(logits) / np.exp(logits).sum()
            out[doc, idx] = tokens[idx], [(names[k], p[k]) for k in np.lexsort((names, -logits))[:50]]
    return out


def test_masked_probabilities_behind_long_words(spark, far):
    """every position with a synonym has its pieces, wherever it stands, from all pieces of its sentence."""
    want = plain_masks()
    assert set(want) >= {(1, 2), (1, 3), (2, 13), (2, 14), (6, 1), (6, 2), (7, 2), (7, 3)}  # all behind 22 pieces
    got = {(r["doc_id"], r["idx"]): r for r in QUERIES["masked_probabilities"](spark, far).collect()}
    assert set(got) == set(want)
    for key, (_, best) in want.items():
        assert (got[key]["n"], got[key]["best"]) == (len(best), best[0][0])
        assert np.allclose([got[key]["p"], got[key]["p_top"]], [best[0][1], sum(p for _, p in best)], atol=1e-6)
    same(spark, QUERIES["masked_probabilities"], ORACLES["masked_probabilities"], far)


def test_slices_of_long_tokens():
    rows = [["a" * 6], None, [], ["b" * 3, None, "é"], ["c" * 50], ["d"], ["e"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(rows, pa.list_(pa.string()))], ["k", "tokens"])
    assert [b.column("k").to_pylist() for b in pieces.slices([batch, batch.slice(4), batch.slice(0, 0)], 10)] == [[0, 1, 2], [3], [4], [5, 6], [4], [5, 6]]
    assert [b.num_rows for b in pieces.slices([batch])] == [7]


def test_masked_variants_behind_long_words(spark, far):
    """candidates of every position meet the pieces that the model gives there from the whole sentence."""
    want, pairs = [], synonyms()
    for (doc, idx), (word, best) in plain_masks().items():
        passed = sorted(pairs[word] & {c for c, p in best if p >= 0.0003})[:4]
        want += [(doc, idx, word, c, k) for k, c in enumerate(passed)]
    assert {x[:2] for x in want} >= {(1, 2), (1, 3), (2, 13), (7, 2)}  # behind 22 pieces
    got = QUERIES["masked_variants"](spark, far).collect()
    assert sorted((r["doc_id"], r["idx"], r["word"], r["cand"], r["cand_ord"]) for r in got) == sorted(want)
    same(spark, QUERIES["masked_variants"], ORACLES["masked_variants"], far)
