"""Contextual vectors by the injected encoder, against a plain loop over sentences."""

import numpy as np
import pytest

from glossa.functions.encoders import HashEncoder, hash_encoder
from glossa.operators import encoding, prototypes

SENTENCES = [(1, "the cat sat".split()), (2, ["extraordinarily"] * 5), (3, []), (4, ["a"]), (5, None), (6, ["", "b", "été"]), (1, "the cat sat".split()), (7, ["w" * 500, "tail"])]


def table(spark, rows=SENTENCES):
    return spark.createDataFrame(rows, "sid int, tokens array<string>").repartition(3)


def plain(tokens, max_len):
    """Vectors by word, of the first mark, and of both poolings, one sentence at a time."""
    e = HashEncoder()
    pieces = [(k, p) for k, t in enumerate(tokens) for p in e.pieces(t)][: max_len - 2]
    ids = np.array([[e.first, *[p for _, p in pieces], e.last]])
    hidden, pooled = e.forward(ids, np.ones_like(ids, bool))
    unit = lambda v: v / np.sqrt((v * v).sum())
    words = {}
    for k in dict.fromkeys(k for k, _ in pieces):
        words[k] = unit(np.mean([hidden[0, 1 + n] for n, (j, _) in enumerate(pieces) if j == k], axis=0))
    return words, unit(hidden[0, 0]), unit(pooled[0]), unit(hidden[0].mean(axis=0)), hidden[0]


@pytest.mark.parametrize("max_len", [8, 64])
def test_word_vectors_by_a_plain_loop(spark, max_len):
    got = sorted((r["sid"], r["pos"], r["word"], r["vec"]) for r in encoding.word_vectors(table(spark), ["sid"], hash_encoder, max_len).collect())
    want = sorted((sid, k, (tokens or [])[k], v.tolist()) for sid, tokens in SENTENCES for k, v in plain(tokens or [], max_len)[0].items())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])
    assert (max_len == 64) == any(x[:2] == (2, 4) for x in got)  # the last long word lies behind 8 pieces


@pytest.mark.parametrize("pooling", ["cls", "mean"])
def test_sentence_vectors(spark, pooling):
    got = sorted((r["sid"], r["vec"]) for r in encoding.sentence_vectors(table(spark), ["sid"], hash_encoder, pooling).collect())
    want = sorted((sid, plain(tokens or [], 64)[2 if pooling == "cls" else 3].tolist()) for sid, tokens in SENTENCES)
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want])


def test_unknown_pooling_fails(spark):
    with pytest.raises(ValueError, match="pooling"):
        encoding.sentence_vectors(table(spark), ["sid"], hash_encoder, "max")


def test_vectors_at_with_all_fallbacks(spark):
    rows = [(k, tokens, idx) for k, (_, tokens) in enumerate(SENTENCES) for idx in (0, 1, 4, -1, 99, None)]
    requests = spark.createDataFrame(rows, "k int, tokens array<string>, idx int")
    got = {(r["k"], r["idx"]): r for r in encoding.vectors_at(requests, ["k"], hash_encoder, 8).collect()}
    assert len(got) == len(rows)
    for k, tokens, idx in rows:
        tokens, r = tokens or [], got[(k, idx)]
        if idx is None or not 0 <= idx < len(tokens):
            words, _, _, _, hidden = plain(["".join(tokens)], 8)
            want, source = hidden[1 if words else 0] / np.sqrt((hidden[1 if words else 0] ** 2).sum()), "text"
        else:
            words, mark, *_ = plain(tokens, 8)
            want, source = (words[idx], "word") if idx in words else (mark, "cls")
        assert r["source"] == source and np.allclose(r["vec"], want)


def test_empty_tables(spark):
    assert encoding.word_vectors(table(spark).limit(0), ["sid"], hash_encoder).count() == 0
    assert encoding.vectors_at(spark.createDataFrame([], "k int, tokens array<string>, idx int"), ["k"], hash_encoder).count() == 0


class Narrow(HashEncoder):
    """Has no memory for more than 40 pieces at once, and counts its calls."""

    def __init__(self):
        super().__init__()
        self.sizes, self.failed = [], 0

    def forward(self, ids, mask):
        if ids.size > 40:
            self.failed += 1
            raise MemoryError
        self.sizes.append(ids.size)
        return super().forward(ids, mask)


def test_steps_shrink_and_grow_again():
    model = Narrow()
    sentences = [["ab"] * (1 + k % 9) for k in range(100)]
    rows = {row: hidden for row, hidden, _ in encoding.Sequences(model, sentences, 64).run()}
    assert sorted(rows) == list(range(100)) and model.failed < 60 and max(model.sizes) > 20
    for k, tokens in enumerate(sentences):
        assert np.allclose(rows[k], plain(tokens, 64)[4])
    with pytest.raises(MemoryError):
        list(encoding.Sequences(model, [["ab"] * 60], 64).run())


def test_a_loader_runs_once_a_process(tmp_path):
    from pyspark import cloudpickle

    calls = tmp_path / "calls"

    def load():
        with open(calls, "a") as f:
            f.write("x")
        return HashEncoder()

    pickled = cloudpickle.dumps(load)
    assert encoding.loaded(pickled) is encoding.loaded(pickled) and calls.read_text() == "x"


def test_readable_sentences(spark):
    rows = spark.createDataFrame([(1, ["a", " ", "b"]), (2, [" ", "a", "　"]), (3, ["a", None, "\t"]), (4, None), (5, [])], "sid int, tokens array<string>")
    assert [(r["sid"], r["tokens"]) for r in prototypes.readable(rows).collect()] == [(1, ["a", "b"])]


def test_groups_keep_the_order_of_prototypes(spark):
    protos = spark.createDataFrame([("b", [1.0, 0.0], 0), ("a", [0.0, 1.0], 1)], "group_id string, vec array<double>, ord int")
    words = spark.createDataFrame([("s", "s:0", "x", [1.0, 0.0]), ("s", "s:1", "y", [0.0, 1.0]), ("s", "s:2", "z", [0.0, 1.0])], "sid string, item string, word string, vec array<double>")
    members = spark.createDataFrame([("a", 0, "m")], "group_id string, ord int, word string")
    only = spark.createDataFrame([("x",), ("y",)], "word string")
    groups = prototypes.assign(words, protos, members, vocabulary=only)["groups"].orderBy("ord").collect()
    assert [(r["group_id"], r["predicted_words"], r["member_words"]) for r in groups] == [("b", ["x"], []), ("a", ["y"], ["m"])]


def test_words_asked_for_alone_run_through_the_model(spark):
    """vectors of whole batches equal those taken sentence by sentence, and sentences without a word asked for don't run."""

    def loud():
        class Loud(HashEncoder):
            def forward(self, ids, mask):
                assert not (ids == self.id_of("stop")).any()
                return super().forward(ids, mask)

        return Loud()

    rows = [(1, ["one", "longerword", "", "one"]), (2, ["stop", "here"]), (3, None), (4, []), (5, ["one"] * 9 + ["two"]), (6, [None, "two", "überlang"]), (7, ["two"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>").coalesce(1)
    plain = {(r["k"], r["pos"]): r for r in encoding.word_vectors(df, ["k"], HashEncoder, 8).collect()}
    want = {}
    tool = encoding.Sequences(HashEncoder(), [t or [] for _, t in rows], 8)
    for row, hidden, _ in tool.run():
        for k, v in zip(*encoding.pool_words(hidden, tool.words[row])):
            want[rows[row][0], int(k)] = v
    assert plain.keys() == want.keys() and all(np.allclose(plain[k]["vec"], want[k]) for k in want)
    assert all(r["word"] == dict(rows)[k][p] for (k, p), r in plain.items())
    asked = spark.createDataFrame([("two",), ("longerword",), ("absent",), (None,)], "word string")
    few = {(r["k"], r["pos"]): r["vec"] for r in encoding.word_vectors(df, ["k"], loud, 8, only=asked).collect()}
    assert few == {k: r["vec"] for k, r in plain.items() if r["word"] in ("two", "longerword")} and len(few) == 3
    joined = {(r["k"], r["pos"]): r["vec"] for r in encoding.word_vectors(df, ["k"], HashEncoder, 8, only=asked, limit=1).collect()}
    assert joined == few
