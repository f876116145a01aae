import json

import pytest

from glossa.operators import lexicon as lx
from glossa.plans.queries import LEXICON
from glossa.sources import readers, writers
from glossa.streaming import sense_stream


def test_token_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["a", "b", "c"], ["x"]]))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text(json.dumps({"tokens": ["d", "e", "f"]}))
    (tmp_path / "d.json").write_text(json.dumps([{"tokens": ["g", "h", "i"]}]))
    rows = readers.token_sentences(spark, str(tmp_path)).collect()
    assert sorted("".join(r["tokens"]) for r in rows) == ["abc", "def", "ghi"]
    assert readers.token_sentences(spark, str(tmp_path), limit=2).count() == 2
    with pytest.raises(ValueError):
        readers.token_sentences(spark, str(tmp_path), least=9, strict=True)
    assert [r["file"].rsplit("/", 1)[1] for r in readers.unparsable(spark, str(tmp_path)).collect()] == ["b.json"]


def test_entries(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps([{"tokens": ["a", "b", "c"], "pos": {"0": [["x", "b", "c"]]}}]))
    row = readers.training_entries(spark, str(tmp_path)).first()
    assert row["pos"] == {"0": [["x", "b", "c"]]} and row["hard_neg"] == {}


def test_text_and_lexicon(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \n")
    assert sorted(r["line"] for r in readers.text_lines(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert readers.sample_lines(spark, str(tmp_path), 1).count() == 1
    (tmp_path / "lex").write_text(LEXICON)
    lex = lx.parse(readers.lexicon_lines(spark, str(tmp_path / "lex")))
    assert lx.vocabulary(lex).count() == 29 and lx.pairs(lex, "=").count() == 50 and lx.pairs(lex, "#").count() == 38


def contents(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_a_file_for_each_document(spark, tmp_path):
    rows = [("1", "t", 10 * k, f"line {k}\nmore") for k in range(30)] + [("", "x/y", 0, "c"), ("2", None, 0, "d")]
    out = tmp_path / "out"
    for part in (rows, rows[:-1]):  # the second run takes the file of document 2 away
        writers.chunks_as_text(spark.createDataFrame(part, "id string, title string, no int, chunk string").repartition(5), str(out), ["no"])
    assert contents(out) == {"1.txt": "".join(f"line {k} more\n" for k in range(30)), "x_y.txt": "c\n"}


def test_numbers_and_files_of_pairs(spark, tmp_path):
    rows = [(f"s{k}", f"t{k}") for k in range(50)]
    spark.createDataFrame(rows, "sentence1 string, sentence2 string").repartition(7).write.parquet(str(tmp_path / "A"))
    spark.createDataFrame([("same", "same")] * 3, "sentence1 string, sentence2 string").write.parquet(str(tmp_path / "B"))
    pairs = readers.sentence_pairs(spark, {"A": str(tmp_path / "A"), "B": str(tmp_path / "B")})
    first, again = ([tuple(r) for r in df.orderBy("config", "row_no").collect()] for df in (pairs, pairs.repartition(11)))
    assert first == again and [r[1] for r in first] == [*range(50), *range(3)] and sorted((r[2], r[3]) for r in first[:50]) == sorted(rows)
    writers.pairs_as_text(pairs, str(tmp_path / "out"))
    got = contents(tmp_path / "out")
    assert len(got) == 53 and all(got[f"{c}_{n}.txt"] == f"{a}\n{b}\n" for c, n, a, b in first)


def test_matches_by_source_file(spark, tmp_path):
    root, out = "file:/data/in", tmp_path / "out"
    lines = [(f"{root}/a.txt", 1, "one"), (f"{root}/a.txt", 0, "zero"), (f"{root}/sub/b.txt", 3, "b")]
    every = spark.createDataFrame([(f"{root}/{f}",) for f in ("a.txt", "sub/b.txt", "c.txt")], "file string")
    schema = "file string, line_no int, line string"
    writers.matches_as_text(spark.createDataFrame([*lines, (f"{root}/c.txt", 0, "c")], schema), every, root, str(out))
    (out / "other.txt").write_text("of another run")
    assert contents(out) == {"a.txt": "zero\none\n", "sub/b.txt": "b\n", "c.txt": "c\n", "other.txt": "of another run"}
    writers.matches_as_text(spark.createDataFrame(lines[:2], schema), every, root, str(out))  # stale targets go
    assert contents(out) == {"a.txt": "zero\none\n", "other.txt": "of another run"}


def test_tokens_come_back_by_file(spark, tmp_path):
    rows = [("file:/x/a.txt", k, ["w", str(k), 'q"']) for k in range(5)] + [("file:/x/b.c.txt", 0, ["é"])]
    writers.tokens_as_json(spark.createDataFrame(rows, "file string, no int, tokens array<string>").repartition(4), str(tmp_path / "out"), ["no"])
    got = {k: json.loads(v) for k, v in contents(tmp_path / "out").items()}
    assert got == {"a.json": [r[2] for r in rows[:5]], "b.c.json": [["é"]]}
    assert sorted(r["tokens"][1] for r in readers.token_sentences(spark, str(tmp_path / "out")).collect()) == list("01234")


def test_a_failed_job_leaves_the_target(spark, tmp_path):
    from pyspark.sql import functions as F

    from glossa.sources import files

    rows = spark.createDataFrame([("a.txt", "old", 0)], "file string, value string, no int")
    files.write(rows, str(tmp_path / "out"), ["no"])
    broken = spark.range(8).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("new").alias("value"), F.lit(0).alias("no"))
    with pytest.raises(Exception, match="broken"):
        files.write(broken, str(tmp_path / "out"), ["no"])
    assert contents(tmp_path / "out") == {"a.txt": "old\n"}


def test_documents_have_all_columns(spark, tmp_path):
    spark.createDataFrame([(1, "t")], "id long, title string").write.parquet(str(tmp_path / "d"))
    assert [tuple(r) for r in readers.documents(spark, str(tmp_path / "d")).collect()] == [("1", None, "t", None)]


def test_prototypes_come_back_normalized(spark, tmp_path):
    one = spark.createDataFrame([("g", [3.0, 4.0])], "group_id string, vec array<double>")
    other = spark.createDataFrame([(1,)], "n int")
    for _ in range(2):
        writers.prototypes({"prototypes": one, "meta": other, "params": other}, str(tmp_path / "p"))
    assert readers.prototypes(spark, str(tmp_path / "p")).first()["vec"] == [0.6, 0.8]


def test_json_sinks_and_metrics(spark, tmp_path):
    entry = spark.createDataFrame([(["a", "b", "c"], {"0": [["x", "b", "c"]]}, {})], "tokens array<string>, pos map<string,array<array<string>>>, hard_neg map<string,array<array<string>>>")
    writers.entries_as_json(entry, str(tmp_path / "e"))
    assert json.loads(spark.read.text(str(tmp_path / "e")).first()[0])["pos"] == {"0": [["x", "b", "c"]]}
    writers.assignments_as_json(spark.createDataFrame([("g", ["a"])], "group_id string, predicted_words array<string>"), spark.createDataFrame([(3,)], "n_words int"), str(tmp_path / "a"))
    assert json.loads(spark.read.text(str(tmp_path / "a" / "meta")).first()[0]) == {"n_words": 3}
    for epoch in (1, 2):
        writers.metrics(spark.createDataFrame([(epoch, "mrr", 0.5)], "epoch int, name string, value double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\nno word\nthe of\n")
    lex = lx.from_text(spark, "A= the x\nB= of y")
    lines = spark.readStream.text(str(tmp_path / "in"))
    assert sense_stream.matched_stream(lines, lex).isStreaming
    q = sense_stream.sense_counts(lines, lex).writeStream.outputMode("complete").format("memory").queryName("senses").start()
    q.processAllAvailable()
    q.stop()
    assert {r["sense_id"]: r["n_occ"] for r in spark.table("senses").collect()} == {"A": 2, "B": 1}
