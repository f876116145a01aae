"""Streams in several batches against the same operators on the whole table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import lexicon as lx
from glossa.operators import sampling
from glossa.plans.queries import QUERIES
from glossa.streaming import reservoir, sense_stream

from oracle import DATA


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reservoir.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(table, folder, n, order):
    """The table in n Parquet files, to be read one a batch."""
    parts = table.withColumn("_p", F.ntile(n).over(Window.orderBy(*order)))
    for k in range(1, n + 1):
        parts.where(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(folder)


def drain(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return len([p for p in q.recentProgress if p["numInputRows"]])
    finally:
        q.stop()


def test_reservoir_of_a_stream_equals_the_sample_of_the_table(rocks, tmp_path):
    docs = rocks.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    files(docs, str(tmp_path / "in"), 4, ["doc_id"])
    stream = rocks.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert drain(reservoir.reservoirs(stream, ["doc_id"], 20, seed=7, shards=3), "kept", "update") == 4
    got = reservoir.merged(rocks.table("kept"), 20, "doc_id long, lang string").collect()
    want = sampling.sample(docs, ["doc_id"], 20, seed=7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 20


def test_windowed_counts_of_a_stream_equal_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type")
    files(events, str(tmp_path / "in"), 5, ["ts"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = reservoir.windowed_counts(stream, "ts", ["event_type"], delay="400 days", width="1 day")
    assert drain(counted, "counted", "complete") == 5
    want = reservoir.windowed_counts(events, "ts", ["event_type"], width="1 day")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, kind string"
    batches = [[("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")], [("2024-01-01 05:00:00", "a")], [("2024-01-01 05:10:00", "a")], [("2024-01-01 00:30:00", "late"), ("2024-01-01 04:50:00", "a")], [("2024-01-02 00:00:00", "a")], [("2024-01-02 01:00:00", "a")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    drain(reservoir.windowed_counts(stream, "ts", ["kind"], delay="1 hour", width="1 hour"), "late", "append")
    got = {(str(r["start"])[11:13], r["kind"]): r["n"] for r in spark.table("late").collect()}
    assert got == {("00", "a"): 2, ("04", "a"): 1, ("05", "a"): 2}  # the row of half past midnight came five hours late


def test_windowed_senses_and_a_bounded_lexicon(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "the cat of"), ("2024-01-01 00:07:00", "the"), ("2024-01-03 00:00:00", "of")], "t string, value string")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    lex = lx.from_text(spark, "A= the x\nB= of y")
    stream = spark.readStream.schema("t timestamp, value string").parquet(str(tmp_path / "in"))
    drain(sense_stream.windowed_sense_counts(stream, lex, "t"), "senses_by_time", "complete")
    assert sorted((str(r["start"])[5:16], r["sense_id"], r["n_occ"]) for r in spark.table("senses_by_time").collect()) == [("01-01 00:00", "A", 1), ("01-01 00:00", "B", 1), ("01-01 00:05", "A", 1), ("01-03 00:00", "B", 1)]
    monkeypatch.setattr(sense_stream, "LITERAL_WORDS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        sense_stream.matched_stream(stream, lex)


def test_event_windows_cover_all_events(spark):
    assert QUERIES["event_window_counts"](spark, DATA).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
