"""A uniform sample of a stream, kept as mergeable reservoirs, and counts of its events by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.common import hash_order

#: Reservoirs among which the rows are dealt; each keeps a whole sample, so that their union holds the sample of all.
SHARDS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reservoir(StatefulProcessor):
    """Keeps the n rows of least hash of its shard, and gives them again whenever they change."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "hashes array<string>, rows array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.kept.get() if self.kept.exists() else None
        before = list(zip(*held)) if held is not None else []
        best = before
        for batch in rows:
            best = sorted([*best, *zip(batch["hash"], batch["row"])])[: self.n]
        if best != before:
            self.kept.update(([h for h, _ in best], [r for _, r in best]))
            yield pd.DataFrame({"shard": [key[0]] * len(best), "hash": [h for h, _ in best], "row": [r for _, r in best]})

    def close(self) -> None:
        pass


def reservoirs(stream: DataFrame, keys: list[str], n: int, seed: int = 42, shards: int = SHARDS) -> DataFrame:
    """shard, hash, row (JSON) of a stream of rows: the present reservoir of each shard that changed, in output mode update.

    The state is n rows a shard, whatever the length of the stream.  The session needs the RocksDB state store (PROVIDER in
    spark.sql.streaming.stateStore.providerClass).  merged() gives the sample.
    """
    digest = hash_order(seed, *keys)
    rows = stream.select(digest.alias("hash"), F.to_json(F.struct("*")).alias("row")).withColumn("shard", F.pmod(F.crc32("hash"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").transformWithStateInPandas(Reservoir(n), "shard int, hash string, row string", "Update", "None")


def merged(changes: DataFrame, n: int, schema: str) -> DataFrame:
    """The n sampled rows, as columns again, of all changes so far: a row that was ever among its shard's least n and among
    the least n of all is among them now, so earlier reservoirs need no removal."""
    least = changes.select("hash", "row").distinct().orderBy("hash", "row").limit(n)
    return least.select(F.from_json("row", schema).alias("r")).select("r.*")


def windowed_counts(events: DataFrame, time: str, by: list[str], delay: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, end, by, n: events by event-time window, on a table or a stream; rows without a time are left out.

    On a stream a window is final `delay` after its end has passed, and rows that come later are dropped.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, delay) if events.isStreaming else rows
    counted = rows.where(F.col(time).isNotNull()).groupBy(F.window(time, width, slide or width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
