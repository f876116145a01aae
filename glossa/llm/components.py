"""Connected components by hooking and pointer jumping on tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, planned_once, shuffled, sweep


#: Rounds whose moves are applied to the labels at once.
TOGETHER = 3


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(id, comp), each comp the least id of its component so far, and new links(a, b) -> labels after them.

    Every id of links must be in labels.  Each round hooks a component to its least neighbour and jumps twice, so the
    rounds grow with the logarithm of a component's length.  No join is a broadcast: the driver gets no table.  The edge
    that a component hooks by is not moved, as the hooks that are left connect what it did: a hub's edges are of this kind.
    """
    spark = labels.sparkSession
    to = lambda hook, c: shuffled(hook.select(F.col("v").alias(c), F.col("p").alias("to")))
    move = lambda df, c, hook: df.join(to(hook, c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    left, right = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    edges, hooks = links.join(shuffled(left), "a").join(shuffled(right), "b").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")), []
    edges = cut(edges.where("u < v").distinct())
    while True:
        rows = edges.count()
        done = rows == 0
        if hooks and (done or len(hooks) == TOGETHER):
            for hook in hooks:
                labels = move(labels, "comp", hook)
            labels, hooks = cut(labels), []
        if done:
            sweep(spark)
            return labels
        with planned_once(spark, rows):
            hook = edges.groupBy("v").agg(F.min("u").alias("least")).withColumn("p", F.col("least"))
            for _ in range(2):
                up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
                hook = hook.join(shuffled(up), "p", "left").select("v", "least", F.coalesce("q", "p").alias("p"))
            hook = cut(hook)
            hooks.append(hook)
            others = edges.join(shuffled(hook.select("v", "least", F.col("p").alias("to"))), "v").where("u <> least").select("u", F.col("to").alias("v"))
            moved = move(others, "u", hook)
            above = hook.select(F.col("p").alias("v")).distinct().join(shuffled(hook), "v").select(F.col("p").alias("u"), "v")
            edges = cut(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(above).where("u < v").distinct())
