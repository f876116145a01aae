"""Evaluation metrics over vectors that are columns: losses, retrieval, uniformity, consistency and margin."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TEMPLATES, fill_template, word_start
from ..functions.vectors import distance, dot, mean_by, normalize
from .common import hash_limit
from .similarity import nearest_distances, ranks


# ---------------------------------------------------------------------------------------------- losses

def infonce(batches: DataFrame, temperature: float = 0.05, batch: str = "batch_id", row: str = "row_no") -> DataFrame:
    """batch_id, loss: symmetric contrastive loss of z1, z2 (normalized) in each batch.

    The 2B vectors of a batch meet in a self join on the batch, so a batch is the unit that grows with its square; the
    log of the sum of exponentials takes out the maximum first.
    """
    side = lambda c, s: batches.select(batch, row, F.lit(s).alias("side"), F.col(c).alias("z"))
    points = side("z1", 0).unionByName(side("z2", 1))
    other = points.select(batch, F.col(row).alias("o_row"), F.col("side").alias("o_side"), F.col("z").alias("o_z"))
    pairs = points.join(other, batch).where((F.col(row) != F.col("o_row")) | (F.col("side") != F.col("o_side")))
    scored = pairs.select(batch, row, "side", (dot(F.col("z"), F.col("o_z")) / F.lit(temperature)).alias("s"), (F.col(row) == F.col("o_row")).alias("partner"))
    top = scored.groupBy(batch, row, "side").agg(F.max("s").alias("top"))
    terms = scored.join(top, [batch, row, "side"]).groupBy(batch, row, "side").agg(
        (F.first("top") + F.ln(F.sum(F.exp(F.col("s") - F.col("top")))) - F.max(F.when(F.col("partner"), F.col("s")))).alias("ce")
    )
    return terms.groupBy(batch).agg(F.avg("ce").alias("loss"))


def triplet(rows: DataFrame, margin: float = 0.3, metric: str = "euclidean", anchor: str = "anchor", positive: str = "pos", negative: str = "neg") -> DataFrame:
    """loss: the mean of max(0, margin + d(a, p) - d(a, n)) over rows with a negative; 0 if there is none."""
    d = lambda x: distance(F.col(anchor), F.col(x), metric)
    term = F.greatest(F.lit(0.0), F.lit(margin) + d(positive) - d(negative))
    return rows.where(F.col(negative).isNotNull()).agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("loss"))


def retrofit(rows: DataFrame, metric: str = "euclidean", a: str = "a", b: str = "b") -> DataFrame:
    """loss: the mean distance of the two word vectors; 0 if there is none."""
    return rows.agg(F.coalesce(F.avg(distance(F.col(a), F.col(b), metric)), F.lit(0.0)).alias("loss"))


def total_loss(contrastive: DataFrame, hard: DataFrame | None, retro: DataFrame | None, hard_weight: float = 0.5, retro_weight: float = 0.1) -> DataFrame:
    """loss: the weighted sum; a term that no row qualifies for is None here and left out."""
    out = contrastive.agg(F.avg("loss").alias("loss"))
    for term, weight in ((hard, hard_weight), (retro, retro_weight)):
        if term is not None:
            out = out.crossJoin(term.select(F.col("loss").alias("_t"))).select((F.col("loss") + F.lit(weight) * F.col("_t")).alias("loss"))
    return out


def batch_mean(rows: DataFrame, value: str, batch: str) -> DataFrame:
    """loss: the mean over batches of each batch's mean (a last, partial batch counts fully)."""
    return rows.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"))


# ---------------------------------------------------------------------------------------------- retrieval

def retrieval(queries: DataFrame, candidates: DataFrame, topk: Iterable[int] = (1, 5), row: str = "row_no", vector: str = "vec") -> DataFrame:
    """One row: n, mrr, r_at_<k>.  Rows are aligned by number; ties favour the positive; k of 0 or less is left out; all
    values are 0 without rows."""
    unit = lambda df: df.where(F.col(vector).isNotNull()).select(row, normalize(F.col(vector)).alias(vector))
    q, c = unit(queries), unit(candidates)
    both = q.select(row).intersect(c.select(row))
    table = ranks(q.join(both, row), c.join(both, row), row, vector)
    hits = [F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"r_at_{k}") for k in topk if k > 0]
    return table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.lit(1.0) / F.col("rank")), F.lit(0.0)).alias("mrr"), *hits)


def paired_retrieval(pairs: DataFrame, topk: Iterable[int] = (1, 5), row: str = "row_no") -> DataFrame:
    """One row: n, then mrr and r_at_<k> of z1 to z2 (_12), of z2 to z1 (_21), and their means.  A k of 0 or less is 0."""
    z1, z2 = (pairs.select(row, F.col(c).alias("vec")) for c in ("z1", "z2"))
    one, two = retrieval(z1, z2, topk, row), retrieval(z2, z1, topk, row)
    names = ["mrr", *[f"r_at_{k}" for k in topk]]
    take = lambda df, s: df.select(F.col("n").alias(f"n{s}"), *[(F.col(x) if x in df.columns else F.lit(0.0)).alias(f"{x}{s}") for x in names])
    both = take(one, "_12").crossJoin(take(two, "_21"))
    return both.select(F.least("n_12", "n_21").alias("n"), *[f"{x}{s}" for x in names for s in ("_12", "_21")], *[(F.lit(0.5) * (F.col(f"{x}_12") + F.col(f"{x}_21"))).alias(x) for x in names])


def word_pairs(variants: DataFrame, keys: list[str], n: int = 200, seed: int = 42, different: bool = True) -> DataFrame:
    """Sampled variants (one for each index, see sampling.one_variant): those whose word differs, at most n in hash order."""
    rows = variants.where("kind = 'pos'")
    rows = rows.where("orig <> cand") if different else rows
    return hash_limit(rows, seed, [*keys, "idx"], n)


# ---------------------------------------------------------------------------------------------- geometry

def local_uniformity(points: DataFrame, key: str, k: int = 5, max_samples: int = 2048, seed: int = 42, vector: str = "vec") -> DataFrame:
    """u: the mean log of the mean of exp(-2 d2) over each point's k nearest; 0 for fewer than two points.

    At most max_samples points, in hash order, take part.
    """
    unit = points.where(F.col(vector).isNotNull()).select(key, normalize(F.col(vector)).alias(vector))
    chosen = hash_limit(unit, seed, [key], max_samples)
    if chosen.limit(2).count() < 2:
        return points.sparkSession.createDataFrame([(0.0,)], "u double")
    near = nearest_distances(chosen, key, k, vector)
    mean = F.aggregate("d2", F.lit(0.0), lambda s, d: s + F.exp(F.lit(-2.0) * d)) / F.size("d2")
    return near.agg(F.avg(F.ln(mean)).alias("u"))


def pairwise(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with cos, d2 and d_cos of two vector columns."""
    return rows.withColumns({"cos": dot(normalize(F.col(a)), normalize(F.col(b))), "d2": distance(F.col(a), F.col(b)), "d_cos": distance(F.col(a), F.col(b), "cosine")})


# ---------------------------------------------------------------------------------------------- consistency

def templates(spark, texts: Iterable[str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "template_no int, template string")


def filled(words: DataFrame, texts: DataFrame) -> DataFrame:
    """word, template_no, sentence, start (0-based place of the word): each word in each template (a few rows)."""
    rows = words.select("word").distinct().crossJoin(F.broadcast(texts))
    rows = rows.withColumn("sentence", fill_template(F.col("template"), F.col("word")))
    return rows.select("word", "template_no", "sentence", word_start(F.col("sentence"), F.col("word")).alias("start"))


def template_vectors(vectors: DataFrame) -> DataFrame:
    """word, vec: the normalized mean of a word's vectors over the templates."""
    return mean_by(vectors, ["word"], "vec").withColumn("vec", normalize(F.col("vec")))


def _cosines(pairs: DataFrame, vec: DataFrame) -> DataFrame:
    left, right = vec.select("word", F.col("vec").alias("v")), vec.select(F.col("word").alias("cand"), F.col("vec").alias("c"))
    return pairs.join(left, "word").join(right, "cand").withColumn("cos", dot(F.col("v"), F.col("c")))


def csc_template(pairs: DataFrame, vectors: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """csc, n: the mean cosine of synonym pairs (word, cand), at most n of them; 0 without pairs."""
    chosen = hash_limit(pairs.where("word <> cand"), seed, ["word", "cand"], n)
    return _cosines(chosen, template_vectors(vectors)).agg(F.coalesce(F.avg("cos"), F.lit(0.0)).alias("csc"), F.count(F.lit(1)).alias("n"))


def _margin(rows: DataFrame) -> DataFrame:
    """mu_same, mu_related, margin of rows (kind, cos); all 0 if either side is empty."""
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("cos")))
    means = rows.agg(mean("same").alias("s"), mean("related").alias("r"))
    both = F.col("s").isNotNull() & F.col("r").isNotNull()
    some = lambda c: F.when(both, c).otherwise(F.lit(0.0))
    return means.select(some(F.col("s")).alias("mu_same"), some(F.col("r")).alias("mu_related"), some(F.col("s") - F.col("r")).alias("margin"))


def csm_template(synonyms: DataFrame, related: DataFrame, vectors: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """Margin between a word's synonyms and its related words, over at most n words that have both; means over all pairs."""
    words = hash_limit(synonyms.select("word").intersect(related.select("word")), seed, ["word"], n)
    vec = template_vectors(vectors)
    kinds = [_cosines(p.join(words, "word", "left_semi"), vec).select(F.lit(k).alias("kind"), "cos") for k, p in (("same", synonyms), ("related", related))]
    return _margin(kinds[0].unionByName(kinds[1]))


def csc_entries(chosen: DataFrame, n: int = 200, keys: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """csc, n: the mean cosine of a and b, the contextual vectors of sampled variants; equal words are not excluded."""
    rows = hash_limit(chosen, seed, [*keys, "idx"], n)
    return rows.agg(F.coalesce(F.avg(dot(normalize(F.col("a")), normalize(F.col("b")))), F.lit(0.0)).alias("csc"), F.count(F.lit(1)).alias("n"))


def csm_entries(chosen: DataFrame, n: int = 200, keys: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Margin over indices that have a sampled variant of either kind: vectors a (original), p (positive), h (negative)."""
    rows = hash_limit(chosen.where("p is not null and h is not null"), seed, [*keys, "idx"], n)
    cos = lambda k, v: rows.select(F.lit(k).alias("kind"), dot(normalize(F.col("a")), normalize(F.col(v))).alias("cos"))
    return _margin(cos("same", "p").unionByName(cos("related", "h")))


def with_fallback(entries: DataFrame, template: DataFrame) -> DataFrame:
    """One row: csc, mu_same, mu_related, margin of two tables of one row each.

    A zero of the entry metrics means that there were none: the template metrics stand in for it, a margin's only if both
    of its means are zero.
    """
    names = ["csc", "mu_same", "mu_related", "margin"]
    both = entries.select(F.lit(0).alias("_k"), F.struct(*names).alias("e")).join(template.select(F.lit(0).alias("_k"), F.struct(*names).alias("t")), "_k")
    none = {"csc": F.col("e.csc") == 0.0} | dict.fromkeys(names[1:], (F.col("e.mu_same") == 0.0) & (F.col("e.mu_related") == 0.0))
    return both.select(*[F.when(none[c], F.col(f"t.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in names])


def best_epoch(metrics: DataFrame, name: str = "word_mrr") -> DataFrame:
    """epoch, value: the first epoch with the greatest value of a metric in (epoch, name, value)."""
    return metrics.where(F.col("name") == name).orderBy(F.desc("value"), "epoch").limit(1).select("epoch", "value")
