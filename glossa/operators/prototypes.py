"""Robust sense prototypes from contextual word vectors, and the assignment of words to their nearest prototype."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.vectors import dot, mean_by, normalize
from .common import saved, small
from .sampling import cap_per_group
from .similarity import nearest


@dataclass(frozen=True)
class Parameters:
    seed: int = 42
    max_per_word: int = 30
    keep_q: float = 0.6
    trim: float = 0.1
    safe_coh_q: float = 0.7
    min_keep: int = 20
    min_anchor_words: int = 2
    min_keep_anchor: int = 20
    margin: float = 0.10
    min_residual: int = 20


def center(items: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """keys, mu: the normalized mean vector."""
    return mean_by(items, keys, vector, "mu").withColumn("mu", normalize(F.col("mu")))


def share(n, q: float):
    """ceil(n * q), at least 1."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(q)))).cast("int")


#: Equal steps of the scores from -1 to 1 in which the rows of a group are counted; scores beyond fall into the end steps.
STEPS = 4096


def top_share(items: DataFrame, keys: list[str], item: str, score: str, q: float) -> DataFrame:
    """The ceil(n * q) best rows of each key by score, ties by item; null scores are the least.

    A group's rows are counted by steps of the score.  All rows above the step in which the share ends are taken, and only
    the rows of that step are ranked, so no window goes over a whole group.
    """
    within = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((F.col(score) + 1) * (STEPS / 2))))
    step = F.when(F.col(score).isNull(), -1).otherwise(within).cast("int")
    marked = items.withColumn("_step", step)
    counts = marked.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*keys)
    above = F.coalesce(F.sum("_n").over(by.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.select(*keys, "_step", "_n", above.alias("_above"), share(F.sum("_n").over(by), q).alias("_k"))
    ends = ends.where("_above < _k and _above + _n >= _k").select(*keys, F.col("_step").alias("_end"), (F.col("_k") - F.col("_above")).alias("_left"))
    joined = marked.join(ends, keys)
    ranked = joined.where("_step = _end").withColumn("_r", F.row_number().over(by.orderBy(F.desc(score), item))).where("_r <= _left")
    return joined.where("_step > _end").select(*items.columns).unionByName(ranked.select(*items.columns))


def trimmed_center(items: DataFrame, keys: list[str], item: str, trim: float = 0.1, vector: str = "vec") -> DataFrame:
    """keys, mu: the direction of the mean, taken again over the ceil(n * (1 - trim)) vectors nearest to it."""
    mu = center(items, keys, vector)
    if trim <= 0:
        return mu
    scored = saved(items.join(mu, keys).withColumn("_s", dot(F.col(vector), F.col("mu"))).drop("mu"))
    return center(top_share(scored, keys, item, "_s", 1 - trim), keys, vector)


def occurrences(positions: DataFrame, groups: DataFrame, cap: int = 30, seed: int = 42) -> DataFrame:
    """group_id, word, sid, pos: positions (sid, pos, word) of group words, at most cap a group and word."""
    rows = positions.join(small(groups.select("group_id", "word").distinct()), "word").select("group_id", "word", "sid", "pos")
    return cap_per_group(rows, ["group_id", "word"], ["group_id", "word", "sid", "pos"], cap, seed)


def keep_table(occ: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Kept items with sim to the group's first centre, and per group: n_occ, n_keep, cohesion (null for small groups)."""
    sizes = occ.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_occ"))
    big = occ.join(sizes.where(F.col("n_occ") >= p.min_keep).select("group_id"), "group_id")
    mu0 = trimmed_center(big, ["group_id"], "item", p.trim)
    scored = saved(big.join(mu0, "group_id").withColumn("sim", dot(F.col("vec"), F.col("mu"))).drop("mu"))
    keep = top_share(scored, ["group_id"], "item", "sim", p.keep_q)
    stats = keep.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_keep"), F.avg("sim").alias("cohesion"))
    return keep, sizes.join(stats, "group_id", "left")


def safe_groups(stats: DataFrame, p: Parameters) -> DataFrame:
    """group_id, cohesion, threshold of safe groups: cohesion at or above the quantile, and enough kept items."""
    threshold = stats.where("cohesion is not null").agg(F.percentile("cohesion", F.lit(p.safe_coh_q)).alias("threshold"))
    return stats.crossJoin(F.broadcast(threshold)).where((F.col("cohesion") >= F.col("threshold")) & (F.col("n_keep") >= p.min_keep)).select("group_id", "cohesion", "threshold")


def build(occ: DataFrame, groups: DataFrame, mono: DataFrame, p: Parameters = Parameters()) -> dict[str, DataFrame]:
    """Tables "prototypes" (group_id, vec), "meta" and "params" from occ(group_id, word, item, vec).

    groups: all group_id; mono: (group_id, word) of words of one group only.  Vectors must be normalized.
    """
    keep, stats = keep_table(saved(occ), p)
    keep, stats = saved(keep), saved(stats)
    safe = saved(safe_groups(stats, p))
    n_safe = safe.count()
    threshold = stats.where("cohesion is not null").agg(F.percentile("cohesion", F.lit(p.safe_coh_q))).first()[0]
    anchors = mono.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_anchor_words"))
    marked = keep.join(small(mono.withColumn("mono", F.lit(True))), ["group_id", "word"], "left").withColumn("mono", F.coalesce("mono", F.lit(False)))
    if n_safe:
        safe_proto = trimmed_center(keep.join(small(safe.select("group_id")), "group_id"), ["group_id"], "item", p.trim).select(F.col("group_id").alias("safe_id"), F.col("mu").alias("vec"))
        marked = nearest(marked, safe_proto, "item", "safe_id", name="best_sim")
    else:
        marked = marked.withColumn("best_sim", F.lit(-1.0))
    return _finish(marked, stats, groups, anchors, n_safe, threshold, p)


def _finish(marked, stats, groups, anchors, n_safe, threshold, p):
    marked = marked.withColumn("resid", (F.col("best_sim") - F.col("sim")) < F.lit(p.margin))
    counts = marked.groupBy("group_id").agg(F.count_if("mono").alias("n_anchor_occ"), F.count_if("resid").alias("n_residual"))
    table = groups.select("group_id").distinct().join(stats, "group_id", "left").join(counts, "group_id", "left").join(anchors, "group_id", "left")
    table = table.withColumn("n_anchor_words", F.coalesce("n_anchor_words", F.lit(0)))
    poly = F.col("n_anchor_words") == 0
    status = (
        F.when(F.col("n_keep").isNull(), "too_small_or_empty")
        .when(~poly & (F.col("n_anchor_words") >= p.min_anchor_words) & (F.col("n_anchor_occ") >= p.min_keep_anchor), "anchor_proto")
        .when(poly & F.lit(n_safe > 0) & (F.col("n_residual") >= p.min_residual), "allpoly_residual_proto")
        .when(poly & F.lit(n_safe > 0), "allpoly_fallback_keep_proto")
        .otherwise("keep_proto")
    )
    table = table.withColumn("status", status)
    rows = marked.join(table.select("group_id", "status"), "group_id")
    use = F.when(F.col("status") == "anchor_proto", F.col("mono")).when(F.col("status") == "allpoly_residual_proto", F.col("resid")).otherwise(F.lit(True))
    proto = trimmed_center(rows.where(use), ["group_id"], "item", p.trim)
    quality = rows.join(proto, "group_id").withColumn("q", dot(F.col("vec"), F.col("mu"))).groupBy("group_id").agg(
        F.avg("q").alias("quality_keep"), F.avg(F.when((F.col("status") == "allpoly_residual_proto") & F.col("resid"), F.col("q"))).alias("quality_residual")
    )
    all_poly = F.col("status").startswith("allpoly")
    meta = table.join(quality, "group_id", "left").select(
        "group_id", "status", F.coalesce("n_occ", F.lit(0)).alias("n_occ"), F.coalesce("n_keep", F.lit(0)).alias("n_keep"), "n_anchor_words",
        F.when(F.col("status") == "anchor_proto", F.col("n_anchor_occ")).alias("n_anchor_occ"), F.when(all_poly, F.col("n_residual")).alias("n_residual"),
        "cohesion", "quality_keep", "quality_residual",
    )
    params = groups.sparkSession.createDataFrame([(*asdict(p).values(), threshold, groups.select("group_id").distinct().count(), n_safe)], ", ".join(
        [f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in asdict(p).items()] + ["safe_coh_threshold double", "n_groups long", "n_safe_groups long"]))
    return {"prototypes": proto.select("group_id", F.col("mu").alias("vec")), "meta": meta, "params": params}


def status_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def readable(sentences: DataFrame, least: int = 2) -> DataFrame:
    """Sentences without their blank tokens, of at least `least` others; the words' places are counted without the blanks."""
    kept = F.filter("tokens", lambda t: F.coalesce(F.substring(t, 1, 1).between("!", "~") | ~t.rlike(r"(?U)^\s*$"), F.lit(False)))  # most tokens begin with a letter
    return sentences.withColumn("tokens", kept).where(F.size("tokens") >= least)


def assign(words: DataFrame, prototypes: DataFrame, members: DataFrame, min_sim: float = 0.5, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables "pairs" (words with best_group_id, sim, hit), "groups" (group_id, predicted_words, member_words), "meta".

    words: sid, item, word, vec.  With a vocabulary, other words are left out before any vector is compared.  A word is a
    hit at a similarity of min_sim or more.  If prototypes have `ord`, the groups carry it: the order of the output.
    """
    if vocabulary is not None:
        words = words.join(small(vocabulary), "word", "left_semi")
    pairs = nearest(words, prototypes.select("group_id", "vec"), "item", "group_id").withColumn("hit", F.col("sim") >= F.lit(min_sim))
    found = pairs.where("hit").groupBy(F.col("best_group_id").alias("group_id")).agg(F.array_sort(F.collect_set("word")).alias("predicted_words"))
    listed = members.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("member_words"))
    groups = found.join(listed, "group_id", "left").withColumn("member_words", F.coalesce("member_words", F.array().cast("array<string>")))
    if "ord" in prototypes.columns:
        groups = groups.join(prototypes.select("group_id", "ord"), "group_id")
    meta = pairs.agg(
        F.countDistinct("sid").alias("n_sentences"), F.count(F.lit(1)).alias("n_occurrences"), F.count_if(~F.col("hit")).alias("n_unmatched"),
        F.countDistinct(F.when(F.col("hit"), F.col("word"))).alias("n_words"), F.countDistinct(F.when(F.col("hit"), F.col("best_group_id"))).alias("n_groups"),
    )
    return {"pairs": pairs, "groups": groups, "meta": meta}
