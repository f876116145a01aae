"""Samples, splits and batches in a fixed hash order: uniform, repeatable, and independent of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hash_limit, hash_order, hash_rank, hash_wide, small


def train_valid_split(rows: DataFrame, keys: list[str], valid_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with split: the first int(n * (1 - ratio)) in hash order are "train", the others "valid"."""
    n = rows.count()
    ranked = hash_rank(rows, seed, keys, name="_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= int(n * (1 - valid_ratio)), "train").otherwise("valid")).drop("_rank")


def cap_per_group(rows: DataFrame, by: list[str], keys: list[str], cap: int = 30, seed: int = 42) -> DataFrame:
    """At most cap rows of each group, uniform without replacement.  Window limits keep cap rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy("_h", *keys)
    return rows.withColumn("_h", hash_order(seed, *keys)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_h", "_r")


def sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, uniform without replacement (a mergeable reservoir)."""
    return hash_limit(rows, seed, keys, n)


def limit_or_all(rows: DataFrame, keys: list[str], n: int = 0, seed: int = 42) -> DataFrame:
    """n rows in hash order; 0 means all."""
    return hash_limit(rows, seed, keys, n) if n else rows


def one_variant(variants: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """One random variant of each (entry, kind, index)."""
    least = variants.withColumn("_h", hash_order(seed, *keys, "kind", "idx", "cand_ord"))
    w = Window.partitionBy(*keys, "kind", "idx").orderBy("_h", "cand_ord")
    return least.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_h", "_r")


def first_positive(variants: DataFrame, keys: list[str]) -> DataFrame:
    """The validation positive: the least index (as a number), its first variant."""
    rest = [c for c in variants.columns if c not in keys and c not in ("kind", "idx", "cand_ord")]
    best = variants.where("kind = 'pos'").groupBy(*keys).agg(F.min(F.struct("idx", "cand_ord", *rest)).alias("b"))
    return best.select(*keys, "b.*")


def random_choice(variants: DataFrame, keys: list[str], kind: str, seed: int = 42) -> DataFrame:
    """One variant of each entry: uniform over its indices, then uniform over the index's variants."""
    own = variants.where(F.col("kind") == kind)
    index = own.select(*keys, "idx").distinct().withColumn("_h", hash_order(f"{seed}:index:{kind}", *keys, "idx"))
    index = index.groupBy(*keys).agg(F.min(F.struct("_h", "idx"))["idx"].alias("idx"))
    rows = own.join(index, [*keys, "idx"]).withColumn("_h", hash_order(f"{seed}:variant:{kind}", *keys, "idx", "cand_ord"))
    rest = [c for c in variants.columns if c not in keys and c not in ("kind", "cand_ord")]
    return rows.groupBy(*keys).agg(F.min(F.struct("_h", "cand_ord", *rest)).alias("b")).select(*keys, "b.cand_ord", *[f"b.{c}" for c in rest])


def samples(entries: DataFrame, variants: DataFrame, keys: list[str], train: bool = True, seed: int = 42) -> DataFrame:
    """keys, s_tokens, s_pos_tokens, s_neg_tokens, word_idx, orig_word, repl_word, has_neg, has_retrofit.

    Without positives the positive is a copy at index -1; negatives are drawn in training only.  has_retrofit is 1 for an
    index in range whose words are there and differ.
    """
    pos = (random_choice(variants, keys, "pos", seed) if train else first_positive(variants, keys)).select(*keys, F.col("idx").alias("word_idx"), F.col("orig").alias("orig_word"), F.col("cand").alias("repl_word"), F.col("variant").alias("p"))
    out = entries.select(*keys, "tokens").join(pos, keys, "left")
    if train:
        out = out.join(random_choice(variants, keys, "hard_neg", seed).select(*keys, F.col("variant").alias("n")), keys, "left")
    else:
        out = out.withColumn("n", F.lit(None).cast("array<string>"))
    both = (F.coalesce("orig_word", F.lit("")) != "") & (F.coalesce("repl_word", F.lit("")) != "") & (F.col("orig_word") != F.col("repl_word"))
    return out.select(
        *keys, F.col("tokens").alias("s_tokens"), F.coalesce("p", "tokens").alias("s_pos_tokens"), F.col("n").alias("s_neg_tokens"), F.coalesce("word_idx", F.lit(-1)).alias("word_idx"),
        "orig_word", "repl_word", F.col("n").isNotNull().cast("int").alias("has_neg"), F.coalesce(both.cast("int"), F.lit(0)).alias("has_retrofit"),
    )


def mini_batches(rows: DataFrame, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """rows with batch, in hash order; a last batch that is not full is dropped."""
    n = rows.count() // size * size
    ranked = hash_rank(rows, seed, keys, name="_rank").where(F.col("_rank") <= n)
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def sense_index(tokens: DataFrame, senses: DataFrame, key: str, include_no_sense: bool = True) -> DataFrame:
    """sense_id, key: each entry under each sense of its tokens, or under NO_SENSE."""
    found = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("word")).join(small(senses), "word").select("sense_id", key).distinct()
    if not include_no_sense:
        return found
    none = tokens.select(key).join(found.select(key).distinct(), key, "left_anti").select(F.lit("NO_SENSE").alias("sense_id"), key)
    return found.unionByName(none)


def check_batches(batch_size: int, k: int) -> None:
    if k <= 0:
        raise ValueError("the number of groups must be positive")
    if batch_size % k:
        raise ValueError("the batch size must be a multiple of the number of groups")
    if k > batch_size:
        raise ValueError("a batch can't have more groups than rows")


def different_draws(n: Column, k: int, seed: str, *keys: Column) -> Column:
    """array<long>: k different numbers below n, each set of k as likely as any other; n must be k at least.

    The j-th draw is below n - k + j + 1, and stands for the greatest of these numbers where it was drawn before: k draws,
    whatever n is.
    """
    def step(drawn, j):
        number = F.pmod(hash_wide(seed, *keys, j), n - k + j + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, number), (n - k + j).cast("long")).otherwise(number)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), step)


def loose_draws(n: Column, k: int, seed: str, *keys: Column) -> Column:
    """array<long>: k numbers below n, drawn with replacement."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod(hash_wide(seed, *keys, j), n))


def two_stage_batches(index: DataFrame, key: str, n_entries: int, batch_size: int, k: int, seed: int = 42) -> DataFrame:
    """batch, slot, sense_id, pick, key: n_entries // batch_size batches of k groups with batch_size / k rows each.

    Groups are drawn without replacement if there are enough, else with, and so are the rows of each.  Groups and the rows
    of a group are numbered in hash order, and draws are numbers, so that the work grows with the rows of the batches alone
    and a pick is an equi-join on the group and the row's number.
    """
    check_batches(batch_size, k)
    spark, m = index.sparkSession, batch_size // k
    pools = index.groupBy("sense_id").agg(F.count(F.lit(1)).alias("pool"))
    ordered = hash_rank(pools, f"{seed}:order", ["sense_id"], name="gno").withColumn("gno", F.col("gno") - 1)
    groups = pools.count()
    if not groups:
        raise ValueError("there is no group to draw from")
    batches = spark.range(n_entries // batch_size).select(F.col("id").alias("batch"))
    draws = (different_draws if groups >= k else loose_draws)(F.lit(groups).cast("long"), k, f"{seed}:group", F.col("batch"))
    chosen = batches.select("batch", F.posexplode(draws).alias("slot", "gno")).join(small(ordered), "gno")
    keys = F.col("batch"), F.col("slot")
    rows = F.when(F.col("pool") >= m, different_draws(F.col("pool"), m, f"{seed}:pick", *keys)).otherwise(loose_draws(F.col("pool"), m, f"{seed}:pick", *keys))
    picks = chosen.select("batch", "slot", "sense_id", F.posexplode(rows).alias("pick", "row"))
    pool = hash_rank(index, f"{seed}:pool", [key], by=["sense_id"], name="row").withColumn("row", F.col("row") - 1)
    return picks.join(pool, ["sense_id", "row"]).select("batch", "slot", "sense_id", "pick", key)
