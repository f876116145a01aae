"""Substitution variants: candidates of each token position, filtered by similarity to the word and to its context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import substitute
from ..functions.vectors import add, dot, normalize, scale
from .common import BROADCAST_ROWS, small

VARIANT = "array<struct<kind:string,idx:int,cand_ord:int,word:string,cand:string,word_sim:double,ctx_sim:double>>"


def length_filter(sentences: DataFrame, least: int = 3, most: int | None = 15, tokens: str = "tokens") -> DataFrame:
    """Rows of at least `least` and at most `most` (None: any number of) tokens."""
    size = F.size(tokens)
    return sentences.where((size >= least) if most is None else size.between(least, most))


def positions(sentences: DataFrame, keys: list[str]) -> DataFrame:
    return sentences.select(*keys, F.posexplode("tokens").alias("idx", "word"))


def candidates(sentences: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, word, cand: each position's candidates from pairs(word, cand)."""
    return positions(sentences, keys).join(small(pairs), "word").select(*keys, "idx", "word", "cand")


def context_vectors(sentences: DataFrame, word_vec: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, word, vec, ctx: for positions with a vector, the normalized mean vector of the other positions.

    The sum over a sentence less the position's own vector: linear in the sentence, which the length filter bounds.  ctx is
    null where no other position has a vector.  Another copy of the same word counts.
    """
    vecs = small(word_vec.select("word", normalize(F.col("vec")).alias("vec")))
    rows = positions(sentences, keys).join(vecs, "word")
    grouped = rows.groupBy(*keys).agg(F.collect_list(F.struct("idx", "word", "vec")).alias("items"))
    zero = F.transform(F.get("items", F.lit(0))["vec"], lambda x: F.lit(0.0))
    summed = grouped.withColumn("total", F.aggregate("items", zero, lambda s, x: add(s, x["vec"])))
    flat = summed.select(*keys, F.size("items").alias("n"), "total", F.explode("items").alias("x"))
    rest = normalize(scale(F.zip_with("total", F.col("x.vec"), lambda a, b: a - b), F.lit(1.0) / (F.col("n") - 1)))
    return flat.select(*keys, F.col("x.idx").alias("idx"), F.col("x.word").alias("word"), F.col("x.vec").alias("vec"), F.when(F.col("n") > 1, rest).alias("ctx"))


def embedding_filter(contexts: DataFrame, pairs: DataFrame, word_vec: DataFrame, word_threshold: float = 0.4, context_threshold: float = 0.25) -> DataFrame:
    """contexts' rows with cand and both similarities, for candidates that pass: near the word, and near its context if it
    has one.  Candidates without a vector are dropped."""
    vec = small(word_vec.select(F.col("word").alias("cand"), normalize(F.col("vec")).alias("cand_vec")))
    rows = contexts.join(small(pairs), "word").join(vec, "cand")
    scored = rows.withColumn("word_sim", dot(F.col("vec"), F.col("cand_vec"))).withColumn("ctx_sim", dot(F.col("ctx"), F.col("cand_vec")))
    return scored.where((F.col("word_sim") >= F.lit(word_threshold)) & (F.col("ctx").isNull() | (F.col("ctx_sim") >= F.lit(context_threshold)))).drop("vec", "ctx", "cand_vec")


def mlm_filter(rows: DataFrame, probabilities: DataFrame, keys: list[str], least: float = 0.01, top: int = 50) -> DataFrame:
    """Candidates that a masked language model gives a probability of at least `least` and a rank of at most `top`.

    probabilities: keys, idx, cand, p, rank of one-piece candidates at positions whose mask was in reach.
    """
    table = probabilities.where((F.col("p") >= F.lit(least)) & (F.col("rank") <= top)).select(*keys, "idx", "cand")
    return rows.join(table, [*keys, "idx", "cand"], "left_semi")


def first_candidates(rows: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """The first `most` candidates of each position in word order, numbered from 0."""
    w = Window.partitionBy(*keys, "idx").orderBy("cand")
    return rows.withColumn("cand_ord", F.row_number().over(w) - 1).where(F.col("cand_ord") < most)


def listed_variants(sentences: DataFrame, pairs: DataFrame, word_vec: DataFrame, keys: list[str], word_threshold: float = 0.4, context_threshold: float = 0.25, most: int = 4, limit: int = BROADCAST_ROWS, make=None) -> DataFrame:
    """keys, tokens, v: the variants (VARIANT) of each sentence, by position and kind; empty for a sentence without any.

    pairs: kind, word, cand.  The rows of context_vectors(), embedding_filter() and first_candidates(), for each kind.  Up to
    `limit` pairs and words that have a vector go to the tasks, and a sentence is done where its tokens are, without a
    shuffle; beyond that, and where a word has several vectors, those operators and a join make the lists.
    make: a function for tasks that gives the vectors of word_vec for an Arrow array of words (pieces.word_table); with it
    only the pairs are bounded, and each batch's words get their vectors where they are.
    """
    known = pairs.select("word").unionByName(pairs.select(F.col("cand").alias("word")))
    vectors = [] if make else word_vec.select("word", normalize(F.col("vec")).alias("vec")).where("word is not null and vec is not null").limit(limit + 1).collect()
    listed = pairs.select("kind", "word", "cand").where("word is not null and cand is not null").distinct().join(known.select("word").distinct(), "word", "left_semi").limit(limit + 1).collect()
    if max(len(vectors), len(listed)) > limit or len({r["word"] for r in vectors}) < len(vectors):
        contexts, parts = context_vectors(sentences, word_vec, keys), []
        for kind in sorted(r["kind"] for r in pairs.select("kind").distinct().collect()):  # a few kinds
            rows = embedding_filter(contexts, pairs.where(F.col("kind") == kind).select("word", "cand"), word_vec, word_threshold, context_threshold)
            parts.append(first_candidates(rows, keys, most).select(*keys, F.struct("idx", F.lit(kind).alias("kind"), "cand_ord", "word", "cand", "word_sim", "ctx_sim").alias("x")))
        flat = parts[0]
        for part in parts[1:]:
            flat = flat.unionByName(part)
        grouped = flat.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
        order = F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), x["idx"].alias("idx"), x["cand_ord"].cast("int").alias("cand_ord"), *[x[c].alias(c) for c in ("word", "cand", "word_sim", "ctx_sim")]))
        return sentences.select(*keys, "tokens").join(grouped.select(*keys, order.alias("v")), keys, "left").withColumn("v", F.coalesce("v", F.array().cast(VARIANT)))

    if make:
        words = sorted({r[c] for r in listed for c in ("word", "cand")})
        has, table = make(pa.array(words, pa.string()))
        words, table = [w for w, x in zip(words, has) if x], table[has]
    else:
        words, by_word = sorted(r["word"] for r in vectors), {r["word"]: r["vec"] for r in vectors}
        table = np.array([by_word[w] for w in words], np.float64).reshape(len(words), -1)
    place = {w: k for k, w in enumerate(words)}
    rows = sorted((place[r["word"]], r["kind"], place[r["cand"]]) for r in listed if r["word"] in place and r["cand"] in place)
    one, two = (np.array([r[k] for r in rows], np.int64) for k in (0, 2))
    sims = np.einsum("id,id->i", table[one], table[two]) if rows else np.empty(0)
    near = sims >= word_threshold
    one, two, sims, kinds = one[near], two[near], sims[near], [r[1] for r, x in zip(rows, near) if x]
    shared = sentences.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), table, one, two, sims, pa.array(kinds, pa.string())))
    kind_type = pa.struct([("kind", pa.string()), ("idx", pa.int32()), ("cand_ord", pa.int32()), ("word", pa.string()), ("cand", pa.string()), ("word_sim", pa.float64()), ("ctx_sim", pa.float64())])

    def run(batches):
        names, table, one, two, sims, kinds = shared.value
        code = np.asarray(kinds.dictionary_encode().indices).astype(np.int64)
        first, last = np.searchsorted(one, np.arange(len(names))), np.searchsorted(one, np.arange(len(names)), side="right")
        paired, listed = last > first, table
        for batch in batches:
            tokens = batch.column("tokens")
            n = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            sentence = np.repeat(np.arange(len(n)), n)
            idx = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=names), -1)).astype(np.int64)
            asked = np.zeros(len(n), bool)
            asked[sentence[word >= 0][paired[word[word >= 0]]]] = True
            if make:
                table = listed
                open_ = np.flatnonzero((word < 0) & asked[sentence])
                coded = pc.dictionary_encode(tokens.flatten().take(pa.array(open_)))
                known, made = make(coded.dictionary)
                number = np.append(np.where(known, len(names) + np.cumsum(known) - 1, -1), -1)
                word[open_] = number[np.asarray(coded.indices.fill_null(len(number) - 1)).astype(np.int64)]
                table = np.concatenate([listed, made[known].reshape(-1, listed.shape[1])])
            has = (word >= 0) & asked[sentence]
            sentence, idx, word = sentence[has], idx[has], word[has]
            count = np.bincount(sentence, minlength=len(n))
            begins = np.cumsum(count) - count
            total = np.zeros((len(n), table.shape[1]))
            if len(word):
                total[count > 0] = np.add.reduceat(table[word], begins[count > 0])
            own = np.minimum(word, max(len(names) - 1, 0))
            many = np.where(word < len(names), (last - first)[own], 0) if len(names) else np.zeros(len(word), np.int64)
            at = np.repeat(np.arange(len(word)), many)
            pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[own] if len(names) else word, many)
            others = count[sentence] - 1
            rest = (total[sentence] - table[word]) / np.maximum(others, 1)[:, None]
            rest /= np.maximum(np.sqrt((rest * rest).sum(axis=1, keepdims=True)), 1e-12)
            ctx = np.einsum("id,id->i", rest[at], table[two[pair]])
            kept = (others[at] == 0) | (ctx >= context_threshold)
            at, pair, ctx = at[kept], pair[kept], ctx[kept]
            group = at * (len(code) + 1) + code[pair]  # position and kind; candidates come in order
            starts = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.empty(0, np.int64)
            order = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            few = order < most
            at, pair, ctx, order = at[few], pair[few], ctx[few], order[few]
            made = pa.StructArray.from_arrays([
                kinds.take(pa.array(pair)), pa.array(idx[at].astype(np.int32)), pa.array(order.astype(np.int32)), names.take(pa.array(word[at])), names.take(pa.array(two[pair])),
                pa.array(sims[pair]), pa.array(ctx, mask=others[at] == 0)], fields=list(kind_type))
            ends = np.cumsum(np.bincount(sentence[at], minlength=len(n)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, "tokens"]), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), made)], [*keys, "tokens", "v"])

    source = sentences.select(*keys, "tokens")
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes), f"v {VARIANT}"]))


def training_entries(sentences: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens, pos, hard_neg: maps from the position, as text, to its variant token sequences.

    variants: keys, kind ("pos" or "hard_neg"), idx, cand_ord, cand.  Sentences without variants have empty maps.
    """
    grouped = variants.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "cand_ord", "cand"))).alias("v"))
    joined = sentences.select(*keys, "tokens").join(grouped, keys, "left")
    return listed_entries(joined.withColumn("v", F.coalesce("v", F.array().cast("array<struct<kind:string,idx:int,cand_ord:int,cand:string>>"))), keys)


def listed_entries(listed: DataFrame, keys: list[str]) -> DataFrame:
    """training_entries() of keys, tokens, v: the variants of a kind and position in the order of cand_ord."""

    def entry(kind):
        of_kind = F.filter("v", lambda x: x["kind"] == kind)
        at = F.array_sort(F.array_distinct(F.transform(of_kind, lambda x: x["idx"])))
        value = lambda i: F.transform(F.filter(of_kind, lambda x: x["idx"] == i), lambda x: substitute(F.col("tokens"), i, x["cand"]))
        return F.map_from_entries(F.transform(at, lambda i: F.struct(i.cast("string"), value(i))))

    return listed.select(*keys, "tokens", entry("pos").alias("pos"), entry("hard_neg").alias("hard_neg"))


def normal_form(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, idx, cand_ord, orig, cand, variant of entries; keys of maps that are no integers, and indices outside of
    the tokens, are skipped."""
    of = lambda kind: F.transform(F.map_entries(F.coalesce(kind, F.create_map().cast("map<string,array<array<string>>>"))), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("k"), e["value"].alias("vs")))
    rows = entries.select(*keys, "tokens", F.inline(F.concat(of("pos"), of("hard_neg"))))
    rows = rows.withColumn("idx", F.expr("try_cast(k as int)")).where("idx is not null and idx >= 0 and idx < size(tokens)")
    rows = rows.select(*keys, "kind", "idx", F.get("tokens", "idx").alias("orig"), F.posexplode("vs").alias("cand_ord", "variant"))
    return rows.select(*keys, "kind", "idx", "cand_ord", "orig", F.get("variant", "idx").alias("cand"), "variant")
