"""The registered queries: each applies an operator to its whole table.  Floats are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions import vectors as vc
from ..operators import augment, match, metrics, postings, prototypes, sampling, splitting
from ..operators import lexicon as lx
from ..operators.common import hash_limit, hash_number, hash_order, hash_rank, saved, small

#: A small lexicon over the words of `documents`: every tag, a word of several senses, a repeated word and sense id.
LEXICON = """Xa01A01= the la der le
Xa01A02= of de von des
Xa01A03= and y und et
Xa01A04= in en dans im
Xa01A05= la de la
Xa01A06= solo
Xb01B01# that das que qui
Xb01B02# for por für pour
Xb01B03# the and
Xa01A03# with mit con avec
Xc01C01@ th er nd"""

ENDS = ".!?;"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return lx.from_text(spark, LEXICON)


#: Words in a line of the documents' lexicon, and the tags of its successive lines; lines of one cycle share their code.
LINE_WORDS, LINE_TAGS = 8, "=#=@"


def document_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of all words of the documents: those of each language in hash order, in lines under codes of the language.

    A word of several languages has several senses; a code has two `=` lines, of which groups take the last, and others.
    """
    words = tokens(spark, sf_dir).select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode("tokens").alias("word")).distinct()
    ranked = hash_rank(words, 11, ["lang", "word"], by=["lang"]).withColumn("line", F.floor((F.col("rank") - 1) / LINE_WORDS).cast("int"))
    langs = words.select("lang").distinct().withColumn("no", F.row_number().over(Window.orderBy("lang")) - 1)  # a few languages
    lines = ranked.groupBy("lang", "line").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w")).join(small(langs), "lang")
    tag = F.substring(F.lit(LINE_TAGS), (F.col("line") % len(LINE_TAGS)) + 1, F.lit(1))
    code = F.concat(F.lit("L"), "lang", F.format_string("%06d", F.floor(F.col("line") / len(LINE_TAGS)).cast("long")), tag)
    value = F.concat_ws(" ", code, F.transform("w", lambda x: x["word"]))
    return lx.parse(lines.select((F.col("line") * 64 + F.col("no")).cast("int").alias("line_no"), value.alias("value")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.tokens_of(read(spark, sf_dir, "documents"), ["doc_id", "lang"])


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sno, tokens of sentences of 3 to 15 tokens."""
    rows = splitting.sentences(read(spark, sf_dir, "documents"), ["doc_id"], ends=ENDS, newline=True)
    return augment.length_filter(rows.select("doc_id", "sno", tx.tokenize(F.col("sentence")).alias("tokens")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, vec (normalized doubles)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", vc.normalize(vc.doubles(F.col("embedding"))).alias("vec"))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, vec: a vector of the embeddings for each word of the lexicon, by the word's rank."""
    words = lexicon(spark).where("word is not null").select("word").distinct()
    ranked = words.withColumn("vec_id", F.row_number().over(Window.orderBy("word")).cast("long") - 1)  # the lexicon's few words
    return ranked.join(points(spark, sf_dir).select("vec_id", "vec"), "vec_id").select("word", "vec")


def z_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, z1, z2: neighbours in vec_id."""
    p = points(spark, sf_dir).withColumn("row_no", F.floor(F.col("vec_id") / 2).cast("long"))
    side = lambda k: p.where(F.col("vec_id") % 2 == k).select("row_no", F.col("vec").alias(f"z{k + 1}"))
    return side(0).join(side(1), "row_no")


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------------------------- matching

@query
def sense_counts(spark, sf_dir):
    return match.sense_counts(tokens(spark, sf_dir), lexicon(spark))


@query
def matched_sentences(spark, sf_dir):
    rows = match.matched(tokens(spark, sf_dir), lexicon(spark), ["doc_id"])
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query
def match_counts(spark, sf_dir):
    return match.n_matches(tokens(spark, sf_dir), lexicon(spark), ["doc_id"])


@query
def match_summary(spark, sf_dir):
    return match.match_summary(tokens(spark, sf_dir), lexicon(spark), ["doc_id"], "lang")


@query
def rare_senses(spark, sf_dir):
    return match.rare_senses(sense_counts(spark, sf_dir), lexicon(spark))


@query
def regex_substring_match(spark, sf_dir):
    found = match.substring_matches(read(spark, sf_dir, "documents"), lexicon(spark), ["doc_id"])
    return found.select("doc_id", F.size("words").cast("long").alias("n_match"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


@query
def token_counts(spark, sf_dir):
    return tokens(spark, sf_dir).select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query
def posting_lists(spark, sf_dir):
    """The positional index of every word of the documents, by block, and the digests of its gaps."""
    index = postings.build(tokens(spark, sf_dir))
    digest = lambda *cs: F.md5(F.concat_ws("|", *[F.array_join(c, ",") for c in cs]).cast("binary"))
    return index.select("word", "block", "n_docs", "n", "last", digest("docs", "counts", "places").alias("gaps_md5"))


@query
def phrase_lookup(spark, sf_dir):
    """The first three words of each benchmark item, sought in the documents' index."""
    words = match.tokens_of(read(spark, sf_dir, "benchmark"), ["item_id"]).select("item_id", F.posexplode(F.slice("tokens", 1, 3)).alias("slot", "word"))
    found = postings.phrases(postings.build(tokens(spark, sf_dir)), words, "item_id")
    return found.select("item_id", F.col("doc").alias("doc_id"), "start")


@query
def inverted_index(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(small(lx.vocabulary(lexicon(spark))), "word", "left_semi")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


# ---------------------------------------------------------------------------------------------- lexicon views

@query
def lexicon_table(spark, sf_dir):
    return document_lexicon(spark, sf_dir).select("line_no", "code", "tag", "sense_id", "n_parts", "ord", "word")


@query
def lexicon_senses(spark, sf_dir):
    return lx.unique_senses(document_lexicon(spark, sf_dir)).select("word", F.array_join("senses", ",").alias("senses"))


@query
def word_senses_all(spark, sf_dir):
    return lx.word_senses(document_lexicon(spark, sf_dir)).groupBy("word", "sense_id").agg(F.count(F.lit(1)).alias("n"))


@query
def syn_pairs(spark, sf_dir):
    return lx.pairs(document_lexicon(spark, sf_dir), "=")


@query
def related_pairs(spark, sf_dir):
    return lx.pairs(document_lexicon(spark, sf_dir), "#")


@query
def equals_groups(spark, sf_dir):
    return lx.groups(document_lexicon(spark, sf_dir))


@query
def raw_members(spark, sf_dir):
    return lx.raw_members(document_lexicon(spark, sf_dir))


@query
def mono_words(spark, sf_dir):
    return lx.mono_words(document_lexicon(spark, sf_dir))


@query
def vocab_union(spark, sf_dir):
    return lx.vocabulary(document_lexicon(spark, sf_dir))


@query
def both_tag_words(spark, sf_dir):
    return lx.both_tag_words(document_lexicon(spark, sf_dir))


# ---------------------------------------------------------------------------------------------- text

@query
def sentence_split(spark, sf_dir):
    rows = splitting.sentences(read(spark, sf_dir, "documents"), ["doc_id"], ends=ENDS, newline=True)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence").cast("long")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


@query
def colon_split(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = splitting.sentences(docs, ["doc_id"], ends=ENDS, newline=True, colon=",", colon_limit=20)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") > 0).alias("n_split"), F.sum(F.length("sentence").cast("long")).alias("chars"))


@query
def sanitize_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.file_name(F.col("url"), 40).alias("name"))


@query
def document_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.document_name(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("doc_id").cast("string")), F.col("text")).alias("name"))


@query
def length_filter(spark, sf_dir):
    return sentence_tokens(spark, sf_dir).groupBy(F.size("tokens").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))


@query
def protected_span(spark, sf_dir):
    span = tx.protected_span(F.col("tokens"), F.lit("the"))
    return tokens(spark, sf_dir).select("doc_id", span["l"].cast("long").alias("l"), span["r"].cast("long").alias("r"))


@query
def split_index(spark, sf_dir):
    cut = tx.pick_split(F.col("tokens"), 10, tx.protected_span(F.col("tokens"), F.lit("the"), 2), connectors=("and", "und", "et", "y"), soft=("of", "de"))
    return sentence_tokens(spark, sf_dir).select("doc_id", "sno", cut.cast("long").alias("cut"))


@query
def semantic_split(spark, sf_dir):
    rows = splitting.split_texts(read(spark, sf_dir, "documents"), ["doc_id"], ends=ENDS, newline=True, limit=60, connectors=frozenset(("and", "und", "et", "y")), soft=frozenset((",", ":")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk").cast("long")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


@query
def bmes_decode(spark, sf_dir):
    """Labels by a token's characters: a token of one is S, else B, M..., E; decoding gives the tokens again."""
    docs = tokens(spark, sf_dir).select("doc_id", "tokens", F.array_join("tokens", "").alias("text"))
    labels = F.flatten(F.transform("tokens", lambda t: F.when(F.length(t) == 1, F.array(F.lit("S"))).otherwise(F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), F.length(t) - 2), F.array(F.lit("E"))))))
    places = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1)).otherwise(F.array().cast("array<int>"))
    offsets = F.transform(places, lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    decoded = docs.select("doc_id", splitting.decode_labels(F.col("text"), labels, offsets).alias("words"))
    return decoded.select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


@query
def template_fill(spark, sf_dir):
    words = document_lexicon(spark, sf_dir).where("word is not null").select("word")
    return metrics.filled(words, metrics.templates(spark)).select("word", "template_no", "sentence", F.col("start").cast("long").alias("start"))


@query
def sub_token_overlap(spark, sf_dir):
    """The first token of a sentence that overlaps the characters 10 to 14 of its tokens joined by a space."""
    rows = sentence_tokens(spark, sf_dir)
    ends = "aggregate(tokens, cast(array() as array<struct<s:int,e:int>>), (a, t) -> concat(a, array(named_struct('s', coalesce(a[size(a) - 1].e + 1, 0), 'e', coalesce(a[size(a) - 1].e + 1, 0) + length(t)))))"
    ends = ends.replace("a[size(a) - 1].e", "get(a, size(a) - 1).e")
    return rows.select("doc_id", "sno", tx.first_overlap(F.expr(ends), F.lit(10), F.lit(14)).cast("long").alias("idx"))


# ---------------------------------------------------------------------------------------------- vectors

@query
def group_centers(spark, sf_dir):
    mu = prototypes.center(points(spark, sf_dir), ["label"])
    return mu.select("label", F.posexplode("mu").alias("dim", "x")).select("label", "dim", r6("x").alias("x"))


@query
def trimmed_centers(spark, sf_dir):
    mu = prototypes.trimmed_center(points(spark, sf_dir), ["label"], "vec_id")
    return mu.select("label", F.posexplode("mu").alias("dim", "x")).select("label", "dim", r6("x").alias("x"))


def kept(spark, sf_dir):
    occ = points(spark, sf_dir).select(F.col("label").alias("group_id"), F.col("vec_id").alias("item"), "vec")
    return prototypes.keep_table(occ, prototypes.Parameters())


@query
def top_q_keep(spark, sf_dir):
    return kept(spark, sf_dir)[0].select(F.col("group_id").alias("label"), F.col("item").alias("vec_id"), r6("sim").alias("sim"))


@query
def cohesion(spark, sf_dir):
    return kept(spark, sf_dir)[1].select(F.col("group_id").alias("label"), "n_occ", "n_keep", r6("cohesion").alias("cohesion"))


@query
def pairwise_distance(spark, sf_dir):
    rows = metrics.pairwise(z_pairs(spark, sf_dir), "z1", "z2")
    return rows.select("row_no", r6("cos").alias("cos"), r6("d2").alias("d2"), r6("d_cos").alias("d_cos"))


@query
def masked_mean(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("mask", (F.col("vec_id") % 3 == 0) & (F.col("label") != 5))
    mean = vc.masked_mean_by(rows, ["label"], "vec", "mask")
    return mean.select("label", F.posexplode("vec").alias("dim", "x")).select("label", "dim", r6("x").alias("x"))


@query
def word_vector_lookup(spark, sf_dir):
    """The vector at index label - 2 of a row's three neighbours; null out of range."""
    p = points(spark, sf_dir)
    grouped = p.groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("row_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "vec"))), lambda x: x["vec"]).alias("words"), F.min("label").alias("label"))
    found = grouped.select("row_no", vc.word_vector(F.col("words"), F.col("label") - 2).alias("v"))
    return found.select("row_no", r6(F.get("v", F.lit(0))).alias("x0"), r6(vc.norm(F.col("v"))).alias("norm"))


# ---------------------------------------------------------------------------------------------- prototypes

def occurrence_table(spark, sf_dir):
    """group_id, word, item, vec: occurrences made of the embeddings, with words of one group and of several."""
    p = points(spark, sf_dir)
    word = F.when(F.col("label") < 4, F.concat(F.lit("m"), F.col("label").cast("string"), F.lit("_"), (F.col("vec_id") % 3).cast("string"))).when(
        (F.col("label") == 4) & (F.col("vec_id") % 4 == 0), F.lit("solo4")).otherwise(F.concat(F.lit("p"), (F.col("vec_id") % 6).cast("string")))
    return p.select(F.col("label").alias("group_id"), word.alias("word"), F.col("vec_id").alias("item"), "vec")


def built(spark, sf_dir):
    occ = occurrence_table(spark, sf_dir)
    words = occ.select("group_id", "word").distinct()
    single = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("word")
    return prototypes.build(occ, words.select("group_id").distinct(), words.join(single, "word").select("group_id", "word"), prototypes.Parameters(margin=0.0))


@query
def safe_groups(spark, sf_dir):
    stats = prototypes.keep_table(occurrence_table(spark, sf_dir), prototypes.Parameters())[1]
    return prototypes.safe_groups(stats, prototypes.Parameters()).select("group_id", r6("cohesion").alias("cohesion"), r6("threshold").alias("threshold"))


@query
def prototype_status(spark, sf_dir):
    return built(spark, sf_dir)["meta"].select("group_id", "status", "n_occ", "n_keep", F.col("n_anchor_words").cast("long").alias("n_anchor_words"), "n_anchor_occ", "n_residual")


@query
def prototype_quality(spark, sf_dir):
    return built(spark, sf_dir)["meta"].select("group_id", *[r6(c).alias(c) for c in ("cohesion", "quality_keep", "quality_residual")])


@query
def prototype_vectors(spark, sf_dir):
    rows = built(spark, sf_dir)["prototypes"]
    return rows.select("group_id", F.posexplode("vec").alias("dim", "x")).select("group_id", "dim", r6("x").alias("x"))


@query
def prototype_params(spark, sf_dir):
    return built(spark, sf_dir)["params"].select("min_keep", "keep_q", "trim", "margin", r6("safe_coh_threshold").alias("safe_coh_threshold"), "n_groups", "n_safe_groups")


@query
def status_counts(spark, sf_dir):
    return prototypes.status_counts(built(spark, sf_dir)["meta"])


def assigned(spark, sf_dir):
    centers = prototypes.trimmed_center(points(spark, sf_dir), ["label"], "vec_id").select(F.col("label").alias("group_id"), F.col("mu").alias("vec"))
    words = points(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 5).cast("long").alias("sid"), F.col("vec_id").alias("item"), F.concat(F.lit("w"), (F.col("vec_id") % 37).cast("string")).alias("word"), "vec")
    members = centers.select("group_id", F.posexplode(F.array(F.lit("b"), F.concat(F.lit("a"), F.col("group_id").cast("string")))).alias("ord", "word"))
    return prototypes.assign(words, centers, members, min_sim=0.3)


@query
def nearest_prototype(spark, sf_dir):
    return assigned(spark, sf_dir)["pairs"].select("item", F.col("best_group_id").alias("group_id"), r6("sim").alias("sim"), "hit")


@query
def assign_words(spark, sf_dir):
    return assigned(spark, sf_dir)["groups"].select("group_id", F.array_join("predicted_words", ",").alias("predicted_words"), F.array_join("member_words", ",").alias("member_words"))


@query
def assign_meta(spark, sf_dir):
    return assigned(spark, sf_dir)["meta"]


# ---------------------------------------------------------------------------------------------- variants

@query
def substitution_candidates(spark, sf_dir):
    found = augment.candidates(sentence_tokens(spark, sf_dir), lx.pairs(lexicon(spark), "="), ["doc_id", "sno"])
    return found.groupBy("doc_id", "word", "cand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("idx").cast("long")).alias("idx_sum"))


@query
def context_vectors(spark, sf_dir):
    rows = augment.context_vectors(sentence_tokens(spark, sf_dir), word_vectors(spark, sf_dir), ["doc_id", "sno"])
    return rows.select("doc_id", "sno", "idx", "word", r6(vc.dot(F.col("vec"), F.col("ctx"))).alias("sim"))


def listed(spark, sf_dir, **kinds):
    """Each sentence with its variants of these kinds (kind=tag), near the word and its context."""
    lex, pairs = lexicon(spark), None
    for kind, tag in kinds.items():
        part = lx.pairs(lex, tag).select(F.lit(kind).alias("kind"), "word", "cand")
        pairs = part if pairs is None else pairs.unionByName(part)
    return augment.listed_variants(sentence_tokens(spark, sf_dir), pairs, word_vectors(spark, sf_dir), ["doc_id", "sno"], -0.05, -0.1)


def filtered(spark, sf_dir, tag):
    return listed(spark, sf_dir, pos=tag).select("doc_id", "sno", F.inline("v"))


@query
def embed_filtered_variants(spark, sf_dir):
    return filtered(spark, sf_dir, "=").select("doc_id", "sno", "idx", "word", "cand", "cand_ord", r6("word_sim").alias("word_sim"), r6("ctx_sim").alias("ctx_sim"))


@query
def mlm_filtered_variants(spark, sf_dir):
    """The probability table stands in for a masked model's: numbers from a hash of position and candidate."""
    keys = ["doc_id", "sno"]
    rows = augment.candidates(sentence_tokens(spark, sf_dir), lx.pairs(lexicon(spark), "="), keys)
    table = rows.select(*keys, "idx", "cand", (hash_number("mlm", F.col("doc_id"), F.col("sno"), F.col("idx"), F.col("cand")) % 1000).alias("h")).distinct()
    table = table.select(*keys, "idx", "cand", (F.col("h") / 20000.0).alias("p"), (F.col("h") % 70).alias("rank"))
    return augment.first_candidates(augment.mlm_filter(rows, table, keys), keys).select(*keys, "idx", "word", "cand", "cand_ord")


def entry_tables(spark, sf_dir):
    keys = ["doc_id", "sno"]
    entries = augment.listed_entries(listed(spark, sf_dir, pos="=", hard_neg="#"), keys)
    return entries, augment.normal_form(entries, keys)


@query
def training_entries(spark, sf_dir):
    entries, _ = entry_tables(spark, sf_dir)
    return entries.select("doc_id", "sno", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.array_sort(F.map_keys("pos")), ",").alias("pos_keys"), F.array_join(F.array_sort(F.map_keys("hard_neg")), ",").alias("neg_keys"))


@query
def entry_variants(spark, sf_dir):
    _, rows = entry_tables(spark, sf_dir)
    return rows.select("doc_id", "sno", "kind", "idx", "cand_ord", "orig", "cand", F.array_join("variant", " ").alias("variant"))


# ---------------------------------------------------------------------------------------------- samples

@query
def train_valid_split(spark, sf_dir):
    return sampling.train_valid_split(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query
def capped_occurrences(spark, sf_dir):
    pos = tokens(spark, sf_dir).select(F.col("doc_id").alias("sid"), F.posexplode("tokens").alias("pos", "word"))
    return prototypes.occurrences(pos, lx.groups(lexicon(spark)), cap=30)


@query
def pair_sample(spark, sf_dir):
    return sampling.sample(z_pairs(spark, sf_dir).select("row_no"), ["row_no"], 200)


@query
def reservoir_sample(spark, sf_dir):
    return sampling.sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 100, seed=7)


@query
def mini_batches(spark, sf_dir):
    return sampling.mini_batches(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64)


@query
def hash_ranks(spark, sf_dir):
    return hash_rank(read(spark, sf_dir, "documents").select("doc_id", "lang"), 5, ["doc_id"], by=["lang"])


@query
def one_variant(spark, sf_dir):
    rows = sampling.one_variant(entry_tables(spark, sf_dir)[1], ["doc_id", "sno"])
    return rows.select("doc_id", "sno", "kind", "idx", "cand_ord", "cand")


@query
def val_positive(spark, sf_dir):
    return sampling.first_positive(entry_tables(spark, sf_dir)[1], ["doc_id", "sno"]).select("doc_id", "sno", "idx", "cand_ord", "orig", "cand")


@query
def train_samples(spark, sf_dir):
    entries, variants = entry_tables(spark, sf_dir)
    rows = sampling.samples(entries, variants, ["doc_id", "sno"])
    join = lambda c: F.array_join(c, " ").alias(c)
    return rows.select("doc_id", "sno", join("s_pos_tokens"), join("s_neg_tokens"), "word_idx", "orig_word", "repl_word", "has_neg", "has_retrofit")


@query
def valid_samples(spark, sf_dir):
    entries, variants = entry_tables(spark, sf_dir)
    rows = sampling.samples(entries, variants, ["doc_id", "sno"], train=False)
    return rows.select("doc_id", "sno", F.array_join("s_pos_tokens", " ").alias("s_pos_tokens"), "word_idx", "has_neg", "has_retrofit")


@query
def sense_index(spark, sf_dir):
    rows = sampling.sense_index(tokens(spark, sf_dir).select("doc_id", "tokens"), lx.word_senses(lexicon(spark)).distinct(), "doc_id")
    return rows.groupBy("sense_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query
def two_stage_batches(spark, sf_dir):
    toks = tokens(spark, sf_dir).select("doc_id", "tokens")
    index = sampling.sense_index(toks, lx.word_senses(lexicon(spark)).distinct(), "doc_id")
    return sampling.two_stage_batches(index, "doc_id", toks.count(), 32, 4)


# ---------------------------------------------------------------------------------------------- losses and metrics

def loss_batches(spark, sf_dir):
    return z_pairs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("row_no") / 25).cast("long"))


def triples(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("row_no", F.floor(F.col("vec_id") / 3).cast("long"))
    side = lambda k, n: p.where(F.col("vec_id") % 3 == k).select("row_no", F.col("vec").alias(n))
    return side(0, "anchor").join(side(1, "pos"), "row_no").join(side(2, "neg"), "row_no")


@query
def infonce_loss(spark, sf_dir):
    return metrics.infonce(loss_batches(spark, sf_dir)).select("batch_id", r6("loss").alias("loss"))


@query
def triplet_loss(spark, sf_dir):
    rows = triples(spark, sf_dir)
    both = metrics.triplet(rows).select(F.lit("euclidean").alias("metric"), "loss").unionByName(metrics.triplet(rows, metric="cosine").select(F.lit("cosine").alias("metric"), "loss"))
    return both.select("metric", r6("loss").alias("loss"))


@query
def retrofit_loss(spark, sf_dir):
    return metrics.retrofit(triples(spark, sf_dir), a="anchor", b="pos").select(r6("loss").alias("loss"))


@query
def total_loss(spark, sf_dir):
    rows = triples(spark, sf_dir)
    total = metrics.total_loss(metrics.infonce(loss_batches(spark, sf_dir)), metrics.triplet(rows), metrics.retrofit(rows, a="anchor", b="pos"))
    return total.select(r6("loss").alias("loss"))


@query
def batch_mean_loss(spark, sf_dir):
    rows = metrics.pairwise(loss_batches(spark, sf_dir), "z1", "z2")
    return metrics.batch_mean(rows, "d2", "batch_id").select(r6("loss").alias("loss"))


@query
def retrieval_metrics(spark, sf_dir):
    z = z_pairs(spark, sf_dir)
    out = metrics.retrieval(z.select("row_no", F.col("z1").alias("vec")), z.select("row_no", F.col("z2").alias("vec")), (0, 1, 5, 50))
    return out.select("n", *[r6(c).alias(c) for c in ("mrr", "r_at_1", "r_at_5", "r_at_50")])


@query
def paired_retrieval(spark, sf_dir):
    out = metrics.paired_retrieval(z_pairs(spark, sf_dir), (5, 50))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


def word_table(spark, sf_dir):
    """One sampled variant for each entry and index, with a vector of its words from the lexicon's table."""
    rows = sampling.one_variant(entry_tables(spark, sf_dir)[1], ["doc_id", "sno"])
    vec = word_vectors(spark, sf_dir)
    return rows.join(vec.withColumnRenamed("word", "orig").withColumnRenamed("vec", "a"), "orig").join(vec.withColumnRenamed("word", "cand").withColumnRenamed("vec", "b"), "cand")


@query
def word_retrieval(spark, sf_dir):
    chosen = metrics.word_pairs(word_table(spark, sf_dir), ["doc_id", "sno"], 200)
    numbered = saved(chosen.withColumn("row_no", F.row_number().over(Window.orderBy("doc_id", "sno", "idx")).cast("long")))  # at most 200 rows, read several times
    out = metrics.paired_retrieval(numbered.select("row_no", F.col("a").alias("z1"), F.col("b").alias("z2")))
    return out.select("n", r6("mrr").alias("mrr"), r6("r_at_1").alias("r_at_1"), r6("r_at_5").alias("r_at_5"))


@query
def local_uniformity(spark, sf_dir):
    return metrics.local_uniformity(points(spark, sf_dir).select("vec_id", "vec"), "vec_id", 5).select(r6("u").alias("u"))


@query
def csc_entries(spark, sf_dir):
    chosen = metrics.word_pairs(word_table(spark, sf_dir), ["doc_id", "sno"], 200, different=False)
    return metrics.csc_entries(chosen, keys=("doc_id", "sno")).select(r6("csc").alias("csc"), "n")


@query
def csm_entries(spark, sf_dir):
    rows = word_table(spark, sf_dir)
    pos = rows.where("kind = 'pos'").select("doc_id", "sno", "idx", "a", F.col("b").alias("p"))
    neg = rows.where("kind = 'hard_neg'").select("doc_id", "sno", "idx", F.col("b").alias("h"))
    out = metrics.csm_entries(pos.join(neg, ["doc_id", "sno", "idx"]), keys=("doc_id", "sno"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def template_table(spark, sf_dir):
    """word, template_no, vec: a vector for each word and template, from the embeddings by rank."""
    words = lexicon(spark).where("word is not null").select("word").distinct()
    ranked = words.withColumn("k", F.row_number().over(Window.orderBy("word")).cast("long") - 1)  # the lexicon's few words
    rows = ranked.crossJoin(F.broadcast(metrics.templates(spark))).withColumn("vec_id", F.col("k") * 3 + F.col("template_no"))
    return rows.join(points(spark, sf_dir).select("vec_id", "vec"), "vec_id").select("word", "template_no", "vec")


@query
def csc_template(spark, sf_dir):
    return metrics.csc_template(lx.pairs(lexicon(spark), "="), template_table(spark, sf_dir)).select(r6("csc").alias("csc"), "n")


@query
def csm_template(spark, sf_dir):
    lex = lexicon(spark)
    out = metrics.csm_template(lx.pairs(lex, "="), lx.pairs(lex, "#"), template_table(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def one_row(csc, csm):
    return csc.select(F.lit(0).alias("_k"), "csc").join(csm.withColumn("_k", F.lit(0)), "_k").drop("_k")


@query
def consistency(spark, sf_dir):
    """The entry metrics of consistency, or those of the templates where there are no entries."""
    return metrics.with_fallback(one_row(csc_entries(spark, sf_dir), csm_entries(spark, sf_dir)), one_row(csc_template(spark, sf_dir), csm_template(spark, sf_dir)))


@query
def model_selection(spark, sf_dir):
    """Epochs from the labels of the embeddings; the metric is a label's mean first coordinate, rounded."""
    per = points(spark, sf_dir).groupBy(F.col("label").alias("epoch")).agg(F.round(F.avg(F.get("vec", F.lit(0))), 3).alias("value"))
    return metrics.best_epoch(per.select("epoch", F.lit("word_mrr").alias("name"), "value"))
