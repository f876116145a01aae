"""Queries over contextual vectors that an encoder makes of the documents' sentences, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.encoders import hash_encoder
from ..operators import augment, encoding, metrics, prototypes, sampling, splitting
from ..operators import lexicon as lx
from ..operators.common import saved, small
from .oracles import LEX, ORACLES, POS, RANKS, SENT, STOK, built, order, unit
from .queries import ENDS, lexicon, query, r6, read, sentence_tokens

#: Pieces of a sequence, marks included: sentences of 15 words are often longer.
MAX_LEN = 24
KEYS = ["doc_id", "sno"]


@query
def encoded_words(spark, sf_dir):
    """Words with a vector in each sentence, and where their mean points; words behind MAX_LEN have none."""
    rows = encoding.word_vectors(sentence_tokens(spark, sf_dir), KEYS, hash_encoder, MAX_LEN)
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last"), *[r6(F.avg(F.get("vec", F.lit(d)))).alias(f"x{d}") for d in (0, 5, 11)])


@query
def encoded_sentences(spark, sf_dir):
    both = [encoding.sentence_vectors(sentence_tokens(spark, sf_dir), KEYS, hash_encoder, pooling, MAX_LEN).withColumn("pooling", F.lit(pooling)) for pooling in ("cls", "mean")]
    return both[0].unionByName(both[1]).select(*KEYS, "pooling", *[r6(F.get("vec", F.lit(d))).alias(f"x{d}") for d in (0, 5, 11)])


@query
def contextual_lookup(spark, sf_dir):
    """The vector of each sentence's last word of the lexicon; of sentences without one, at an index outside of them."""
    rows = sentence_tokens(spark, sf_dir)
    hits = augment.positions(rows, KEYS).join(F.broadcast(lx.vocabulary(lexicon(spark))), "word", "left_semi").groupBy(*KEYS).agg(F.max("idx").alias("idx"))
    requests = rows.join(hits, KEYS, "left").withColumn("idx", F.coalesce("idx", F.size("tokens")))
    found = encoding.vectors_at(requests, KEYS, hash_encoder, MAX_LEN)
    return found.select(*KEYS, F.col("idx").cast("long").alias("idx"), "source", *[r6(F.get("vec", F.lit(d))).alias(f"x{d}") for d in (0, 5, 11)])


def encoded_occurrences(spark, sf_dir):
    """group_id, word, item, vec: capped occurrences of the words of `=` groups, encoded where they stand."""
    rows = sentence_tokens(spark, sf_dir).withColumn("sid", F.concat_ws(":", "doc_id", "sno"))
    places = augment.positions(rows, ["sid"]).select("sid", F.col("idx").alias("pos"), "word")
    occ = saved(prototypes.occurrences(places, lx.groups(lexicon(spark)), cap=60))  # few rows, to which the sentences are not shuffled
    requests = rows.select("sid", "tokens").join(small(occ), "sid").withColumnRenamed("pos", "idx")
    found = encoding.vectors_at(requests, ["group_id", "word", "sid"], hash_encoder, MAX_LEN)
    return found.select("group_id", "word", F.concat_ws(":", "sid", "idx").alias("item"), "vec")


def encoded_build(spark, sf_dir):
    lex = lexicon(spark)
    return prototypes.build(encoded_occurrences(spark, sf_dir), lx.groups(lex).select("group_id").distinct(), lx.mono_words(lex), prototypes.Parameters(margin=0.0))


@query
def encoded_prototypes(spark, sf_dir):
    meta = encoded_build(spark, sf_dir)["meta"]
    return meta.select("group_id", "status", "n_occ", "n_keep", F.col("n_anchor_words").cast("long").alias("n_anchor_words"), *[r6(c).alias(c) for c in ("cohesion", "quality_keep")])


def encoded_assigned(spark, sf_dir):
    """Words of the lexicon in all sentences of the documents, blank tokens and short sentences left out, by prototype."""
    lex = lexicon(spark)
    protos = encoded_build(spark, sf_dir)["prototypes"].join(lx.groups(lex).groupBy("group_id").agg(F.min("group_id").alias("ord")), "group_id")
    rows = splitting.sentences(read(spark, sf_dir, "documents"), ["doc_id"], ends=ENDS, newline=True)
    rows = prototypes.readable(rows.select(*KEYS, tx.tokenize(F.lower("sentence"), "pieces").alias("tokens")))
    words = encoding.word_vectors(rows, KEYS, hash_encoder, only=lx.vocabulary(lex)).select(F.concat_ws(":", *KEYS).alias("sid"), F.concat_ws(":", *KEYS, "pos").alias("item"), "word", "vec")
    return prototypes.assign(words, protos, lx.raw_members(lex), min_sim=0.8, vocabulary=lx.vocabulary(lex))


@query
def encoded_assignment(spark, sf_dir):
    rows = encoded_assigned(spark, sf_dir)["groups"]
    return rows.select("group_id", "ord", F.array_join("predicted_words", ",").alias("predicted_words"), F.array_join("member_words", ",").alias("member_words"))


@query
def encoded_assignment_meta(spark, sf_dir):
    return encoded_assigned(spark, sf_dir)["meta"]


@query
def encoded_retrieval(spark, sf_dir):
    """A word in its sentence against its first synonym in the same place, over at most 200 sentences in hash order."""
    rows = sentence_tokens(spark, sf_dir)
    pairs = augment.first_candidates(augment.candidates(rows, lx.pairs(lexicon(spark), "="), KEYS).distinct(), KEYS, 1)
    chosen = saved(sampling.sample(pairs.select(*KEYS, "idx", "cand"), [*KEYS, "idx"], 200).join(rows, KEYS))  # at most 200 rows, read several times
    both = [chosen, chosen.withColumn("tokens", tx.substitute(F.col("tokens"), F.col("idx"), F.col("cand")))]
    first, second = (encoding.vectors_at(df, KEYS, hash_encoder, MAX_LEN).select(F.concat_ws(":", *KEYS, "idx").alias("row_no"), F.col("vec").alias(f"z{k + 1}")) for k, df in enumerate(both))
    out = metrics.paired_retrieval(saved(first.join(second, "row_no")), (1, 5))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


# ---------------------------------------------------------------------------------------------- SQL

def bits(piece: str) -> str:
    return f"list_transform(range(12), lambda d: ((CAST('0x' || substr(md5({piece}), 1, 15) AS BIGINT) >> CAST(5 * d AS INTEGER)) & 31) - 15.5::DOUBLE)"


def total(vectors: str, size: str) -> str:
    return f"list_transform(range(1, 13), lambda d: list_sum(list_transform({vectors}, lambda v: v[d])) / {size})"


def encoded(source: str, name: str, max_len: int | None = MAX_LEN) -> str:
    """CTEs of `source`(sid, tokens): `name`(sid, idx, word, vec) of words, `name`_s(sid, cls, avg) of sequences, not normalized; max_len None: of whole ones."""
    reach = "" if max_len is None else f" WHERE p <= {max_len - 2}"
    return f"""{name}_t AS (SELECT sid, CAST(i - 1 AS INTEGER) AS idx, tokens[i] AS word FROM (SELECT sid, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM {source})),
    {name}_p AS (SELECT sid, idx, word, k, CASE WHEN k > 0 THEN '##' ELSE '' END || substr(word, 4 * k + 1, 4) AS piece FROM (SELECT *, unnest(range(0, (length(word) + 3) // 4)) AS k FROM {name}_t)),
    {name}_n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY idx, k) AS p FROM {name}_p),
    {name}_v AS (SELECT sid, idx, word, p, {bits('piece')} AS v FROM {name}_n{reach}),
    {name}_g AS (SELECT s.sid, list_concat([{bits("'[CLS]'")}, {bits("'[SEP]'")}], coalesce(list(v.v ORDER BY v.p) FILTER (v.v IS NOT NULL), [])) AS vs FROM {source} s LEFT JOIN {name}_v v USING (sid) GROUP BY s.sid),
    {name}_c AS (SELECT sid, vs, {total('vs', 'len(vs)')} AS ctx FROM {name}_g),
    {name}_s AS (SELECT sid, ctx, list_transform(list_zip(vs[1], ctx), lambda z: z[1] + 0.5::DOUBLE * z[2]) AS cls, list_transform(ctx, lambda x: 1.5::DOUBLE * x) AS avg,
                        list_transform(list_zip(vs[3], ctx), lambda z: z[1] + 0.5::DOUBLE * z[2]) AS head FROM {name}_c),
    {name}_w AS (SELECT sid, idx, any_value(word) AS word, list(v ORDER BY p) AS vs FROM {name}_v GROUP BY sid, idx),
    {name}_m AS (SELECT w.sid, w.idx, w.word, list_transform(list_zip({total('w.vs', 'len(w.vs)')}, c.ctx), lambda z: z[1] + 0.5::DOUBLE * z[2]) AS h FROM {name}_w w JOIN {name}_c c USING (sid)),
    {name} AS (SELECT sid, idx, word, {unit('h')} AS vec FROM {name}_m)"""


SID = "doc_id || ':' || sno"
ROWS = f"{STOK}, src AS (SELECT doc_id, sno, {SID} AS sid, tokens FROM stok)"
X = ", ".join(f"round(vec[{d + 1}], 6) AS x{d}" for d in (0, 5, 11))
VOCABULARY = "voc AS (SELECT word FROM syn UNION SELECT word FROM rel UNION SELECT word FROM lex WHERE tag IN ('=', '#') AND n_parts >= 2)"
AT = f"""hit AS (SELECT sid, max(idx) AS idx FROM enc_t WHERE word IN (SELECT word FROM voc) GROUP BY sid),
    req AS (SELECT src.*, coalesce(hit.idx, len(tokens)) AS idx, hit.idx IS NOT NULL AS inside FROM src LEFT JOIN hit USING (sid))"""
ENC_OCC = f"""{LEX}, {ROWS}, {encoded('src', 'enc')},
    capped AS (SELECT group_id, word, sid, idx FROM (SELECT g.group_id, g.word, t.sid, t.idx, row_number() OVER (PARTITION BY g.group_id, g.word ORDER BY {order('42', 'g.group_id', 'g.word', 't.sid', 't.idx')}) AS r
               FROM enc_t t JOIN (SELECT DISTINCT group_id, word FROM grp) g USING (word)) WHERE r <= 60),
    occ AS (SELECT c.group_id, c.word, c.sid || ':' || c.idx AS item, coalesce(e.vec, {unit('s.cls')}) AS vec FROM capped c JOIN enc_s s USING (sid) LEFT JOIN enc e ON e.sid = c.sid AND e.idx = c.idx)"""
ENC_BUILT = built(ENC_OCC, "mono AS (SELECT group_id, word FROM grp WHERE word IN (SELECT word FROM eg GROUP BY word HAVING count(*) = 1))")
ENC_ASSIGNED = f"""{ENC_BUILT}, {VOCABULARY},
    every AS (SELECT {SID} AS sid, list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]'), lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+|[^\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')) AS tokens FROM sent),
    long AS (SELECT * FROM every WHERE len(tokens) >= 2), {encoded('long', 'all_words', 64)},
    near AS (SELECT w.sid, w.idx, w.word, max(list_dot_product(w.vec, p.mu)) AS sim, min_by(p.group_id, (-list_dot_product(w.vec, p.mu), p.group_id)) AS group_id FROM all_words w, proto p WHERE w.word IN (SELECT word FROM voc) GROUP BY ALL)"""

ORACLES.update({
    "encoded_words": f"WITH {ROWS}, {encoded('src', 'enc')} SELECT src.doc_id, src.sno, count(*) AS n, CAST(max(idx) AS BIGINT) AS last, " + ", ".join(f"round(avg(vec[{d + 1}]), 6) AS x{d}" for d in (0, 5, 11)) + " FROM enc JOIN src USING (sid) GROUP BY ALL",
    "encoded_sentences": f"""WITH {ROWS}, {encoded('src', 'enc')}, u AS (SELECT sid, 'cls' AS pooling, {unit('cls')} AS vec FROM enc_s UNION ALL SELECT sid, 'mean', {unit('avg')} FROM enc_s)
        SELECT doc_id, sno, pooling, {X} FROM u JOIN src USING (sid)""",
    "contextual_lookup": f"""WITH {LEX}, {ROWS}, {VOCABULARY}, {encoded('src', 'enc')}, {AT}, odd AS (SELECT sid, [array_to_string(tokens, '')] AS tokens FROM req WHERE NOT inside), {encoded('odd', 'joined')},
        f AS (SELECT r.doc_id, r.sno, r.idx, CASE WHEN NOT inside THEN 'text' WHEN e.vec IS NOT NULL THEN 'word' ELSE 'cls' END AS source, CASE WHEN NOT inside THEN {unit('j.head')} ELSE coalesce(e.vec, {unit('s.cls')}) END AS vec
              FROM req r JOIN enc_s s ON s.sid = r.sid LEFT JOIN enc e ON e.sid = r.sid AND e.idx = r.idx LEFT JOIN joined_s j ON j.sid = r.sid)
        SELECT doc_id, sno, CAST(idx AS BIGINT) AS idx, source, {X} FROM f""",
    "encoded_prototypes": f"""WITH {ENC_BUILT}, q AS (SELECT m.group_id, avg(list_dot_product(m.vec, p.mu)) AS qk FROM marked m JOIN proto p USING (group_id) GROUP BY 1), every AS (SELECT DISTINCT group_id FROM grp)
        SELECT every.group_id, coalesce(status, 'too_small_or_empty') AS status, coalesce(n_occ, 0) AS n_occ, coalesce(n_keep, 0) AS n_keep, coalesce(a.n, 0) AS n_anchor_words, round(cohesion, 6) AS cohesion, round(qk, 6) AS quality_keep
        FROM every LEFT JOIN st USING (group_id) LEFT JOIN q USING (group_id) LEFT JOIN (SELECT group_id, count(*) AS n FROM mono GROUP BY 1) a USING (group_id)""",
    "encoded_assignment": f"""WITH {ENC_ASSIGNED} SELECT n.group_id, n.group_id AS ord, string_agg(DISTINCT n.word, ',' ORDER BY n.word) AS predicted_words,
        any_value((SELECT string_agg(l.word, ',' ORDER BY l.ord) FROM lex l WHERE l.code = n.group_id)) AS member_words FROM near n WHERE sim >= 0.8 GROUP BY n.group_id""",
    "encoded_assignment_meta": f"""WITH {ENC_ASSIGNED} SELECT count(DISTINCT sid) AS n_sentences, count(*) AS n_occurrences, count(*) FILTER (sim < 0.8) AS n_unmatched, count(DISTINCT word) FILTER (sim >= 0.8) AS n_words,
        count(DISTINCT group_id) FILTER (sim >= 0.8) AS n_groups FROM near""",
    "encoded_retrieval": f"""WITH {LEX}, {ROWS}, c AS (SELECT DISTINCT t.doc_id, t.sno, t.idx, first_value(s.cand) OVER (PARTITION BY t.doc_id, t.sno, t.idx ORDER BY s.cand) AS cand FROM spos t JOIN syn s USING (word)),
        ch AS (SELECT * FROM c ORDER BY {order('42', 'doc_id', 'sno', 'idx')}, doc_id, sno, idx LIMIT 200), one AS (SELECT ch.*, doc_id || ':' || sno || ':' || idx AS sid, tokens FROM ch JOIN stok USING (doc_id, sno)),
        two AS (SELECT sid, idx, list_concat(list_concat(tokens[1 : idx], [cand]), tokens[idx + 2 :]) AS tokens FROM one), {encoded('one', 'ea')}, {encoded('two', 'eb')},
        zp AS (SELECT o.sid AS row_no, coalesce(a.vec, {unit('sa.cls')}) AS z1, coalesce(b.vec, {unit('sb.cls')}) AS z2 FROM one o JOIN ea_s sa USING (sid) JOIN eb_s sb USING (sid) LEFT JOIN ea a ON a.sid = o.sid AND a.idx = o.idx LEFT JOIN eb b ON b.sid = o.sid AND b.idx = o.idx),
        {RANKS}, m AS (SELECT count(*) AS n, avg(1.0::DOUBLE / r12) AS a, avg(1.0::DOUBLE / r21) AS b, avg(CAST(r12 <= 1 AS DOUBLE)) AS c, avg(CAST(r21 <= 1 AS DOUBLE)) AS d, avg(CAST(r12 <= 5 AS DOUBLE)) AS e, avg(CAST(r21 <= 5 AS DOUBLE)) AS f FROM rk)
        SELECT n, round(a, 6) AS mrr_12, round(b, 6) AS mrr_21, round(0.5::DOUBLE * (a + b), 6) AS mrr, round(c, 6) AS r_at_1_12, round(d, 6) AS r_at_1_21, round(0.5::DOUBLE * (c + d), 6) AS r_at_1,
               round(e, 6) AS r_at_5_12, round(f, 6) AS r_at_5_21, round(0.5::DOUBLE * (e + f), 6) AS r_at_5 FROM m""",
})
