"""Queries over dictionary words, pieces and a masked model's probabilities, all made from the documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.encoders import hash_encoder
from ..operators import augment, automaton, match, pieces, segment
from ..operators import lexicon as lx
from ..operators.common import saved
from ..streaming import reservoir
from .encoded import KEYS, bits, encoded
from .oracles import LEX, ORACLES, POS, STOK
from .queries import lexicon, query, r6, read, sentence_tokens, tokens


# ---------------------------------------------------------------------------------------------- segmentation

@query
def dict_boundaries(spark, sf_dir):
    """Sentences without their spaces, cut again by the counts of the documents' words."""
    rows = sentence_tokens(spark, sf_dir).withColumn("joined", F.array_join("tokens", ""))
    cut = segment.segment(rows, match.token_counts(tokens(spark, sf_dir)), [*KEYS, F.array_join("tokens", " ").alias("own")], "joined")
    return cut.select(*KEYS, F.size("tokens").cast("long").alias("n"), (F.array_join("tokens", " ") == F.col("own")).alias("same"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@query
def dict_tokens(spark, sf_dir):
    """Whole texts, cut by the counts of the documents' words."""
    docs = read(spark, sf_dir, "documents").where(F.length(tx.strip(F.coalesce("text", F.lit("")))) > 0).withColumn("text", F.lower("text"))
    cut = segment.segment(docs, match.token_counts(tokens(spark, sf_dir)), ["doc_id"])
    return cut.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@query
def converted_documents(spark, sf_dir):
    """All documents with the phrases that begin one of them (its first two words) in brackets."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    first = tokens(spark, sf_dir).where(F.size("tokens") >= 2).select(F.concat_ws(" ", F.get("tokens", F.lit(0)), F.get("tokens", F.lit(1))).alias("phrase")).distinct()
    out = automaton.convert(docs, first.withColumn("replacement", F.concat(F.lit("["), "phrase", F.lit("]"))), ["doc_id"], limit=1 << 22)
    return out.select("doc_id", F.col("n_converted").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def event_window_counts(spark, sf_dir):
    rows = reservoir.windowed_counts(read(spark, sf_dir, "events"), "ts", ["event_type"], width="6 hours")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


# ---------------------------------------------------------------------------------------------- pieces

def hash_vector(piece):
    """The vector that the hash encoder gives a piece."""
    code = F.conv(F.substring(F.md5(piece.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda d: F.call_function("shiftright", code, 5 * d).bitwiseAND(F.lit(31)).cast("double") - 15.5)


def document_words(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.explode("tokens").alias("word")).distinct()


def document_pieces(spark, sf_dir):
    """piece, vec: beginnings of up to three characters and later parts of up to two that three words or more share."""
    words = document_words(spark, sf_dir)
    first = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("word"))), lambda k: F.substr("word", F.lit(1), k))
    part = lambda i, size: F.when(i + (size - 1) <= F.length("word"), F.concat(F.lit("##"), F.substr("word", i, F.lit(size))))
    later = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word"))), lambda i: F.array(part(i, 1), part(i, 2))))
    parts = words.select(F.explode(F.concat(first, F.array_compact(later))).alias("piece"))  # the words are made once
    return saved(parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("piece", hash_vector(F.col("piece")).alias("vec")))


@query
def static_word_vectors(spark, sf_dir):
    rows = pieces.word_vectors(document_words(spark, sf_dir), document_pieces(spark, sf_dir))
    return rows.select("word", *[r6(F.get("vec", F.lit(d))).alias(f"x{d}") for d in (0, 5, 11)])


@query
def word_pieces(spark, sf_dir):
    return pieces.segment(document_words(spark, sf_dir), document_pieces(spark, sf_dir)).select("word", F.array_join("pieces", " ").alias("pieces"))


@query
def static_filtered_variants(spark, sf_dir):
    """Synonyms near the word and its context by the vectors that the documents' pieces give them."""
    parts = document_pieces(spark, sf_dir)
    vectors = pieces.word_vectors(document_words(spark, sf_dir), parts)  # made only if the tasks cannot hold the pieces
    pairs = lx.pairs(lexicon(spark), "=").select(F.lit("pos").alias("kind"), "word", "cand")
    rows = augment.listed_variants(sentence_tokens(spark, sf_dir), pairs, vectors, KEYS, 0.05, 0.0, make=pieces.word_table(parts)).select(*KEYS, F.inline("v"))
    return rows.select(*KEYS, "idx", "word", "cand", "cand_ord", r6("word_sim").alias("word_sim"), r6("ctx_sim").alias("ctx_sim"))


# ---------------------------------------------------------------------------------------------- masked model

def model_pieces(spark, sf_dir):
    """piece, vec: the words of the benchmark's items and of the lexicon in parts of four characters, the model's vocabulary."""
    words = match.tokens_of(read(spark, sf_dir, "benchmark"), ["item_id"]).select(F.explode("tokens").alias("word")).union(lexicon(spark).where("word is not null").select("word")).distinct()
    parts = words.select("word", F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 4))).alias("k"))
    piece = F.concat(F.when(F.col("k") > 0, F.lit("##")).otherwise(F.lit("")), F.substr("word", (4 * F.col("k") + 1).cast("int"), F.lit(4)))
    return parts.select(piece.alias("piece")).distinct().select("piece", F.transform(hash_vector(F.col("piece")), lambda x: x / 32).alias("vec"))


def masked_candidates(spark, sf_dir):
    """All synonyms of all positions, and the model's best pieces there; sequences are whole, whatever their length."""
    rows = sentence_tokens(spark, sf_dir)
    found = augment.candidates(rows, lx.pairs(lexicon(spark), "="), KEYS)
    requests = found.select(*KEYS, "idx").distinct().join(rows, KEYS)
    return found, pieces.mask_probabilities(requests, KEYS, hash_encoder, model_pieces(spark, sf_dir), None)


@query
def masked_probabilities(spark, sf_dir):
    rows = masked_candidates(spark, sf_dir)[1]
    first, total = F.get("best", F.lit(0)), F.aggregate("best", F.lit(0.0), lambda s, x: s + x["p"])
    return rows.select(*KEYS, "idx", F.size("best").cast("long").alias("n"), first["cand"].alias("best"), r6(first["p"]).alias("p"), r6(total).alias("p_top"))


@query
def masked_variants(spark, sf_dir):
    found, best = masked_candidates(spark, sf_dir)
    table = best.select(*KEYS, "idx", F.inline("best"))
    rows = augment.first_candidates(pieces.masked_filter(found, table, model_pieces(spark, sf_dir), KEYS, least=0.0003), KEYS)
    return rows.select(*KEYS, "idx", "word", "cand", "cand_ord")


# ---------------------------------------------------------------------------------------------- SQL

# Lists of numbers in pairs: a word's length and log probability for each word at a place (`opts`), and for each place from the
# right the best score and the length of its first word (`best`).  `starts` walks these lengths from the left.
DICT = """wc AS (SELECT word, count(*) AS n FROM pos WHERE length(word) <= 32 GROUP BY 1), tot AS (SELECT sum(n) AS total FROM wc),
    blk AS (SELECT DISTINCT array_to_string(tokens, '') AS block FROM stok), sub AS (SELECT block, i, unnest(range(1, least(32, length(block) - i) + 1)) AS size FROM (SELECT block, unnest(range(0, length(block))) AS i FROM blk)),
    opt AS (SELECT block, i, flatten(list([size::DOUBLE, ln(n::DOUBLE) - ln(total::DOUBLE)] ORDER BY size)) AS opts FROM sub JOIN wc ON wc.word = substr(sub.block, sub.i + 1, sub.size), tot GROUP BY block, i),
    allo AS (SELECT block, list(coalesce(opts, [1.0::DOUBLE, -ln(total::DOUBLE)]) ORDER BY i DESC) AS os FROM (SELECT block, unnest(range(0, length(block))) AS i FROM blk) LEFT JOIN opt USING (block, i), tot GROUP BY block),
    bst AS (SELECT block, list_reduce(os, lambda s, x: list_concat(list_max(list_transform(range(0, len(x) // 2), lambda k: [x[2 * k + 2] + s[2 * CAST(x[2 * k + 1] AS BIGINT) - 1], x[2 * k + 1]])), s), [0.0::DOUBLE, 0.0::DOUBLE]) AS best FROM allo),
    wlk AS (SELECT block, best, list_reduce(list_transform(range(0, length(block)), lambda i: [i]), lambda s, x: CASE WHEN s[1] = x[1] THEN list_concat([x[1] + CAST(best[2 * x[1] + 2] AS BIGINT)], list_append(s[2 :], x[1])) ELSE s END, [0::BIGINT])[2 :] AS starts FROM bst),
    tkn AS (SELECT block, place, word, regexp_full_match(word, '[A-Za-z0-9]') AS lone FROM (SELECT block, place, substr(block, place + 1, CAST(best[2 * place + 2] AS BIGINT)) AS word FROM (SELECT block, best, unnest(starts) AS place FROM wlk))),
    isl AS (SELECT *, sum(CASE WHEN lone AND before THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY place) AS no FROM (SELECT *, coalesce(lag(lone) OVER (PARTITION BY block ORDER BY place), false) AS before FROM tkn)),
    wrd AS (SELECT block, no, string_agg(word, '' ORDER BY place) AS word FROM isl GROUP BY block, no),
    done AS (SELECT block, count(*) AS n, string_agg(word, ' ' ORDER BY no) AS words FROM wrd GROUP BY block)"""
PIECES = f"""w AS (SELECT DISTINCT word FROM pos), raw_p AS (SELECT word[1 : k] AS piece FROM (SELECT word, unnest(range(1, least(3, length(word)) + 1)) AS k FROM w)
        UNION ALL SELECT '##' || word[i : i + s - 1] FROM (SELECT word, unnest(range(2, length(word) + 1)) AS i FROM w), (VALUES (1), (2)) t(s) WHERE i + s - 1 <= length(word)),
    voc AS (SELECT piece, {bits('piece')} AS v FROM raw_p GROUP BY piece HAVING count(*) >= 3),
    fit AS (SELECT word, i, max(size) AS size FROM (SELECT word, i, unnest(range(1, least(4, length(word) - i) + 1)) AS size FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w WHERE length(word) <= 100))
            WHERE CASE WHEN i > 0 THEN '##' ELSE '' END || substr(word, i + 1, size) IN (SELECT piece FROM voc) GROUP BY word, i),
    cutw(word, place, piece) AS (SELECT word, 0::BIGINT, NULL::VARCHAR FROM w WHERE length(word) <= 100 UNION ALL
        SELECT c.word, c.place + f.size, CASE WHEN c.place > 0 THEN '##' ELSE '' END || substr(c.word, c.place + 1, f.size) FROM cutw c JOIN fit f ON f.word = c.word AND f.i = c.place),
    whole AS (SELECT c.word, c.place, c.piece FROM cutw c WHERE c.piece IS NOT NULL AND c.word IN (SELECT word FROM cutw WHERE place = length(word)))"""


def unit12(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


STATIC = f"""{PIECES}, pv AS (SELECT piece, {unit12('v')} AS v FROM voc),
    pw AS (SELECT word, list(v ORDER BY place) AS vs FROM whole JOIN pv USING (piece) GROUP BY word),
    pm AS (SELECT word, list_transform(range(1, 13), lambda d: list_sum(list_transform(vs, lambda v: v[d])) / len(vs)) AS m FROM pw),
    wv AS (SELECT word, {unit12('m')} AS vec FROM pm)"""
MASKED = f"""{STOK}, mv AS (SELECT DISTINCT CASE WHEN k > 0 THEN '##' ELSE '' END || substr(word, 4 * k + 1, 4) AS piece FROM (SELECT word, unnest(range(0, (length(word) + 3) // 4)) AS k FROM
        (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark UNION SELECT word FROM lex WHERE word IS NOT NULL))),
    mvec AS (SELECT piece, list_transform({bits('piece')}, lambda x: x / 32) AS v FROM mv),
    cnd AS (SELECT t.doc_id, t.sno, t.idx, t.word, s.cand FROM spos t JOIN syn s USING (word)),
    rq AS (SELECT DISTINCT doc_id, sno, idx, doc_id || ':' || sno || ':' || idx AS sid FROM cnd),
    src AS (SELECT rq.*, list_concat(list_concat(tokens[1 : idx], ['[MAS']), tokens[idx + 2 :]) AS tokens FROM rq JOIN stok USING (doc_id, sno)), {encoded('src', 'mk', None)},
    lg AS (SELECT r.doc_id, r.sno, r.idx, p.piece, list_dot_product(m.h, p.v) / sqrt(12.0::DOUBLE) AS logit FROM rq r JOIN mk_m m ON m.sid = r.sid AND m.idx = r.idx, mvec p),
    nm AS (SELECT doc_id, sno, idx, max(logit) AS most FROM lg GROUP BY ALL), sm AS (SELECT lg.doc_id, lg.sno, lg.idx, any_value(most) AS most, sum(exp(logit - most)) AS total FROM lg JOIN nm USING (doc_id, sno, idx) GROUP BY ALL),
    pr AS (SELECT * FROM (SELECT lg.*, exp(logit - most) / total AS p, row_number() OVER (PARTITION BY lg.doc_id, lg.sno, lg.idx ORDER BY logit DESC, piece) AS rank FROM lg JOIN sm USING (doc_id, sno, idx)) WHERE rank <= 50)"""

ORACLES.update({
    "converted_documents": f"""WITH {POS}, f AS (SELECT DISTINCT tokens[1] || ' ' || tokens[2] AS phrase FROM tok WHERE len(tokens) >= 2), r AS (SELECT '(' || string_agg(phrase, '|' ORDER BY length(phrase) DESC, phrase) || ')' AS p FROM f)
        SELECT doc_id, CAST(coalesce(len(regexp_extract_all(lower(text), p)), 0) AS BIGINT) AS n, md5(regexp_replace(lower(text), p, '[\\1]', 'g')) AS text_md5 FROM documents, r""",
    "event_window_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "dict_boundaries": f"""WITH {POS}, {STOK}, {DICT}
        SELECT s.doc_id, s.sno, n, words = array_to_string(s.tokens, ' ') AS same, md5(words) AS tokens_md5 FROM stok s JOIN done d ON d.block = array_to_string(s.tokens, '')""",
    "word_pieces": f"WITH RECURSIVE {POS}, {PIECES} SELECT w.word, string_agg(piece, ' ' ORDER BY place) AS pieces FROM w LEFT JOIN whole USING (word) GROUP BY w.word",
    "static_word_vectors": f"WITH RECURSIVE {POS}, {STATIC} SELECT word, " + ", ".join(f"round(vec[{d + 1}], 6) AS x{d}" for d in (0, 5, 11)) + " FROM wv",
    "static_filtered_variants": f"""WITH RECURSIVE {LEX}, {POS}, {STOK}, {STATIC}, sv AS (SELECT p.*, wv.vec FROM spos p JOIN wv USING (word)),
        ol AS (SELECT a.doc_id, a.sno, a.idx, list(b.vec ORDER BY b.idx) AS vs FROM sv a JOIN sv b ON a.doc_id = b.doc_id AND a.sno = b.sno AND a.idx <> b.idx WHERE a.word IN (SELECT word FROM syn) GROUP BY ALL),
        om AS (SELECT doc_id, sno, idx, list_transform(range(1, 13), lambda d: list_sum(list_transform(vs, lambda v: v[d])) / len(vs)) AS m FROM ol),
        ctx AS (SELECT sv.*, {unit12('om.m')} AS ctx FROM sv LEFT JOIN om USING (doc_id, sno, idx)),
        f AS (SELECT c.doc_id, c.sno, c.idx, c.word, p.cand, list_dot_product(c.vec, w.vec) AS word_sim, list_dot_product(c.ctx, w.vec) AS ctx_sim FROM ctx c JOIN syn p USING (word) JOIN wv w ON w.word = p.cand)
        SELECT doc_id, sno, idx, word, cand, cand_ord, round(word_sim, 6) AS word_sim, round(ctx_sim, 6) AS ctx_sim FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sno, idx ORDER BY cand) - 1 AS INTEGER) AS cand_ord
            FROM f WHERE word_sim >= 0.05 AND (ctx_sim IS NULL OR ctx_sim >= 0)) WHERE cand_ord < 4""",
    "masked_probabilities": f"WITH {LEX}, {MASKED} SELECT doc_id, sno, idx, count(*) AS n, min_by(piece, rank) AS best, round(max(p), 6) AS p, round(sum(p), 6) AS p_top FROM pr GROUP BY ALL",
    "masked_variants": f"""WITH {LEX}, {MASKED}, ok AS (SELECT c.* FROM cnd c JOIN pr USING (doc_id, sno, idx) WHERE pr.piece = c.cand AND pr.p >= 0.0003)
        SELECT doc_id, sno, idx, word, cand, cand_ord FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sno, idx ORDER BY cand) - 1 AS INTEGER) AS cand_ord FROM ok) WHERE cand_ord < 4""",
})
