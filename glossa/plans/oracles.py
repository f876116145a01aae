"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from .queries import LEXICON

LINES = "lines(line_no, value) AS (VALUES " + ", ".join(f"({k}, '{line}')" for k, line in enumerate(LEXICON.splitlines())) + ")"
LEX = LINES + r""", lexp AS (SELECT CAST(line_no AS INTEGER) AS line_no, string_split_regex(value, '\s+') AS parts FROM lines),
    lex AS (SELECT line_no, parts[1] AS code, right(parts[1], 1) AS tag, left(parts[1], len(parts[1]) - 1) AS sense_id, CAST(len(parts) AS INTEGER) AS n_parts,
                   CAST(o AS INTEGER) AS ord, parts[o + 2] AS word FROM (SELECT *, unnest(range(0, len(parts) - 1)) AS o FROM lexp)),
    ws AS (SELECT word, sense_id FROM lex WHERE tag IN ('=', '#')),
    syn AS (SELECT DISTINCT a.word, b.word AS cand FROM lex a JOIN lex b USING (line_no) WHERE a.tag = '=' AND a.word <> b.word),
    rel AS (SELECT DISTINCT a.word, b.word AS cand FROM lex a JOIN lex b USING (line_no) WHERE a.tag = '#' AND a.word <> b.word),
    eq AS (SELECT line_no, code AS group_id, word, min(ord) AS ord FROM lex WHERE tag = '=' GROUP BY ALL),
    eg AS (SELECT * FROM eq WHERE line_no IN (SELECT line_no FROM eq GROUP BY line_no HAVING count(*) >= 2)),
    grp AS (SELECT group_id, ord, word FROM eg WHERE (group_id, line_no) IN (SELECT (group_id, max(line_no)) FROM eg GROUP BY group_id))"""
TOK = r"tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]'))"
POS = TOK + ", pos AS (SELECT doc_id, lang, i - 1 AS pos, tokens[i] AS word FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM tok))"
DLEX = POS + """, dw AS (SELECT lang, word, (row_number() OVER (PARTITION BY lang ORDER BY md5('11:' || lang || ':' || word), lang, word) - 1) AS r FROM (SELECT DISTINCT coalesce(lang, '') AS lang, word FROM pos)),
    dl AS (SELECT lang, CAST(r // 8 AS INTEGER) AS line, string_agg(word, ' ' ORDER BY r) AS words FROM dw GROUP BY ALL), dn AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS no FROM (SELECT DISTINCT lang FROM dw)),
    lines AS (SELECT CAST(line * 64 + no AS INTEGER) AS line_no, 'L' || lang || printf('%06d', line // 4) || '=#=@'[line % 4 + 1] || ' ' || words AS value FROM dl JOIN dn USING (lang))""" + LEX.removeprefix(LINES)
SENT = r"""raw AS (SELECT doc_id, li, unnest(string_split(text, e'\n')) AS part FROM (SELECT doc_id, text, 0 AS li FROM documents)),
    numbered AS (SELECT doc_id, list_transform(string_split(text, e'\n'), lambda p: regexp_extract_all(p, '[^.!?;]*[.!?;]|[^.!?;]+')) AS ps FROM documents),
    sl AS (SELECT doc_id, list_filter(list_transform(flatten(ps), lambda s: trim(s, e' \t\r\n\f\x0B')), lambda s: s <> '') AS ss FROM numbered),
    sent AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sno, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sl))"""
STOK = SENT + r""", stok AS (SELECT * FROM (SELECT doc_id, sno, regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+') AS tokens FROM sent) WHERE len(tokens) BETWEEN 3 AND 15),
    spos AS (SELECT doc_id, sno, CAST(i - 1 AS INTEGER) AS idx, tokens[i] AS word FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM stok))"""
PTS = """raw_pts AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    pts AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS vec FROM raw_pts)"""
ZP = PTS + """, zp AS (SELECT a.vec_id // 2 AS row_no, a.vec AS z1, b.vec AS z2 FROM pts a JOIN pts b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""
TRI = PTS + """, tri AS (SELECT a.vec_id // 3 AS row_no, a.vec AS anchor, b.vec AS pos, c.vec AS neg
    FROM pts a JOIN pts b ON b.vec_id = a.vec_id + 1 JOIN pts c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 3 = 0)"""
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def d2(a: str, b: str) -> str:
    return D2.format(a=a, b=b)


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def mean(name: str, source: str, keys: str, vec: str = "vec") -> str:
    """CTEs: the mean vector of each key as `name`(keys, mu), normalized."""
    return f"""{name}_d AS (SELECT {keys}, i, avg({vec}[i]) AS x FROM (SELECT *, unnest(range(1, len({vec}) + 1)) AS i FROM {source}) GROUP BY {keys}, i),
    {name}_m AS (SELECT {keys}, list(x ORDER BY i) AS m FROM {name}_d GROUP BY {keys}), {name} AS (SELECT {keys}, {unit('m')} AS mu FROM {name}_m)"""


def trimmed(name: str, source: str, key: str, item: str, trim: float = 0.1) -> str:
    return f"""{mean(name + '_0', source, key)},
    {name}_s AS (SELECT s.*, row_number() OVER (PARTITION BY s.{key} ORDER BY list_dot_product(s.vec, m.mu) DESC, s.{item}) AS r, count(*) OVER (PARTITION BY s.{key}) AS n FROM {source} s JOIN {name}_0 m USING ({key})),
    {name}_k AS (SELECT * FROM {name}_s WHERE r <= greatest(1, ceil(n * {1 - trim}::DOUBLE))), {mean(name, name + '_k', key)}"""


def keep(source: str, key: str, item: str) -> str:
    """CTEs: sizes, kept items (keep) and statistics (stats) of groups."""
    return f"""sizes AS (SELECT {key}, count(*) AS n_occ FROM {source} GROUP BY 1), big AS (SELECT s.* FROM {source} s JOIN sizes USING ({key}) WHERE n_occ >= 20),
    {trimmed('mu0', 'big', key, item)},
    ranked AS (SELECT b.*, list_dot_product(b.vec, m.mu) AS sim, count(*) OVER (PARTITION BY b.{key}) AS n, row_number() OVER (PARTITION BY b.{key} ORDER BY list_dot_product(b.vec, m.mu) DESC, b.{item}) AS r FROM big b JOIN mu0 m USING ({key})),
    keep AS (SELECT * FROM ranked WHERE r <= greatest(1, ceil(n * 0.6::DOUBLE))),
    stats AS (SELECT sizes.{key}, n_occ, k.n_keep, k.cohesion FROM sizes LEFT JOIN (SELECT {key}, count(*) AS n_keep, avg(sim) AS cohesion FROM keep GROUP BY 1) k USING ({key}))"""


def order(seed: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def number(seed: str, *keys: str) -> str:
    return f"CAST('0x' || substr({order(seed, *keys)}, 1, 8) AS BIGINT)"


def wide(seed: str, *keys: str) -> str:
    return f"CAST('0x' || substr({order(seed, *keys)}, 1, 15) AS BIGINT)"


def draws(seed: str, n: str, k: int, *keys: str) -> str:
    """k different numbers below n: the j-th draw, or the greatest number it may be where it was drawn before."""
    return f"""list_reduce(list_transform(range({k}), lambda j: [{wide(seed, *keys, 'j')} % ({n} - {k} + j + 1), {n} - {k} + j]), lambda s, x: list_append(s, CASE WHEN list_contains(s, x[1]) THEN x[2] ELSE x[1] END), []::BIGINT[])"""


OCC = PTS + """, occ AS (SELECT label AS group_id, vec_id AS item, vec, CASE WHEN label < 4 THEN 'm' || label || '_' || (vec_id % 3) WHEN label = 4 AND vec_id % 4 = 0 THEN 'solo4' ELSE 'p' || (vec_id % 6) END AS word
    FROM pts)"""
MONO = "mono AS (SELECT group_id, word FROM (SELECT DISTINCT group_id, word FROM occ) WHERE word IN (SELECT word FROM (SELECT DISTINCT group_id, word FROM occ) GROUP BY word HAVING count(*) = 1))"


def built(occ: str, mono: str) -> str:
    """CTEs of prototypes at a margin of 0, from those of occ(group_id, word, item, vec) and mono(group_id, word)."""
    return f"""{occ}, {keep('occ', 'group_id', 'item')}, thr AS (SELECT quantile_cont(cohesion, 0.7) AS t FROM stats WHERE cohesion IS NOT NULL),
    safe AS (SELECT group_id FROM stats, thr WHERE cohesion >= t AND n_keep >= 20), safe_keep AS (SELECT group_id, item, vec FROM keep WHERE group_id IN (SELECT group_id FROM safe)),
    {trimmed('sp', 'safe_keep', 'group_id', 'item')},
    {mono},
    best AS (SELECT k.item, max(list_dot_product(k.vec, sp.mu)) AS best_sim FROM keep k, sp GROUP BY k.item),
    marked AS (SELECT k.group_id, k.item, k.vec, k.word, k.sim, (k.group_id, k.word) IN (SELECT (group_id, word) FROM mono) AS mono, coalesce(best_sim, -1) - k.sim < 0.0 AS resid FROM keep k LEFT JOIN best USING (item)),
    cnt AS (SELECT group_id, count(*) FILTER (mono) AS n_anchor_occ, count(*) FILTER (resid) AS n_residual FROM marked GROUP BY 1),
    tbl AS (SELECT g.group_id, s.n_occ, s.n_keep, s.cohesion, c.n_anchor_occ, c.n_residual, coalesce(a.n, 0) AS n_anchor_words FROM (SELECT DISTINCT group_id FROM occ) g LEFT JOIN stats s USING (group_id) LEFT JOIN cnt c USING (group_id)
            LEFT JOIN (SELECT group_id, count(*) AS n FROM mono GROUP BY 1) a USING (group_id)),
    st AS (SELECT *, CASE WHEN n_keep IS NULL THEN 'too_small_or_empty' WHEN n_anchor_words >= 2 AND n_anchor_occ >= 20 THEN 'anchor_proto'
                          WHEN n_anchor_words = 0 AND (SELECT count(*) FROM safe) > 0 AND n_residual >= 20 THEN 'allpoly_residual_proto'
                          WHEN n_anchor_words = 0 AND (SELECT count(*) FROM safe) > 0 THEN 'allpoly_fallback_keep_proto' ELSE 'keep_proto' END AS status FROM tbl),
    chosen AS (SELECT m.* FROM marked m JOIN st USING (group_id) WHERE CASE status WHEN 'anchor_proto' THEN mono WHEN 'allpoly_residual_proto' THEN resid ELSE true END),
    {trimmed('proto', 'chosen', 'group_id', 'item')}"""


BUILT = built(OCC, MONO)
VOCAB_VEC = LEX + ", " + PTS + """, lw AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k FROM (SELECT DISTINCT word FROM lex)), wv AS (SELECT lw.word, pts.vec FROM lw JOIN pts ON pts.vec_id = lw.k)"""
CTX = f"""{VOCAB_VEC}, {STOK}, pv AS (SELECT p.*, wv.vec FROM spos p JOIN wv USING (word)),
    other AS (SELECT a.doc_id, a.sno, a.idx, i, avg(b.vec[i]) AS x FROM pv a JOIN pv b ON a.doc_id = b.doc_id AND a.sno = b.sno AND a.idx <> b.idx, range(1, 65) t(i) GROUP BY ALL),
    om AS (SELECT doc_id, sno, idx, list(x ORDER BY i) AS m FROM other GROUP BY ALL),
    ctx AS (SELECT pv.*, {unit('om.m')} AS ctx FROM pv LEFT JOIN om USING (doc_id, sno, idx))"""


def filtered(name: str, pairs: str) -> str:
    return f"""{name}_f AS (SELECT c.doc_id, c.sno, c.idx, c.word, p.cand, list_dot_product(c.vec, w.vec) AS word_sim, list_dot_product(c.ctx, w.vec) AS ctx_sim
        FROM ctx c JOIN {pairs} p USING (word) JOIN wv w ON w.word = p.cand),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sno, idx ORDER BY cand) - 1 AS INTEGER) AS cand_ord FROM {name}_f WHERE word_sim >= -0.05 AND (ctx_sim IS NULL OR ctx_sim >= -0.1)) WHERE cand_ord < 4)"""


VARS = f"""{CTX}, {filtered('fp', 'syn')}, {filtered('fn', 'rel')},
    vars AS (SELECT doc_id, sno, kind, idx, cand_ord, word AS orig, cand, list_concat(list_concat(s.tokens[1 : idx], [cand]), s.tokens[idx + 2 :]) AS variant
             FROM (SELECT 'pos' AS kind, * FROM fp UNION ALL SELECT 'hard_neg', * FROM fn) v JOIN stok s USING (doc_id, sno)),
    onev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sno, kind, idx ORDER BY {order('42', 'doc_id', 'sno', 'kind', 'idx', 'cand_ord')}, cand_ord) AS rn FROM vars) WHERE rn = 1),
    wt AS (SELECT o.*, a.vec AS a, b.vec AS b FROM onev o JOIN wv a ON a.word = o.orig JOIN wv b ON b.word = o.cand)"""


def choice(name: str, kind: str) -> str:
    return f"""{name}_i AS (SELECT doc_id, sno, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sno ORDER BY {order(f'42:index:{kind}', 'doc_id', 'sno', 'idx')}, idx) AS rn FROM (SELECT DISTINCT doc_id, sno, idx FROM vars WHERE kind = '{kind}')) WHERE rn = 1),
    {name} AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id, v.sno ORDER BY {order(f'42:variant:{kind}', 'v.doc_id', 'v.sno', 'v.idx', 'v.cand_ord')}, v.cand_ord) AS rn FROM vars v JOIN {name}_i USING (doc_id, sno, idx) WHERE v.kind = '{kind}') WHERE rn = 1)"""


FIRSTPOS = "fpos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sno ORDER BY idx, cand_ord) AS fr FROM vars WHERE kind = 'pos') WHERE fr = 1)"
INDEX = f"""{LEX}, {POS}, hits AS (SELECT DISTINCT sense_id, doc_id FROM pos JOIN ws USING (word)),
    sidx AS (SELECT * FROM hits UNION ALL SELECT 'NO_SENSE', doc_id FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM hits))"""
RANKS = """unitless AS (SELECT row_no, z1, z2 FROM zp),
    rk AS (SELECT q.row_no, 1 + count(*) FILTER (list_dot_product(q.z1, c.z2) > list_dot_product(q.z1, q.z2) + 1e-12 AND c.row_no <> q.row_no) AS r12,
                  1 + count(*) FILTER (list_dot_product(q.z2, c.z1) > list_dot_product(q.z2, q.z1) + 1e-12 AND c.row_no <> q.row_no) AS r21 FROM unitless q, unitless c GROUP BY 1)"""
INFO = f"""{ZP}, side AS (SELECT row_no // 25 AS batch_id, row_no, 0 AS s, z1 AS z FROM zp UNION ALL SELECT row_no // 25, row_no, 1, z2 FROM zp),
    sc AS (SELECT a.batch_id, a.row_no, a.s, list_dot_product(a.z, b.z) / 0.05::DOUBLE AS x, a.row_no = b.row_no AS partner FROM side a JOIN side b ON a.batch_id = b.batch_id AND (a.row_no <> b.row_no OR a.s <> b.s)),
    tp AS (SELECT batch_id, row_no, s, max(x) AS top FROM sc GROUP BY ALL),
    ce AS (SELECT sc.batch_id, sc.row_no, sc.s, any_value(top) + ln(sum(exp(x - top))) - max(x) FILTER (partner) AS c FROM sc JOIN tp USING (batch_id, row_no, s) GROUP BY ALL),
    info AS (SELECT batch_id, avg(c) AS loss FROM ce GROUP BY 1)"""
TEMPLATE = LEX + ", " + PTS + f""", lw AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k FROM (SELECT DISTINCT word FROM lex)),
    tv AS (SELECT word, t AS template_no, vec FROM lw, range(0, 3) r(t) JOIN pts ON pts.vec_id = lw.k * 3 + r.t), {mean('tm', 'tv', 'word')}"""
MARGIN = """SELECT CASE WHEN s IS NULL OR r IS NULL THEN 0 ELSE round(s, 6) END AS mu_same, CASE WHEN s IS NULL OR r IS NULL THEN 0 ELSE round(r, 6) END AS mu_related,
    CASE WHEN s IS NULL OR r IS NULL THEN 0 ELSE round(s - r, 6) END AS margin FROM (SELECT avg(cos) FILTER (kind = 'same') AS s, avg(cos) FILTER (kind = 'related') AS r FROM cs)"""
ASSIGNED = f"""{PTS}, {trimmed('cen', 'pts', 'label', 'vec_id')},
    near AS (SELECT vec_id AS item, max(list_dot_product(p.vec, c.mu)) AS sim, arg_max(c.label, (list_dot_product(p.vec, c.mu), -c.label)) AS group_id FROM pts p, cen c GROUP BY 1),
    asg AS (SELECT *, item // 5 AS sid, 'w' || (item % 37) AS word, sim >= 0.3 AS hit FROM near)"""
CENTER_OUT = "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(mu[i], 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM {0})"
TEMPLATES = "tpl(template_no, template) AS (VALUES (0, '我覺得{w}很重要。'), (1, '最近大家都在討論{w}。'), (2, '很多人關心{w}這件事。'))"

ORACLES: dict[str, str] = {
    "sense_counts": f"WITH {LEX}, {POS} SELECT sense_id, CAST(count(*) AS BIGINT) AS n_occ FROM pos JOIN ws USING (word) GROUP BY 1",
    "matched_sentences": f"WITH {LEX}, {POS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens FROM tok WHERE doc_id IN (SELECT doc_id FROM pos JOIN ws USING (word))",
    "match_counts": f"WITH {LEX}, {POS} SELECT doc_id, CAST(len(any_value(tokens)) AS BIGINT) AS n_tokens, count(*) AS n_match FROM pos JOIN ws USING (word) JOIN tok USING (doc_id) GROUP BY 1",
    "match_summary": f"WITH {LEX}, {POS} SELECT lang, count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM pos JOIN ws USING (word))) AS kept FROM tok GROUP BY 1",
    "rare_senses": f"""WITH {LEX}, {POS}, c AS (SELECT sense_id, count(*) AS n FROM pos JOIN ws USING (word) GROUP BY 1), s AS (SELECT DISTINCT line_no, sense_id FROM lex WHERE tag IN ('=', '#'))
        SELECT sense_id, n_occ FROM (SELECT sense_id, coalesce(n, 0) AS n_occ, row_number() OVER (ORDER BY coalesce(n, 0), sense_id) AS r FROM s LEFT JOIN c USING (sense_id)) WHERE r <= 5""",
    "regex_substring_match": f"""WITH {LEX}, w AS (SELECT DISTINCT word FROM ws), f AS (SELECT doc_id, regexp_extract_all(lower(text), (SELECT string_agg(word, '|' ORDER BY len(word) DESC, word) FROM w)) AS ws FROM documents)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_match, md5(array_to_string(ws, ' ')) AS words_md5 FROM f WHERE len(ws) > 0""",
    "token_counts": f"WITH {POS} SELECT lang, word, count(*) AS n FROM pos GROUP BY ALL",
    "inverted_index": f"WITH {LEX}, {POS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum(pos) AS BIGINT) AS pos_sum FROM pos WHERE word IN (SELECT word FROM ws) GROUP BY 1",
    "posting_lists": f"""WITH {POS}, d AS (SELECT word, doc_id, doc_id // 1024 AS block, list(pos ORDER BY pos) AS places FROM pos GROUP BY ALL), g AS (SELECT word, block, list(doc_id ORDER BY doc_id) AS ds, list(places ORDER BY doc_id) AS ps FROM d GROUP BY ALL)
        SELECT word, block, CAST(len(ds) AS BIGINT) AS n_docs, CAST(list_sum(list_transform(ps, lambda p: len(p))) AS BIGINT) AS n, ds[-1] AS last,
               md5(array_to_string(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i = 1 THEN ds[1] ELSE ds[i] - ds[i - 1] END), ',') || '|' || array_to_string(list_transform(ps, lambda p: len(p)), ',') || '|'
                   || array_to_string(flatten(list_transform(ps, lambda p: list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[1] ELSE p[i] - p[i - 1] END))), ',')) AS gaps_md5 FROM g""",
    "phrase_lookup": f"""WITH {POS}, b AS (SELECT item_id, w[1 : 3] AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark) WHERE len(w) > 0)
        SELECT item_id, a.doc_id, CAST(a.pos AS BIGINT) AS start FROM b JOIN pos a ON a.word = w[1] LEFT JOIN pos c ON c.doc_id = a.doc_id AND c.pos = a.pos + 1 AND c.word = w[2] LEFT JOIN pos e ON e.doc_id = a.doc_id AND e.pos = a.pos + 2 AND e.word = w[3]
        WHERE (len(w) < 2 OR c.word IS NOT NULL) AND (len(w) < 3 OR e.word IS NOT NULL)""",
    "lexicon_table": f"WITH {DLEX} SELECT line_no, code, tag, sense_id, n_parts, ord, word FROM lex",
    "lexicon_senses": f"WITH {DLEX} SELECT word, string_agg(DISTINCT sense_id, ',' ORDER BY sense_id) AS senses FROM ws GROUP BY 1",
    "word_senses_all": f"WITH {DLEX} SELECT word, sense_id, count(*) AS n FROM ws GROUP BY ALL",
    "syn_pairs": f"WITH {DLEX} SELECT word, cand FROM syn",
    "related_pairs": f"WITH {DLEX} SELECT word, cand FROM rel",
    "equals_groups": f"WITH {DLEX} SELECT group_id, ord, word FROM grp",
    "raw_members": f"WITH {DLEX} SELECT code AS group_id, ord, word FROM lex WHERE tag = '=' AND (code, line_no) IN (SELECT (code, max(line_no)) FROM lex WHERE tag = '=' AND n_parts >= 2 GROUP BY code)",
    "mono_words": f"WITH {DLEX} SELECT group_id, word FROM grp WHERE word IN (SELECT word FROM eg GROUP BY word HAVING count(*) = 1)",
    "vocab_union": f"WITH {DLEX} SELECT DISTINCT word FROM ws",
    "both_tag_words": f"WITH {DLEX} SELECT word FROM syn INTERSECT SELECT word FROM rel",
    "sentence_split": f"WITH {SENT} SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(max(length(sentence)) AS INTEGER) AS longest FROM sent GROUP BY 1",
    "colon_split": f"""WITH {SENT}, c AS (SELECT doc_id, sentence, instr(sentence, ',') AS p, len(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) AS n FROM sent),
        p AS (SELECT doc_id, CASE WHEN p > 0 AND n > 20 THEN list_filter([CASE WHEN trim(sentence[: p - 1]) <> '' THEN trim(sentence[: p - 1]) || ',' END, CASE WHEN trim(sentence[p + 1 :]) <> '' THEN trim(sentence[p + 1 :]) END], lambda x: x IS NOT NULL) ELSE [sentence] END AS ps FROM c),
        q AS (SELECT doc_id, i, ps[i] AS s FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p))
        SELECT doc_id, count(*) AS n, count(*) FILTER (i > 1) AS n_split, CAST(sum(length(s)) AS BIGINT) AS chars FROM q GROUP BY 1""",
    "sanitize_names": r"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g'), '\s+', ' ', 'g')) AS s FROM pages)
        SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE rtrim(s[: 40]) END AS name FROM a""",
    "document_names": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS i, text AS title FROM documents),
        a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(nullif(i, ''), nullif(title, ''), 'untitled'), '[\\/:*?"<>|]+', '_', 'g'), '\s+', ' ', 'g')) AS s FROM t) SELECT doc_id, CASE WHEN s = '' THEN 'untitled' WHEN length(s) > 120 THEN regexp_replace(s[: 120], '\s+$', '') ELSE s END AS name FROM a""",
    "length_filter": f"WITH {STOK} SELECT CAST(len(tokens) AS BIGINT) AS n_tokens, count(*) AS n FROM stok GROUP BY 1",
    "protected_span": f"WITH {TOK}, a AS (SELECT doc_id, list_position(tokens, 'the') - 1 AS i, len(tokens) AS n FROM tok) SELECT doc_id, CAST(CASE WHEN i >= 0 THEN greatest(0, i - 12) END AS BIGINT) AS l, CAST(CASE WHEN i >= 0 THEN least(n - 1, i + 12) END AS BIGINT) AS r FROM a",
    "split_index": f"""WITH {STOK}, a AS (SELECT *, list_position(tokens, 'the') - 1 AS p, len(tokens) AS n, range(1, len(tokens)) AS every FROM stok),
        b AS (SELECT *, list_filter(every, lambda i: tokens[i + 1] IN ('and', 'und', 'et', 'y') OR tokens[i] IN ('of', 'de')) AS safe FROM a),
        c AS (SELECT *, list_filter(CASE WHEN len(safe) > 0 THEN safe ELSE every END, lambda i: p IS NULL OR p < 0 OR i < p - 2 OR i > p + 2) AS cuts FROM b)
        SELECT doc_id, sno, CAST(coalesce(list_max(list_filter(cuts, lambda i: i <= 10)), list_min(list_filter(cuts, lambda i: i > 10))) AS BIGINT) AS cut FROM c""",
    "bmes_decode": f"WITH {TOK} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, md5(array_to_string(tokens, ' ')) AS words_md5 FROM tok",
    "template_fill": f"WITH {DLEX}, {TEMPLATES} SELECT word, template_no, replace(template, '{{w}}', word) AS sentence, CAST(instr(replace(template, '{{w}}', word), word) - 1 AS BIGINT) AS start FROM (SELECT DISTINCT word FROM lex WHERE word IS NOT NULL), tpl",
    "sub_token_overlap": f"""WITH {STOK}, o AS (SELECT doc_id, sno, idx, sum(length(word) + 1) OVER (PARTITION BY doc_id, sno ORDER BY idx) - 1 AS e, length(word) AS n FROM spos)
        SELECT doc_id, sno, CAST(coalesce(min(idx) FILTER (e > 10 AND e - n < 14), 0) AS BIGINT) AS idx FROM o GROUP BY ALL""",
    "group_centers": f"WITH {PTS}, {mean('mu', 'pts', 'label')} {CENTER_OUT.format('mu')}",
    "trimmed_centers": f"WITH {PTS}, {trimmed('mu', 'pts', 'label', 'vec_id')} {CENTER_OUT.format('mu')}",
    "top_q_keep": f"WITH {PTS}, {keep('pts', 'label', 'vec_id')} SELECT label, vec_id, round(sim, 6) AS sim FROM keep",
    "cohesion": f"WITH {PTS}, {keep('pts', 'label', 'vec_id')} SELECT label, n_occ, n_keep, round(cohesion, 6) AS cohesion FROM stats",
    "pairwise_distance": f"WITH {ZP} SELECT row_no, round(list_dot_product(z1, z2), 6) AS cos, round({d2('z1', 'z2')}, 6) AS d2, round(1 - list_dot_product(z1, z2), 6) AS d_cos FROM zp",
    "masked_mean": f"""WITH {PTS}, f AS (SELECT label, vec, vec_id % 3 = 0 AND label <> 5 AS mask FROM pts)
        SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(coalesce(sum(vec[i]) FILTER (mask), 0) / greatest(count(*) FILTER (mask), 1), 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM f) GROUP BY label, i""",
    "word_vector_lookup": f"""WITH {PTS}, g AS (SELECT vec_id // 3 AS row_no, list(vec ORDER BY vec_id) AS words, min(label) AS label FROM pts GROUP BY 1),
        v AS (SELECT row_no, CASE WHEN label >= 2 AND label - 1 <= len(words) THEN words[label - 1] END AS v FROM g) SELECT row_no, round(v[1], 6) AS x0, CASE WHEN v IS NOT NULL THEN round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) END AS norm FROM v""",
    "safe_groups": f"WITH {BUILT} SELECT group_id, round(cohesion, 6) AS cohesion, round(t, 6) AS threshold FROM stats JOIN safe USING (group_id), thr",
    "prototype_status": f"""WITH {BUILT} SELECT group_id, status, coalesce(n_occ, 0) AS n_occ, coalesce(n_keep, 0) AS n_keep, n_anchor_words, CASE WHEN status = 'anchor_proto' THEN n_anchor_occ END AS n_anchor_occ,
        CASE WHEN status LIKE 'allpoly%' THEN n_residual END AS n_residual FROM st""",
    "prototype_quality": f"""WITH {BUILT}, q AS (SELECT m.group_id, avg(list_dot_product(m.vec, p.mu)) AS qk, avg(list_dot_product(m.vec, p.mu)) FILTER (status = 'allpoly_residual_proto' AND resid) AS qr FROM marked m JOIN proto p USING (group_id) JOIN st USING (group_id) GROUP BY 1)
        SELECT group_id, round(cohesion, 6) AS cohesion, round(qk, 6) AS quality_keep, round(qr, 6) AS quality_residual FROM st LEFT JOIN q USING (group_id)""",
    "prototype_vectors": f"WITH {BUILT} SELECT group_id, CAST(i - 1 AS INTEGER) AS dim, round(mu[i], 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM proto)",
    "prototype_params": f"WITH {BUILT} SELECT CAST(20 AS BIGINT) AS min_keep, 0.6::DOUBLE AS keep_q, 0.1::DOUBLE AS trim, 0.0::DOUBLE AS margin, round(t, 6) AS safe_coh_threshold, (SELECT count(DISTINCT group_id) FROM occ) AS n_groups, (SELECT count(*) FROM safe) AS n_safe_groups FROM thr",
    "status_counts": f"WITH {BUILT} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "nearest_prototype": f"WITH {ASSIGNED} SELECT item, group_id, round(sim, 6) AS sim, hit FROM asg",
    "assign_words": f"""WITH {ASSIGNED} SELECT group_id, string_agg(DISTINCT word, ',' ORDER BY word) AS predicted_words, 'b,a' || group_id AS member_words FROM asg WHERE hit GROUP BY 1""",
    "assign_meta": f"WITH {ASSIGNED} SELECT count(DISTINCT sid) AS n_sentences, count(*) AS n_occurrences, count(*) FILTER (NOT hit) AS n_unmatched, count(DISTINCT word) FILTER (hit) AS n_words, count(DISTINCT group_id) FILTER (hit) AS n_groups FROM asg",
    "substitution_candidates": f"WITH {LEX}, {STOK} SELECT doc_id, word, cand, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM spos JOIN syn USING (word) GROUP BY ALL",
    "context_vectors": f"WITH {CTX} SELECT doc_id, sno, idx, word, round(list_dot_product(vec, ctx), 6) AS sim FROM ctx",
    "embed_filtered_variants": f"WITH {CTX}, {filtered('fp', 'syn')} SELECT doc_id, sno, idx, word, cand, cand_ord, round(word_sim, 6) AS word_sim, round(ctx_sim, 6) AS ctx_sim FROM fp",
    "mlm_filtered_variants": f"""WITH {LEX}, {STOK}, c AS (SELECT *, {number('mlm', 'doc_id', 'sno', 'idx', 'cand')} % 1000 AS h FROM spos JOIN syn USING (word))
        SELECT doc_id, sno, idx, word, cand, cand_ord FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sno, idx ORDER BY cand) - 1 AS INTEGER) AS cand_ord FROM c WHERE h / 20000.0::DOUBLE >= 0.01 AND h % 70 <= 50) WHERE cand_ord < 4""",
    "training_entries": f"""WITH {VARS}, k AS (SELECT DISTINCT doc_id, sno, kind, CAST(idx AS VARCHAR) AS idx FROM vars),
        g AS (SELECT doc_id, sno, string_agg(idx, ',' ORDER BY idx) FILTER (kind = 'pos') AS p, string_agg(idx, ',' ORDER BY idx) FILTER (kind = 'hard_neg') AS n FROM k GROUP BY ALL)
        SELECT doc_id, sno, CAST(len(tokens) AS BIGINT) AS n_tokens, coalesce(p, '') AS pos_keys, coalesce(n, '') AS neg_keys FROM stok LEFT JOIN g USING (doc_id, sno)""",
    "entry_variants": f"WITH {VARS} SELECT doc_id, sno, kind, idx, cand_ord, orig, cand, array_to_string(variant, ' ') AS variant FROM vars",
    "train_valid_split": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order('42', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM r",
    "capped_occurrences": f"""WITH {LEX}, {POS}, o AS (SELECT group_id, word, doc_id AS sid, CAST(pos AS INTEGER) AS pos FROM pos JOIN grp USING (word))
        SELECT group_id, word, sid, pos FROM (SELECT *, row_number() OVER (PARTITION BY group_id, word ORDER BY {order('42', 'group_id', 'word', 'sid', 'pos')}) AS r FROM o) WHERE r <= 30""",
    "pair_sample": f"WITH {ZP} SELECT row_no FROM zp ORDER BY {order('42', 'row_no')}, row_no LIMIT 200",
    "reservoir_sample": f"SELECT doc_id, lang FROM documents ORDER BY {order('7', 'doc_id')}, doc_id LIMIT 100",
    "mini_batches": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order('42', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, (r - 1) // 64 AS batch FROM r WHERE r <= n // 64 * 64",
    "hash_ranks": f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order('5', 'doc_id')}, doc_id) AS rank FROM documents",
    "one_variant": f"WITH {VARS} SELECT doc_id, sno, kind, idx, cand_ord, cand FROM onev",
    "val_positive": f"WITH {VARS}, {FIRSTPOS} SELECT doc_id, sno, idx, cand_ord, orig, cand FROM fpos",
    "train_samples": f"""WITH {VARS}, {choice('cp', 'pos')}, {choice('cn', 'hard_neg')}
        SELECT s.doc_id, s.sno, array_to_string(coalesce(p.variant, s.tokens), ' ') AS s_pos_tokens, array_to_string(n.variant, ' ') AS s_neg_tokens, coalesce(p.idx, -1) AS word_idx, p.orig AS orig_word, p.cand AS repl_word,
               CAST(n.variant IS NOT NULL AS INTEGER) AS has_neg, CAST(coalesce(p.orig <> p.cand, false) AS INTEGER) AS has_retrofit
        FROM stok s LEFT JOIN cp p ON p.doc_id = s.doc_id AND p.sno = s.sno LEFT JOIN cn n ON n.doc_id = s.doc_id AND n.sno = s.sno""",
    "valid_samples": f"""WITH {VARS}, {FIRSTPOS} SELECT s.doc_id, s.sno, array_to_string(coalesce(p.variant, s.tokens), ' ') AS s_pos_tokens, coalesce(p.idx, -1) AS word_idx, 0 AS has_neg, CAST(coalesce(p.orig <> p.cand, false) AS INTEGER) AS has_retrofit
        FROM stok s LEFT JOIN fpos p ON p.doc_id = s.doc_id AND p.sno = s.sno""",
    "sense_index": f"WITH {INDEX} SELECT sense_id, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM sidx GROUP BY 1",
    "two_stage_batches": f"""WITH {INDEX}, pools AS (SELECT sense_id, count(*) AS pool FROM sidx GROUP BY 1), gs AS (SELECT *, row_number() OVER (ORDER BY {order('42:order', 'sense_id')}, sense_id) - 1 AS gno, count(*) OVER () AS n FROM pools),
        b AS (SELECT batch, (SELECT any_value(n) FROM gs) AS n FROM (SELECT unnest(range(0, (SELECT count(*) FROM tok) // 32)) AS batch)),
        dr AS (SELECT batch, {draws('42:group', 'n', 4, 'batch')} AS gnos FROM b), ch AS (SELECT batch, CAST(s AS INTEGER) AS slot, sense_id, pool FROM (SELECT batch, s, gnos[s + 1] AS gno FROM dr, range(0, 4) t(s)) JOIN gs USING (gno)),
        rs AS (SELECT *, CASE WHEN pool >= 8 THEN {draws('42:pick', 'pool', 8, 'batch', 'slot')} ELSE list_transform(range(8), lambda j: {wide('42:pick', 'batch', 'slot', 'j')} % pool) END AS nos FROM ch),
        pk AS (SELECT batch, slot, sense_id, CAST(j AS INTEGER) AS pick, nos[j + 1] AS row FROM rs, range(0, 8) t(j)),
        rw AS (SELECT sense_id, doc_id, row_number() OVER (PARTITION BY sense_id ORDER BY {order('42:pool', 'doc_id')}, doc_id) - 1 AS row FROM sidx)
        SELECT batch, slot, sense_id, pick, doc_id FROM pk JOIN rw USING (sense_id, row)""",
    "infonce_loss": f"WITH {INFO} SELECT batch_id, round(loss, 6) AS loss FROM info",
    "triplet_loss": f"""WITH {TRI} SELECT 'euclidean' AS metric, round(avg(greatest(0, 0.3::DOUBLE + {d2('anchor', 'pos')} - {d2('anchor', 'neg')})), 6) AS loss FROM tri WHERE neg IS NOT NULL
        UNION ALL SELECT 'cosine', round(avg(greatest(0, 0.3::DOUBLE + (1 - list_dot_product(anchor, pos)) - (1 - list_dot_product(anchor, neg)))), 6) FROM tri WHERE neg IS NOT NULL""",
    "retrofit_loss": f"WITH {TRI} SELECT round(avg({d2('anchor', 'pos')}), 6) AS loss FROM tri",
    "total_loss": f"""WITH {INFO}, {TRI.replace(PTS + ', ', '')} SELECT round((SELECT avg(loss) FROM info) + 0.5::DOUBLE * (SELECT avg(greatest(0, 0.3::DOUBLE + {d2('anchor', 'pos')} - {d2('anchor', 'neg')})) FROM tri WHERE neg IS NOT NULL)
        + 0.1::DOUBLE * (SELECT avg({d2('anchor', 'pos')}) FROM tri), 6) AS loss""",
    "batch_mean_loss": f"WITH {ZP} SELECT round(avg(m), 6) AS loss FROM (SELECT row_no // 25 AS b, avg({d2('z1', 'z2')}) AS m FROM zp GROUP BY 1)",
    "retrieval_metrics": f"WITH {ZP}, {RANKS} SELECT count(*) AS n, round(avg(1.0::DOUBLE / r12), 6) AS mrr, round(avg(CAST(r12 <= 1 AS DOUBLE)), 6) AS r_at_1, round(avg(CAST(r12 <= 5 AS DOUBLE)), 6) AS r_at_5, round(avg(CAST(r12 <= 50 AS DOUBLE)), 6) AS r_at_50 FROM rk",
    "paired_retrieval": f"""WITH {ZP}, {RANKS}, m AS (SELECT count(*) AS n, avg(1.0::DOUBLE / r12) AS a, avg(1.0::DOUBLE / r21) AS b, avg(CAST(r12 <= 5 AS DOUBLE)) AS c, avg(CAST(r21 <= 5 AS DOUBLE)) AS d, avg(CAST(r12 <= 50 AS DOUBLE)) AS e, avg(CAST(r21 <= 50 AS DOUBLE)) AS f FROM rk)
        SELECT n, round(a, 6) AS mrr_12, round(b, 6) AS mrr_21, round(0.5::DOUBLE * (a + b), 6) AS mrr, round(c, 6) AS r_at_5_12, round(d, 6) AS r_at_5_21, round(0.5::DOUBLE * (c + d), 6) AS r_at_5,
               round(e, 6) AS r_at_50_12, round(f, 6) AS r_at_50_21, round(0.5::DOUBLE * (e + f), 6) AS r_at_50 FROM m""",
    "word_retrieval": f"""WITH {VARS}, zp AS (SELECT row_number() OVER (ORDER BY doc_id, sno, idx) AS row_no, a AS z1, b AS z2 FROM (SELECT * FROM wt WHERE kind = 'pos' AND orig <> cand ORDER BY {order('42', 'doc_id', 'sno', 'idx')}, doc_id, sno, idx LIMIT 200)), {RANKS}
        SELECT count(*) AS n, round(0.5::DOUBLE * (avg(1.0::DOUBLE / r12) + avg(1.0::DOUBLE / r21)), 6) AS mrr, round(0.5::DOUBLE * (avg(CAST(r12 <= 1 AS DOUBLE)) + avg(CAST(r21 <= 1 AS DOUBLE))), 6) AS r_at_1,
               round(0.5::DOUBLE * (avg(CAST(r12 <= 5 AS DOUBLE)) + avg(CAST(r21 <= 5 AS DOUBLE))), 6) AS r_at_5 FROM rk""",
    "local_uniformity": f"""WITH {PTS}, s AS (SELECT * FROM pts ORDER BY {order('42', 'vec_id')}, vec_id LIMIT 2048), d AS (SELECT a.vec_id, 2 - 2 * list_dot_product(a.vec, b.vec) AS d2, b.vec_id AS o FROM s a JOIN s b ON a.vec_id <> b.vec_id),
        k AS (SELECT vec_id, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, o) AS r FROM d) SELECT round(avg(u), 6) AS u FROM (SELECT ln(avg(exp(-2 * d2))) AS u FROM k WHERE r <= 5 GROUP BY vec_id)""",
    "csc_entries": f"WITH {VARS}, c AS (SELECT * FROM wt WHERE kind = 'pos' ORDER BY {order('42', 'doc_id', 'sno', 'idx')}, doc_id, sno, idx LIMIT 200) SELECT round(avg(list_dot_product(a, b)), 6) AS csc, count(*) AS n FROM c",
    "csm_entries": f"""WITH {VARS}, j AS (SELECT p.doc_id, p.sno, p.idx, p.a, p.b AS p, h.b AS h FROM wt p JOIN wt h ON p.doc_id = h.doc_id AND p.sno = h.sno AND p.idx = h.idx WHERE p.kind = 'pos' AND h.kind = 'hard_neg'),
        c AS (SELECT * FROM j ORDER BY {order('42', 'doc_id', 'sno', 'idx')}, doc_id, sno, idx LIMIT 200), cs AS (SELECT 'same' AS kind, list_dot_product(a, p) AS cos FROM c UNION ALL SELECT 'related', list_dot_product(a, h) FROM c) {MARGIN}""",
    "csc_template": f"WITH {TEMPLATE}, c AS (SELECT * FROM syn ORDER BY {order('42', 'word', 'cand')}, word, cand LIMIT 200) SELECT round(avg(list_dot_product(a.mu, b.mu)), 6) AS csc, count(*) AS n FROM c JOIN tm a ON a.word = c.word JOIN tm b ON b.word = c.cand",
    "csm_template": f"""WITH {TEMPLATE}, w AS (SELECT word FROM syn INTERSECT SELECT word FROM rel),
        cs AS (SELECT kind, list_dot_product(a.mu, b.mu) AS cos FROM (SELECT 'same' AS kind, word, cand FROM syn UNION ALL SELECT 'related', word, cand FROM rel) p JOIN w USING (word) JOIN tm a ON a.word = p.word JOIN tm b ON b.word = p.cand) {MARGIN}""",
    "model_selection": f"WITH {PTS}, e AS (SELECT label AS epoch, round(avg(vec[1]), 3) AS value FROM pts GROUP BY 1) SELECT epoch, value FROM e ORDER BY value DESC, epoch LIMIT 1",
}

ORACLES["consistency"] = f"""WITH ce AS ({ORACLES['csc_entries']}), me AS ({ORACLES['csm_entries']}), ct AS ({ORACLES['csc_template']}), mt AS ({ORACLES['csm_template']})
    SELECT CASE WHEN ce.csc <> 0 THEN ce.csc ELSE ct.csc END AS csc, CASE WHEN z THEN mt.mu_same ELSE me.mu_same END AS mu_same, CASE WHEN z THEN mt.mu_related ELSE me.mu_related END AS mu_related,
           CASE WHEN z THEN mt.margin ELSE me.margin END AS margin FROM ce, ct, mt, (SELECT *, mu_same = 0 AND mu_related = 0 AS z FROM me) me"""
