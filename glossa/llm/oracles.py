"""DuckDB SQL with the results of those queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
               sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+') AS w FROM documents),
             b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+') AS w FROM benchmark),
             bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS body
                    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
             ns AS (SELECT DISTINCT n FROM bw),
             dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS body
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
             m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.body = bw.body AND dw.n = bw.n),
             h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(parts[i], e' \t\r\f\x0B') AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), e'\n') AS parts, unnest(range(1, len(string_split(coalesce(text, ''), e'\n')) + 1)) AS i FROM documents)),
             d AS (SELECT line, length(line) AS n, min({'d': doc_id, 'k': line_no}) AS first FROM l WHERE line <> '' GROUP BY line),
             near AS (SELECT a.line, min(b.first) AS near FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first
                      WHERE (a.line[: a.n // 2] = b.line[: a.n // 2] OR a.line[a.n // 2 + 2 :] = b.line[b.n - a.n + a.n // 2 + 2 :])
                        AND levenshtein(a.line, b.line) <= 1 GROUP BY a.line),
             gone AS (SELECT l.doc_id, list_sort(list(CAST(l.line_no AS INTEGER))) AS dropped, count(*) AS n FROM l JOIN d USING (line) LEFT JOIN near USING (line)
                      WHERE least(d.first, coalesce(near.near, d.first)) < {'d': l.doc_id, 'k': l.line_no} GROUP BY l.doc_id)
        SELECT s.doc_id, CAST(len(string_split(coalesce(s.text, ''), e'\n')) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_dropped,
               coalesce(gone.dropped, CAST([] AS INTEGER[])) AS dropped
        FROM documents s LEFT JOIN gone USING (doc_id)
    """,
    "op7_chat_format": r"""
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY CAST(to_json(text) AS VARCHAR), text) AS k FROM conversations),
             u AS (SELECT * FROM c WHERE role = 'user' AND k = 1), a AS (SELECT * FROM c WHERE role = 'assistant' AND k = 1),
             m AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, u.turn AS turn, u.conv_id IS NOT NULL AS called, a.conv_id IS NOT NULL AS answered,
                          '{"arguments":{"prompt":' || to_json(u.text) || ',"turn":' || u.turn || '},"errors":[],"id":"t:' || u.turn || '","name":"chat.reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS body
                   FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
             g AS (SELECT conv_id, count(*) FILTER (called) AS n_calls, count(*) FILTER (called AND answered) AS n_linked, count(*) FILTER (NOT called) AS n_orphans,
                          coalesce(string_agg(body, ',' ORDER BY turn) FILTER (called), '') AS calls FROM m GROUP BY conv_id),
             o AS (SELECT c.conv_id, c.turn, c.role, c.text FROM c LEFT JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1
                   WHERE c.k > 1 OR coalesce(c.role, '') NOT IN ('user', 'assistant') OR (c.role = 'assistant' AND u.conv_id IS NULL)),
             t AS (SELECT conv_id, string_agg('{"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}', ','
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM o GROUP BY conv_id)
        SELECT conv_id, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_orphans, 0) AS n_orphans, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_cyclic,
               '{"calls":[' || coalesce(calls, '') || ']' || coalesce(',"turns":[' || turns || ']', '') || '}' AS json
        FROM g FULL JOIN t USING (conv_id)
    """,
    "op11_fingerprint": r"""
        WITH s AS (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS k FROM documents),
             n AS (SELECT a.k, a.doc_id, a.body, b.body AS next, length(a.body) AS n_chars, length(a.body) // 3 AS third
                   FROM s a JOIN s b ON b.k = a.k % (SELECT count(*) FROM s) + 1),
             e AS (SELECT k, doc_id, n_chars, body, next, body[: n_chars - third] || next[: third] AS edited FROM n),
             t AS (SELECT body FROM e UNION SELECT edited FROM e),
             h AS (SELECT body, regexp_extract_all(hex(encode(body)), '..') AS b FROM t),
             v AS (SELECT body, ((('0x' || b[i + 2] || b[i + 1] || b[i])::BIGINT * 2654435761) % 4294967296) >> 24 AS bucket
                   FROM (SELECT body, b, unnest(range(1, len(b) - 1)) AS i FROM h)),
             c AS (SELECT body, bucket, count(*) AS n FROM v GROUP BY body, bucket),
             m AS (SELECT h.body, len(h.b) AS n_bytes, map_from_entries(list(struct_pack(k := c.bucket, v := c.n)) FILTER (c.n IS NOT NULL)) AS counts
                   FROM h LEFT JOIN c ON h.body = c.body GROUP BY h.body, len(h.b)),
             l AS (SELECT body, n_bytes, list_transform(range(256), lambda x: coalesce(counts[x], 0)) AS n FROM m),
             q AS (SELECT body, n_bytes, n, list_sort(n) AS o FROM l),
             f AS (SELECT body, CASE WHEN n_bytes < 8 THEN n_bytes ELSE least(255, 8 * (length(bin(n_bytes)) - 3) + (n_bytes >> (length(bin(n_bytes)) - 4)) - 8) END AS size,
                          list_transform(n, lambda x: (x > o[64])::INT + (x > o[128])::INT + (x > o[192])::INT) AS codes FROM q),
             p AS (SELECT body, size, codes, printf('%02x', CAST(size AS INT)) || array_to_string(list_transform(range(64), lambda x:
                          printf('%02x', codes[4 * x + 1] + 4 * codes[4 * x + 2] + 16 * codes[4 * x + 3] + 64 * codes[4 * x + 4])), '') AS print FROM f),
             x AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, p.print AS fingerprint, r.print AS edited_fingerprint, p.size, p.codes, r.size AS size1, r.codes AS codes1, w.size AS size2, w.codes AS codes2
                   FROM e JOIN p ON p.body = e.body JOIN p r ON r.body = e.edited JOIN p w ON w.body = e.next)
        SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
               round(1.0::DOUBLE - (0.75::DOUBLE * (list_sum(list_transform(range(1, 257), lambda i: abs(codes[i] - codes1[i])))::DOUBLE / greatest(1, list_sum(list_transform(range(1, 257), lambda i: greatest(codes[i], codes1[i]))))::DOUBLE)
                     + 0.25::DOUBLE * (least(abs(size - size1), 16)::DOUBLE / 16::DOUBLE)), 6) AS near_edited,
               round(1.0::DOUBLE - (0.75::DOUBLE * (list_sum(list_transform(range(1, 257), lambda i: abs(codes[i] - codes2[i])))::DOUBLE / greatest(1, list_sum(list_transform(range(1, 257), lambda i: greatest(codes[i], codes2[i]))))::DOUBLE)
                     + 0.25::DOUBLE * (least(abs(size - size2), 16)::DOUBLE / 16::DOUBLE)), 6) AS near_next
        FROM x
    """,
    "op12_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             g AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
             p AS (SELECT doc_id, n, form, body, array_to_string(w[: a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 :], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM p
    """,
}
