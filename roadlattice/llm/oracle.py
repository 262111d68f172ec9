"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS txt
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), tok AS (
  SELECT doc_id, line, txt, list_transform(list_filter(string_split_regex(txt, '[ \t\r\f\x0B]'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9@=/\\_#]') THEN '<*>' ELSE t END) AS t FROM lines
), rws AS (
  SELECT doc_id, line, txt, t, concat_ws(' ', len(t), array_to_string(t[1:3], ' ')) AS node FROM tok WHERE len(t) >= 3
), bodies AS (
  SELECT doc_id, string_agg(array_to_string(t, ' '), chr(10) ORDER BY array_to_string(t, ' ')) AS body FROM tok WHERE len(t) > 0 GROUP BY 1
), parsed AS (
  SELECT doc_id, line, txt, t, node, body, dense_rank() OVER (ORDER BY body) AS b FROM rws JOIN bodies USING (doc_id)
), nodes AS (
  SELECT node, count(DISTINCT b) AS support FROM parsed GROUP BY 1 HAVING count(DISTINCT b) >= 5
), shared AS (
  SELECT p.*, support FROM parsed p JOIN nodes USING (node)
), words AS (
  SELECT doc_id, line, node, b, support, unnest(range(len(t))) AS pos, unnest(t) AS token FROM shared
), common AS (
  SELECT node, pos, token, count(DISTINCT b) AS c FROM words WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT b) >= 5
), levels AS (
  SELECT share, w.doc_id, w.line, w.node, count(*) AS n, count(c.token) AS k, string_agg(CAST(c.pos AS VARCHAR) || ':' || c.token, ' ' ORDER BY c.pos) AS shape
  FROM words w CROSS JOIN (VALUES (0.5), (0.1), (0.0)) AS s(share) LEFT JOIN common c ON w.node = c.node AND w.pos = c.pos AND w.token = c.token AND c.c >= w.support * share GROUP BY 1, 2, 3, 4
), general AS (
  SELECT DISTINCT doc_id, line, 'shape ' || node || '|' || shape AS template FROM levels WHERE k >= n * 0.6
), own AS (
  SELECT doc_id, line, CASE WHEN len(list_filter(t, lambda x: x <> '<*>')) >= len(t) * 0.6 THEN 'leaf ' || array_to_string(t, ' ') ELSE 'line ' || trim(txt, concat(' ', chr(9), chr(13), chr(12), chr(11))) END AS template
  FROM shared ANTI JOIN general USING (doc_id, line)
), templated AS (
  SELECT doc_id, line, b, template FROM (SELECT * FROM general UNION ALL SELECT * FROM own) JOIN shared USING (doc_id, line)
), gone AS (
  SELECT DISTINCT doc_id, line FROM templated WHERE template IN (SELECT template FROM templated GROUP BY template HAVING count(DISTINCT b) >= 5)
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_dropped
FROM documents d
LEFT JOIN (SELECT l.doc_id, string_agg(l.txt, chr(10) ORDER BY l.line) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY 1) k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON d.doc_id = g.doc_id
"""

OP2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), c AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS canon FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND canon <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND canon <> page_id THEN canon END AS refers_to
FROM c
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS ab FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * ab >= 75 * (na.n + nb.n - ab)
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other
), comp AS (
  SELECT id, min(other) AS c FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.id = d.doc_id
"""

OP6 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS g_lang, coalesce(source, chr(0)) AS g_source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), wins AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i) WHERE len(w) >= 5
), twice AS (
  SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) AS u(k) GROUP BY 1
), base AS (
  SELECT t.r, doc_id, g_lang, g_source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM t LEFT JOIN rep ON rep.r = t.r
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), metrics AS (
  SELECT r, g_lang, g_source, base_failed, metric, v, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + CAST(floor(v / pow(2, length(bin(v)) - 6)) AS BIGINT) END AS b
  FROM (SELECT r, g_lang, g_source, base_failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
    unnest([word_chars * 1000 // greatest(n_words, 1), n_symbols * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1)]) AS v FROM failed)
), levels AS (
  SELECT 1 AS lvl, g_lang, g_source, metric, b FROM metrics WHERE NOT base_failed UNION ALL
  SELECT 2, g_lang, '', metric, b FROM metrics WHERE NOT base_failed UNION ALL SELECT 3, '', '', metric, b FROM metrics WHERE NOT base_failed
), ranked AS (
  SELECT lvl, g_lang, g_source, metric, b, row_number() OVER (PARTITION BY lvl, g_lang, g_source, metric ORDER BY b) AS k, count(*) OVER (PARTITION BY lvl, g_lang, g_source, metric) AS n FROM levels
), q AS (
  SELECT lvl, g_lang, g_source, metric, n, min(CASE WHEN k * 1000 >= n * x THEN b END) AS bx, min(CASE WHEN k * 1000 >= n * y THEN b END) AS by_, any_value(reach) AS reach FROM ranked
  JOIN (VALUES ('word_length', 250, 750, 5), ('symbols', 500, 800, 2), ('dup_lines', 500, 990, 1), ('repeats', 500, 990, 1)) AS f(metric, x, y, reach) USING (metric) GROUP BY lvl, g_lang, g_source, metric, n
), edges AS (
  SELECT lvl, g_lang, g_source, metric, n, reach, CASE WHEN bx < 64 THEN bx ELSE CAST((bx - (bx // 32 - 1) * 32) * pow(2, bx // 32 - 1) AS BIGINT) END AS qx,
    CASE WHEN by_ < 64 THEN by_ ELSE CAST((by_ - (by_ // 32 - 1) * 32) * pow(2, by_ // 32 - 1) AS BIGINT) END AS qy FROM q
), fences AS (
  SELECT *, qy + reach * (qy - qx) AS hi, qx - reach * (qy - qx) AS lo FROM edges
), bad AS (
  SELECT m.r, list_sort(list(m.metric) FILTER (v > f.hi OR (m.metric = 'word_length' AND v < f.lo))) AS failed
  FROM metrics m
  LEFT JOIN fences s ON s.lvl = 1 AND s.g_lang = m.g_lang AND s.g_source = m.g_source AND s.metric = m.metric
  LEFT JOIN fences l ON l.lvl = 2 AND l.g_lang = m.g_lang AND l.metric = m.metric
  JOIN fences f ON f.metric = m.metric AND ((s.n >= 30 AND f.lvl = 1 AND f.g_lang = m.g_lang AND f.g_source = m.g_source) OR (coalesce(s.n, 0) < 30 AND l.n >= 30 AND f.lvl = 2 AND f.g_lang = m.g_lang) OR (coalesce(s.n, 0) < 30 AND coalesce(l.n, 0) < 30 AND f.lvl = 3))
  GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(len(bad.failed), 0) = 0 AS kept, coalesce(array_to_string(bad.failed, ','), '') AS failed
FROM failed LEFT JOIN bad ON bad.r = failed.r
"""

OP7 = rf"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[k : k + 12], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 11, 2))) AS u(k) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), x AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM p), unnest(range(1, greatest(len(w) - m + 2, 1))) AS u(k)
), hits AS (
  SELECT x.doc_id, x.k, x.m, p.item FROM x JOIN p ON p.m = x.m AND p.s = x.s
), h AS (
  SELECT doc_id, count(DISTINCT k + j) AS n FROM hits, unnest(range(m)) AS u(j) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP11 = r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM documents
), g AS (
  SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS moved, (h // 10) % greatest(len(w0), 1) AS a, 3 + (h // 10) % 8 AS k FROM c
), x AS (
  SELECT doc_id, n, CASE WHEN moved THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w0 END AS w FROM g
), grams AS (
  SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + 8], ' ')) AS s FROM x, unnest(range(greatest(n - 7, 0))) AS u(i)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY 1, 2, 3
), gone AS (
  SELECT DISTINCT doc_id, start + j AS i FROM runs, unnest(range(period, length)) AS u(j)
), kept AS (
  SELECT x.doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS body FROM x CROSS JOIN unnest(range(n)) AS u(i) ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.i = u.i GROUP BY 1
), per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM x LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _books(before: str, after: str) -> str:
    """One round: codes by the entries of ``before``, then means into ``after``."""
    return f"""a_{after} AS (
  SELECT p.r, p.part, arg_min(entry, d) AS entry FROM (
    SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) * 64 + b.entry AS d FROM p JOIN {before} b USING (part)) p GROUP BY 1, 2
), {after} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY dim) AS x FROM (
      SELECT part, entry, dim, sum(v) AS total, count(*) AS n FROM (SELECT part, entry, unnest(range(len(x))) AS dim, unnest(x) AS v FROM p JOIN a_{after} USING (r, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry)
)"""


OP12 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), p AS MATERIALIZED (
  SELECT r, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM v, unnest(range(16)) AS u(part)
), b0 AS (
  SELECT part, r AS entry, x FROM p WHERE r < 64
), {_books("b0", "b1")}, {_books("b1", "b2")}, coded AS (
  SELECT r, part, min(d) AS d FROM (
    SELECT p.r, p.part, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) * 64 + b.entry AS d FROM p JOIN b2 b USING (part)) GROUP BY 1, 2
), each AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(d % 64 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d // 64) AS BIGINT) AS error FROM coded JOIN v USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM each
"""

SQL = {"op11_periodic_runs": OP11, "op12_vector_codes": OP12, "op1_line_dedup": OP1, "op2_warc": OP2, "op3_near_dedup": OP3, "op6_quality": OP6, "op7_decontaminate": OP7}
