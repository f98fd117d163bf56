"""DuckDB SQL of those queries that SQL can express on whole tables."""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM meet JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON x = w.doc_id GROUP BY w.doc_id, n.n
"""

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN dup USING (s)) GROUP BY doc_id, p),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(e.x, ' ' ORDER BY e.p) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


OP6 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT x AS vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(y) AS component_id, x = min(y) AS kept FROM reach LEFT JOIN n ON n.a = x GROUP BY x
"""

OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS w0, CASE WHEN i > 1 THEN ws[i - 1] END AS w1, CASE WHEN i > 2 THEN ws[i - 2] END AS w2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
one AS (SELECT w0 AS a, count(*) AS c FROM t GROUP BY 1),
two AS (SELECT w1 AS a, w0 AS b, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
three AS (SELECT w2 AS a, w1 AS b, w0 AS d, count(*) AS c FROM t WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT doc_id, CASE WHEN c3.c IS NOT NULL THEN log10(c3.c / b2.c) WHEN c2.c IS NOT NULL THEN log10(c2.c / b1.c) + CASE WHEN w2 IS NULL THEN 0 ELSE log10(0.4) END
    ELSE log10(c1.c / n.n) + CASE WHEN w1 IS NULL THEN 0 WHEN w2 IS NULL THEN log10(0.4) ELSE 2 * log10(0.4) END END AS s,
  CASE WHEN c3.c IS NOT NULL OR (c2.c IS NOT NULL AND w2 IS NULL) OR w1 IS NULL THEN 0 ELSE 1 END AS back
  FROM t CROSS JOIN n JOIN one c1 ON c1.a = w0 LEFT JOIN one b1 ON b1.a = w1 LEFT JOIN two c2 ON c2.a = w1 AND c2.b = w0 LEFT JOIN two b2 ON b2.a = w2 AND b2.b = w1 LEFT JOIN three c3 ON c3.a = w2 AND c3.b = w1 AND c3.d = w0),
d AS (SELECT doc_id, count(*) AS k, sum(back) AS back, sum(s) AS total FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(back, 0) AS BIGINT) AS n_backed_off, round(total, 4) AS log10_score, round(total / k, 6) AS mean_log10 FROM w LEFT JOIN d USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, md5(array_to_string(ws[i:i + m - 1], ' ')) AS s
  FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS m FROM b WHERE len(ws) > 0))),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, md5(array_to_string(ws[i:i + m - 1], ' ')) AS s FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d CROSS JOIN m WHERE len(ws) >= m)),
hit AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
c AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(text) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(text) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, least(a, b) AS x, greatest(a, b) AS y FROM c),
parts AS (SELECT *, substring(text, 1, x) AS pre, substring(text, x + 1, y - x) AS mid, substring(text, y + 1, n - y) AS suf FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


def oracle_sql() -> dict:
    return {"op2_ngram_jaccard_join": OP2, "op3_substring_dedup": OP3, "op6_embedding_dedup": OP6, "op8_lm_scoring": OP8, "op10_benchmark_decontamination": OP10, "op12_fill_in_middle": OP12}
