"""SQL of the training-data queries, where SQL can express them on whole tables."""

_GRAMS = r"""
WITH word_lists AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
doc_grams AS (
  SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM word_lists)),
item_lists AS (
  SELECT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS ws FROM eval_items
  UNION ALL SELECT item_id, regexp_extract_all(lower(solution), '[\p{L}\p{N}]+') FROM eval_items),
item_grams AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (
    SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM item_lists))
"""

_SHINGLES = r"""
WITH words AS (SELECT chunk_id, list_transform(regexp_extract_all(source_text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS ws
  FROM (SELECT DISTINCT chunk_id, source_text FROM chunks WHERE chunk_id IS NOT NULL AND source_text IS NOT NULL)),
runs AS (SELECT DISTINCT chunk_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT chunk_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY chunk_id),
shared AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id < b.chunk_id GROUP BY a.chunk_id, b.chunk_id)
"""

SQL = {
    "p4_found": _SHINGLES
    + """SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE 10 * c >= 6 * (x.n + y.n - c)
    UNION SELECT a.chunk_id, b.chunk_id FROM chunks a JOIN chunks b ON a.source_text = b.source_text AND a.chunk_id < b.chunk_id""",
    "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(source_text) > 8000 OR length(source_text) - length(replace(source_text, chr(10), '')) + 1 > 150",
    "p4_groups": """
WITH RECURSIVE texts AS (SELECT DISTINCT chunk_id, source_text FROM chunks WHERE chunk_id IS NOT NULL AND source_text IS NOT NULL),
words AS (SELECT chunk_id, source_text, list_transform(regexp_extract_all(source_text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS ws FROM texts),
sets AS (SELECT chunk_id, CASE WHEN len(ws) < 3 THEN 'text ' || md5(source_text)
    ELSE md5(array_to_string(list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))), '|')) END AS cls, ws FROM words),
members AS (SELECT DISTINCT chunk_id, cls FROM sets),
firsts AS (SELECT cls, min(chunk_id) AS class_id FROM members GROUP BY cls),
runs AS (SELECT DISTINCT cls, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT cls, ws, unnest(range(1, len(ws) - 1)) AS i FROM sets WHERE len(ws) >= 3)),
sizes AS (SELECT cls, count(*) AS n FROM runs GROUP BY cls),
shared AS (SELECT a.cls AS a, b.cls AS b, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.cls <> b.cls GROUP BY a.cls, b.cls),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.cls = a JOIN sizes y ON y.cls = b WHERE 10 * c >= 6 * (x.n + y.n - c)),
reach AS (SELECT cls AS u, cls AS v FROM firsts UNION SELECT u, b FROM reach JOIN links ON links.a = reach.v),
grouped AS (SELECT u, min(class_id) AS group_id FROM reach JOIN firsts ON firsts.cls = reach.v GROUP BY u),
degrees AS (SELECT a AS cls, count(*) AS links FROM links GROUP BY a)
SELECT DISTINCT chunk_id, class_id, group_id, coalesce(links, 0)::BIGINT AS links
FROM members JOIN firsts USING (cls) JOIN grouped ON grouped.u = members.cls LEFT JOIN degrees USING (cls)""",
    "p7_report": _GRAMS
    + """, placed AS (
  SELECT DISTINCT d, item_id, i FROM (SELECT doc_id || ' ' || array_to_string(ws, ' ') AS d, i, array_to_string(ws[i:i + 11], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM word_lists)) JOIN item_grams USING (g)),
marked AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY d, item_id ORDER BY i) + 12 THEN 1 ELSE 0 END AS fresh FROM placed),
spans AS (SELECT d, item_id, i, sum(fresh) OVER (PARTITION BY d, item_id ORDER BY i) AS span FROM marked),
lengths AS (SELECT item_id, max(i) - min(i) + 12 AS words FROM spans GROUP BY d, item_id, span),
named AS (SELECT item_id, count(DISTINCT doc_id) AS documents FROM doc_grams JOIN item_grams USING (g) GROUP BY item_id)
SELECT item_id, documents, max(words)::BIGINT AS longest_passage FROM lengths JOIN named USING (item_id) GROUP BY item_id, documents""",
    "p7_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (g)",
}
