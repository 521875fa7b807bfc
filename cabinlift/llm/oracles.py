"""SQL twins of the joins over documents, for an independent engine on small tables.

They take the plain road: all shared n-grams of all pairs, all windows of all items.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT row, doc_id, CASE
    WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
entries AS (SELECT row, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.row AS a, b.row AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.row < b.row GROUP BY a.row, b.row),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
mirrored AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT row AS a, row AS b FROM d UNION SELECT reach.a, mirrored.b FROM reach JOIN mirrored ON reach.b = mirrored.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN sets s ON s.row = a JOIN sets o ON o.row = b GROUP BY s.row, s.doc_id, s.s
"""

CONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(
    range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT row, k, unnest(range(0, len(w) - k + 1)) AS i,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM d JOIN sizes ON len(w) >= k),
hits AS (SELECT row, i, k, item_id FROM grams JOIN windows USING (k, gram)),
covered AS (
  SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest(range(i, i + k)) AS word FROM hits) GROUP BY row),
named AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""
