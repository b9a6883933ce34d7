"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

ORACLES = {}

ORACLES["op5_wu_manber_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
hits AS (
  SELECT d.doc_id, p.i, win.m, win.item_id
  FROM (SELECT doc_id, w, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)) AS p
  JOIN win ON win.m = p.m AND win.k = p.k JOIN dw AS d ON d.doc_id = p.doc_id),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op1_repeated_phrases"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT doc_id, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again),
marked AS (SELECT doc_id, count(*) AS n_removed, list(j) AS js FROM gone GROUP BY doc_id),
words AS (SELECT d.doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) AS d
          ANTI JOIN gone AS g ON d.doc_id = g.doc_id AND d.j = g.j),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM words GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_bottom_k_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e AS a JOIN e AS b ON a.k = b.k AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach AS r JOIN links AS l ON l.u = r.v)
SELECT s.doc_id, len(g) AS n_shingles, min(v) AS component_id, s.doc_id = min(v) AS kept
FROM s JOIN reach ON reach.u = s.doc_id GROUP BY s.doc_id, len(g)
"""


def shard_sql(limit: int) -> str:
    """Every prefix of every hash is a bucket; the shard of a document is its shortest bucket that is settled."""
    return rf"""
WITH h AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash FROM documents),
nodes AS (SELECT depth, hash >> (60 - depth) AS node, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs
          FROM h, range(0, 61) AS t(depth) GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR min(hash) = max(hash)),
first AS (SELECT h.doc_id, n_bytes, hash, min(depth) AS depth FROM h, range(0, 61) AS t(depth)
          SEMI JOIN nodes ON t.depth = nodes.depth AND h.hash >> (60 - t.depth) = nodes.node GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(format('{{:060b}}', hash), 1, depth::INT) END AS shard,
       depth::INT AS depth, shard_bytes::BIGINT AS shard_bytes, shard_docs
FROM first JOIN nodes USING (depth) WHERE nodes.node = hash >> (60 - depth)
"""


ORACLES["op6_extendible_hash_shards"] = shard_sql(64 << 20)

ORACLES["op11_angular_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.l = v.l AS same,
             coalesce(list_sum(list_transform(list_zip(a.q, v.q), lambda z: z[1] * z[2])), 0)::BIGINT AS s
      FROM v AS a, v WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s AS n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY rank <= 3
"""
