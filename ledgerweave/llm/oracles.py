"""SQL for results that SQL can express as a whole and in time.

Spans by leftmost matching, XXH64 fingerprints, tokenizers and models cannot be expressed, and byte windows of all texts are
too slow; those queries are tested against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
starts AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT r, id, i, array_to_string(w[i:i + 49], ' ') AS p FROM starts),
low AS (SELECT p, min(id) AS low FROM win GROUP BY p),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (p) WHERE low < id),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT words.r, count(*) AS n, string_agg(x, ' ' ORDER BY words.j) AS k FROM words LEFT JOIN hit ON words.r = hit.r AND words.j = hit.j WHERE hit.r IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALPHANUMERIC}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_ALPHANUMERIC}') AS w FROM benchmark),
bs AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
found AS (SELECT r, i, s.k AS k, item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM ds) AS s JOIN bw ON s.k = bw.k AND s.p = bw.p),
hits AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) AS t GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM found) AS t GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, {_LOWER.replace("coalesce(text, '')", "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
low AS (SELECT key, min(id) AS low FROM k WHERE length(key) >= 10 GROUP BY key),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM k LEFT JOIN low ON k.key = low.key WHERE low.low IS NULL OR low.low >= id GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({_LOWER}, '{_TERMS}')) AS w FROM benchmark),
s AS (SELECT (count(*) FILTER (WHERE len(w) > 0))::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
qt AS (SELECT i, item_id, unnest(w) AS t FROM q),
dt AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) AS x WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM dt GROUP BY t) AS x, s),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::BIGINT * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT qt.i, qt.item_id, dt.r, sum(wt.w * ((1000000000 * dt.tf) // (1000 * dt.tf + 20 * m.m)))::BIGINT AS score
  FROM qt JOIN dt ON qt.t = dt.t JOIN wt ON wt.t = qt.t JOIN m ON m.r = dt.r GROUP BY qt.i, qt.item_id, dt.r),
k AS (SELECT sc.item_id, m.doc_id, sc.score, row_number() OVER (PARTITION BY sc.i ORDER BY sc.score DESC, m.doc_id NULLS LAST) AS k
  FROM sc JOIN m ON m.r = sc.r WHERE sc.score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM k WHERE k <= 50
"""

OP13 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
a AS (SELECT * FROM c WHERE id % 100 = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, a.label AS a_label, c.r, c.id, c.label, sum(a.x * c.x)::BIGINT AS score
  FROM a JOIN c ON a.i = c.i GROUP BY a.r, a.id, a.label, c.r, c.id, c.label),
p AS (SELECT a, anchor_id, r AS p, id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, r) AS k FROM s WHERE a_label = label AND a <> r) AS x WHERE k <= 5),
g AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.id NULLS LAST, s.r) AS k
  FROM p JOIN s ON p.a = s.a WHERE s.a_label <> s.label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE k <= 10
"""

ORACLES: dict[str, str] = {
    "op9_substring_dedup": OP9, "op10_benchmark_decontamination": OP10, "op11_line_dedup": OP11, "op12_ranked_lexical_search": OP12,
    "op13_hard_negative_mining": OP13,
}
