"""Check SQL of the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

# every window of 35 words as a string; those that stand in more than one place are removed
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (s)),
kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN removed USING (doc_id, p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words,
       CAST(coalesce(r.n, 0) AS bigint) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id) r USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# windows of items and of documents joined as strings
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
met AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows v ON p.s = v.s AND p.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(DISTINCT item_id) AS n,
         string_agg(DISTINCT CAST(item_id AS varchar), ',' ORDER BY CAST(item_id AS varchar)) AS ids
  FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(h.n, 0) AS bigint) AS n_hit,
       CAST(coalesce(o.n, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""

# all pairs of documents that share an n-gram, and their closure
JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, x.n = y.n AND s.n = x.n AS same
  FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
copies AS (SELECT a AS doc_id, min(b) AS least, count(*) AS n FROM links WHERE same GROUP BY a),
copy_of AS (SELECT doc_id, least(doc_id, coalesce(c.least, doc_id)) AS copy_id FROM d LEFT JOIN copies c USING (doc_id)),
counts AS (
  SELECT a AS doc_id, count(*) AS n, count(DISTINCT copy_id) FILTER (WHERE NOT same) AS other
  FROM links JOIN copy_of ON copy_of.doc_id = b GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, o.copy_id,
       CAST(1 + coalesce(p.n, 0) AS bigint) AS n_copies,
       CAST(coalesce(k.n, 0) AS bigint) AS n_links, CAST(coalesce(k.other, 0) AS bigint) AS n_class_links
FROM d LEFT JOIN classes c USING (doc_id) LEFT JOIN copies p USING (doc_id)
JOIN copy_of o USING (doc_id) LEFT JOIN counts k USING (doc_id)
"""

# every phrase as a string, every cut, every longer candidate
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS bigint) AS n FROM lists GROUP BY lang),
f AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
cuts AS (
  SELECT lang, p, a, k, p[1:k] AS head, p[k + 1:] AS tail
  FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r,
         CAST(2000000 * CAST(a AS hugeint) // (CAST(x.f AS hugeint) + y.f) AS bigint) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = head JOIN f y ON y.lang = c.lang AND y.p = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i
        FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS m FROM candidates))
  GROUP BY ALL),
rest AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p
  WHERE NOT coalesce(CAST(100 AS hugeint) * longer >= CAST(80 AS hugeint) * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM rest JOIN totals USING (lang) QUALIFY rank <= 2000
"""
