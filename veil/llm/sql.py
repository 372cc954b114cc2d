"""What the queries return, as SQL for another engine, where SQL can say it."""

from __future__ import annotations

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
runs AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, runs.n, item FROM runs JOIN win ON runs.g = win.g AND runs.n = win.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_BARS = r"regexp_replace({}, '<(\|+)', '<|\1', 'g')"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
  sum(length('<|im_start|>') + length({_BARS.format("role")}) + 1 + length({_BARS.format("text")}) + length('<|im_end|>') + 1) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, cast(n_turns AS bigint) AS n_turns, sha256(turns) AS turns_sha256, cast(length(lost) AS bigint) AS loss_chars, sha256(lost) AS loss_sha256,
  cast(formatted_chars AS bigint) AS formatted_chars FROM s
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (g), unnest(range(0, 13)) AS t(k) WHERE m < doc_id),
kept AS (SELECT d.doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n FROM d, unnest(range(1, len(w) + 1)) AS t(p)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.p = t.p) GROUP BY d.doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{ALNUM}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g)) AS whole FROM s GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS copy_id, count(*) OVER (PARTITION BY whole) - 1 AS n_copies FROM n),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 10 * m >= 8 * (x.n + y.n - m)),
reach(v, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.v),
classes AS (SELECT v, min(label) AS class_id FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, class_id, coalesce(copy_id, d.doc_id) AS copy_id, cast(coalesce(n_links, 0) AS bigint) AS n_links, cast(coalesce(n_copies, 0) AS bigint) AS n_copies
FROM d JOIN classes ON classes.v = d.doc_id LEFT JOIN copies ON copies.doc_id = d.doc_id LEFT JOIN degree ON degree.a = d.doc_id
"""

VECTORS = r"""
WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(x, label) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.x),
low AS (SELECT x, min(label) AS component_id FROM reach GROUP BY x),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, cast(coalesce(n_links, 0) AS bigint) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.x = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id
"""

PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i) GROUP BY ALL),
n AS (SELECT lang, cast(sum(f) AS hugeint) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.phrase, c.m, c.a, n.n, k, x.f AS l, y.f AS r, (1000 * cast(a AS hugeint) * n) // (cast(x.f AS hugeint) * y.f) AS score
  FROM c JOIN n USING (lang), unnest(range(1, c.m)) AS t(k)
  JOIN g AS x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN g AS y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND c.m > best.m AND 100 * c.a >= 100 * best.a
  AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM ranked WHERE rank <= 2000
"""
