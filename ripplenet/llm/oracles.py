"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATED_WINDOWS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (k) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i+1] END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, link.b FROM r JOIN link ON link.a = r.seen),
g AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN g ON g.node = w.doc_id
"""

_BUCKET = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
_METRICS = {"mean_word": ("1000 * word_chars // n_words", "n_words", 10), "symbols": ("1000 * n_symbols // n_words", "n_words", 1), "dup_lines": ("1000 * n_dup_lines // n_lines", "n_lines", 1), "repeats": ("1000 * n_repeat_words // n_words", "n_words", 6)}
_MEASURED = {m: f for m, (f, _, _) in _METRICS.items()} | {"n_words": "n_words", "n_lines": "n_lines"}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({f} AS BIGINT) AS v FROM base WHERE NOT base_failed" for m, f in _MEASURED.items())
_WIDE = ", ".join(f"max({q}) FILTER (metric = '{m}') AS {m}_{q}" for m in _MEASURED for q in ("low", "mid", "high"))
_LEAST = {m: f"greatest(1, {1000 * o} // least({size}, {size}_mid))" for m, (_, size, o) in _METRICS.items()}
_INSIDE = " AND ".join(f"{f} <= {m}_mid + 5 * greatest({m}_high - {m}_mid, {_LEAST[m]})" for m, (f, _, _) in _METRICS.items())
_INSIDE += f" AND {_METRICS['mean_word'][0]} >= mean_word_mid - 5 * greatest(mean_word_mid - mean_word_low, {_LEAST['mean_word']})"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM tri WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
feat AS (SELECT d.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feat),
fine AS (SELECT lang, source, metric, {_BUCKET} AS bucket, count(*) AS n FROM ({_LONG}) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, metric FROM fine),
by_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL), by_all AS (SELECT metric, bucket, sum(n) AS n FROM fine GROUP BY ALL),
size_lang AS (SELECT lang, metric, sum(n) AS size FROM fine GROUP BY ALL), size_all AS (SELECT metric, sum(n) AS size FROM fine GROUP BY ALL),
blend AS (SELECT lang, source, metric, bucket, sum(w) AS w FROM (
 SELECT lang, source, metric, bucket, 1000 * n AS w FROM fine
 UNION ALL SELECT g.lang, source, g.metric, bucket, 50000 * n // size AS w FROM groups g JOIN by_lang p ON p.lang = g.lang AND p.metric = g.metric JOIN size_lang s ON s.lang = g.lang AND s.metric = g.metric
 UNION ALL SELECT lang, source, g.metric, bucket, 50000 * n // size AS w FROM groups g JOIN by_all p ON p.metric = g.metric JOIN size_all s ON s.metric = g.metric) GROUP BY ALL HAVING sum(w) > 0),
ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS below, sum(w) OVER (PARTITION BY lang, source, metric) AS size FROM blend),
q AS (SELECT lang, source, metric, min(bucket) FILTER (100 * below >= 15 * size) AS low, min(bucket) FILTER (100 * below >= 50 * size) AS mid, min(bucket) FILTER (100 * below >= 85 * size) AS high FROM ranked GROUP BY ALL),
wide AS (SELECT lang, source, {_WIDE} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {_INSIDE} END AS kept FROM base LEFT JOIN wide USING (lang, source)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM near JOIN p USING (anchor_id)
 WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

_CUT = "CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST({l} AS HUGEINT) * {r}) AS BIGINT)"
PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
w1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM pieces) GROUP BY ALL),
w2 AS (SELECT lang, p, q, count(*) AS a FROM (SELECT lang, unnest(ws[:-2]) AS p, unnest(ws[2:]) AS q FROM pieces WHERE len(ws) >= 2) GROUP BY ALL),
w3 AS (SELECT lang, p, q, s, count(*) AS a FROM (SELECT lang, unnest(ws[:-3]) AS p, unnest(ws[2:-2]) AS q, unnest(ws[3:]) AS s FROM pieces WHERE len(ws) >= 3) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, p, q, max(a) AS a FROM (SELECT lang, p, q, a FROM w3 UNION ALL SELECT lang, q, s, a FROM w3) GROUP BY lang, p, q),
two AS (SELECT w2.lang, w2.p || ' ' || w2.q AS phrase, w2.a, x.f AS l, y.f AS r, {_CUT.format(l="x.f", r="y.f").replace(" a ", " w2.a ")} AS score FROM w2 JOIN w1 x ON x.lang = w2.lang AND x.w = w2.p JOIN w1 y ON y.lang = w2.lang AND y.w = w2.q
 LEFT JOIN longer g ON g.lang = w2.lang AND g.p = w2.p AND g.q = w2.q WHERE w2.a >= 10 AND coalesce(100 * g.a < 50 * w2.a, true)),
cuts AS (SELECT t.lang, t.p || ' ' || t.q || ' ' || t.s AS phrase, t.a, x.f AS l1, qs.a AS r1, pq.a AS l2, y.f AS r2 FROM w3 t JOIN w1 x ON x.lang = t.lang AND x.w = t.p JOIN w2 qs ON qs.lang = t.lang AND qs.p = t.q AND qs.q = t.s
 JOIN w2 pq ON pq.lang = t.lang AND pq.p = t.p AND pq.q = t.q JOIN w1 y ON y.lang = t.lang AND y.w = t.s),
scored AS (SELECT *, {_CUT.format(l="l1", r="r1")} AS s1, {_CUT.format(l="l2", r="r2")} AS s2 FROM cuts),
every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM scored),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM w1 GROUP BY lang)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM every JOIN n USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""
