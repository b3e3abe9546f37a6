"""DuckDB SQL of the text queries that SQL can express.

The others (classifiers, compression, merges of tokens, surrogates, and rules whose matches have
places) are held against brute force or held-out rows in the tests.
"""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win USING (n, t)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

SUBSTRING_DEDUP = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)),
first AS (SELECT k, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY k HAVING count(*) > 1),
rep AS (SELECT win.doc_id, i FROM win JOIN first USING (k) WHERE f <> {'d': win.doc_id, 'i': i}),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM rep),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM run GROUP BY doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda j: substring(x, 2 * coalesce(e[j - 1], 0) + 1, 2 * (coalesce(s[j], n) - coalesce(e[j - 1], 0)))), '') END)) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
reach AS (SELECT a AS x, a AS y FROM link UNION SELECT x, b FROM reach JOIN link ON link.a = reach.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""

RANKED = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS t FROM benchmark),
st AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, st GROUP BY t, n_docs),
imp AS (SELECT doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS s FROM tf JOIN df USING (t), st),
sc AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN imp USING (t) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 10
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, unnest([1, 2, 3]) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, g, a, c, array_to_string(w[1:c], ' ') AS g1, array_to_string(w[c + 1:k], ' ') AS g2 FROM c, unnest([1, 2]) AS t(c) WHERE c < k),
s AS (SELECT cut.lang, cut.k, cut.g, a, c, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = g1 JOIN f y ON y.lang = cut.lang AND y.g = g2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
d AS (SELECT DISTINCT i.lang, i.g FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE k = 3) o JOIN c i USING (lang, g) WHERE 100 * o.a >= 50 * i.a)
SELECT b.lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM b ANTI JOIN d USING (lang, g)) b JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_decontamination": DECONTAMINATION, "op3_run_length_dedup": SUBSTRING_DEDUP, "op10_jaccard_join": JACCARD, "op11_ranked_search": RANKED, "op12_collocations": COLLOCATIONS}
