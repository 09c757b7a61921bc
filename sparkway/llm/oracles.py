"""DuckDB SQL of the rows of the queries that SQL can express, from plain definitions."""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS h, s FROM g),
r AS MATERIALIZED (SELECT min(doc_id) AS doc_id, any_value(n) AS n, any_value(s) AS s FROM n WHERE n > 0 GROUP BY h, n),
e AS MATERIALIZED (SELECT doc_id, n, hash(unnest(s)) AS x FROM r),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
k AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS x, doc_id AS y FROM r UNION SELECT c.x, k.b FROM c JOIN k ON k.a = c.y),
m AS (SELECT x AS doc_id, min(y) AS c FROM c GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE m.c END AS component_id
FROM n LEFT JOIN (SELECT h, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY h, n) q ON q.h = n.h AND q.n = n.n LEFT JOIN m ON m.doc_id = q.rep
"""
OP7 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.x = dw.x),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
OP9 = r"""
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(x[2 * i + 1 : 2 * i + 200]) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM b WHERE n >= 100)),
f AS (SELECT h, min((doc_id, i)) AS first FROM w GROUP BY h),
r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (h) WHERE (w.doc_id, w.i) > f.first),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS new FROM r),
q AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
z AS MATERIALIZED (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS e FROM q GROUP BY 1, 2),
y AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS o FROM z),
v AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans, max(e) AS last FROM z GROUP BY 1),
u AS (SELECT y.doc_id, string_agg(x[2 * o + 1 : 2 * a], '' ORDER BY a) AS kept FROM y JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1 :])) AS kept_sha256 FROM b LEFT JOIN v USING (doc_id) LEFT JOIN u USING (doc_id)
"""

OP11 = "SELECT *, doc_id = component_id AS kept FROM (" + OP6.replace("85 *", "80 *") + ")"
OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
m AS MATERIALIZED (SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN first < doc_id THEN 'E' END) AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM w LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(s) AS (SELECT '' UNION ALL SELECT s || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(s, f)),
q AS (SELECT s, k, s[k] AS f, s[1 : k - 1] AS earlier FROM (SELECT s, unnest(range(1, 6)) AS k FROM o WHERE length(s) = 5)),
j AS (SELECT part, s, k, f, n, good, toxic, fails, contains(fails, f) AS hit, translate(fails, earlier, '') <> fails AS gone FROM m, q),
r AS (SELECT part, s, k, f, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY 1, 2, 3, 4)
SELECT part, s AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def op13(rounds: int = 5) -> str:
    """The rounds one after another, each vector compared with each centroid."""
    near = "a{r} AS MATERIALIZED (SELECT vec_id, min((d, k)) AS m FROM (SELECT vec_id, k, CAST(sum((u.x - c{r}.x) * (u.x - c{r}.x)) AS BIGINT) AS d FROM u JOIN c{r} USING (i) GROUP BY 1, 2) GROUP BY 1)"
    mean = "s{r} AS (SELECT m[2] AS k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u JOIN a{r} USING (vec_id) GROUP BY 1, 2), c{n} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN s{r} USING (k, i))"
    steps = ", ".join(f"{near.format(r=r)}, {mean.format(r=r, n=r + 1)}" for r in range(rounds)) + ", " + near.format(r=rounds)
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
u AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM v),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v FROM v) WHERE k < 40), {steps},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h ON h.k = m[2]
"""


ORACLES = {"op6_ngram_jaccard_join": OP6, "op7_benchmark_decontamination": OP7, "op9_long_match_dedup": OP9, "op11_minhash_near_dedup": OP11, "op12_filter_interaction_audit": OP12, "op13_centroid_clustering": op13()}
