"""DuckDB SQL of the operators that it can express; the other operators are tested against brute force."""

from __future__ import annotations

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + v.v) AS p
 FROM gt JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
q AS (SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.total + v.v) AS q FROM kept JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def clusters(size: int = 64, centroids: int = 8, rounds: int = 10) -> str:
    """Each round is a pair of common table expressions."""
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    out = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v FROM k ORDER BY sha256('3:' || vec_id) LIMIT {centroids})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {distance}, cluster := c.cluster)) AS best FROM k, c{r} c GROUP BY rid)")
        if r < rounds:
            total = "sum(k.v[i])"
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST(x AS HUGEINT) ORDER BY i) AS v FROM
 (SELECT a.best.cluster AS cluster, i, ({total} - (({total} % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{r} a JOIN k USING (rid), range(1, {size + 1}) AS g(i) GROUP BY a.best.cluster, i) GROUP BY cluster) n USING (cluster))""")
    last = f"SELECT k.vec_id, CAST(a.best.cluster AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN k USING (rid) JOIN c{rounds} c ON c.cluster = a.best.cluster"
    return "WITH " + ",\n".join(out) + "\n" + last
