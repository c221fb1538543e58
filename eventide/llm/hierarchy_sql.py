"""The condensed hierarchy of similar vectors in SQL, by plain Kruskal, for the check of small tables.

The state of the recursion is the component of every node after each edge. All else is read off the merges: which of them open clusters, when each
node first is in a component of the least size, how stable a cluster is, and which clusters are the stable ones.
"""

from __future__ import annotations

LEAST, TOP = 3, 1000.0

_VECTORS = """
c AS (SELECT DISTINCT cid, lower(trim(term)) AS term, weight AS w FROM centroid_tbl WHERE isfinite(weight) AND weight > 0 AND trim(term) <> '' AND cid IN (SELECT cid FROM output_tbl)),
s AS (SELECT cid, term, sum(w) AS w FROM c GROUP BY ALL),
vec AS (SELECT cid, list({'t': term, 'w': w} ORDER BY term) AS v FROM s GROUP BY cid),
node AS MATERIALIZED (SELECT min(cid) AS rep, count(*) AS copies, list(cid) AS cids, row_number() OVER (ORDER BY min(cid)) AS x FROM vec GROUP BY v),
unit AS MATERIALIZED (SELECT x, term, w / sqrt(sum(w * w) OVER (PARTITION BY cid)) AS w FROM s JOIN node ON cid = rep),
pair AS (SELECT a.x AS x, b.x AS y, round(sum(a.w * b.w), 12) AS cosine FROM unit a JOIN unit b ON a.term = b.term AND a.x < b.x GROUP BY ALL),
edge AS MATERIALIZED (SELECT x, y, d, row_number() OVER (ORDER BY d, x, y) AS k FROM (SELECT x, y, round(greatest(1 - cosine, 0), 12) AS d FROM pair WHERE cosine >= 0.7)),
start AS (SELECT list(x::INT ORDER BY x) AS comp FROM node),
"""

_HIERARCHY = f"""
r(k, comp) AS (
  SELECT 0::BIGINT, comp FROM start
  UNION ALL
  SELECT edge.k, CASE WHEN comp[x] = comp[y] THEN comp ELSE list_transform(comp, lambda l: CASE WHEN l = greatest(comp[x], comp[y]) THEN least(comp[x], comp[y]) ELSE l END) END
  FROM r JOIN edge ON edge.k = r.k + 1),
m AS MATERIALIZED (SELECT e.k, 1 / greatest(d, 0.001) AS dens, least(comp[x], comp[y]) AS lo, greatest(comp[x], comp[y]) AS hi, comp FROM r JOIN edge e ON e.k = r.k + 1 WHERE comp[x] <> comp[y]),
member AS MATERIALIZED (SELECT k, dens, lo, hi, l, node.x, copies FROM (SELECT k, dens, lo, hi, unnest(comp) AS l, generate_subscripts(comp, 1) AS x FROM m) JOIN node USING (x) WHERE l IN (lo, hi)),
n AS MATERIALIZED (SELECT k, any_value(dens) AS dens, any_value(lo) AS lo, any_value(hi) AS hi, sum(copies) FILTER (l = lo) AS nlo, sum(copies) FILTER (l = hi) AS nhi FROM member GROUP BY k),
event AS MATERIALIZED (SELECT *, nlo >= {LEAST} AS joins FROM n WHERE nlo + nhi >= {LEAST} AND (nlo >= {LEAST}) = (nhi >= {LEAST})),
final AS MATERIALIZED (SELECT generate_subscripts(comp, 1) AS x, unnest(comp) AS l FROM r WHERE k = (SELECT max(k) FROM r)),
open_ AS (SELECT k, l, max(e) AS e FROM (
    SELECT m.k, m.comp[event.lo] AS l, event.k AS e FROM m JOIN event ON event.k < m.k
    UNION ALL SELECT m.k, m.comp[x], -x FROM m, node WHERE copies >= {LEAST}) GROUP BY ALL),
ended AS (SELECT e, any_value(dens) AS birth, any_value(CASE WHEN o.l = lo THEN nlo ELSE nhi END) AS size, any_value(event.k) AS parent FROM event JOIN open_ o ON o.k = event.k AND o.l IN (lo, hi) WHERE joins GROUP BY e),
total AS (SELECT l, sum(copies) AS size, max(x) AS last FROM final JOIN node USING (x) GROUP BY l),
small AS (SELECT t.l, t.size, coalesce((SELECT max_by(dens, k) FROM n WHERE n.lo = t.l), {TOP}) AS dens, 1e9::BIGINT + t.l AS e FROM total t WHERE t.size BETWEEN 2 AND {LEAST} - 1),
home AS MATERIALIZED (
  SELECT x, -x AS e, {TOP} AS leaves FROM node WHERE copies >= {LEAST}
  UNION ALL
  SELECT x, e, leaves FROM (
    SELECT member.x, CASE WHEN (nlo >= {LEAST}) = (nhi >= {LEAST}) THEN n.k ELSE o.e END AS e, n.dens AS leaves, row_number() OVER (PARTITION BY member.x ORDER BY n.k) AS first
    FROM member JOIN n USING (k) LEFT JOIN open_ o ON o.k = n.k AND o.l = CASE WHEN nlo >= {LEAST} THEN n.lo ELSE n.hi END
    WHERE CASE WHEN member.l = n.lo THEN nlo ELSE nhi END < {LEAST} AND nlo + nhi >= {LEAST}) WHERE first = 1
  UNION ALL
  SELECT x, e, dens FROM small JOIN final USING (l)),
known AS (SELECT k AS e FROM event UNION SELECT -x FROM node WHERE copies >= {LEAST} UNION SELECT e FROM small),
joined AS (SELECT e, sum(copies * leaves) AS s FROM home JOIN node USING (x) GROUP BY e),
cluster AS MATERIALIZED (
  SELECT known.e, parent, coalesce(s, 0) + coalesce((SELECT (nlo + nhi) * dens FROM event WHERE event.k = known.e AND joins), 0)
      - coalesce(ended.size, t.size) * coalesce(birth, 1 / (1 - 0.7)) AS own, row_number() OVER (ORDER BY CASE WHEN known.e < 0 THEN 0 ELSE known.e END, known.e) AS i
  FROM known LEFT JOIN ended USING (e) LEFT JOIN joined USING (e)
  LEFT JOIN event v ON v.k = known.e LEFT JOIN small ON small.e = known.e
  LEFT JOIN final f ON f.x = CASE WHEN known.e < 0 THEN -known.e ELSE coalesce(v.lo, small.l) END LEFT JOIN total t ON t.l = f.l),
within AS (SELECT p.i, list(q.i) AS inner_ FROM cluster p JOIN cluster q ON q.parent = p.e GROUP BY p.i),
tree AS MATERIALIZED (SELECT i, own, inner_ FROM cluster LEFT JOIN within USING (i)),
worth(i, vals, chosen) AS (
  SELECT 0::BIGINT, []::DOUBLE[], []::BOOLEAN[]
  UNION ALL
  SELECT tree.i, list_append(vals, CASE WHEN inner_ IS NULL THEN own ELSE greatest(own, list_sum([vals[j] FOR j IN inner_])) END), list_append(chosen, inner_ IS NULL OR own >= list_sum([vals[j] FOR j IN inner_]))
  FROM worth JOIN tree ON tree.i = worth.i + 1),
picked AS (SELECT unnest(chosen) AS chosen, generate_subscripts(chosen, 1) AS i FROM worth WHERE i = (SELECT max(i) FROM worth)),
above(e, a, i) AS (SELECT e, e, i FROM cluster UNION ALL SELECT above.e, p.e, p.i FROM above JOIN cluster q ON q.e = above.a JOIN cluster p ON p.e = q.parent),
label AS (SELECT above.e, max(above.i) FILTER (chosen) AS i FROM above JOIN picked USING (i) GROUP BY above.e),
placed AS (SELECT unnest(cids) AS id, rep, label.i, coalesce(leaves, 0.0) AS persistence FROM node LEFT JOIN home USING (x) LEFT JOIN label USING (e)),
named AS (SELECT id, CASE WHEN i IS NOT NULL THEN min(rep) OVER (PARTITION BY i) END AS lead, persistence FROM placed)
"""

MEMBERS = f"WITH RECURSIVE {_VECTORS} {_HIERARCHY} SELECT lead::BIGINT AS lead, id::BIGINT AS id, round(persistence, 6) AS persistence FROM named"
CLUSTERS = f"""WITH RECURSIVE {_VECTORS} {_HIERARCHY},
counts AS (SELECT cid AS id, max(doc_count) AS n FROM output_tbl GROUP BY cid),
best AS (SELECT lead, string_agg(id, ' ' ORDER BY k) AS exemplars FROM (SELECT lead, id, row_number() OVER (PARTITION BY lead ORDER BY round(persistence, 9) DESC, id) AS k FROM named WHERE lead IS NOT NULL) WHERE k <= 3 GROUP BY lead)
SELECT lead::BIGINT AS lead, count(*) AS members, sum(coalesce(n, 0))::BIGINT AS doc_count, any_value(exemplars) AS exemplars FROM named JOIN best USING (lead) LEFT JOIN counts USING (id) GROUP BY lead"""
