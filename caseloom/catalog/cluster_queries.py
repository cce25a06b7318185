"""Cluster facts from vectors, and clustering itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.catalog.vector_queries import _SCORES, _top
from caseloom.operators import clusters as C, density as D, feedback as H, hierarchy as T

_MEANS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT vec_id, label, unnest(e) AS val, generate_subscripts(e, 1) AS dim FROM v),
m AS (SELECT label, dim, avg(val) AS mean FROM x GROUP BY 1, 2)"""


@named("centroid", "WITH " + _MEANS + """
SELECT CAST(label AS BIGINT) AS cluster_id, CAST(dim - 1 AS INTEGER) AS dim, round(mean, 6) AS mean FROM m""")
def centroid(spark, folder):
    found = C.centroids(V.member_vectors(spark, folder))
    return found.select("cluster_id", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@named("representatives", "WITH " + _MEANS + """,
d AS (SELECT label, vec_id, sqrt(sum((val - mean) ** 2)) AS distance FROM x JOIN m USING (label, dim) GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS cluster_id, vec_id AS ticket_id, round(distance, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS INTEGER) AS rank
FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) <= 3""")
def representatives(spark, folder):
    return C.representatives(V.member_vectors(spark, folder)).withColumn("distance", F.round("distance", 6))


@named("cluster_sizes", "SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, folder):
    return C.cluster_sizes(V.member_vectors(spark, folder))


def _with_noise(spark, folder):
    """Label 0 plays the noise."""
    return V.member_vectors(spark, folder).withColumn("cluster_id", F.col("cluster_id") - 1)


@named("cluster_counts", """
SELECT count(DISTINCT label) FILTER (label > 0) AS n_clusters, count(*) FILTER (label = 0) AS n_noise FROM embeddings""")
def cluster_counts(spark, folder):
    return C.cluster_counts(_with_noise(spark, folder))


@named("cluster_labels", "SELECT DISTINCT CAST(label - 1 AS BIGINT) AS cluster_id FROM embeddings WHERE label > 0")
def cluster_labels(spark, folder):
    return C.cluster_labels(_with_noise(spark, folder))


_REACH = "WITH RECURSIVE " + _SCORES + ", " + _top(15) + """,
g AS (SELECT query_id AS src, neighbour_id AS dst, rank, sqrt(greatest(0, 2 - 2 * score)) AS length FROM hits),
core AS (SELECT src AS node, length AS core FROM g WHERE rank = 3),
reach AS (SELECT g.src, g.dst, greatest(length, a.core, b.core) AS reach
          FROM g JOIN core a ON a.node = g.src JOIN core b ON b.node = g.dst)"""


@named("reach_edges", _REACH + " SELECT src, dst, round(reach, 6) AS reach FROM reach")
def reach_edges(spark, folder):
    return D.reach_edges(V.vectors(spark, folder)).withColumn("reach", F.round("reach", 6))


@named("density_clusters", "WITH RECURSIVE " + _SCORES + """,
near AS (SELECT query_id AS src, neighbour_id AS dst FROM scores WHERE sqrt(greatest(0, 2 - 2 * score)) <= 1.09),
dense AS (SELECT src FROM near GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT src, dst FROM near SEMI JOIN dense USING (src) WHERE dst IN (SELECT src FROM dense)),
c(node, label) AS (SELECT id, id FROM v UNION SELECT e.dst, c.label FROM c JOIN e ON e.src = c.node AND c.label < e.dst),
l AS (SELECT node, min(label) AS component FROM c GROUP BY 1),
s AS (SELECT component, count(*) AS size FROM l GROUP BY 1 HAVING count(*) >= 5),
n AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS number FROM s)
SELECT node AS id, CAST(coalesce(number, -1) AS BIGINT) AS cluster_id FROM l LEFT JOIN n USING (component)""")
def density_clusters(spark, folder):
    return D.density_clusters(V.vectors(spark, folder), eps=1.09)


@named("density_clusters_auto")
def density_clusters_auto(spark, folder):
    """The cut is chosen from the data; checked on planted clusters in the tests."""
    return D.density_clusters(V.vectors(spark, folder), eps="auto")


@named("centre_clusters")
def centre_clusters(spark, folder):
    return D.centre_clusters(V.vectors(spark, folder), k=10)


@named("reduced_dimensions")
def reduced_dimensions(spark, folder):
    reduced = D.reduce_dimensions(V.vectors(spark, folder))
    return reduced.select("id", F.posexplode("vec").alias("dim", "value"))


# Kruskal by steps over all pairs: every step joins the two groups of the least edge between different groups.
_HIERARCHY = "WITH RECURSIVE " + _SCORES + """,
pair AS MATERIALIZED (SELECT query_id AS lo, neighbour_id AS hi, sqrt(greatest(0, 2 - 2 * score)) AS length FROM scores),
core AS (SELECT lo AS node, length AS core FROM pair QUALIFY row_number() OVER (PARTITION BY lo ORDER BY length, hi) = 3),
edge AS MATERIALIZED (SELECT lo, hi, greatest(length, a.core, b.core) AS reach FROM pair JOIN core a ON a.node = lo JOIN core b ON b.node = hi WHERE lo < hi),
steps(k, node, grp, a, b, reach) AS (
  SELECT 0::BIGINT, id, id, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM v
  UNION ALL
  SELECT s.k + 1, s.node, CASE WHEN s.grp = m.b THEN m.a ELSE s.grp END, m.a, m.b, m.reach
  FROM steps s, (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, edge.reach FROM edge JOIN steps x ON x.node = lo JOIN steps y ON y.node = hi
                 WHERE x.grp <> y.grp ORDER BY edge.reach, lo, hi LIMIT 1) m),
merge AS MATERIALIZED (
  SELECT s.k, any_value(s.a) AS a, any_value(s.b) AS b, any_value(s.reach) AS reach, count(*) FILTER (s.grp = s.a) AS size,
         count(*) FILTER (p.grp = s.b) AS b_size FROM steps s JOIN steps p ON p.node = s.node AND p.k = s.k - 1 WHERE s.k > 0 GROUP BY 1),
tree AS MATERIALIZED (
  SELECT m.*, least(b_size, size - b_size) AS small, greatest(b_size, size - b_size) AS large, 1 / greatest(reach, 1e-5) AS density,
         (SELECT min(n.k) FROM merge n WHERE n.k > m.k AND m.a IN (n.a, n.b)) AS parent FROM merge m),
big AS MATERIALIZED (
  SELECT t.k, t.parent, t.size, t.density, t.small >= 5 AS split, CASE WHEN t.small >= 5 OR t.large < 5 THEN t.size ELSE t.small END AS fallen,
         u.density AS birth, t.parent IS NULL OR u.small >= 5 AS top FROM tree t LEFT JOIN tree u ON u.k = t.parent WHERE t.size >= 5),
chain(k, c) AS (SELECT k, k FROM big WHERE top UNION ALL SELECT big.k, chain.c FROM big JOIN chain ON big.parent = chain.k WHERE NOT top),
cluster AS MATERIALIZED (
  SELECT x.c, any_value(y.c) AS up, sum(big.fallen * big.density) - any_value(h.size * coalesce(h.birth, 0)) AS stability
  FROM chain x JOIN big ON big.k = x.k JOIN big h ON h.k = x.c LEFT JOIN chain y ON y.k = h.parent GROUP BY 1),
deep(c, d) AS (SELECT c, 0 FROM cluster WHERE up IS NULL UNION ALL SELECT cluster.c, d + 1 FROM cluster JOIN deep ON deep.c = cluster.up),
won(d, c, up, mass, wins) AS (
  SELECT d, c, up, stability, true FROM cluster JOIN deep USING (c) WHERE d = (SELECT max(d) FROM deep)
  UNION ALL
  SELECT x.d, x.c, x.up, greatest(x.stability, coalesce(below, 0)), x.stability >= coalesce(below, 0)
  FROM (SELECT * FROM cluster JOIN deep USING (c)) x
  LEFT JOIN (SELECT up AS c, sum(mass) AS below FROM won GROUP BY 1) w ON w.c = x.c
  WHERE x.d = (SELECT max(d) - 1 FROM won)),
best(c, chosen) AS (
  SELECT c, NULL::BIGINT FROM won WHERE up IS NULL
  UNION ALL SELECT won.c, coalesce(best.chosen, CASE WHEN won.wins THEN won.c END) FROM won JOIN best ON best.c = won.up),
entry AS (SELECT s.node, min(t.k) AS k FROM steps s JOIN tree t ON t.k = s.k AND t.size >= 5 AND s.grp = t.a GROUP BY 1),
placed AS (SELECT node, chosen FROM entry JOIN chain USING (k) JOIN best USING (c)),
names AS (SELECT chosen, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS number FROM placed WHERE chosen IS NOT NULL GROUP BY 1)
"""


@named("hierarchical_clusters", _HIERARCHY + "SELECT node AS id, CAST(coalesce(number, -1) AS BIGINT) AS cluster_id FROM placed LEFT JOIN names USING (chosen)")
def hierarchical_clusters(spark, folder):
    """Clusters of any density: excess of mass over the condensed tree."""
    return T.hierarchical_clusters(V.vectors(spark, folder))


_EDITS = """edits AS (
  SELECT event_id AS edited_at, CASE user_id % 4 WHEN 0 THEN 'move' WHEN 1 THEN 'split' ELSE 'duplicate' END AS action,
         user_id AS ticket_id, event_id % 10 AS cluster_id, event_id % 97 AS target_id FROM events WHERE event_type <> 'error'),
merges AS (SELECT DISTINCT user_id % 10 AS a, (user_id * 3) % 10 AS b FROM events
           WHERE event_type = 'error')"""


@named("feedback", "WITH RECURSIVE " + _EDITS + """,
base AS (SELECT vec_id AS ticket_id, CAST(label AS BIGINT) AS cluster_id FROM embeddings),
newest AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY edited_at DESC) = 1),
moved AS (SELECT b.ticket_id, CASE WHEN n.action = 'duplicate' THEN t.cluster_id ELSE n.cluster_id END AS new_cluster,
                 b.cluster_id AS old_cluster
          FROM base b LEFT JOIN newest n USING (ticket_id) LEFT JOIN base t ON t.ticket_id = n.target_id),
placed AS (SELECT ticket_id, coalesce(new_cluster, old_cluster) AS cluster_id, new_cluster IS NOT NULL AS human FROM moved),
e AS (SELECT a, b FROM merges UNION SELECT b, a FROM merges),
r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(label) AS merged FROM r GROUP BY 1)
SELECT ticket_id, coalesce(merged, cluster_id) AS cluster_id,
       CASE WHEN human OR merged <> cluster_id THEN 'human' ELSE 'auto' END AS assigned_by
FROM placed LEFT JOIN m ON node = cluster_id""")
def feedback(spark, folder):
    """Events read as an edit log over the labelled vectors."""
    e = V.table(spark, folder, "events")
    user, merge = F.col("user_id"), F.col("event_type") == "error"
    kind = F.when(user % 4 == 0, F.lit("move")).when(user % 4 == 1, F.lit("split")).otherwise(F.lit("duplicate"))
    edits = e.select(
        F.col("event_id").alias("edited_at"), F.when(merge, F.lit("merge")).otherwise(kind).alias("action"),
        F.when(~merge, user).alias("ticket_id"),
        F.when(merge, user % 10).otherwise(F.col("event_id") % 10).alias("cluster_id"),
        F.when(merge, (user * 3) % 10).otherwise(F.col("event_id") % 97).alias("target_id"))
    return H.apply_feedback(V.member_vectors(spark, folder).select("ticket_id", "cluster_id"), edits)
