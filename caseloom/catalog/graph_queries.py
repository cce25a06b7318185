"""Knowledge graph of the derived tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.catalog.intake_queries import RAW_SQL, normalized
from caseloom.catalog.vector_queries import _SCORES
from caseloom.operators import graph as G, modularity as M, normalize as N
from caseloom.operators.neighbours import duplicate_edges
from caseloom.session import cut_lineage

ENTITIES_SQL = RAW_SQL + """, found AS (
  SELECT ticket_id, 'Environment' AS node_type, p AS name FROM (
    SELECT ticket_id, CASE WHEN o_custkey % 5 = 0 THEN 'windows' WHEN o_custkey % 7 = 2 THEN 'linux'
      WHEN o_custkey % 5 = 1 THEN 'macos' END AS p FROM raw WHERE dated) WHERE p IS NOT NULL
  UNION ALL SELECT ticket_id, 'Environment', 'version ' || (o_custkey % 7) || '.' || (o_orderkey % 10)
    FROM raw WHERE dated AND o_orderkey % 3 <> 0
  UNION ALL SELECT ticket_id, 'ErrorSignature', CASE o_custkey % 5 WHEN 0 THEN '500' ELSE '7001' END
    FROM raw WHERE dated AND o_custkey % 5 IN (0, 1)
  UNION ALL SELECT ticket_id, 'Component', CASE o_custkey % 5 WHEN 1 THEN 'client' ELSE 'cloud' END
    FROM raw WHERE dated AND o_custkey % 5 IN (1, 3)
  UNION ALL SELECT ticket_id, 'Component', 'storage' FROM raw WHERE dated AND o_custkey % 5 = 3),
placed AS (SELECT ticket_id, o_custkey % 20 AS cluster_id FROM raw WHERE dated),
node AS (SELECT *, node_type || ':' || substr(md5(name), 1, 16) AS node_id FROM found)"""


def _tickets(spark, folder):
    return N.accepted(normalized(spark, folder))


def _found(spark, folder):
    return G.entities(_tickets(spark, folder))


def _assignments(spark, folder):
    t = _tickets(spark, folder)
    return t.select("ticket_id", (F.col("assignee_id") % 20).alias("cluster_id"), F.lit(0.5).alias("confidence"))


@named("graph_nodes", "WITH " + ENTITIES_SQL + """
SELECT DISTINCT node_id, node_type, name FROM node
UNION ALL SELECT 'Ticket:' || ticket_id, 'Ticket', 'Order ' || ticket_id FROM raw WHERE dated""")
def graph_nodes(spark, folder):
    tickets = cut_lineage(_tickets(spark, folder).select(
        "ticket_id", "subject", "description", "status", "platform", "version"))
    return G.nodes(tickets, G.entities(tickets)).drop("properties")


@named("graph_mentions", "WITH " + ENTITIES_SQL + """
SELECT md5('mentions|Ticket:' || ticket_id || '|' || node_id) AS edge_id, 'mentions' AS edge_type,
       'Ticket:' || ticket_id AS src, node_id AS dst, CAST(1 AS DOUBLE) AS weight FROM node""")
def graph_mentions(spark, folder):
    return G.mentions(_found(spark, folder)).drop("properties")


@named("graph_belongs_to", "WITH " + ENTITIES_SQL + """
SELECT 'Ticket:' || ticket_id AS src, 'IssueCluster:' || cluster_id AS dst, '0.5' AS confidence FROM placed""")
def graph_belongs_to(spark, folder):
    return G.belongs_to(_assignments(spark, folder)).select("src", "dst", F.col("properties")["confidence"].alias("confidence"))


def _shares(kinds: str, share: float) -> str:
    return f"""WITH {ENTITIES_SQL},
n AS (SELECT cluster_id, node_id, count(*) AS n FROM node JOIN placed USING (ticket_id) WHERE node_type IN ({kinds}) GROUP BY 1, 2),
s AS (SELECT cluster_id, count(*) AS size FROM placed GROUP BY 1)
SELECT 'IssueCluster:' || cluster_id AS src, node_id AS dst, round(n / size, 6) AS weight
FROM n JOIN s USING (cluster_id) WHERE n / size >= {share}"""


@named("graph_caused_by", _shares("'Component', 'Feature'", 0.2))
def graph_caused_by(spark, folder):
    found = G.caused_by(_found(spark, folder), _assignments(spark, folder))
    return found.select("src", "dst", F.round("weight", 6).alias("weight"))


@named("graph_mitigated_by", f"""WITH {ENTITIES_SQL},
fix AS (SELECT ticket_id, CASE WHEN o_custkey % 5 = 1 THEN 'update client' ELSE 'restart' END AS name FROM raw WHERE dated
        AND o_orderstatus = 'F'),
n AS (SELECT cluster_id, name, count(*) AS n FROM fix JOIN placed USING (ticket_id) GROUP BY 1, 2),
s AS (SELECT cluster_id, count(*) AS size FROM placed GROUP BY 1)
SELECT 'IssueCluster:' || cluster_id AS src, 'Fix:' || substr(md5(name), 1, 16) AS dst, round(n / size, 6) AS weight
FROM n JOIN s USING (cluster_id) WHERE n / size >= 0.2""")
def graph_mitigated_by(spark, folder):
    """The fix of a solved ticket follows from its description."""
    t = _tickets(spark, folder)
    fix = F.when(F.col("assignee_id") % 5 == 1, F.lit("update client")).otherwise(F.lit("restart"))
    fixes = t.where(F.col("status") == "solved").select("ticket_id", F.lit("Fix").alias("node_type"), fix.alias("name"))
    found = G.mitigated_by(fixes, _assignments(spark, folder))
    return found.select("src", "dst", F.round("weight", 6).alias("weight"))


@named("graph_duplicate_of", "WITH " + _SCORES + """
SELECT 'Ticket:' || query_id AS src, 'Ticket:' || neighbour_id AS dst FROM scores
WHERE score >= 0.45 AND neighbour_id < query_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) = 1""")
def graph_duplicate_of(spark, folder):
    return G.duplicate_of(duplicate_edges(V.vectors(spark, folder), 0.45)).select("src", "dst")


@named("entity_weights", "WITH " + ENTITIES_SQL + " SELECT node_type, name, count(*) AS n_tickets FROM found GROUP BY 1, 2")
def entity_weights(spark, folder):
    return G.edge_weights(_found(spark, folder))


@named("shared_entities", "WITH " + ENTITIES_SQL + """,
n AS (SELECT *, count(*) OVER (PARTITION BY node_type, name) AS n_tickets FROM found)
SELECT ticket_id, count(*) AS n_entities, CAST(sum(n_tickets - 1) AS BIGINT) AS n_links, min(n_tickets) AS rarest
FROM n GROUP BY 1""")
def shared_entities(spark, folder):
    return G.shared_entities(cut_lineage(_found(spark, folder)))


def _communities_sql(rounds: int = 5) -> str:
    parts = ["WITH " + ENTITIES_SQL + """,
pairs AS (SELECT DISTINCT ticket_id AS t, node_type || ':' || name AS e FROM found),
sized AS (SELECT t, e, 1.0::DOUBLE / count(*) OVER (PARTITION BY e) AS share FROM pairs),
l0 AS (SELECT DISTINCT t, t AS label FROM pairs)"""]
    for r in range(1, rounds + 1):
        parts.append(f"""
m{r} AS MATERIALIZED (SELECT e, label FROM sized JOIN l{r - 1} USING (t) GROUP BY e, label
  QUALIFY row_number() OVER (PARTITION BY e ORDER BY count(*) DESC, label) = 1),
l{r} AS MATERIALIZED (SELECT t, label FROM sized JOIN m{r} USING (e) GROUP BY t, label
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(sum(share), 9) DESC, label) = 1)""")
    return ",".join(parts) + f" SELECT t AS ticket_id, label AS community FROM l{rounds}"


@named("communities", _communities_sql())
def communities(spark, folder):
    return G.communities(_found(spark, folder))


def _dense_sql(levels: int = M.LEVELS, rounds: int = M.ROUNDS) -> str:
    parts = ["WITH " + ENTITIES_SQL + f""",
pairs AS MATERIALIZED (SELECT t, e, greatest({M.UNIT} // count(*) OVER (PARTITION BY e), 1)::BIGINT AS w FROM (
  SELECT DISTINCT ticket_id::VARCHAR AS t, node_type || ':' || name AS e FROM found)),
n0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY side, name) - 1 AS node, side, name, degree, 0::BIGINT AS loop FROM (
  SELECT 'E' AS side, e AS name, sum(w)::BIGINT AS degree FROM pairs GROUP BY e
  UNION ALL SELECT 'T', t, sum(w)::BIGINT FROM pairs GROUP BY t)),
one AS (SELECT a.node AS src, b.node AS dst, w FROM pairs JOIN n0 a ON a.side = 'E' AND a.name = e JOIN n0 b ON b.side = 'T' AND b.name = t),
e0 AS MATERIALIZED (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one),
total AS MATERIALIZED (SELECT sum(degree)::BIGINT AS t FROM n0),
m0 AS (SELECT name AS ticket_id, node AS label FROM n0 WHERE side = 'T')"""]
    for v in range(levels):
        parts.append(f"l{v}_0 AS MATERIALIZED (SELECT node, side, degree, loop, node AS community FROM n{v})")
        for r in range(rounds + 1):
            if r:
                before = f"l{v}_{r - 1}"
                if v == 0:
                    move, take = f"l.side = '{'E' if r % 2 else 'T'}'", "true"
                else:
                    move, take = "true", f"o.target {'<' if r % 2 else '>='} l.community"
                parts.append(f"""
l{v}_{r} AS MATERIALIZED (
  WITH vol AS (SELECT community AS target, sum(degree)::BIGINT AS volume FROM {before} GROUP BY 1),
  o AS (SELECT node, target, sum(w)::BIGINT AS w FROM (
    SELECT src AS node, community AS target, w FROM e{v} JOIN {before} ON node = dst
    UNION ALL SELECT node, community, 0 FROM {before}) GROUP BY 1, 2),
  best AS (SELECT o.node, o.target FROM o JOIN {before} l ON l.node = o.node JOIN vol ON vol.target = o.target, total
    WHERE {move} AND (o.target = l.community OR {take})
    QUALIFY row_number() OVER (PARTITION BY o.node ORDER BY w::DOUBLE - l.degree::DOUBLE
      * (volume - CASE WHEN o.target = l.community THEN l.degree ELSE 0 END)::DOUBLE / t::DOUBLE DESC,
      o.target = l.community DESC, o.target) = 1)
  SELECT l.node, l.side, l.degree, l.loop, coalesce(best.target, l.community) AS community FROM {before} l LEFT JOIN best ON best.node = l.node)""")
            parts.append(f"""
q{v}_{r} AS MATERIALIZED (SELECT {r} AS r, (coalesce((SELECT sum(w)::HUGEINT FROM e{v} JOIN l{v}_{r} a ON a.node = src JOIN l{v}_{r} b ON b.node = dst
    WHERE a.community = b.community), 0) + (SELECT sum(loop)::HUGEINT FROM l{v}_{r})) * (SELECT t::HUGEINT FROM total)
  - (SELECT sum(volume * volume) FROM (SELECT sum(degree)::HUGEINT AS volume FROM l{v}_{r} GROUP BY community)) AS quality)""")
        every = " UNION ALL ".join(f"SELECT * FROM q{v}_{r}" for r in range(rounds + 1))
        chosen = " UNION ALL ".join(f"SELECT * FROM l{v}_{r} WHERE (SELECT r FROM pick{v}) = {r}" for r in range(rounds + 1))
        parts.append(f"""
pick{v} AS MATERIALIZED (SELECT r FROM ({every}) ORDER BY quality DESC, r LIMIT 1),
l{v} AS MATERIALIZED ({chosen}),
m{v + 1} AS MATERIALIZED (SELECT ticket_id, community AS label FROM m{v} JOIN l{v} ON node = label),
c{v} AS MATERIALIZED (SELECT a.community AS src, b.community AS dst, sum(w)::BIGINT AS w
  FROM e{v} JOIN l{v} a ON a.node = src JOIN l{v} b ON b.node = dst GROUP BY 1, 2),
n{v + 1} AS MATERIALIZED (SELECT community AS node, 'C' AS side, sum(degree)::BIGINT AS degree, (sum(loop) + coalesce(any_value(w), 0))::BIGINT AS loop
  FROM l{v} LEFT JOIN c{v} ON src = community AND dst = community GROUP BY community),
e{v + 1} AS MATERIALIZED (SELECT * FROM c{v} WHERE src <> dst)""")
    return ",".join(parts) + f" SELECT ticket_id, min(ticket_id) OVER (PARTITION BY label) AS community FROM m{levels}"


@named("dense_communities", _dense_sql())
def dense_communities(spark, folder):
    return M.dense_communities(_found(spark, folder))


@named("stabilized_clusters", "WITH " + ENTITIES_SQL + """,
noisy AS (SELECT p.ticket_id, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE cluster_id END AS cluster_id,
                 o_custkey % 5 AS community FROM placed p JOIN raw USING (ticket_id)),
n AS (SELECT community, cluster_id, count(*) AS n FROM noisy WHERE cluster_id >= 0 GROUP BY 1, 2),
top AS (SELECT community, cluster_id AS first_cluster FROM n
         QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, cluster_id) = 1)
SELECT ticket_id, CASE WHEN cluster_id < 0 THEN first_cluster ELSE cluster_id END AS cluster_id FROM noisy JOIN top USING (community)""")
def stabilized_clusters(spark, folder):
    """Open tickets are noise; the community is the description they share."""
    t = _tickets(spark, folder)
    noisy = t.select("ticket_id", F.when(F.col("status") == "open", F.lit(-1)).otherwise(F.col("assignee_id") % 20)
                     .cast("bigint").alias("cluster_id"))
    return G.stabilize(noisy, t.select("ticket_id", (F.col("assignee_id") % 5).alias("community")))


@named("tickets_for_node", "WITH " + ENTITIES_SQL + """
SELECT ticket_id, 'Order ' || ticket_id AS subject FROM found WHERE node_type = 'Component' AND name = 'cloud'""")
def tickets_for_node(spark, folder):
    picked = G.node_id(F.lit("Component"), F.lit("cloud"))
    tickets = cut_lineage(_tickets(spark, folder).select("ticket_id", "subject", "description", "platform", "version"))
    return G.tickets_for_node(tickets, G.mentions(G.entities(tickets)), picked).select("ticket_id", "subject")
