"""Operational metrics (weekly volume, resolution, growth, deflection, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.operators import clusters as C, kpis as K, quality as Q

EVENTS_AS_OF = "2024-01-31"


def _weekly_sql(shift: int) -> str:
    """Weekly counts with change; the first bucket starts ``shift`` weeks before the reference date."""
    return f"""
WITH counted AS (
  SELECT CAST(ceil((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 604800000000.0) AS INTEGER) - {shift} AS k,
         count(*) AS n FROM events GROUP BY 1),
weeks AS (
  SELECT CAST(w AS INTEGER) AS week_offset,
         strftime(TIMESTAMP '{EVENTS_AS_OF}' - to_days(CAST(7 * (w + {shift}) AS INTEGER)), '%Y-%m-%d') AS week_start,
         coalesce(n, 0) AS ticket_count
  FROM range(8) r(w) LEFT JOIN counted ON k = w)
SELECT week_offset, week_start, ticket_count,
       CASE WHEN lead(ticket_count) OVER (ORDER BY week_offset) > 0
            THEN round((ticket_count - lead(ticket_count) OVER (ORDER BY week_offset))
                 / lead(ticket_count) OVER (ORDER BY week_offset) * 100, 6) END AS change_pct
FROM weeks"""


def _weekly(spark, folder, anchor):
    volume = K.weekly_volume(V.event_tickets(spark, folder), EVENTS_AS_OF, anchor=anchor)
    return K.week_over_week(volume).withColumn("change_pct", F.round("change_pct", 6))


@named("weekly_trend", _weekly_sql(1))
def weekly_trend(spark, folder):
    return _weekly(spark, folder, "trailing")


@named("weekly_trend_literal", _weekly_sql(0))
def weekly_trend_literal(spark, folder):
    return _weekly(spark, folder, "literal")


@named("resolution_stats", "WITH " + V.SOLVED_SQL + """, h AS (
  SELECT date_sub('hour', created_at, solved_at) AS hours FROM solved WHERE status IN ('solved', 'closed')),
f AS (SELECT hours FROM h WHERE hours > 0 AND hours < 720),
l AS (SELECT list(hours ORDER BY hours) AS a, count(*) AS n, avg(hours) AS m FROM f)
SELECT n AS resolved, round(m, 6) AS avg_hours, a[CAST(floor(n * 0.5) AS BIGINT) + 1] AS median_hours,
       a[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90_hours FROM l""")
def resolution_stats(spark, folder):
    return K.resolution_stats(V.solved_tickets(spark, folder)).withColumn("avg_hours", F.round("avg_hours", 6))


@named("resolution_trend", "WITH " + V.SOLVED_SQL + """, h AS (
  SELECT date_sub('hour', created_at, solved_at) AS hours, solved_at FROM solved WHERE status IN ('solved', 'closed')),
f AS (SELECT * FROM h WHERE hours > 0 AND hours < 720),
a AS (SELECT avg(hours) FILTER (solved_at < TIMESTAMP '2001-07-01'
                                AND solved_at >= TIMESTAMP '2001-07-01' - INTERVAL 365 DAY) AS now_avg,
             avg(hours) FILTER (solved_at < TIMESTAMP '2001-07-01' - INTERVAL 365 DAY
                                AND solved_at >= TIMESTAMP '2001-07-01' - INTERVAL 730 DAY) AS old_avg FROM f)
SELECT round(now_avg, 6) AS avg_hours, round(old_avg, 6) AS previous_avg_hours,
       round((now_avg - old_avg) / old_avg * 100, 6) AS trend_pct FROM a""")
def resolution_trend(spark, folder):
    trend = K.resolution_trend(V.solved_tickets(spark, folder), V.AS_OF, days=365)
    return trend.select(*[F.round(c, 6).alias(c) for c in trend.columns])


_GROWTH = V.CLUSTERS_SQL + f""", growth AS (
  SELECT cluster_id, label, size AS current_size, previous_size,
         CASE WHEN previous_size > 0 THEN (size - previous_size) / previous_size * 100 ELSE 0.0 END AS growth_rate,
         coalesce(floor((epoch_us(TIMESTAMP '{V.AS_OF}') - epoch_us(created_at)) / 86400000000.0) <= 7, false) AS is_new
  FROM clusters)"""


@named("cluster_growth", "WITH " + _GROWTH + """
SELECT cluster_id, label, current_size, previous_size, round(growth_rate, 1) AS growth_rate, is_new
FROM growth WHERE abs(growth_rate) > 5 OR is_new ORDER BY round(growth_rate, 1) DESC, cluster_id LIMIT 10""")
def cluster_growth(spark, folder):
    return K.cluster_growth(V.customer_clusters(spark, folder), V.AS_OF)


@named("growth_rates", "WITH " + _GROWTH + """
SELECT cluster_id, current_size, previous_size, round(growth_rate, 6) AS growth_rate, is_new FROM growth""")
def growth_rates(spark, folder):
    rows = K.growth_rows(V.customer_clusters(spark, folder), V.AS_OF)
    return rows.drop("label").withColumn("growth_rate", F.round("growth_rate", 6))


@named("new_clusters", "WITH " + _GROWTH + " SELECT count(*) FILTER (is_new) AS new_clusters FROM growth")
def new_clusters(spark, folder):
    return K.new_clusters(V.customer_clusters(spark, folder), V.AS_OF)


@named("deflection", "WITH " + V.CLUSTERS_SQL + """, d AS (
  SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM clusters
  WHERE confidence >= 0.7 AND recommended_response <> '')
SELECT total AS total_deflectable, round(total / (SELECT count(*) FROM tickets) * 100, 6) AS deflection_rate,
       round(total * 5 / 60, 6) AS estimated_hours_saved FROM d""")
def deflection(spark, folder):
    found = K.deflection(V.customer_clusters(spark, folder), V.order_tickets(spark, folder))
    return found.select("total_deflectable", F.round("deflection_rate", 6).alias("deflection_rate"),
                        F.round("estimated_hours_saved", 6).alias("estimated_hours_saved"))


@named("top_deflectable", "WITH " + V.CLUSTERS_SQL + """
SELECT cluster_id, label, size, confidence FROM clusters WHERE confidence >= 0.7 AND recommended_response <> ''
ORDER BY size DESC, cluster_id LIMIT 5""")
def top_deflectable(spark, folder):
    return K.top_deflectable(V.customer_clusters(spark, folder))


@named("basic_stats", "WITH " + V.CLUSTERS_SQL + """
SELECT count(*) AS total_clusters, (SELECT count(*) FROM tickets) AS total_tickets,
       round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (trend_direction = 'up') AS trending_up FROM clusters""")
def basic_stats(spark, folder):
    stats = K.basic_stats(V.customer_clusters(spark, folder), V.order_tickets(spark, folder))
    return stats.withColumn("avg_confidence", F.round("avg_confidence", 6))


@named("top_clusters", "WITH " + V.CLUSTERS_SQL + """
SELECT cluster_id, label, size FROM clusters ORDER BY size DESC, cluster_id LIMIT 5""")
def top_clusters(spark, folder):
    return K.top_clusters(V.customer_clusters(spark, folder))


_CLUSTER_VIEW = """cluster_id, label, size, 'medium' AS priority, confidence,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"""


def _shown(frame):
    return frame.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@named("list_clusters", "WITH " + V.CLUSTERS_SQL + f"""
SELECT {_CLUSTER_VIEW} FROM clusters ORDER BY clusters.created_at DESC NULLS LAST, cluster_id LIMIT 50 OFFSET 20""")
def list_clusters(spark, folder):
    return _shown(K.list_clusters(V.customer_clusters(spark, folder), sort_by="created_at", offset=20))


@named("list_clusters_by_confidence", "WITH " + V.CLUSTERS_SQL + f"""
SELECT {_CLUSTER_VIEW} FROM clusters ORDER BY confidence ASC NULLS FIRST, cluster_id LIMIT 200""")
def list_clusters_by_confidence(spark, folder):
    return _shown(K.list_clusters(V.customer_clusters(spark, folder), sort_by="confidence", sort_order="asc", limit=200))


@named("cluster_detail", "WITH " + V.CLUSTERS_SQL + f" SELECT {_CLUSTER_VIEW} FROM clusters WHERE cluster_id = 7")
def cluster_detail(spark, folder):
    return _shown(K.cluster_detail(V.customer_clusters(spark, folder), 7))


@named("list_tickets", "WITH " + V.TICKETS_SQL + """
SELECT ticket_id, subject, status, cluster_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM tickets
WHERE status = 'solved' ORDER BY tickets.created_at DESC, ticket_id LIMIT 50 OFFSET 10""")
def list_tickets(spark, folder):
    return _shown(K.list_tickets(V.order_tickets(spark, folder), status="solved", offset=10))


@named("ticket_filter", "WITH " + V.TICKETS_SQL + """
SELECT ticket_id, subject, priority FROM tickets WHERE cluster_id = 7 AND status = 'closed'""")
def ticket_filter(spark, folder):
    kept = K.ticket_filter(V.order_tickets(spark, folder), cluster_id=7, status="closed")
    return kept.select("ticket_id", "subject", "priority")


@named("ticket_detail", "WITH " + V.TICKETS_SQL + """
SELECT ticket_id, subject, status, priority, cluster_id FROM tickets WHERE ticket_id = 42""")
def ticket_detail(spark, folder):
    return K.ticket_detail(V.order_tickets(spark, folder), 42).select(
        "ticket_id", "subject", "status", "priority", "cluster_id")


@named("work_slice", "WITH " + V.TICKETS_SQL + """
SELECT ticket_id, status FROM tickets ORDER BY ticket_id LIMIT 100 OFFSET 250""")
def work_slice(spark, folder):
    return K.work_slice(V.order_tickets(spark, folder), 250, 100).select("ticket_id", "status")


@named("severity_distribution", "WITH " + V.TICKETS_SQL + """, n AS (
  SELECT cluster_id, priority, count(*) AS n FROM tickets WHERE priority IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, string_agg(priority || '=' || n, ',' ORDER BY priority) AS severity FROM n GROUP BY 1""")
def severity_distribution(spark, folder):
    found = C.severity_distribution(V.order_tickets(spark, folder))
    parts = F.transform(F.array_sort(F.map_entries("severity_distribution")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("cluster_id", F.array_join(parts, ",").alias("severity"))


@named("cluster_priority", "WITH " + V.TICKETS_SQL + """, n AS (
  SELECT cluster_id, priority, count(*) AS n FROM tickets WHERE priority IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, priority, n FROM n
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, priority) = 1""")
def cluster_priority(spark, folder):
    return C.cluster_priority(V.order_tickets(spark, folder))


_BUCKET = (f"CAST(ceil((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 604800000000.0) AS INTEGER) - 1")


@named("trend_per_cluster", f"""
SELECT event_type AS cluster_id, CAST(w AS INTEGER) AS week_offset, count(*) FILTER ({_BUCKET} = w) AS n
FROM events, range(8) r(w) GROUP BY 1, 2""")
def trend_per_cluster(spark, folder):
    return C.cluster_weeks(V.event_tickets(spark, folder), EVENTS_AS_OF)


@named("trend_data", f"""
WITH c AS (SELECT event_type, w, count(*) FILTER ({_BUCKET} = w) AS n FROM events, range(8) r(w) GROUP BY 1, 2)
SELECT event_type AS cluster_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY w DESC) AS trend FROM c GROUP BY 1""")
def trend_data(spark, folder):
    found = C.trend_data(C.cluster_weeks(V.event_tickets(spark, folder), EVENTS_AS_OF))
    return found.select("cluster_id", F.array_join(F.col("trend").cast("array<string>"), ",").alias("trend"))


@named("trend_direction", f"""
WITH c AS (SELECT event_type AS cluster_id, count(*) AS size, count(*) FILTER ({_BUCKET} > 0) AS previous_size,
                  count(*) FILTER ({_BUCKET} = 0) AS last_week, count(*) FILTER ({_BUCKET} = 1) AS week_before
           FROM events WHERE ts < TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1)
SELECT *, CASE WHEN last_week > week_before THEN 'up' WHEN last_week < week_before THEN 'down' ELSE 'flat' END
  AS trend_direction FROM c""")
def trend_direction(spark, folder):
    return C.trend_direction(V.event_tickets(spark, folder), EVENTS_AS_OF)


@named("coverage", """
SELECT count(*) AS n_tickets, count(*) FILTER (o_orderstatus <> 'O') AS n_assigned,
       count(*) FILTER (o_orderstatus = 'O') AS needs_triage,
       round(avg(CASE WHEN o_orderstatus <> 'O' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM orders""")
def coverage(spark, folder):
    """Open tickets count as not yet assigned."""
    t = V.order_tickets(spark, folder)
    placed = t.select("ticket_id", F.when(F.col("status") == "open", F.lit(C.NOISE)).otherwise(F.col("cluster_id"))
                      .alias("cluster_id"))
    return Q.coverage(placed).withColumn("coverage", F.round("coverage", 6))


@named("purity", "WITH " + V.TICKETS_SQL + """, n AS (
  SELECT cluster_id, coalesce(priority, 'none') AS truth, count(*) AS n FROM tickets GROUP BY 1, 2),
m AS (SELECT max(n) AS main, sum(n) AS size FROM n GROUP BY cluster_id)
SELECT CAST(sum(main) AS BIGINT) AS n_main, CAST(sum(size) AS BIGINT) AS n_tickets,
       round(sum(main) / sum(size), 6) AS purity FROM m""")
def purity(spark, folder):
    labelled = V.order_tickets(spark, folder).select("cluster_id", F.coalesce("priority", F.lit("none")).alias("truth"))
    return Q.purity(labelled).withColumn("purity", F.round("purity", 6))


@named("reduction_backlog", "WITH " + V.CLUSTERS_SQL + """, s AS (
  SELECT cluster_id, size, size * (CASE WHEN recommended_response <> '' THEN confidence ELSE 0.0 END) AS r FROM clusters),
t AS (SELECT * FROM s ORDER BY r DESC, cluster_id LIMIT 20)
SELECT cluster_id, size, round(r, 6) AS expected_return, CAST(rank() OVER (ORDER BY r DESC) AS INTEGER) AS place FROM t""")
def reduction_backlog(spark, folder):
    found = Q.reduction_backlog(V.customer_clusters(spark, folder))
    return found.withColumn("expected_return", F.round("expected_return", 6))
