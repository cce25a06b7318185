"""The given tables seen as ticket tables, once as frames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.session import spread

AS_OF = "2001-07-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on."""
    return spread(table(spark, folder, name))


def order_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tickets of the cluster (customer) they belong to."""
    o = table(spark, folder, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("solved"))
              .when(F.col("o_orderstatus") == "P", F.lit("closed")).otherwise(F.lit("open")))
    code = F.substring("o_orderpriority", 1, 1)
    priority = (F.when(code == "1", F.lit("urgent")).when(code == "2", F.lit("high"))
                .when(code == "3", F.lit("normal")).when(code == "5", F.lit("low")))
    return o.select(F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("cluster_id"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at"), status.alias("status"),
                    priority.alias("priority"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("subject"))


TICKETS_SQL = """tickets AS (
  SELECT o_orderkey AS ticket_id, o_custkey AS cluster_id, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'P' THEN 'closed' ELSE 'open' END AS status,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'normal'
              WHEN '5' THEN 'low' END AS priority,
         'Order ' || o_orderkey AS subject
  FROM orders)"""


def solved_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets with the last shipping date as time of solution."""
    shipped = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id")).agg(
        F.max("l_shipdate").cast("timestamp").alias("solved_at"))
    return order_tickets(spark, folder).join(shipped, "ticket_id", "left")


SOLVED_SQL = TICKETS_SQL + """, solved AS (
  SELECT t.*, s.solved_at FROM tickets t
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS solved_at FROM lineitem GROUP BY 1) s ON l_orderkey = ticket_id)"""


def customer_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as clusters, sized by their orders up to the reference date."""
    moment = F.lit(AS_OF).cast("timestamp")
    days = lambda n: moment - F.make_dt_interval(days=F.lit(n))
    when = F.col("created_at")
    sizes = order_tickets(spark, folder).where(when < moment).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(when < days(180)).alias("previous_size"),
        F.min("created_at").alias("created_at"), F.count_if(when >= days(30)).alias("recent"),
        F.count_if((when < days(30)) & (when >= days(60))).alias("before"))
    c = table(spark, folder, "customer")
    joined = c.join(sizes, F.col("c_custkey") == F.col("cluster_id"), "left")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))
    response = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).otherwise(
        F.concat(F.lit("See the guide for "), F.lower("c_mktsegment")))
    return joined.select(
        F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("label"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("previous_size", F.lit(0)).alias("previous_size"),
        "created_at", confidence.alias("confidence"), response.alias("recommended_response"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("issue_description"),
        F.when(F.col("recent") > F.col("before"), F.lit("up")).otherwise(F.lit("flat")).alias("trend_direction"),
        F.lit(None).cast("string").alias("priority"))


CLUSTERS_SQL = TICKETS_SQL + f""", sizes AS (
  SELECT cluster_id AS k, count(*) AS size, min(created_at) AS created_at,
         count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY) AS previous_size,
         count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent,
         count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
                          AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) AS before
  FROM tickets WHERE created_at < TIMESTAMP '{AS_OF}' GROUP BY 1),
clusters AS (
  SELECT c_custkey AS cluster_id, c_name AS label, coalesce(size, 0) AS size,
         coalesce(previous_size, 0) AS previous_size, created_at,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000)) AS confidence,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'See the guide for ' || lower(c_mktsegment) END
           AS recommended_response,
         CASE WHEN recent > before THEN 'up' ELSE 'flat' END AS trend_direction
  FROM customer LEFT JOIN sizes ON k = c_custkey)"""


def event_tickets(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("ticket_id"), F.col("ts").cast("timestamp").alias("created_at"),
                    F.col("event_type").alias("cluster_id"))


def member_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with their label as cluster."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("ticket_id"), F.col("label").cast("bigint").alias("cluster_id"),
                    F.col("embedding").alias("vector"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
