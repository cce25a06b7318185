"""Quality measures of clusters and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.operators.clusters import NOISE

HIT_NEIGHBOURS = 20


def coverage(assignments: DataFrame) -> DataFrame:
    """Share of tickets in a cluster; the rest needs triage."""
    inside = F.col("cluster_id").isNotNull() & (F.col("cluster_id") != NOISE)
    return assignments.agg(
        F.count(F.lit(1)).alias("n_tickets"), F.count_if(inside).alias("n_assigned"),
        F.count_if(~inside).alias("needs_triage"),
        F.avg(inside.cast("double")).alias("coverage"))


def purity(labelled: DataFrame) -> DataFrame:
    """Share of tickets carrying the main true label of their cluster; (cluster_id, truth) in."""
    confusion = labelled.where(F.col("cluster_id") != NOISE).groupBy("cluster_id", "truth").agg(
        F.count(F.lit(1)).alias("n"))
    main = confusion.groupBy("cluster_id").agg(F.max("n").alias("main"), F.sum("n").alias("size"))
    return main.agg(F.sum("main").alias("n_main"), F.sum("size").alias("n_tickets"),
                    F.try_divide(F.sum("main"), F.sum("size")).alias("purity"))


def duplicate_hit_rate(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of queries with a neighbour of the same root cause among the first twenty.

    ``truth``: (id, cause).
    """
    near = hits.where(F.col("rank") <= HIT_NEIGHBOURS)
    mine = truth.select(F.col("id").alias("query_id"), F.col("cause").alias("query_cause"))
    other = truth.select(F.col("id").alias("neighbour_id"), F.col("cause").alias("neighbour_cause"))
    same = near.join(mine, "query_id").join(other, "neighbour_id").groupBy("query_id").agg(
        F.bool_or(F.col("query_cause") == F.col("neighbour_cause")).alias("hit"))
    return same.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("hit").alias("n_hits"),
                    F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def reduction_backlog(clusters: DataFrame, top: int = 20) -> DataFrame:
    """Clusters by expected return: size times how likely an answer deflects.

    Cut to the report length first, so the ranking window sees ``top`` rows.
    """
    deflects = F.when(F.coalesce("recommended_response", F.lit("")) != "", F.coalesce("confidence", F.lit(0.0))).otherwise(
        F.lit(0.0))
    scored = clusters.select("cluster_id", "size", (F.col("size") * deflects).alias("expected_return"))
    first = scored.orderBy(F.desc("expected_return"), "cluster_id").limit(top)
    return first.withColumn("place", F.rank().over(W.orderBy(F.desc("expected_return"))))
