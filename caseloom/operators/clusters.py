"""Facts about clusters, derived from assignments, tickets, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.text import STOP_WORDS, keyword_tokens
from caseloom.operators.joins import salted_join
from caseloom.operators.kpis import WEEKS, week_bucket

NOISE = -1


def ranked(frame: DataFrame, group: str, order: list, limit: int, name: str = "rank") -> DataFrame:
    """The first rows of every group.

    Spark cuts each group to ``limit`` rows before the shuffle (WindowGroupLimit),
    so a group holding most rows reaches its task already cut down.
    """
    number = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return frame.withColumn(name, number).where(F.col(name) <= limit)


def keyword_counts(texts: DataFrame) -> DataFrame:
    """(cluster_id, word, n, first position) with the words counted before the shuffle."""
    tokens = texts.select("cluster_id", "ticket_id", F.posexplode(keyword_tokens(F.col("text"))).alias("pos", "word"))
    return tokens.where(~F.col("word").isin(STOP_WORDS)).groupBy("cluster_id", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ticket_id", "pos")).alias("first_seen"))


def keywords(texts: DataFrame, top: int = 10, tie: str = "first_seen") -> DataFrame:
    """Most frequent words per cluster; equal counts by first appearance or by word."""
    order = [F.desc("n"), F.asc("first_seen" if tie == "first_seen" else "word")]
    return ranked(keyword_counts(texts), "cluster_id", order, top).select("cluster_id", "rank", "word", "n")


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_counts(assignments: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows; counted over the per-cluster sizes."""
    sizes = cluster_sizes(assignments)
    return sizes.agg(F.count_if(F.col("cluster_id") != NOISE).alias("n_clusters"),
                     F.coalesce(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("size"))), F.lit(0)).alias("n_noise"))


def cluster_labels(assignments: DataFrame) -> DataFrame:
    return assignments.select("cluster_id").distinct().where(F.col("cluster_id") != NOISE)


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per cluster, in the original space."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = vectors.select("cluster_id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    mean = as_vector.groupBy("cluster_id").agg(Summarizer.mean(F.col("v")).alias("m"))
    return mean.select("cluster_id", vector_to_array("m").alias("centroid"))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")),
                          lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"]))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def representatives(vectors: DataFrame, top: int = 3) -> DataFrame:
    """The members nearest to their centroid, equal distances by the smaller ticket id."""
    distance = euclidean(F.col("vector").cast("array<double>"), F.col("centroid"))
    near = salted_join(vectors, centroids(vectors), "cluster_id", "ticket_id").select(
        "cluster_id", "ticket_id", distance.alias("distance"))
    return ranked(near, "cluster_id", [F.round("distance", 9), "ticket_id"], top).select(
        "cluster_id", "rank", "ticket_id", "distance")


def severity_counts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("cluster_id", "priority").agg(F.count(F.lit(1)).alias("n"))


def severity_distribution(tickets: DataFrame) -> DataFrame:
    """Map of ticket counts by priority; at most one entry per priority value."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n"))))
    known = severity_counts(tickets).where(F.col("priority").isNotNull())
    return known.groupBy("cluster_id").agg(entries.alias("severity_distribution"))


def cluster_priority(tickets: DataFrame) -> DataFrame:
    """Most frequent priority; equal counts go to the alphabetically first."""
    known = severity_counts(tickets).where(F.col("priority").isNotNull())
    return ranked(known, "cluster_id", [F.desc("n"), "priority"], 1).select("cluster_id", "priority", "n")


def cluster_weeks(tickets: DataFrame, as_of: str, weeks: int = WEEKS) -> DataFrame:
    """Weekly counts per cluster with empty weeks as zero; needs no spine join.

    All weeks of a cluster are counted side by side in one aggregate and then
    turned into rows.
    """
    bucket = week_bucket(F.col("created_at"), F.lit(as_of).cast("timestamp"))
    counts = tickets.groupBy("cluster_id").agg(
        *[F.count_if(bucket == k).alias(f"w{k}") for k in range(weeks)])
    return counts.select("cluster_id", F.posexplode(F.array(*[f"w{k}" for k in range(weeks)])).alias("week_offset", "n"))


def trend_data(weeks: DataFrame) -> DataFrame:
    """Oldest week first, as one short list per cluster."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("week_offset")).alias("age"), "n")))
    return weeks.groupBy("cluster_id").agg(F.transform(ordered, lambda w: w["n"]).alias("trend"))


def trend_direction(tickets: DataFrame, as_of: str) -> DataFrame:
    """Last week against the week before, and the size one week ago."""
    moment = F.lit(as_of).cast("timestamp")
    bucket = week_bucket(F.col("created_at"), moment)
    counted = tickets.where(F.col("created_at") < moment).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(bucket > 0).alias("previous_size"),
        F.count_if(bucket == 0).alias("last_week"), F.count_if(bucket == 1).alias("week_before"))
    direction = (F.when(F.col("last_week") > F.col("week_before"), F.lit("up"))
                 .when(F.col("last_week") < F.col("week_before"), F.lit("down")).otherwise(F.lit("flat")))
    return counted.withColumn("trend_direction", direction)
