"""Clusters as objects of retrieval: a vector for each cluster, and the nearest clusters of tickets or messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.text import first_filled
from caseloom.operators.clusters import centroids
from caseloom.operators.embedding import DIMENSION, Embedder, embed
from caseloom.operators.neighbours import nearest

SUMMARY_FIELDS = ("label", "issue_description", "recommended_response")


def summary_vectors(clusters: DataFrame, *, fields: tuple = SUMMARY_FIELDS, embedder: Embedder | None = None,
                    dimension: int = DIMENSION) -> DataFrame:
    """(cluster_id, vec): the embedded summary of each cluster, its filled fields one after the other.

    A cluster without any filled field has no vector.
    """
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col(c).cast("string"))
    text = F.concat_ws("\n", *[blank(f) for f in fields])
    return embed(clusters.select("cluster_id", text.alias("text")).where("text <> ''"), "cluster_id", embedder=embedder, dimension=dimension)


def cluster_vectors(clusters: DataFrame, members: DataFrame, **options) -> DataFrame:
    """(cluster_id, vec, origin): the embedded summary, or the mean of the members where there is no summary.

    ``members`` are (ticket_id, cluster_id, vector) of the same model.  A cluster with neither is left out.
    """
    own = summary_vectors(clusters, **options).select("cluster_id", F.transform("vec", lambda x: x.cast("double")).alias("own"))
    means = centroids(members.where(F.col("vector").isNotNull())).select("cluster_id", F.col("centroid").alias("mean"))
    both = clusters.select("cluster_id").distinct().join(own, "cluster_id", "left").join(means, "cluster_id", "left")
    return both.where(F.coalesce("own", "mean").isNotNull()).select(
        "cluster_id", F.coalesce("own", "mean").alias("vec"), F.when(F.col("own").isNotNull(), F.lit("summary")).otherwise(F.lit("members")).alias("origin"))


def nearest_clusters(queries: DataFrame, vectors: DataFrame, k: int = 3, *, clusters: DataFrame | None = None,
                     min_score: float | None = None, **layout) -> DataFrame:
    """(query_id, rank, cluster_id, label, similarity): the k clusters nearest to each (id, vec), ties by the smaller id.

    Without a table of clusters there is no label.
    """
    corpus = vectors.select(F.col("cluster_id").alias("id"), "vec")
    found = nearest(queries, corpus, k, min_score=min_score, **layout).select(
        "query_id", "rank", F.col("neighbour_id").alias("cluster_id"), F.col("score").alias("similarity"))
    if clusters is None:
        return found.withColumn("label", F.lit(None).cast("string"))
    return found.join(clusters.select("cluster_id", first_filled(F.col("label").cast("string"), F.lit("unknown")).alias("label")), "cluster_id", "left")
