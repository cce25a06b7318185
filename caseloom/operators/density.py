"""Grouping vectors into clusters: density based, with noise, or around centres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from caseloom.operators.clusters import NOISE
from caseloom.operators.components import components, numbered
from caseloom.operators.joins import salted_join
from caseloom.operators.neighbours import nearest
from caseloom.session import cut_lineage

# Clustering parameters of the ticket contract.
MIN_CLUSTER_SIZE = 5
MIN_SAMPLES = 3
GRAPH_NEIGHBOURS = 15
REDUCED_DIMENSIONS = 10


def reach_edges(vectors: DataFrame, *, neighbours: int = GRAPH_NEIGHBOURS, min_samples: int = MIN_SAMPLES,
                **layout) -> DataFrame:
    """(src, dst, reach): neighbour graph weighted by mutual reachability distance.

    The reach of an edge is the largest of its length and the core distances of
    both ends; a core distance is the distance to the ``min_samples``-th neighbour.
    The graph has at most ``neighbours`` edges per row, whatever the density.
    """
    found = nearest(vectors, vectors, neighbours, exclude_self=True, **layout)
    graph = cut_lineage(found.select(
        F.col("query_id").alias("src"), F.col("neighbour_id").alias("dst"), "rank",
        F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("length")))
    core = graph.where(F.col("rank") == min_samples).select(F.col("src").alias("node"), F.col("length").alias("core"))
    source = core.select(F.col("node").alias("src"), F.col("core").alias("src_core"))
    target = core.select(F.col("node").alias("dst"), F.col("core").alias("dst_core"))
    return graph.join(source, "src").join(target, "dst").select(
        "src", "dst", F.greatest("length", "src_core", "dst_core").alias("reach"))


def density_clusters(vectors: DataFrame, *, eps: float | str = "auto", min_cluster_size: int = MIN_CLUSTER_SIZE,
                     steps: int = 6, **options) -> DataFrame:
    """(id, cluster_id): numbered by falling size, -1 for noise; empty below the minimum size.

    A row is dense when its ``min_samples``-th neighbour lies within ``eps``; dense
    rows within ``eps`` of each other are in one cluster.  No number of links is
    fixed.  ``eps='auto'`` picks the distance: the nearest-neighbour graph is cut
    at several distance quantiles at once, and the cut whose clusters hold most rows
    over the largest distance range names it.
    """
    few = vectors.limit(min_cluster_size).count() < min_cluster_size
    if few:
        return vectors.limit(0).select("id", F.lit(NOISE).cast("bigint").alias("cluster_id"))
    min_samples = options.pop("min_samples", MIN_SAMPLES)
    if eps != "auto":
        return name_clusters(_dense_components(vectors, float(eps), min_samples, options), min_cluster_size)
    edges = cut_lineage(reach_edges(vectors, min_samples=min_samples, **options))
    shares = [(i + 1) / (steps + 1) for i in range(steps)]
    levels = sorted(set(edges.agg(F.percentile_approx("reach", shares + [1.0]).alias("q")).first()["q"] or [0.0]))
    cuts = cut_lineage(_cuts(vectors, edges, levels))
    chosen = _best_level(cuts, levels, min_cluster_size) if len(levels) > 1 else 0
    options.pop("neighbours", None)
    return name_clusters(_dense_components(vectors, levels[chosen], min_samples, options), min_cluster_size)


def _dense_components(vectors: DataFrame, eps: float, min_samples: int, layout: dict) -> DataFrame:
    """(node, component) of the links between dense rows within ``eps``.

    A first search gives every row its nearest few.  A link that it leaves out has
    two ends whose lists are full, so as long as rows with full lists lie in
    different components, those outside the largest one search again, among such
    rows, for four times as many.
    """
    floor = 1 - eps * eps / 2 - 1e-9
    length = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))

    def near(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
        found = nearest(queries, corpus, k, exclude_self=True, min_score=floor, **layout)
        return cut_lineage(found.withColumn("length", length).where(F.col("length") <= eps)
                           .select(F.col("query_id").alias("src"), F.col("neighbour_id").alias("dst")))

    k = max(GRAPH_NEIGHBOURS, min_samples)
    found = near(vectors, vectors, k)
    counts = cut_lineage(found.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples))
    dense, full = counts.select("src"), counts.where(F.col("n") >= k).select("src")
    nodes = vectors.select(F.col("id").alias("node"))
    links = found.join(dense, "src", "left_semi").join(dense.withColumnRenamed("src", "dst"), "dst", "left_semi")
    while True:
        labels = components(nodes, links)
        open_ = cut_lineage(labels.join(full.withColumnRenamed("src", "node"), "node", "left_semi"))
        sizes = open_.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(2).collect()
        if len(sizes) < 2:
            return labels
        corpus = cut_lineage(vectors.join(open_.select(F.col("node").alias("id")), "id", "left_semi"))
        asking = open_.where(F.col("component") != F.lit(sizes[0]["component"]))
        queries = cut_lineage(vectors.join(asking.select(F.col("node").alias("id")), "id", "left_semi"))
        k *= 4
        more = near(queries, corpus, k)
        links = links.unionByName(more)
        again = more.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("src")
        # The largest component's rows stay partners of those whose lists are full again.
        partners = open_.where(F.col("component") == F.lit(sizes[0]["component"])).select(F.col("node").alias("src"))
        full = again if again.isEmpty() else cut_lineage(again.unionByName(partners))


def _cuts(vectors: DataFrame, edges: DataFrame, levels: list) -> DataFrame:
    """(level, node, component) of every cut, found in one run over (level, node) pairs."""
    every = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(eps).alias("eps")) for i, eps in enumerate(levels)])
    nodes = vectors.select("id", F.explode(every).alias("cut")).select(
        F.struct("cut.level", F.col("id").alias("node")).alias("node"))
    kept = edges.select("src", "dst", F.explode(F.filter(every, lambda c: F.col("reach") <= c["eps"])).alias("cut"))
    linked = kept.select(F.struct("cut.level", F.col("src").alias("node")).alias("src"),
                         F.struct("cut.level", F.col("dst").alias("node")).alias("dst"))
    found = components(nodes, linked)
    return found.select("node.level", "node.node", F.col("component.node").alias("component"))


def _best_level(cuts: DataFrame, levels: list, min_cluster_size: int) -> int:
    """Level whose clusters hold most rows, weighted by how far the distance may grow until the next level.

    The growth is a ratio, so the choice does not depend on the scale of the
    distances.  One row per level reaches the driver.
    """
    sizes = cuts.groupBy("level", "component").agg(F.count(F.lit(1)).alias("size"))
    facts = {r["level"]: r for r in sizes.where(F.col("size") >= min_cluster_size).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows")).collect()}
    best, best_score = 0, -1.0
    for i, (level, following) in enumerate(zip(levels, levels[1:])):
        # One cluster holding everything says nothing.
        several = i in facts and facts[i]["n"] > 1 and level > 0
        score = facts[i]["rows"] * math.log(following / level) if several else 0.0
        if score > best_score:
            best, best_score = i, score
    return best


def name_clusters(labelled: DataFrame, min_cluster_size: int) -> DataFrame:
    """Components to cluster numbers; components below the minimum size become noise."""
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    kept = numbered(sizes.where(F.col("size") >= min_cluster_size), [F.desc("size"), F.asc("component")])
    named = salted_join(labelled, kept.select("component", "number"), "component", "node", "left")
    return named.select(F.col("node").alias("id"), F.coalesce("number", F.lit(NOISE)).cast("bigint").alias("cluster_id"))


def reduce_dimensions(vectors: DataFrame, k: int = REDUCED_DIMENSIONS) -> DataFrame:
    """(id, vec) in fewer dimensions by principal components; a linear stand-in for manifold methods."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    prepared = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="r").fit(prepared)
    return model.transform(prepared).select("id", vector_to_array("r").alias("vec"))


def centre_clusters(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(id, cluster_id) by k-means over cosine distance; every row gets a cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    prepared = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(prepared)
    return model.transform(prepared).select("id", F.col("prediction").cast("bigint").alias("cluster_id"))
