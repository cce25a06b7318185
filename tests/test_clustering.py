import random

import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import clusters as C, components as K, density as D, feedback as H, quality as Q


def test_components_against_union_find(spark):
    rng = random.Random(3)
    nodes = list(range(300))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(180)]
    edges += [(i, i + 1) for i in range(100, 160)] + [(200, j) for j in range(201, 260)]
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for local in (0, 10_000):
        got = K.components(spark.createDataFrame([(n,) for n in nodes], "node bigint"),
                           spark.createDataFrame(edges, "src bigint, dst bigint"), local_links=local)
        assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_long_chain_needs_few_rounds(spark):
    n = 2000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = K.components(spark.range(n).withColumnRenamed("id", "node"), chain, max_rounds=20, local_links=0)
    assert got.select("component").distinct().count() == 1


def test_shuffled_chain_needs_few_rounds(spark):
    """Labels in random order along a path: groups must move as a whole."""
    order = list(range(3000))
    random.Random(5).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "src bigint, dst bigint")
    got = K.components(spark.range(3000).withColumnRenamed("id", "node"), chain, max_rounds=12, local_links=0)
    assert {r.component for r in got.select("component").distinct().collect()} == {0}


def test_numbers_are_dense_and_ordered(spark):
    frame = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("size"))
    got = [r.k for r in K.numbered(frame, [F.desc("size"), F.asc("k")]).orderBy("number").collect()]
    assert got == sorted(range(500), key=lambda k: (-(k % 7), k))
    assert K.numbered(frame.limit(0), ["k"]).count() == 0


def planted(spark, seed=0, groups=5, size=30, noise=20, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = [(i, [float(x) for x in centres[i % groups] + 0.12 * rng.normal(size=dims)], i % groups) for i in range(groups * size)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=dims)], -1) for i in range(noise)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, truth int")


def test_planted_groups_are_found(spark):
    data = planted(spark)
    found = D.density_clusters(data.select("id", "vec"), eps="auto")
    joined = found.join(data.select("id", "truth"), "id")
    assert Q.purity(joined).first().purity > 0.95
    sizes = {r.cluster_id: r.size for r in C.cluster_sizes(found).collect()}
    assert len([c for c in sizes if c >= 0]) == 5 and all(sizes[c] >= 20 for c in range(5))
    assert sizes.get(-1, 0) >= 10
    cells = D.density_clusters(data.select("id", "vec"), eps="auto", cells=5, column_rows=32)
    assert sorted(cells.collect()) == sorted(found.collect())


def test_too_few_rows_and_equal_vectors(spark):
    data = planted(spark).select("id", "vec")
    assert D.density_clusters(data.limit(4)).count() == 0
    same = spark.range(12).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert {r.cluster_id for r in D.density_clusters(same, eps=0.1).collect()} == {0}


def test_centres_and_reduction(spark):
    data = planted(spark, noise=0)
    found = D.centre_clusters(data.select("id", "vec"), k=5).join(data.select("id", "truth"), "id")
    assert Q.purity(found).first().purity > 0.7
    reduced = D.reduce_dimensions(data.select("id", "vec"), k=3)
    assert {len(r.vec) for r in reduced.collect()} == {3}


def test_representatives_of_a_large_cluster(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(200, 4))
    rows = [(i, 0 if i < 150 else 1, [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "ticket_id bigint, cluster_id int, vector array<double>")
    got = C.representatives(frame).orderBy("cluster_id", "rank").collect()
    for c, part in ((0, points[:150]), (1, points[150:])):
        d = np.linalg.norm(part - part.mean(axis=0), axis=1)
        assert [r.ticket_id for r in got if r.cluster_id == c] == [int(i) + 150 * c for i in np.argsort(d)[:3]]


def test_feedback_newest_edit_wins_and_merges_chain(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 9)], "ticket_id string, cluster_id bigint")
    edits = spark.createDataFrame([
        (1, "move", "a", 5, None), (2, "move", "a", 6, None), (3, "duplicate", "b", None, "d"), (4, "split", "c", 100, None),
        (5, "merge", None, 4, "7"), (6, "merge", None, 7, "3")],
        "edited_at int, action string, ticket_id string, cluster_id bigint, target_id string")
    got = {r.ticket_id: (r.cluster_id, r.assigned_by) for r in H.apply_feedback(base, edits).collect()}
    assert got == {"a": (6, "human"), "b": (3, "human"), "c": (100, "human"), "d": (3, "human"), "e": (9, "auto")}
    assert [(r.id, r.duplicate_of) for r in H.duplicate_marks(edits).collect()] == [("b", "d")]


def test_no_link_is_lost_between_dense_groups(spark):
    # Two bands of 30 rows; each row's nearest 29 are its own band, and the bands are near enough to link.
    rows = [(i, [1.0, 0.0005 * (i % 30), 0.05 * (i // 30)]) for i in range(60)]
    data = spark.createDataFrame(rows, "id bigint, vec array<double>")
    found = D.density_clusters(data, eps=0.1).collect()
    assert {r.cluster_id for r in found} == {0} and len(found) == 60
