import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import hierarchy as H, quality as Q
from tests.test_clustering import planted


def plain_tree(vectors, min_samples=3):
    """Kruskal over all pairs."""
    ids = sorted(vectors)
    points = np.array([vectors[i] for i in ids], float)
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    points = np.divide(points, norms, out=points, where=norms > 0)
    length = np.sqrt(np.maximum(0, 2 - 2 * np.round(points @ points.T, 9)))
    np.fill_diagonal(length, -1)
    core = np.sort(length, axis=1)[:, min(min_samples, len(ids) - 1)]
    edges = sorted((max(length[a, b], core[a], core[b]), ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    tree = []
    for w, a, b in edges:
        if find(a) != find(b):
            root[find(b)] = find(a)
            tree.append((a, b, round(w, 7)))
    return tree


def plain_clusters(tree, m=5):
    """Single linkage, condensed tree and excess of mass by recursion over member sets: sets of members."""
    groups = {}
    top = None
    for a, b, w in tree:
        left, right = groups.get(a, (frozenset([a]), None)), groups.get(b, (frozenset([b]), None))
        top = (left[0] | right[0], (w, left, right))
        for i in top[0]:
            groups[i] = top

    def condense(node, birth):
        """(stability, members, children) of the cluster that starts at a node."""
        members, mass = node[0], 0.0
        while True:
            w, left, right = node[1]
            density = 1 / max(w, 1e-5)
            if len(left[0]) >= m and len(right[0]) >= m:
                mass += len(node[0]) * density
                children = [condense(left, density), condense(right, density)]
                break
            large = left if len(left[0]) >= len(right[0]) else right
            if len(large[0]) < m:
                mass += len(node[0]) * density
                children = []
                break
            mass += (len(node[0]) - len(large[0])) * density
            node = large
        return mass - len(members) * birth, members, children

    def best(cluster, root):
        below = [best(c, False) for c in cluster[2]]
        total = sum(s for s, _ in below)
        if not root and cluster[0] >= total:
            return cluster[0], [cluster[1]]
        return total, [x for _, own in below for x in own]

    return {frozenset(x) for x in best(condense(top, 0.0), True)[1]}


def vectors_of(data):
    return {r["id"]: r["vec"] for r in data.select("id", "vec").collect()}


def found_sets(found):
    groups = {}
    for r in found.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    noise = groups.pop(-1, set())
    assert sorted(groups) == list(range(len(groups)))
    sizes = [len(groups[k]) for k in sorted(groups)]
    assert sizes == sorted(sizes, reverse=True)
    return {frozenset(g) for g in groups.values()}, noise


def mixed_densities(spark, seed=3):
    """Three tight groups, two loose ones and noise: no single distance separates them."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, (size, spread) in enumerate([(25, 0.01), (25, 0.01), (20, 0.01), (40, 0.25), (40, 0.25)]):
        centre = rng.normal(size=12)
        if g == 1:
            centre = first + 0.12 * rng.normal(size=12)
        first = centre
        rows += [(1000 * g + i, [float(x) for x in centre + spread * rng.normal(size=12)], g) for i in range(size)]
    rows += [(9000 + i, [float(x) for x in rng.normal(size=12)], -1) for i in range(10)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, truth int")


@pytest.mark.parametrize("options", [{}, {"cells": 3, "column_rows": 40, "neighbours": 4}])
def test_tree_against_kruskal(spark, options):
    data = planted(spark, groups=3, size=14, noise=6)
    got = sorted((round(r["reach"], 7), r["lo"], r["hi"]) for r in H.spanning_edges(data, **options).collect())
    assert got == sorted((w, a, b) for a, b, w in plain_tree(vectors_of(data)))


def test_clusters_against_recursion(spark):
    data = mixed_densities(spark)
    found = H.hierarchical_clusters(data)
    sets, noise = found_sets(found)
    assert sets == plain_clusters(plain_tree(vectors_of(data)))
    assert len(sets) >= 4
    joined = found.where("cluster_id >= 0").join(data.select("id", "truth"), "id")
    assert Q.purity(joined).first().purity > 0.95


def test_blocks_and_rounds_give_the_same(spark):
    data = planted(spark, groups=3, size=12, noise=9)
    tree = H.cut_lineage(H.spanning_edges(data))
    one = sorted(map(tuple, H.dendrogram(tree).collect()), key=lambda r: r[0])
    for local in (12,):
        assert sorted(map(tuple, H.dendrogram(tree, local).collect()), key=lambda r: r[0]) == one
    clusters, _ = H.condensed_tree(H.dendrogram(tree), 3)
    rounds = H._highest(H._weighed(clusters))
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, H._chosen_locally(clusters).collect()))


def test_few_rows_copies_and_zeros(spark):
    data = planted(spark).select("id", "vec")
    assert H.hierarchical_clusters(data.limit(4)).count() == 0
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(8)] + [(10 + i, [0.0, 1.0, 0.001 * i]) for i in range(8)] + [(30, [0.0, 0.0, 0.0]), (31, None)]
    odd = spark.createDataFrame(rows, "id bigint, vec array<double>")
    sets, noise = found_sets(H.hierarchical_clusters(odd))
    assert sets == {frozenset(range(8)), frozenset(range(10, 18))} and noise == {30}


def test_least_reach_is_that_of_all_pairs(monkeypatch):
    monkeypatch.setattr(H, "RUN_ROWS", 16)
    rng = np.random.default_rng(4)
    points = rng.normal(size=(70, 6))
    points[10:30] = points[0] + rng.normal(size=(20, 6)) * 1e-8
    points[30:40] = points[1]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    owner, core = rng.integers(0, 4, 70), rng.choice([0.0, 0.3, 0.9], 70)
    length = np.sqrt(np.maximum(0.0, 2 - 2 * np.round(points @ points.T, 9)))
    reach = np.maximum(np.maximum(length, core[None, :]), core[:, None])
    reach[owner[:, None] == owner[None, :]] = np.inf
    side = (points.astype(np.float32), lambda at: points[at], owner, core)
    place, least = H._least_reach(side, side, np.full(70, 2.0))
    assert np.array_equal(place, reach.argmin(axis=1)) and np.allclose(least, reach.min(axis=1), atol=1e-7)
    place, least = H._least_reach(side, side, np.full(70, 0.95))
    near = reach.min(axis=1) <= 0.95
    assert np.array_equal(place[near], reach.argmin(axis=1)[near]) and np.allclose(least[near], reach.min(axis=1)[near], atol=1e-7)
