import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import neighbours as B, routing as R

KIND = "id bigint, vec array<double>"


def planted(seed, rows=240, dims=8, centres=6, copies=0):
    """Tight groups around a few centres, some exact copies, some zero vectors."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dims))
    points = centre[rng.integers(centres, size=rows)] + 0.15 * rng.normal(size=(rows, dims))
    points[rows - copies:] = points[0]
    points[5] = points[17] = 0
    return points


def brute(q, c, k, self_excluded=False, earlier=False, floor=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    scores = np.round(unit(q) @ unit(c).T, 9)
    out = {}
    for i, row in enumerate(scores):
        found = [(-s, j) for j, s in enumerate(row) if not (self_excluded and i == j) and not (earlier and j >= i)
                 and (floor is None or s >= floor)]
        out[i] = [(j, round(-s, 6)) for s, j in sorted(found)[:k]]
    return {i: v for i, v in out.items() if v}


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], KIND).repartition(3)


def collected(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.neighbour_id, round(r.score, 6)))
    return out


@pytest.mark.parametrize("layout", [{}, {"column_rows": 50}, {"cells": 7, "column_rows": 40}, {"cells": 40}])
def test_topk_equals_brute_force(spark, layout):
    points = planted(1, copies=70)
    v = frame(spark, points)
    assert collected(B.nearest(v, v, 5, exclude_self=True, **layout)) == brute(points, points, 5, self_excluded=True)


@pytest.mark.parametrize("layout", [{}, {"cells": 9, "column_rows": 30}])
def test_threshold_and_other_table(spark, layout):
    corpus, queries = planted(2), planted(3, rows=60)
    got = collected(B.nearest(frame(spark, queries), frame(spark, corpus), 4, min_score=0.8, **layout))
    assert got == brute(queries, corpus, 4, floor=0.8)


def test_many_cells_skip_work_on_grouped_data(spark):
    """The proven radius must rule out most cells when the data has groups."""
    points = planted(4, rows=400, centres=8, dims=16)
    points = points[np.linalg.norm(points, axis=1) > 0]
    v = frame(spark, points)
    placed, cells = B._build_cells(v, 20, len(points))
    wide = v.withColumn("radius", F.lit(0.6))
    assert B._visits(wide, cells, True, True).count() < 0.5 * len(points) * 20


def test_more_wanted_than_there_is(spark):
    points = planted(5, rows=30)
    got = collected(B.nearest(frame(spark, points[:3]), frame(spark, points[:4]), 10))
    assert all(len(v) == 4 for v in got.values()) and len(got) == 3
    assert B.nearest(frame(spark, points[:3]), frame(spark, points[:4]).limit(0), 10).count() == 0


@pytest.mark.parametrize("layout", [{}, {"cells": 6}])
def test_duplicates_give_one_edge_each(spark, layout):
    points = planted(6, copies=90)
    got = {r.id: (r.duplicate_of, round(r.score, 6)) for r in B.duplicate_edges(frame(spark, points), 0.97, **layout).collect()}
    want = {i: v[0] for i, v in brute(points, points, 1, earlier=True, floor=0.97).items()}
    # Copies point at the first copy even if another row ties.
    assert {i: v for i, v in got.items() if i < 150} == {i: v for i, v in want.items() if i < 150}
    assert all(got[i] == (0, 1.0) for i in range(150, 240))


@pytest.mark.parametrize("layout", [{}, {"cells": 6, "column_rows": 40}])
def test_groups_hold_every_pair(spark, layout):
    """The third row resembles the first and, less, the second, which do not resemble each other; one edge each drops the second."""
    bridge = [[1, 0, 0], [0.3, 1, 0], [1, 0.9, 0], [0, 0, 1]]
    got = {r.id: (r.group_id, r.n_links) for r in B.duplicate_groups(frame(spark, np.array(bridge)), 0.7).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 2)}
    points = planted(9, rows=300, centres=4, copies=60)
    found = brute(points, points, len(points), self_excluded=True, floor=0.9)
    parent = {i: i for i in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, partners in found.items():
        for j, _ in partners:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert max(map(len, found.values())) > 4 * B.GROUP_NEIGHBOURS
    got = {r.id: (r.group_id, r.n_links) for r in B.duplicate_groups(frame(spark, points), 0.9, **layout).collect()}
    assert got == {i: (root(i), len(partners)) for i, partners in found.items()}


def test_votes(spark):
    hits = spark.createDataFrame(
        [(1, 10, 0.5, 1), (1, 11, 0.3, 2), (1, 12, 0.2, 3), (2, 13, 0.9, 1), (3, 10, 0.4, 1), (3, 13, 0.3, 2)],
        "query_id bigint, neighbour_id bigint, score double, rank int")
    member = spark.createDataFrame([(10, 7), (11, 8), (12, 8), (13, None)], "id bigint, cluster_id bigint")
    got = {r.query_id: (r.cluster_id, round(r.confidence, 6), list(r.similar_tickets)) for r in R.vote(hits, member).collect()}
    # A tie goes to the cluster met first; neighbours without a cluster do not dilute; no votes keeps the best score.
    assert got == {1: (7, 0.5, [10, 11, 12]), 2: (None, 0.9, [13]), 3: (7, 1.0, [10, 13])}


def test_assignment_without_neighbours(spark):
    points = planted(7, rows=20)
    q = frame(spark, points[:2])
    none = spark.createDataFrame([], "id bigint, cluster_id bigint")
    got = R.assign_clusters(q, frame(spark, points).limit(0), none).collect()
    assert [(r.cluster_id, r.confidence, r.similar_tickets) for r in got] == [(None, 0.0, [])] * 2


def test_short_columns_do_not_multiply_with_the_rows(spark, monkeypatch):
    """Copies of a row follow cores and memory, not the length of its cell; blocks shrink as columns grow."""
    assert B._columns([100, 1000, 100_000, 1_000_000], 128, 3, 65_536) == [1, 3, 3, 16]
    assert B._block(100) == 512 and B._block(1 << 17) * (1 << 17) <= B.SCORES_HELD
    monkeypatch.setattr(B, "SCORES_HELD", 600)
    points = planted(8, rows=300)
    v = frame(spark, points)
    assert collected(B.nearest(v, v, 4, exclude_self=True, cells=3, column_rows=8)) == brute(points, points, 4, self_excluded=True)


def _sides(q, c):
    units = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, c = units(q), units(c)
    return q.astype(np.float32), c.astype(np.float32), lambda at: q[at], lambda at: c[at], np.round(q @ c.T, B.SCORE_DIGITS) + 0.0


def test_scores_closer_than_single_precision_are_told_apart(monkeypatch):
    monkeypatch.setattr(B, "RUN_ROWS", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 8))
    c = np.concatenate([base + rng.normal(size=(90, 8)) * 1e-8, np.repeat(base, 40, axis=0), rng.normal(size=(30, 8))])
    c = c[rng.permutation(len(c))]
    q32, c32, exact_q, exact_c, score = _sides(np.concatenate([base, rng.normal(size=(20, 8))]), c)
    for take, least in ((1, None), (7, None), (50, 0.2), (160, None), (5, 0.999999999)):
        at, col, found = B._best_places(q32, c32, exact_q, exact_c, take, B._hidden(np.arange(21), np.arange(160), False, False), None, least)
        wanted = [(i, j) for i in range(21) for j in sorted(range(160), key=lambda j: (-score[i, j], j))[:take]
                  if least is None or score[i, j] >= least]
        assert list(zip(at.tolist(), col.tolist())) == wanted
        assert np.allclose(found, [score[p] for p in wanted], atol=1e-9)


def test_hidden_rows_follow_identifiers_with_nulls_and_repeats():
    ids = np.array(["a", "b", "b", "c", None], dtype=object)
    first, last = B._hidden(np.array(["b", None, "x"], dtype=object), ids, True, False)
    assert [(f, t) for f, t in zip(first, last)] == [(1, 3), (4, 5), (4, 4)]
    first, last = B._hidden(np.array([2.0, np.nan]), np.array([1.0, 2.0, 3.0, np.nan]), True, True)
    assert [(f, t) for f, t in zip(first, last)] == [(1, 3), (0, 0)]


def test_a_large_k_takes_fewer_queries_a_task(spark, monkeypatch):
    assert B._query_columns([1], [65_536], [65_536], [1], 10) == [1]
    assert B._query_columns([1], [65_536], [65_536], [1], 960) == [30]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(60, 4)))]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    wanted = sorted(map(tuple, B.nearest(vectors, vectors, 30, exclude_self=True).collect()))
    monkeypatch.setattr(B, "PAIRS_HELD", 300)
    assert sorted(map(tuple, B.nearest(vectors, vectors, 30, exclude_self=True).collect())) == wanted and len(wanted) == 1800
