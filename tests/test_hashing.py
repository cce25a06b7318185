import numpy as np

from caseloom.operators import hashing as L
from caseloom.operators.neighbours import duplicate_groups


def near_copies(spark, seed=1, groups=60, dims=24):
    """Groups of copies at scores around 0.8 to 1, exact copies, one hot group, and rows of their own."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(40 if g == 0 else rng.integers(1, 5)):
            rows.append([float(x) for x in centre + rng.choice([0.0, 0.1, 0.35]) * rng.normal(size=dims)])
    rows += [rows[3], rows[3], rows[-1], [0.0] * dims, [0.0] * dims, None]
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, vec array<double>")


def pairs(groups):
    held = {}
    for i, g in groups:
        held.setdefault(g, []).append(i)
    return {(a, b) for own in held.values() for a in own for b in own if a < b}


def test_recall_against_the_exact_groups(spark):
    data = near_copies(spark)
    exact = pairs((r["id"], r["group_id"]) for r in duplicate_groups(data.where("vec IS NOT NULL"), 0.8).collect())
    found = [(r["id"], r["group_id"]) for r in L.hashed_groups(data, 0.8).collect()]
    assert all(g == min(i for i, h in found if h == g) for _, g in found)
    got = pairs(found)
    assert got <= exact and len(exact) > 800
    assert len(got) >= 0.9 * len(exact)


def test_columns_of_a_hot_bucket_lose_nothing(spark):
    data = near_copies(spark)
    whole = sorted(map(tuple, L.hashed_groups(data, 0.8).collect()))
    assert sorted(map(tuple, L.hashed_groups(data, 0.8, column_rows=7).collect())) == whole


def test_expected_recall():
    assert L.expected_recall(1.0) == 1 and L.expected_recall(0.8) > 0.95 and L.expected_recall(0.0) < 0.05


def test_empty(spark):
    assert L.hashed_groups(near_copies(spark).limit(0), 0.8).count() == 0


def test_bands_in_rounds_find_the_same_groups(spark, monkeypatch):
    """A long table takes a few bands at a time; each round's links are stored and its shuffle files go."""
    data = near_copies(spark)
    whole = {(r["id"], r["group_id"]) for r in L.hashed_groups(data, 0.8).collect()}
    rounds, cut = [], L.cut_and_free
    monkeypatch.setattr(L, "cut_and_free", lambda frame: rounds.append(1) or cut(frame))
    monkeypatch.setattr(L, "COPIES_AT_ONCE", 2000)
    assert {(r["id"], r["group_id"]) for r in L.hashed_groups(data, 0.8).collect()} == whole
    assert 3 <= len(rounds) <= 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def joined(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_a_task_joins_what_all_pairs_join_by_as_few_links(monkeypatch):
    """Dense groups, scores at the limit itself, groups known before, one column and two."""
    monkeypatch.setattr(L, "FIRST_ROWS", 4)
    monkeypatch.setattr(L, "RUN_ROWS", 16)
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(12, 8)), [60, 30, 20, *[5] * 7, 1, 1], axis=0)
    points += 0.15 * rng.normal(size=points.shape)
    points[-2:] = [[1, 0, 0, 0, 0, 0, 0, 0], [0.8, 0.6, 0, 0, 0, 0, 0, 0]]
    points = points[rng.permutation(len(points))]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n = len(points)
    near = np.round(points @ points.T, 9) >= 0.8
    for known in (np.arange(n), np.arange(n) // 3):
        before = [(a, b) for a in range(n) for b in range(a) if known[a] == known[b]]
        for sides in (None, rng.random(n) < 0.3):
            meet = near if sides is None else near & (sides[:, None] != sides[None, :])
            found = L._forest(points.astype(np.float32), lambda at: points[at], sides, known, 0.8)
            assert all(meet[a, b] for a, b in found)
            whole = joined(n, [*before, *zip(*np.nonzero(meet))])
            assert joined(n, [*before, *found]) == whole
            assert len(found) == len(set(known)) - len(set(whole))


def test_further_bands_leave_out_what_the_first_have_joined(spark, monkeypatch):
    """One dense group of many different rows: not a forest of its own for each band."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.ones(16) + 0.2 * rng.normal(size=16)]) for i in range(150)]
    data = spark.createDataFrame(rows, "id bigint, vec array<double>")
    monkeypatch.setattr(L, "COPIES_AT_ONCE", 1200)
    links = [tuple(r) for r in L.similar_links(data, 0.8).collect()]
    assert set(joined(150, links)) == {0}
    assert len(links) < 1000
