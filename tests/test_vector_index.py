import numpy as np
import pytest

from caseloom.operators import neighbours as B, vector_index as X

KINDS = "id bigint, vec array<double>, cell int"


def planted(number, seed=3, dimension=12, groups=30):
    """Vectors around centres, the first centre holding a third of them, with copies and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimension))
    home = np.where(rng.random(number) < 0.34, 0, rng.integers(0, groups, number))
    points = centres[home] + rng.normal(scale=0.15, size=(number, dimension))
    points[5:40] = points[5]
    points[50:53] = 0.0
    return [(i, p.tolist(), 0) for i, p in enumerate(points)]


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["neighbour_id"], round(r["score"], 7)) for r in frame.collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(planted(1500), KINDS).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    made = X.create(table, str(tmp_path_factory.mktemp("index") / "x"), dimension=12)
    return X.load(spark, made.path)


def test_same_rows_as_the_search_over_everything(table, index):
    for options in ({"exclude_self": True, "column_rows": 700}, {"min_score": 0.97}):
        report = {}
        got = X.search(index, table, 7, report=report, **options)
        assert rows(got) == rows(B.nearest(table, table, 7, **options))
        assert report["rows"] == 1500 and report["cells_read"] <= report["cells"] and report["cells"] >= 38


def test_one_query_reads_few_cells(table, index):
    report = {}
    one = table.where("id = 700")
    got = X.search(index, one, 5, report=report)
    assert rows(got) == rows(B.nearest(one, table, 5))
    assert report["cells_read"] < report["cells"] / 3
    plan = index.rows().where(X._only({1, 2}))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_recall_of_probes(table, index):
    exact = {(r[0], r[2]) for r in rows(B.nearest(table, table, 10))}
    found = {(r[0], r[2]) for r in rows(X.search(index, table, 10, probes=6))}
    assert len(exact & found) >= 0.9 * len(exact)


def test_put_adds_and_replaces(spark, table, tmp_path):
    made = X.create(table.where("id < 1250"), str(tmp_path / "x"), dimension=12, cells=40)
    moved = spark.createDataFrame([(i, [float(x) for x in np.eye(12)[i % 12]], 0) for i in range(0, 300)], KINDS)
    added = table.where("id >= 1250")
    change = moved.unionByName(added)
    X.put(made, change)
    truth = table.where("id >= 300").unionByName(moved)
    assert made.rows().count() == 1500
    want = rows(B.nearest(truth, truth, 4))
    assert rows(X.search(made, truth, 4)) == want
    X.put(made, change)  # a rerun changes nothing
    assert made.rows().count() == 1500 and rows(X.search(X.load(spark, made.path), truth, 4)) == want
    counts, near, far = made.facts()
    assert sum(counts) == 1500 and all(lo <= hi for lo, hi in zip(near, far))


def test_only_touched_cells_are_rewritten(spark, table, tmp_path):
    made = X.create(table, str(tmp_path / "x"), dimension=12)
    files = lambda: {r["f"] for r in made.rows().selectExpr("input_file_name() AS f").distinct().collect()}
    before = files()
    X.put(made, table.where("id = 700"))
    assert len(before - files()) == 1


def test_an_emptied_cell(spark, tmp_path):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0)], KINDS)
    made = X.create(table, str(tmp_path / "x"), dimension=2, cells=4)
    X.put(made, spark.createDataFrame([(3, [1.0, 0.05], 0)], KINDS))
    assert {r["id"] for r in made.rows().collect()} == {1, 2, 3}
    assert [r[2] for r in rows(X.search(made, table.where("id = 1"), 3))] == [1, 3, 2]


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 1.0], 0), (2, None, 0), (4, [0.0, 0.0], 0)], KINDS)
    made = X.create(table, str(tmp_path / "x"), dimension=2)
    assert {(r["id"], tuple(r["vec"])) for r in made.rows().collect()} == {(1, (1.0, 0.0)), (4, (0.0, 0.0))}
    assert X.search(made, table.limit(0), 3).count() == 0
    assert rows(X.search(made, table.where("id = 4"), 3)) == [(4, 1, 1, 0.0), (4, 2, 4, 0.0)]
    with pytest.raises(Exception, match="dimension"):
        X.put(made, spark.createDataFrame([(9, [1.0], 0)], KINDS))
    empty = X.create(table.limit(0), str(tmp_path / "y"), dimension=2)
    assert X.search(empty, table, 3).count() == 0
    X.put(empty, table)
    assert X.search(empty, table.where("id = 4"), 3).count() == 2


def test_text_ids(spark, table, tmp_path):
    named = table.selectExpr("concat('t', id) AS id", "vec")
    made = X.create(named, str(tmp_path / "x"), dimension=12)
    assert rows(X.search(made, named, 3)) == rows(B.nearest(named, named, 3))


def test_a_query_travels_once_to_a_pack_of_cells(spark, table, tmp_path):
    made = X.create(table, str(tmp_path / "x"), dimension=12, cells=40)
    facts = made.facts()
    firsts = X._packs(facts[0], 500)
    assert 3 <= len(firsts) <= 6 and X._packs([0, 0], 5) == [0]
    every = table.select("id", "vec").where("id < 100")
    visits = X._planned(every, made, facts, firsts, lambda distance, bound, counts, part: bound >= 0)
    assert visits.count() == 100 * len(firsts)
    assert X._asked(visits, firsts, len(facts[0])) == {c: 100 for c, n in enumerate(facts[0]) if n}
    assert rows(X.search(made, table, 4, column_rows=500)) == rows(B.nearest(table, table, 4))
