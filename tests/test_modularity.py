import collections
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import graph as G, modularity as M

SCHEMA = "ticket_id string, node_type string, name string"


def planted(groups: int = 6, tickets: int = 25, seed: int = 3) -> list[tuple]:
    """Groups of tickets with entities of their own, one entity that all of them name, and some stray mentions."""
    draw, rows = random.Random(seed), []
    for g in range(groups):
        for t in range(tickets):
            ticket = f"{g}-{t:02d}"
            rows += [(ticket, "E", f"{g}/{k}") for k in draw.sample(range(8), 4)]
            rows.append((ticket, "E", "everywhere"))
            if draw.random() < 0.1:
                rows.append((ticket, "E", f"{draw.randrange(groups)}/0"))
    return rows


def plain_modularity(rows: list[tuple], label: dict) -> float:
    """Modularity by its definition over all pairs of nodes."""
    pairs = {(t, f"{kind}:{name}") for t, kind, name in rows}
    many = collections.Counter(e for _, e in pairs)
    weight = {pair: max(M.UNIT // many[pair[1]], 1) for pair in pairs}
    votes = collections.defaultdict(collections.Counter)
    for (t, e), w in weight.items():
        votes[e][label[t]] += w
    label = {**label, **{e: min(c, key=lambda one: (-c[one], one)) for e, c in votes.items()}}
    degree = collections.Counter()
    for (t, e), w in weight.items():
        degree[t] += w
        degree[e] += w
    total = sum(degree.values())
    return sum((2 * weight.get((a, b), 0) if a in votes or b in votes else 0) / total for a, b in weight if label[a] == label[b]) - sum(
        degree[a] * degree[b] for a in degree for b in degree if label[a] == label[b]) / total**2


def test_planted_groups_are_found(spark):
    rows = planted()
    found = spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(5)
    got = M.dense_communities(found)
    label = {r.ticket_id: r.community for r in got.collect()}
    assert label == {t: f"{t.split('-')[0]}-00" for t, _, _ in rows}
    ours = M.modularity(found, got)
    assert ours == pytest.approx(plain_modularity(rows, label), abs=1e-9)
    assert ours >= M.modularity(found, G.communities(found))


def test_modularity_is_not_below_label_spreading(spark):
    draw = random.Random(8)
    rows = [(f"t{draw.randrange(80)}", "E", f"e{min(draw.randrange(40), draw.randrange(40))}") for _ in range(300)]
    found = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ours, spread = (M.modularity(found, labels) for labels in (M.dense_communities(found), G.communities(found)))
    assert ours >= spread and ours > 0.2


def test_odd_rows(spark):
    assert M.dense_communities(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.modularity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "ticket_id string, community string")) == 0.0
    rows = [("a", "E", "x"), ("a", "E", "x"), ("b", None, "y"), (None, "E", "x"), ("c", "E", None), ("d", "E", "")]
    got = M.dense_communities(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("a", "a"), ("b", "b"), ("d", "d")]


def test_tables_of_all_nodes_are_never_broadcast(spark):
    """Tables as long as the mentions must not go through the driver, however short Spark thinks they are."""
    found = spark.createDataFrame([("a", "Component", "x"), ("b", "Component", "x"), ("b", "Component", "y")], "ticket_id string, node_type string, name string")
    nodes, edges = M.mention_graph(found)
    labels = nodes.select("node", "side", "degree", "loop", F.col("node").alias("community"))
    offers = M._offers(edges, labels)
    for frame in (M._between(edges, labels), M.dense_communities(found)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert offers.count() > 0
