from pyspark.sql import functions as F

from caseloom.operators import graph as G


def found(spark, rows):
    return spark.createDataFrame(rows, "ticket_id string, node_type string, name string")


def test_entities(spark):
    rows = [("1", "Error 500 in Cloud client", "code: 7001 and error 500", "linux", "1.2"), ("2", "clientele", "", None, None)]
    tickets = spark.createDataFrame(rows, "ticket_id string, subject string, description string, platform string, version string")
    got = sorted((r.ticket_id, r.node_type, r.name) for r in G.entities(tickets).collect())
    assert got == [("1", "Component", "client"), ("1", "Component", "cloud"), ("1", "Environment", "linux"),
                   ("1", "Environment", "version 1.2"), ("1", "ErrorSignature", "500"), ("1", "ErrorSignature", "7001")]


def test_links_and_communities(spark):
    rows = found(spark, [("1", "E", "a"), ("2", "E", "a"), ("2", "E", "b"), ("3", "E", "b"), ("4", "E", "c"), ("5", "E", "c")])
    got = {r.ticket_id: (r.n_entities, r.n_links, r.rarest) for r in G.shared_entities(rows).collect()}
    assert got == {"1": (1, 1, 2), "2": (2, 2, 2), "3": (1, 1, 2), "4": (1, 1, 2), "5": (1, 1, 2)}
    groups = {}
    for r in G.communities(rows).collect():
        groups.setdefault(r.community, set()).add(r.ticket_id)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3"], ["4", "5"]]


def test_shared_causes(spark):
    assignments = spark.createDataFrame([("1", 7), ("2", 7), ("3", 7), ("4", 8), ("5", -1)], "ticket_id string, cluster_id bigint")
    rows = found(spark, [("1", "Component", "cloud"), ("2", "Component", "cloud"), ("3", "Component", "sso"), ("4", "Environment", "x"),
                         ("5", "Component", "cloud")])
    got = [(r.src, round(r.weight, 3)) for r in G.caused_by(rows, assignments, 0.5).collect()]
    assert got == [("IssueCluster:7", 0.667)]


def test_noise_follows_its_community(spark):
    assignments = spark.createDataFrame([("1", 7), ("2", 7), ("3", -1), ("4", -1), ("5", 8)], "ticket_id string, cluster_id bigint")
    community = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y"), ("5", "x")], "ticket_id string, community string")
    got = {r.ticket_id: r.cluster_id for r in G.stabilize(assignments, community).collect()}
    assert got == {"1": 7, "2": 7, "3": 7, "4": -1, "5": 8}


def test_joins_by_ticket_are_never_broadcast(spark):
    """Both sides grow with the tickets; Spark's guess of a narrow table must not send it through the driver."""
    assigned = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5), ("c", -1, 0.5)], "ticket_id string, cluster_id bigint, confidence double")
    community = spark.createDataFrame([("a", 7), ("b", 7), ("c", 7)], "ticket_id string, community bigint")
    found = spark.createDataFrame([("a", "Component", "x"), ("b", "Component", "x")], "ticket_id string, node_type string, name string")
    for frame in (G.stabilize(assigned, community), G.caused_by(found, assigned), G.tickets_for_node(assigned, G.mentions(found), F.lit("n"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [ticket_id" not in plan and "BroadcastHashJoin [concat(Ticket" not in plan
    assert {r.ticket_id: r.cluster_id for r in G.stabilize(assigned, community).collect()} == {"a": 1, "b": 1, "c": 1}
