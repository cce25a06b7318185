import numpy as np

from caseloom.operators import embedding as E, retrieval as R


def test_vectors_of_summaries_and_members(spark):
    clusters = spark.createDataFrame([
        (1, "Login failures", "users cannot sign in", "reset the password", 7), (2, "Billing", None, " ", 7), (3, None, "", None, 7),
        (4, None, None, None, 7), (5, "Login failures", None, None, 7)],
        "cluster_id bigint, label string, issue_description string, recommended_response string, vec int")
    vector = lambda *xs: [float(x) for x in xs] + [0.0] * (E.DIMENSION - len(xs))
    members = spark.createDataFrame([("a", 3, vector(1, 2)), ("b", 3, vector(3, 4)), ("c", 1, vector(9)), ("d", 3, None)],
                                    "ticket_id string, cluster_id bigint, vector array<double>")
    found = {r["cluster_id"]: (r["origin"], r["vec"]) for r in R.cluster_vectors(clusters, members).collect()}
    assert {c: o for c, (o, _) in found.items()} == {1: "summary", 2: "summary", 3: "members", 5: "summary"}
    assert found[3][1][:3] == [2.0, 3.0, 0.0]
    model = E.hash_embedder()()
    assert np.allclose(found[1][1], model(["Login failures\nusers cannot sign in\nreset the password"])[0], atol=1e-6)


def test_messages_find_their_cluster(spark):
    clusters = spark.createDataFrame([(1, "login password reset"), (2, "invoice billing refund"), (3, "")], "cluster_id bigint, label string")
    vectors = R.summary_vectors(clusters, fields=("label",))
    messages = E.embed(spark.createDataFrame([("m1", "please reset my password"), ("m2", "refund the invoice"), ("m3", "")], "id string, text string"), "id")
    got = R.nearest_clusters(messages, vectors, 1, clusters=clusters, min_score=0.1).collect()
    assert {(r["query_id"], r["cluster_id"], r["label"]) for r in got} == {("m1", 1, "login password reset"), ("m2", 2, "invoice billing refund")}
    assert R.nearest_clusters(messages, vectors, 1).count() == 3
    assert R.nearest_clusters(messages, vectors.limit(0), 1).count() == 0
