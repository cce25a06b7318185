import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import embedding as E, inference as I
from caseloom.session import prepare_session


def tickets(spark):
    rows = [("a", "S1", "First. Second.", "p"), ("b", "S2", "", "p"), ("c", "S3", "Third", "p")]
    return spark.createDataFrame(rows, "ticket_id string, subject string, content string, prompt string")


def test_resume_and_failures(spark):
    done = spark.createDataFrame([("a", "old", "ok"), ("c", "bad", "failed"), ("z", "gone", "ok")],
                                 "ticket_id string, summary string, status string")
    got = {r.ticket_id: r for r in I.summarize(tickets(spark), done).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].summary == "old" and got["a"].skipped
    assert got["b"].status == "failed" and got["b"].summary == "Subject: S2\n\n[Summary generation failed: no content]"
    assert got["c"].summary == "Subject: S3\nProblem: Third" and not got["c"].skipped


def test_empty_answer_counts_as_failed(spark):
    got = I.summarize(tickets(spark), model=lambda: (lambda row: "")).collect()
    assert {r.status for r in got} == {"failed"} and all(r.summary.endswith("failed - no output]") for r in got)


def test_answers(spark):
    answers = [('{"label":"x","common_symptoms":["a","b"]}', 0.8, "x"), ('```json\n{"label":"y"}\n```', 0.8, "y"),
               ('```\n{"label":"y2"}', 0.8, "y2"), ('Sure! {"label":"z","n":{"q":1}} bye', 0.8, "z"), ("{}", 0.3, "Cluster-5"),
               ("nothing", 0.3, "Cluster-6"), ("[1]", 0.0, "Cluster-7"), (None, 0.0, "Cluster-8"), ('{"label": oops}', 0.3, "Cluster-9")]
    frame = spark.createDataFrame([(i + 1, a) for i, (a, _, _) in enumerate(answers)], "cluster_id int, output string")
    got = I.summary_fields(frame).orderBy("cluster_id").collect()
    assert [(r.confidence, r.label) for r in got] == [(c, label) for _, c, label in answers]
    assert got[0].common_symptoms == ["a", "b"] and got[1].common_symptoms == []


def test_clusters_without_texts_stay_empty(spark):
    frame = spark.createDataFrame([(1, ["t"], ["alpha", "beta"]), (2, [], ["x"])], "cluster_id int, texts array<string>, keywords array<string>")
    got = {r.cluster_id: r for r in I.label_clusters(frame).collect()}
    assert got[1].label == "alpha beta" and got[1].confidence == 0.8
    assert got[2].label == "Cluster-2" and got[2].confidence == 0.0


def test_routing_without_neighbours(spark):
    messages = spark.createDataFrame([(1, "help"), (2, "other")], "id bigint, text string")
    hits = spark.createDataFrame([(1, 7, 0.5, 1)], "query_id bigint, neighbour_id bigint, score double, rank int")
    known = spark.createDataFrame([(7, "s" * 80, "sum", 3)], "id bigint, subject string, summary string, cluster_id bigint")
    clusters = spark.createDataFrame([(3, "lab", 9, "d", "r")], "cluster_id bigint, label string, size bigint, issue_description string, recommended_response string")
    got = {r.message_id: r for r in I.route_messages(messages, hits, known, clusters).collect()}
    assert got[1].predicted_cluster == "3" and got[1].confidence == 0.5
    assert [(c.type, len(c.label), c.relevance) for c in got[1].citations] == [("ticket", 50, 0.5), ("cluster", 3, 0.5)]
    assert got[2].predicted_cluster is None and len(got[2].citations) == 1
    plain = I.route_messages(messages, hits, known, clusters, model=lambda: (lambda row: "no json"), include_citations=False)
    assert {(r.confidence, len(r.citations)) for r in plain.collect()} == {(0.0, 0)}


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"12345")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = files.first().path
    rows = [("t", [("a.png", path)] + [("gone.png", "file:/none")] * 6 + [(None, None)])]
    frame = spark.createDataFrame(rows, "ticket_id string, images array<struct<filename:string,path:string>>")
    got = I.describe_images(frame, files, model=lambda: (lambda row: f"{len(row['content'])} bytes")).first()
    assert [i.description for i in got.image_descriptions] == ["5 bytes"] + ["[Image: gone.png - not available]"] * 4


def test_embedding(spark):
    frame = spark.createDataFrame([(1, "a b a"), (2, "  "), (3, None), (4, "a b a")], "id bigint, text string")
    got = {r.id: np.array(r.vec) for r in E.embed(frame, "id", dimension=32).collect()}
    assert np.allclose(np.linalg.norm(got[1]), 1) and not got[2].any() and not got[3].any() and (got[1] == got[4]).all()


def test_embedding_fallback_and_dimension(spark):
    frame = spark.createDataFrame([(1, "a b")], "id bigint, text string")

    def broken():
        def fail(texts):
            raise RuntimeError("down")
        return fail
    assert E.embed(frame, "id", embedder=broken, fallback=E.hash_embedder(16), dimension=16).first().vec
    with pytest.raises(Exception, match="down"):
        E.embed(frame, "id", embedder=broken, dimension=16).collect()
    with pytest.raises(Exception, match="dimensions"):
        E.embed(frame, "id", embedder=E.hash_embedder(8), dimension=16).collect()
    with pytest.raises(Exception, match="vector dimension 16"):
        E.assert_dimension(E.embed(frame, "id", dimension=16), 5).collect()


def test_metrics_of_an_empty_run(spark):
    kinds = ("status string, skipped boolean, input_chars bigint, output_tokens bigint, output_chars bigint, "
             "latency_seconds double, started_at double, ended_at double")
    row = I.batch_metrics(spark.createDataFrame([], kinds)).first()
    assert row.total_tickets == 0 and row.avg_latency == 0.0 and row.tickets_per_minute == 0.0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield batch[["n"]].iloc[:1].assign(n=len(batch))

    prepare_session(spark)
    long = spark.range(30).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("content"), F.lit(0).alias("n"))
    found = [r.n for r in long.mapInPandas(sizes, "n int").collect()]
    assert sum(found) == 30 and max(found) <= 9
