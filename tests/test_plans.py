import json

from caseloom.operators.embedding import hash_embedder
from caseloom.plans.dashboard import dashboard
from caseloom.plans.ticket_run import RunOptions, run
from caseloom.sources.raw import parse_payloads


def test_whole_run_and_resume(spark, tmp_path):
    topics = ["printer jams paper tray", "login password reset mail", "camera stream freezes often"]
    docs = [{"id": i, "created_at": "2024-01-01" if i != 30 else None, "subject": topics[i % 3],
             "description": f"{topics[i % 3]} again today"} for i in range(31)]
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    raw = parse_payloads(lines, "value")
    options = RunOptions(str(tmp_path), "2024-02-01", embedder=hash_embedder(64), dimension=64, eps=0.3)
    out = run(raw, options)
    assert out["tickets"].count() == 30 and [r.ticket_id for r in out["rejected"].collect()] == ["30"]
    clusters = {r.cluster_id: r for r in out["clusters"].collect()}
    assert sorted(clusters) == [0, 1, 2] and {c.size for c in clusters.values()} == {10}
    assert all(len(c.texts) == 3 for c in clusters.values())
    labels = [r.label for r in out["cluster_summaries"].collect()]
    assert len(labels) == 3 and any("printer" in label for label in labels)
    # A second run reads the finished stages; a stage named in redo is made again.
    again = run(raw.limit(0), options)
    assert again["tickets"].count() == 30
    options.redo = {"normalized"}
    assert run(raw.limit(0), options)["tickets"].count() == 0


def test_dashboard_frames_are_lazy_and_run(spark):
    tickets = spark.sql("""select 1 as ticket_id, 'solved' as status, timestamp'2024-01-20' as created_at,
                           timestamp'2024-01-21' as solved_at""")
    clusters = spark.sql("""select 1 as cluster_id, 'a' as label, 5 as size, 4 as previous_size, timestamp'2024-01-01' as created_at,
                            0.9D as confidence, 'r' as recommended_response, 'up' as trend_direction""")
    page = dashboard(tickets, clusters, "2024-01-31")
    assert {name: frame.count() for name, frame in page.items()}["weekly_trend"] == 8
    assert page["resolution"].first().avg_hours == 24.0
    assert page["growth"].first().growth_rate == 25.0
