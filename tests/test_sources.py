import json

from pyspark.sql import functions as F

from caseloom.operators import joins as J
from caseloom.sources import raw as R, tables as S


def test_export_files(spark, tmp_path):
    forms = {"list": [{"id": 1}, {"id": 2}], "wrapped": {"tickets": [{"id": 3}]}, "text": "just text", "empty": []}
    for name, content in forms.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    (tmp_path / "broken.json").write_text("{")
    got = R.read_raw(spark, str(tmp_path)).select(F.try_variant_get("raw_payload", "$.id", "int")).collect()
    assert sorted(r[0] for r in got) == [1, 2, 3]


def test_envelopes(spark):
    inner = json.dumps({"tickets": [{"id": 1}, {"id": 2}]})
    cases = [[{"type": "text", "text": "{bad"}, {"type": "text", "text": inner}], {"tickets": [{"id": 3}]},
             {"content": [{"type": "text", "text": json.dumps([{"id": 4}])}]}, {"content": {"tickets": [{"id": 5}]}},
             [{"id": 6}], {"other": 1}, "text", 7]
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, v string")
    ids = F.transform(R.unwrap_envelope(F.parse_json("v")), lambda t: F.try_variant_get(t, "$.id", "int"))
    got = [list(r.x) for r in frame.select("i", ids.alias("x")).orderBy("i").collect()]
    assert got == [[1, 2], [3], [4], [5], [6], [], [], []]


def test_chunks(spark):
    spans = spark.sql("""select * from values (1, timestamp'2024-01-01', timestamp'2024-03-10'), (2, timestamp'2024-01-01',
        timestamp'2024-01-31'), (3, timestamp'2024-01-01', timestamp'2024-01-01') as t(span, start_date, end_date)""")
    got = [(r.span, r.chunk_no, str(r.chunk_start)[:10], str(r.chunk_end)[:10])
           for r in R.plan_chunks(spans).orderBy("span", "chunk_no").collect()]
    assert got == [(1, 1, "2024-01-01", "2024-01-31"), (1, 2, "2024-01-31", "2024-03-01"), (1, 3, "2024-03-01", "2024-03-10"),
                   (2, 1, "2024-01-01", "2024-01-31"), (3, 1, "2024-01-01", "2024-01-01")]


def test_first_row_stays_and_rows_without_id_go(spark):
    one = spark.createDataFrame([(7, "a"), (0, "b"), (None, "c")], "id bigint, v string")
    two = spark.createDataFrame([(7, "d"), (8, "e")], "id bigint, v string")
    united = R.union_chunks([one, two])
    got = {r.id: r.v for r in R.keep_first(united, "id", ["chunk_no", "v"]).collect()}
    assert got == {7: "a", 8: "e"}
    again = R.keep_first(R.keep_first(united, "id", ["chunk_no", "v"]), "id", ["chunk_no", "v"])
    assert {r.id: r.v for r in again.collect()} == got


def test_landing_is_repeatable_and_last_write_wins(spark, tmp_path):
    path, backup = str(tmp_path / "raw"), str(tmp_path / "backup")

    def land(job, at, docs):
        lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
        rows = R.landing_rows(R.parse_payloads(lines, "value"), job_id=job, ingested_at=F.lit(at).cast("timestamp"))
        R.land_raw(rows, path, backup)
    land("j1", "2024-01-01", [{"id": 1, "v": "a"}, {"ticket_id": 2, "v": "b"}, {"v": "no id"}])
    land("j2", "2024-01-02", [{"id": 1, "v": "c"}])
    land("j2", "2024-01-02", [{"id": 1, "v": "c"}])
    landed = R.read_landed(spark, path)
    assert landed.count() == 4 and R.read_raw_lines(spark, backup).count() == 4
    current = R.current_raw(landed).select("ticket_key", F.try_variant_get("raw_payload", "$.v", "string").alias("v")).collect()
    got = {r.ticket_key: r.v for r in current}
    assert got["1"] == "c" and got["2"] == "b" and len(got) == 3 and "no id" in got.values()


def test_reports_and_tables(spark, tmp_path):
    row = [(1, 'a "b", c', "d", ["s"], "e", "r" * 600, "p", 0.8)]
    frame = spark.createDataFrame(row, "cluster_id int, label string, issue_description string, common_symptoms array<string>, "
                                       "environment string, recommended_response string, deflection_path string, confidence double")
    S.csv_report(frame, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.label == 'a "b", c' and len(back.recommended_response) == 500 and "common_symptoms" not in back.asDict()
    S.json_report(frame, str(tmp_path / "json"), F.lit("2024-01-01"), F.lit(9))
    report = spark.read.json(str(tmp_path / "json")).first()
    assert report.total_tickets == 9 and report.cluster.common_symptoms == ["s"]
    assert S.exists(spark, str(tmp_path / "csv")) and not S.exists(spark, str(tmp_path / "none"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 2)], "ticket_id string, vector array<float>, written_at int")
    assert S.latest_vectors(vectors, 2).first().vector == [0.0, 1.0]


def test_salted_join_equals_join(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    assert sorted(J.salted_join(left, right, "k", "id").collect()) == sorted(left.join(right, "k").collect())


def test_representative_texts_keep_rank_order(spark):
    reps = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "missing")], "cluster_id int, rank int, ticket_id string")
    texts = spark.createDataFrame([("a", "first"), ("b", "second")], "ticket_id string, text string")
    assert J.representative_texts(reps, texts).first().texts == ["first", "second"]


def test_current_payloads_are_not_written_out_again(spark, capsys):
    rows = [("1", '{"id":1,"v":"old"}', "2024-01-01", "a"), ("1", '{"id":1,"v":"new"}', "2024-01-02", "b"), ("2", "null", "2024-01-01", "a")]
    stored = spark.createDataFrame(rows, "ticket_key string, payload string, at string, job_id string").select(
        "ticket_key", "payload", F.col("at").cast("timestamp").alias("ingested_at"), "job_id", F.lit("s").alias("source"))
    current = R.current_raw(R.parse_payloads(stored, "payload", "ticket_key", "ingested_at", "job_id", "source"))
    assert current.columns == ["ticket_key", "ingested_at", "job_id", "source", "raw_payload"]
    got = current.select("ticket_key", "job_id", F.try_variant_get("raw_payload", "$.v", "string")).collect()
    assert sorted(map(tuple, got)) == [("1", "b", "new"), ("2", "a", None)]
    current.explain("extended")
    assert "to_json" not in capsys.readouterr().out
