import json

from pyspark.sql import functions as F

from caseloom.functions import fields as N
from caseloom.operators import normalize as Z
from caseloom.sources import raw as R

AT = "2025-02-01 00:00:00"


def normalized(spark, tickets, redaction=False):
    lines = spark.createDataFrame([(json.dumps(t),) for t in tickets], "value string")
    return Z.normalize(R.parse_payloads(lines, "value"), F.lit(AT).cast("timestamp"), redaction=redaction)


def one(spark, **fields):
    ticket = {"id": 1, "created_at": "2025-01-15T10:30:00Z", **fields}
    return normalized(spark, [ticket]).first()


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_timestamps(spark):
    values = ["2025-01-15T10:30:00Z", "2025-01-15", "2025-01-15T10:30:00+02:00", "20250115T103000", "20250115", "2025-1-5",
              "soon", "", None, "2025-13-45"]
    got = column(spark, values, lambda c: F.date_format(N.parse_timestamp(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2025-01-15 10:30", "2025-01-15 00:00", "2025-01-15 08:30", "2025-01-15 10:30", "2025-01-15 00:00", None,
                   None, None, None, None]


def test_status_and_priority(spark):
    assert column(spark, ["Open", "DELETED", None, "solved"], N.parse_status) == ["open", "open", "open", "solved"]
    assert column(spark, ["Urgent", "", None, "odd"], N.parse_priority) == ["urgent", None, None, None]


def test_platform_order_and_word_boundaries(spark):
    values = ["linux on windows", "a raspberry  pi here", "winning darwinism", "my iPad", "Ubuntu!", "éwin"]
    assert column(spark, values, N.detect_platform) == ["windows", "arm", None, "ios", "linux", None]


def test_version_comes_from_the_first_tag_with_one(spark):
    values = [["a", "v2.1", "3.4"], ["version 6.0.5"], ["x1"], []]
    assert column(spark, values, N.detect_version, "array<string>") == ["2.1", "6.0.5", None, None]


def test_whole_row(spark):
    row = one(spark, updated_at="soon", status=7, priority="HIGH", subject="S", description=None, tags=None,
              comments=[{"id": 1, "body": None, "public": False}, {"body": "  ", "public": "false"},
                        {"body": "b", "created_at": "2025-01-16"}, "stray"],
              custom_fields=[{"id": 5, "value": [1]}, {"id": 6, "value": True}, {"value": 1}, {"id": 5, "value": "x"}],
              attachments=[{"filename": "f", "id": 3}, 9], assignee_id=4)
    assert row.updated_at == row.created_at and row.status == "open" and row.priority == "high"
    assert row.tags == [] and row.platform is None and row.description == ""
    assert [c.author_role for c in row.comments] == ["system", "end-user", "end-user"]
    assert [c.is_public for c in row.comments] == [False, False, True]
    assert str(row.comments[0].created_at) == "2025-02-01 00:00:00"
    assert row.ticket_fulltext == "S\n\nb"
    assert row.custom_fields == {"6": "true", "5": '"x"'}
    assert [(a.id, a.filename, a.size) for a in row.attachments] == [(3, "f", 0)]
    assert row.errors == [] and row.pii_redacted_text == row.ticket_fulltext


def test_rejects(spark):
    both = normalized(spark, [{"id": 1}, {"id": 2, "created_at": 20250101}, {"created_at": "2025-01-01"}])
    assert sorted(r.ticket_id for r in Z.rejected(both).collect()) == ["1", "2"]
    assert [r.ticket_id for r in Z.accepted(both).collect()] == [""]


def test_redaction_flag(spark):
    ticket = {"id": 1, "created_at": "2025-01-01", "description": "mail a@b.com", "comments": [{"body": "ip 10.0.0.1"}]}
    row = normalized(spark, [ticket], redaction=True).first()
    assert row.description_redacted == "mail [REDACTED_EMAIL]"
    assert row.comments[0].body_redacted == "ip [REDACTED_IP]" and row.comments[0].body_text == "ip 10.0.0.1"
    assert row.pii_redacted_text == "mail [REDACTED_EMAIL]\n\nip [REDACTED_IP]"


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("c", 1, "q")], "k string, at int, v string")
    got = {r.k: r.v for r in Z.upsert_latest(old, new, "k", "at").collect()}
    assert got == {"a": "z", "b": "w", "c": "q"}
