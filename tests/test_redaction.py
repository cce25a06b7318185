import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import redaction as R

GOLDEN = [
    ("https://user:pass@host.com/a", "https://user:[REDACTED_EMAIL]/a"),
    ("https://u:p@localhost/a", "[REDACTED_URL_CREDS]"),
    ("4111111111111111", "[REDACTED_CC]"),
    ("4111-1111-1111-1111", "[REDACTED_LICENSE]"),
    ("order 123456789 id", "order [REDACTED_SSN] id"),
    ("build 10.20.30.40 ok", "build [REDACTED_IP] ok"),
    ("(555) 123-4567", "([REDACTED_PHONE]"),
    ("+1 555 123 4567", "+[REDACTED_PHONE]"),
    ("call +44 20 7946 0958 now", "call +44 20 7946 0958 now"),
    ("x+44 20 7946 0958", "x[REDACTED_PHONE_INTL]"),
    ("this does look like nothing special", "[REDACTED_LICENSE] nothing special"),
    ("token: abcdefghijklmnopqrstuvwxyz", "[REDACTED_API_KEY]"),
    ("Dr. Jane Doe Smith", "[REDACTED_NAME_PREFIX] Smith"),
    ("éa@b.com", "éa@b.com"),
    ("", ""),
    (None, None),
]


def test_golden(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = [r.x for r in rows.select("i", R.redact(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [want for _, want in GOLDEN]


def test_lenient_mode_keeps_names(spark):
    row = spark.createDataFrame([("Dr. Jane Doe",)], "t string")
    assert row.select(R.redact(F.col("t"), strict=False)).first()[0] == "Dr. Jane Doe"


def test_counts_follow_the_changing_text(spark):
    rows = spark.createDataFrame([("a@b.com c@d.org 10.0.0.1",), ("clean",), (None,)], "t string")
    got = R.redact_with_stats(rows, "t").collect()
    assert got[0].counts == {"EMAIL": 2, "IP": 1} and got[1].counts == {}
    assert got[0].redacted_text == "[REDACTED_EMAIL] [REDACTED_EMAIL] [REDACTED_IP]"


def test_same_as_regular_expressions_of_python(spark):
    import duckdb
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    expected = []
    for text in texts:
        for name, pattern, fold in R.PATTERNS:
            text = re.sub(pattern, f"[REDACTED_{name}]", text, flags=re.I if fold else 0)
        expected.append(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in rows.select("i", R.redact(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == expected
    assert not any(re.search(R.PATTERNS[0][1], t, re.I) for t in got)


@pytest.mark.parametrize("name", ["redact", "redact_stats"])
def test_counting_does_not_repeat_the_chain(spark, name):
    """The plan must grow with the number of patterns, not with its square."""
    import __spark_entry__ as entry_points
    plan = entry_points.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace(") <= 2 * len(R.PATTERNS)


def test_the_cheap_look_passes_every_match(spark):
    rows = spark.createDataFrame([(t,) for t, _ in GOLDEN if t is not None], "t string")
    for name, pattern, _ in R._active(True):
        missed = rows.where(F.regexp_like("t", pattern) & ~R._may_match(name, F.col("t")))
        assert missed.count() == 0, name
    assert set(R.NEEDS) <= {name for name, _, _ in R.PATTERNS}
    both = R.redact_with_stats(rows, "t").where(F.col("redacted_text") != R.redact(F.col("t")))
    assert both.count() == 0
