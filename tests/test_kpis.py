import random
from datetime import datetime, timedelta

import pytest

from caseloom.operators import clusters as C, kpis as K, quality as Q

AS_OF = datetime(2024, 1, 31)


def tickets(spark, times):
    return spark.createDataFrame([(t,) for t in times], "created_at timestamp")


def test_weekly_edges(spark):
    week = timedelta(days=7)
    times = [AS_OF, AS_OF - timedelta(microseconds=1), AS_OF - week, AS_OF - week - timedelta(microseconds=1),
             AS_OF + timedelta(hours=1), AS_OF - 8 * week, AS_OF - 8 * week - timedelta(microseconds=1)]
    rows = K.week_over_week(K.weekly_volume(tickets(spark, times), "2024-01-31")).orderBy("week_offset").collect()
    assert [r.ticket_count for r in rows] == [2, 1, 0, 0, 0, 0, 0, 1]
    assert rows[0].week_start == "2024-01-24" and rows[0].change_pct == 100.0
    assert rows[1].change_pct is None and rows[6].change_pct == -100.0 and rows[7].change_pct is None
    literal = K.weekly_volume(tickets(spark, times), "2024-01-31", anchor="literal").orderBy("week_offset").collect()
    assert [r.ticket_count for r in literal] == [2, 2, 1, 0, 0, 0, 0, 0] and literal[0].week_start == "2024-01-31"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 101])
def test_resolution_equals_the_sorted_list(spark, n):
    rng = random.Random(n)
    hours = [rng.randint(1, 719) for _ in range(n)]
    rows = [("solved", AS_OF, AS_OF + timedelta(hours=h, minutes=59)) for h in hours]
    rows += [("closed", AS_OF, AS_OF), ("closed", AS_OF, AS_OF + timedelta(hours=720)), ("open", AS_OF, AS_OF + timedelta(hours=5)),
             ("solved", AS_OF, AS_OF - timedelta(hours=5)), ("solved", AS_OF, None)]
    got = K.resolution_stats(spark.createDataFrame(rows, "status string, created_at timestamp, solved_at timestamp")).collect()
    if n == 0:
        assert got == []
        return
    ordered = sorted(hours)
    assert (got[0].resolved, got[0].median_hours, got[0].p90_hours) == (n, ordered[n // 2], ordered[int(n * 0.9)])
    assert got[0].avg_hours == pytest.approx(sum(hours) / n)


def test_growth_rules(spark):
    old = AS_OF - timedelta(days=100)
    rows = [(1, "a", 10, 0, old), (2, "b", 10, None, old), (3, "c", 105, 100, old), (4, None, 106, 100, old),
            (5, "e", 3, 3, AS_OF - timedelta(days=7.9)), (6, "f", 3, 3, AS_OF - timedelta(days=8)), (7, "g", 50, 100, old)]
    frame = spark.createDataFrame(rows, "cluster_id int, label string, size int, previous_size int, created_at timestamp")
    got = [(r.cluster_id, r.label, r.growth_rate, r.is_new) for r in K.cluster_growth(frame, "2024-01-31").collect()]
    assert got == [(4, "Unknown", 6.0, False), (5, "e", 0.0, True), (7, "g", -50.0, False)]
    assert K.new_clusters(frame, "2024-01-31").first().new_clusters == 1


def test_deflection_and_pages(spark):
    rows = [(1, 10, 0.7, "r", "up"), (2, 20, 0.9, "", "up"), (3, 30, 0.69, "r", None), (4, 5, None, "r", "up")]
    frame = spark.createDataFrame(rows, "cluster_id int, size int, confidence double, recommended_response string, trend_direction string")
    frame = frame.selectExpr("*", "'x' as label", "cast(null as string) as priority", "current_timestamp() as created_at")
    hundred = spark.range(100)
    got = K.deflection(frame, hundred).first()
    assert (got.total_deflectable, got.deflection_rate) == (10, 10.0) and got.estimated_hours_saved == pytest.approx(50 / 60)
    assert K.deflection(frame, spark.range(0)).first().deflection_rate == 0.0
    stats = K.basic_stats(frame, hundred).first()
    assert (stats.total_clusters, stats.total_tickets, stats.trending_up) == (4, 100, 3)
    assert stats.avg_confidence == pytest.approx((0.7 + 0.9 + 0.69) / 4)
    page = K.list_clusters(frame, sort_by="confidence", sort_order="asc", limit=2).collect()
    assert [r.cluster_id for r in page] == [4, 3] and page[0].confidence == 0.0 and page[0].priority == "medium"
    for bad in ({"sort_by": "label"}, {"limit": 0}, {"sort_order": "up"}):
        with pytest.raises(ValueError):
            K.list_clusters(frame, **bad)


def test_coverage_and_purity(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (-1, "z")]
    frame = spark.createDataFrame(rows, "cluster_id int, truth string")
    assert Q.purity(frame).first().purity == pytest.approx(3 / 4)
    row = Q.coverage(frame).first()
    assert (row.n_assigned, row.needs_triage, row.coverage) == (4, 1, 0.8)


def test_weeks_per_cluster(spark):
    frame = spark.createDataFrame([(1, AS_OF - timedelta(days=1)), (1, AS_OF - timedelta(days=8)), (2, AS_OF - timedelta(days=90))],
                                  "cluster_id int, created_at timestamp")
    got = {r.cluster_id: r.trend for r in C.trend_data(C.cluster_weeks(frame, "2024-01-31")).collect()}
    assert got == {1: [0] * 6 + [1, 1], 2: [0] * 8}
