"""Operational metrics over tickets and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Metric parameters of the ticket contract.
WEEKS = 8
MAX_RESOLUTION_HOURS = 720
GROWTH_PERCENT = 5
NEW_CLUSTER_DAYS = 7
DEFLECTABLE_CONFIDENCE = 0.7
MINUTES_PER_TICKET = 5


def week_bucket(created_at: Column, as_of: Column, anchor: str = "trailing") -> Column:
    """Bucket number; 0 is the last seven days (trailing) or the coming seven (literal)."""
    week = 7 * 24 * 3600 * 1_000_000
    age = F.unix_micros(as_of) - F.unix_micros(created_at)
    # Buckets include their start and exclude their end, so age k weeks exactly is in bucket k-1.
    trailing = F.ceil(age / F.lit(week)).cast("int") - 1
    if anchor == "trailing":
        return trailing
    if anchor == "literal":
        return trailing + 1
    raise ValueError(f"unknown anchor {anchor!r}")


def weekly_volume(tickets: DataFrame, as_of: str, *, anchor: str = "trailing", weeks: int = WEEKS,
                  created: str = "created_at") -> DataFrame:
    """Ticket count per week before ``as_of``, newest first, empty weeks as zero."""
    moment = F.lit(as_of).cast("timestamp")
    bucket = week_bucket(F.col(created), moment, anchor)
    shift = 1 if anchor == "trailing" else 0
    first, last = (moment - F.make_dt_interval(days=F.lit(7 * (n + shift))) for n in (weeks - 1, -1))
    # The plain time range reaches the scan, so files of other weeks are not read.
    counted = (tickets.where((F.col(created) >= first) & (F.col(created) < last))
               .select(bucket.alias("week_offset"))
               .groupBy("week_offset").agg(F.count(F.lit(1)).alias("n")))
    spine = tickets.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week_offset"))
    start = moment - F.make_dt_interval(days=7 * (F.col("week_offset") + shift))
    return spine.join(counted, "week_offset", "left").select(
        "week_offset", F.date_format(start, "yyyy-MM-dd").alias("week_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("ticket_count"))


def week_over_week(volume: DataFrame) -> DataFrame:
    """Change against the next older week; the input has one row per week, so one task is enough."""
    previous = F.lead("ticket_count").over(W.orderBy("week_offset"))
    change = F.when(previous > 0, (F.col("ticket_count") - previous) / previous * 100)
    return volume.withColumn("change_pct", change)


def resolution_hours(tickets: DataFrame) -> DataFrame:
    """Whole hours from creation to solution of finished tickets, outliers left out."""
    hours = F.expr("timestampdiff(HOUR, created_at, solved_at)")
    return (tickets.where(F.col("status").isin("solved", "closed"))
            .where(F.col("created_at").isNotNull() & F.col("solved_at").isNotNull())
            .select(hours.alias("hours"))
            .where((F.col("hours") > 0) & (F.col("hours") < MAX_RESOLUTION_HOURS)))


def resolution_stats(tickets: DataFrame) -> DataFrame:
    """Average, upper median and 90th percentile in hours.

    The hours are whole numbers below 720, so a histogram holds the whole
    distribution; the window below never sees more than 719 rows.
    """
    histogram = resolution_hours(tickets).groupBy("hours").agg(F.count(F.lit(1)).alias("n"))
    running = histogram.select(
        "hours", "n", F.sum("n").over(W.orderBy("hours").rowsBetween(W.unboundedPreceding, 0)).alias("cum"),
        F.sum("n").over(W.partitionBy()).alias("total"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("cum") > F.floor(F.col("total") * share), F.col("hours")))

    return running.agg(
        F.sum("n").alias("resolved"),
        (F.sum(F.col("hours") * F.col("n")) / F.sum("n")).alias("avg_hours"),
        at(0.5).alias("median_hours"), at(0.9).alias("p90_hours"),
    ).where(F.col("resolved") > 0)


def resolution_trend(tickets: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Average hours of tickets solved in the last period against the period before."""
    moment = F.lit(as_of).cast("timestamp")
    solved = F.col("solved_at")
    recent = F.when((solved < moment) & (solved >= moment - F.make_dt_interval(days=F.lit(days))), F.lit("now")).when(
        (solved < moment - F.make_dt_interval(days=F.lit(days)))
        & (solved >= moment - F.make_dt_interval(days=F.lit(2 * days))), F.lit("before"))
    hours = F.expr("timestampdiff(HOUR, created_at, solved_at)")
    rows = (tickets.where(F.col("status").isin("solved", "closed"))
            .select(hours.alias("hours"), recent.alias("period"))
            .where((F.col("hours") > 0) & (F.col("hours") < MAX_RESOLUTION_HOURS)))
    now = F.avg(F.when(F.col("period") == "now", F.col("hours")))
    before = F.avg(F.when(F.col("period") == "before", F.col("hours")))
    return rows.agg(now.alias("avg_hours"), before.alias("previous_avg_hours"),
                    (F.try_divide(now - before, before) * 100).alias("trend_pct"))


def growth_rows(clusters: DataFrame, as_of: str) -> DataFrame:
    """Growth rate and newness of every cluster."""
    moment = F.lit(as_of).cast("timestamp")
    previous = F.coalesce("previous_size", "size")
    age_days = F.floor((F.unix_micros(moment) - F.unix_micros("created_at")) / F.lit(86_400_000_000))
    rate = F.when(previous > 0, (F.col("size") - previous) / previous * 100).otherwise(F.lit(0.0))
    return clusters.select(
        "cluster_id", F.coalesce("label", F.lit("Unknown")).alias("label"),
        F.col("size").alias("current_size"), previous.alias("previous_size"), rate.alias("growth_rate"),
        F.coalesce(age_days <= NEW_CLUSTER_DAYS, F.lit(False)).alias("is_new"))


def cluster_growth(clusters: DataFrame, as_of: str, top: int = 10) -> DataFrame:
    rows = growth_rows(clusters, as_of)
    return (rows.where((F.abs("growth_rate") > GROWTH_PERCENT) | F.col("is_new"))
            .withColumn("growth_rate", F.round("growth_rate", 1))
            .orderBy(F.desc("growth_rate"), "cluster_id").limit(top))


def new_clusters(clusters: DataFrame, as_of: str) -> DataFrame:
    return growth_rows(clusters, as_of).agg(F.count_if("is_new").alias("new_clusters"))


def deflectable(clusters: DataFrame) -> DataFrame:
    return clusters.where((F.coalesce("confidence", F.lit(0.0)) >= DEFLECTABLE_CONFIDENCE)
                          & (F.coalesce("recommended_response", F.lit("")) != ""))


def deflection(clusters: DataFrame, tickets: DataFrame) -> DataFrame:
    """Tickets in deflectable clusters, their share of all tickets, and hours saved."""
    covered = deflectable(clusters).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_deflectable"))
    both = _beside(covered, tickets.agg(F.count(F.lit(1)).alias("total_tickets")))
    return both.select(
        "total_deflectable",
        F.coalesce(F.try_divide(F.col("total_deflectable"), F.col("total_tickets")) * 100,
                   F.lit(0.0)).alias("deflection_rate"),
        (F.col("total_deflectable") * MINUTES_PER_TICKET / 60).alias("estimated_hours_saved"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row results as one row, by a union and an aggregate instead of a join."""
    names = left.columns + right.columns
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def top_deflectable(clusters: DataFrame, top: int = 5) -> DataFrame:
    return (deflectable(clusters).select("cluster_id", "label", "size", "confidence")
            .orderBy(F.desc("size"), "cluster_id").limit(top))


def basic_stats(clusters: DataFrame, tickets: DataFrame) -> DataFrame:
    summary = clusters.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(F.col("trend_direction") == "up").alias("trending_up"))
    return _beside(summary, tickets.agg(F.count(F.lit(1)).alias("total_tickets"))).select(
        "total_clusters", "total_tickets", "avg_confidence", "trending_up")


def top_clusters(clusters: DataFrame, top: int = 5) -> DataFrame:
    return (clusters.select("cluster_id", F.coalesce("label", F.lit("")).alias("label"),
                            F.coalesce("size", F.lit(0)).alias("size"))
            .orderBy(F.desc("size"), "cluster_id").limit(top))


SORTABLE = ("size", "confidence", "created_at")


def _page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")


def list_clusters(clusters: DataFrame, *, limit: int = 50, offset: int = 0, sort_by: str = "size",
                  sort_order: str = "desc") -> DataFrame:
    """A page of clusters; column and direction come from a fixed list."""
    _page(limit, offset)
    if sort_by not in SORTABLE or sort_order not in ("asc", "desc"):
        raise ValueError("unknown sort")
    key = F.col(sort_by)
    key = key.desc_nulls_last() if sort_order == "desc" else key.asc_nulls_first()
    return cluster_view(clusters.orderBy(key, "cluster_id").offset(offset).limit(limit))


def cluster_view(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "cluster_id",
        F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("label"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "created_at")


def cluster_detail(clusters: DataFrame, cluster_id) -> DataFrame:
    return cluster_view(clusters.where(F.col("cluster_id") == F.lit(cluster_id)))


def ticket_filter(tickets: DataFrame, *, cluster_id=None, status: str | None = None) -> DataFrame:
    if cluster_id is not None:
        tickets = tickets.where(F.col("cluster_id") == F.lit(cluster_id))
    if status:
        tickets = tickets.where(F.col("status") == F.lit(status))
    return tickets


def list_tickets(tickets: DataFrame, *, limit: int = 50, offset: int = 0, cluster_id=None,
                 status: str | None = None) -> DataFrame:
    _page(limit, offset)
    kept = ticket_filter(tickets, cluster_id=cluster_id, status=status)
    page = kept.orderBy(F.col("created_at").desc_nulls_last(), "ticket_id").offset(offset).limit(limit)
    return page.select("ticket_id", F.coalesce("subject", F.lit("")).alias("subject"),
                       F.coalesce("status", F.lit("unknown")).alias("status"), "cluster_id", "created_at")


def ticket_detail(tickets: DataFrame, ticket_id) -> DataFrame:
    one = tickets.where(F.col("ticket_id") == F.lit(ticket_id))
    return one.withColumns({"subject": F.coalesce("subject", F.lit("")),
                            "status": F.coalesce("status", F.lit("unknown"))})


def work_slice(tickets: DataFrame, start: int, count: int, key: str = "ticket_id") -> DataFrame:
    return tickets.orderBy(key).offset(start).limit(count)
