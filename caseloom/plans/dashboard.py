"""All figures of the operations page, as one set of lazy frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseloom.operators import kpis


def dashboard(tickets: DataFrame, clusters: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Each figure is its own frame; nothing runs before the caller asks for it."""
    return {
        "basic": kpis.basic_stats(clusters, tickets),
        "weekly_trend": kpis.week_over_week(kpis.weekly_volume(tickets, as_of)),
        "growth": kpis.cluster_growth(clusters, as_of),
        "new_clusters": kpis.new_clusters(clusters, as_of),
        "resolution": kpis.resolution_stats(tickets),
        "resolution_trend": kpis.resolution_trend(tickets, as_of),
        "deflection": kpis.deflection(clusters, tickets),
        "top_deflectable": kpis.top_deflectable(clusters),
        "top_clusters": kpis.top_clusters(clusters),
    }
