"""Human corrections of cluster assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.operators.components import components
from caseloom.operators.joins import salted_join


def apply_feedback(assignments: DataFrame, edits: DataFrame) -> DataFrame:
    """Assignments after the edit log.

    ``edits``: edited_at, action, ticket_id, cluster_id, target_id.  ``move`` and
    ``split`` put a ticket into cluster ``cluster_id``, ``duplicate`` into the
    cluster of ticket ``target_id``, ``merge`` joins clusters ``cluster_id`` and
    ``target_id`` under the smaller number.  The newest edit of a ticket wins;
    merges apply to the result.
    """
    ticket_edits = edits.where(F.col("action").isin("move", "split", "duplicate"))
    newest = ticket_edits.groupBy("ticket_id").agg(
        F.max_by(F.struct("action", "cluster_id", "target_id"), "edited_at").alias("edit"))
    twin = assignments.select(F.col("ticket_id").cast("string").alias("twin_id"),
                              F.col("cluster_id").alias("twin_cluster"))
    wanted = newest.select("ticket_id", "edit.*").withColumnRenamed("cluster_id", "new_cluster")
    # Only duplicates need the join, and a ticket named by many of them is spread.
    twins = wanted.where(F.col("action") == "duplicate").select("ticket_id", F.col("target_id").cast("string").alias("twin_id"))
    twins = salted_join(twins, twin, "twin_id", "ticket_id", "left").select("ticket_id", F.col("twin_cluster").alias("new_cluster"))
    moved = wanted.where(F.col("action") != "duplicate").select("ticket_id", "new_cluster").unionByName(twins)
    placed = assignments.join(moved, "ticket_id", "left").select(
        "ticket_id", F.coalesce("new_cluster", "cluster_id").alias("cluster_id"),
        F.when(F.col("new_cluster").isNotNull(), F.lit("human")).otherwise(F.lit("auto")).alias("assigned_by"))
    merges = edits.where(F.col("action") == "merge").select(
        F.col("cluster_id").alias("src"), F.col("target_id").cast("bigint").alias("dst"))
    ends = merges.select(F.col("src").alias("node")).unionByName(merges.select(F.col("dst").alias("node")))
    merged = components(ends, merges).select(F.col("node").alias("cluster_id"), F.col("component").alias("merged_id"))
    return salted_join(placed, merged, "cluster_id", "ticket_id", "left").select(
        "ticket_id", F.coalesce("merged_id", "cluster_id").alias("cluster_id"),
        F.when(F.col("merged_id") != F.col("cluster_id"), F.lit("human")).otherwise(F.col("assigned_by")).alias("assigned_by"))


def duplicate_marks(edits: DataFrame) -> DataFrame:
    """(id, duplicate_of, score) of tickets marked as duplicates, newest mark per ticket."""
    marks = edits.where(F.col("action") == "duplicate")
    return marks.groupBy(F.col("ticket_id").alias("id")).agg(
        F.max_by("target_id", "edited_at").alias("duplicate_of")).withColumn("score", F.lit(1.0))
