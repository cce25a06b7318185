"""Key joins of the ticket tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def delta(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return incoming.join(known.select(key), key, "left_anti")


def already_known(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return incoming.join(known.select(key), key, "left_semi")


def split_resumable(tickets: DataFrame, done: DataFrame, key: str = "ticket_id") -> tuple[DataFrame, DataFrame]:
    """(finished rows, rows still to do).  Only rows that ended well count as finished."""
    finished = done.where(F.col("status") == "ok")
    return finished.join(tickets.select(key), key, "left_semi"), delta(tickets, finished, key)


def representative_texts(representatives: DataFrame, texts: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Texts of each cluster's representatives in rank order; ids without a text are left out.

    ``representatives`` holds at most a handful of rows per cluster, so the list is small.
    """
    found = representatives.join(texts.select(key, "text"), key)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy("cluster_id").agg(F.transform(ordered, lambda r: r["text"]).alias("texts"))


def with_labels(frame: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add the cluster label, null for an unknown cluster."""
    return frame.join(clusters.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id", "left")


def salted_join(left: DataFrame, right: DataFrame, keys: str | list, spread_by: str, how: str = "inner",
                salts: int = 32) -> DataFrame:
    """Join many rows per key to one row per key without meeting a hot key in one task.

    Left rows of a key are spread over ``salts`` sub-keys by ``spread_by``; the
    right side, one row per key, is copied to each of them.  Meant for a right
    side much shorter than the left one.
    """
    keys = [keys] if isinstance(keys, str) else keys
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.withColumn("__salt", salt).join(
        right.withColumn("__salt", copies), [*keys, "__salt"], how).drop("__salt")


def long_join(left: DataFrame, right: DataFrame, keys: str | list, how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input, sorted on both sides.

    Spark guesses the size of narrow columns taken from wide rows far too low and would send such a table whole through
    the driver.  A hot key of the left side is cut by the adaptive skew join.
    """
    return left.join(right.hint("merge"), keys, how)
