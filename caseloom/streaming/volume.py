"""Ticket volume per time window, kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_volume(events: DataFrame, time_column: str, width: str = "7 days", delay: str = "7 days") -> DataFrame:
    """Counts per window; rows later than the delay are left out by the watermark."""
    timed = events.withColumn(time_column, F.col(time_column).cast("timestamp"))
    return (timed.withWatermark(time_column, delay).groupBy(F.window(time_column, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def run_volume(events: DataFrame, time_column: str, root: str, width: str = "7 days", delay: str = "7 days"):
    """Write every update of a window as a part of its micro-batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/volume/batch_id={batch_id}")

    query = (windowed_volume(events, time_column, width, delay).writeStream.outputMode("update")
             .foreachBatch(step).option("checkpointLocation", f"{root}/_volume_progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def current_volume(spark: SparkSession, root: str) -> DataFrame:
    """Last update of every window."""
    parts = spark.read.option("basePath", f"{root}/volume").parquet(f"{root}/volume")
    return parts.groupBy("window_start", "window_end").agg(F.max_by("n", "batch_id").alias("n"))
