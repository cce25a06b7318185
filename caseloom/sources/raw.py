"""Raw ticket payloads: reading, unwrapping, planning, landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENVELOPE_DEPTH = 3
CHUNK_DAYS = 30


def tickets_of(document: Column) -> Column:
    """Ticket array of a document that is a list or ``{"tickets": [...]}``; otherwise empty."""
    return F.coalesce(F.try_variant_get(document, "$.tickets", "array<variant>"),
                      F.try_variant_get(document, "$", "array<variant>"), F.array().cast("array<variant>"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Payload rows of export files, each one JSON document.

    A document cannot be split, so this suits files of ordinary size; large
    exports are JSON lines, see ``read_raw_lines``.
    """
    files = spark.read.text(path, wholetext=True)
    found = tickets_of(F.try_parse_json(F.col("value")))
    return files.select(F.explode(found).alias("raw_payload"))


def parse_payloads(frame: DataFrame, column: str, *keep: str) -> DataFrame:
    """Payload variants of a text column; text that is no JSON gives no row.

    The one-element explode keeps the optimizer from copying the parse into
    every field read from the payload: each text is parsed once.
    """
    return frame.select(*keep, F.explode(F.array(F.try_parse_json(column))).alias("raw_payload")).where(
        F.col("raw_payload").isNotNull())


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Payload rows of JSON lines; lines that are no JSON give no row."""
    return parse_payloads(spark.read.text(path), "value")


def unwrap_envelope(document: Column, depth: int = ENVELOPE_DEPTH) -> Column:
    """Ticket array inside a tool answer.

    A list of ``{type: text, text: json}`` items gives the tickets of the first
    item whose text parses; a list without such items is itself the tickets; an
    object gives its ``tickets``, else what its ``content`` unwraps to.
    """
    none = F.array().cast("array<variant>")
    items = F.try_variant_get(document, "$", "array<variant>")
    texts = F.transform(items, lambda i: F.when(
        F.try_variant_get(i, "$.type", "string") == "text",
        F.try_parse_json(F.coalesce(F.try_variant_get(i, "$.text", "string"), F.lit("[]")))))
    first = F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))
    listed = F.when(first.isNotNull(), tickets_of(first)).otherwise(items)
    content = F.try_variant_get(document, "$.content", "variant")
    inner = unwrap_envelope(content, depth - 1) if depth > 1 else none
    return F.when(items.isNotNull(), listed).otherwise(F.coalesce(
        F.try_variant_get(document, "$.tickets", "array<variant>"),
        F.when(content.isNotNull(), inner), none))


def plan_chunks(spans: DataFrame, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Consecutive windows covering every (start_date, end_date) row.

    A span of at most one chunk is one window; the last window is cut to the end.
    """
    step = F.make_dt_interval(days=F.lit(chunk_days))
    starts = F.filter(F.sequence(F.col("start_date"), F.col("end_date"), step), lambda s: s < F.col("end_date"))
    starts = F.when(F.size(starts) == 0, F.array("start_date")).otherwise(starts)
    chunks = spans.select("*", F.posexplode(starts).alias("pos", "chunk_start"))
    return chunks.select(*spans.columns, (F.col("pos") + 1).alias("chunk_no"), "chunk_start",
                         F.least(F.col("chunk_start") + step, F.col("end_date")).alias("chunk_end"))


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First row per key in the given order; rows without a usable key are left out.

    Runs as an aggregate with a partial step: copies of a hot key are reduced
    where they lie.
    """
    usable = rows.where(F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0"))
    picked = usable.groupBy(F.col(key).alias("__key")).agg(
        F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def union_chunks(chunks: list) -> DataFrame:
    """Chunk frames as one, each row numbered by its chunk."""
    numbered = [c.withColumn("chunk_no", F.lit(i)) for i, c in enumerate(chunks)]
    result = numbered[0]
    for frame in numbered[1:]:
        result = result.unionByName(frame)
    return result


def landing_rows(payloads: DataFrame, *, job_id: str, ingested_at: Column, source: str = "helpdesk") -> DataFrame:
    """Rows of ``raw_tickets``.  A payload without an id is keyed by a hash of its text.

    A running number would differ between reruns; the hash stays the same.
    """
    p = F.col("raw_payload")
    key = F.coalesce(F.try_variant_get(p, "$.id", "string"), F.try_variant_get(p, "$.ticket_id", "string"),
                     F.concat(F.lit("#"), F.substring(F.md5(F.to_json(p)), 1, 16)))
    return payloads.select(key.alias("ticket_key"), p, ingested_at.alias("ingested_at"),
                           F.lit(job_id).alias("job_id"), F.lit(source).alias("source"))


def land_raw(rows: DataFrame, path: str, backup_path: str | None = None) -> None:
    """Write landing rows by job, the JSON backup first.  Rerunning a job replaces its own part only."""
    if backup_path:
        (rows.select("job_id", F.to_json("raw_payload").alias("value")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("job_id").text(backup_path))
    (rows.withColumn("raw_payload", F.to_json("raw_payload")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path).withColumnRenamed("raw_payload", "payload")
    return parse_payloads(stored, "payload", "ticket_key", "ingested_at", "job_id", "source")


def current_raw(landed: DataFrame) -> DataFrame:
    """Last written payload per ticket key.  The parsed payload travels as it is, so none is written out and parsed again."""
    row = F.struct("ticket_key", "raw_payload", "ingested_at", "job_id", "source")
    latest = landed.groupBy("ticket_key").agg(F.max_by(row, F.struct("ingested_at", "job_id")).alias("row"))
    kept = latest.select("row.*")
    return kept.select("ticket_key", "ingested_at", "job_id", "source", "raw_payload")
