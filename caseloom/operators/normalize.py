"""Raw payloads to canonical ticket rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import fields as N
from caseloom.functions.redaction import redact
from caseloom.schemas import TICKETS


def normalize(raw: DataFrame, normalized_at: Column, *, redaction: bool = False,
              payload: str = "raw_payload") -> DataFrame:
    """One canonical row per payload, plus ``errors`` naming the fields that failed.

    ``created_at`` must be there; ``subject`` and ``description`` must be text where they are given.

    ``payload`` is a variant column, best from ``sources.raw``, whose readers parse each text once.
    """
    # One typed read per payload.  The one-element explode keeps the optimizer from repeating it per field.
    typed = raw.select(F.explode(F.array(F.try_variant_get(payload, "$", N.PAYLOAD))).alias("p")).select("p.*")
    wrong = F.filter(F.array(*[F.when(F.col(c).isNotNull() & ~F.schema_of_variant(F.col(c)).isin("STRING", "VOID"), F.lit(c))
                               for c in ("subject", "description")]), lambda e: e.isNotNull())
    typed = typed.withColumn("wrong", wrong)
    typed = typed.withColumns({c: N.as_text(F.col(c)) for c in (
        "created_at", "updated_at", "solved_at", "status", "priority", "subject", "description")})
    parsed = typed.select(
        F.coalesce("id", F.lit("")).alias("ticket_id"), F.col("url").alias("source_url"),
        N.parse_timestamp(F.col("created_at")).alias("created_at"),
        N.parse_timestamp(F.col("updated_at")).alias("updated_given"),
        N.parse_timestamp(F.col("solved_at")).alias("solved_at"),
        N.parse_status(F.col("status")).alias("status"), N.parse_priority(F.col("priority")).alias("priority"),
        F.col("type").alias("ticket_type"), F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("description", F.lit("")).alias("description"), N.items(F.col("tags")).alias("tags"),
        N.normalize_comments(N.items(F.col("comments")), normalized_at).alias("comments"),
        N.items(F.col("custom_fields")).alias("fields"),
        N.normalize_attachments(N.items(F.col("attachments"))).alias("attachments"),
        "assignee_id", "requester_id", "group_id", "wrong",
    ).withColumn("custom_fields", N.flatten_custom_fields(F.col("fields")))
    bodies = F.transform("comments", lambda c: c["body_text"])
    all_text = F.concat_ws(" ", "subject", "description", F.array_join("tags", " "))
    clean = redact if redaction else (lambda c: c)
    if redaction:
        parsed = parsed.withColumn("comments", F.transform(
            "comments", lambda c: c.withField("body_redacted", redact(c["body_text"]))))
    full = parsed.withColumn("ticket_fulltext", N.build_fulltext(F.col("subject"), F.col("description"), bodies))
    full = full.withColumns({
        "updated_at": F.coalesce("updated_given", "created_at"),
        "brand": F.lit(None).cast("string"),
        "product_line": F.lit(None).cast("string"),
        "platform": N.detect_platform(all_text),
        "version": N.detect_version(F.col("tags")),
        "description_redacted": clean(F.col("description")),
        "pii_redacted_text": clean(F.col("ticket_fulltext")),
        "normalized_at": normalized_at,
        "errors": F.concat(F.filter(F.array(F.when(F.col("created_at").isNull(), F.lit("created_at"))),
                                    lambda e: e.isNotNull()), F.col("wrong")),
    })
    return full.select(*TICKETS.fieldNames(), "errors")


def payload_errors(payload: Column) -> Column:
    """The ``errors`` of ``normalize`` for one payload, without the other fields."""
    def field(name: str) -> Column:
        return F.try_variant_get(payload, f"$.{name}", "variant")

    created = N.parse_timestamp(N.as_text(field("created_at")))
    wrong = [F.when(field(c).isNotNull() & ~F.schema_of_variant(field(c)).isin("STRING", "VOID"), F.lit(c)) for c in ("subject", "description")]
    return F.filter(F.array(F.when(created.isNull(), F.lit("created_at")), *wrong), lambda e: e.isNotNull())


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") == 0).drop("errors")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") > 0).select("ticket_id", "errors")


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key; on equal order values the incoming row stays.

    An aggregate with a partial step, so copies of one key meet as one row per
    task and not as one large group.
    """
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    columns = existing.columns
    picked = both.groupBy(F.col(key).alias("__key")).agg(
        F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("__side"))).alias("__row"))
    return picked.select("__row.*")
