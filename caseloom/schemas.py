"""Table schemas: the contract between stages."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns.
STATUSES = ["new", "open", "pending", "hold", "solved", "closed"]
PRIORITIES = ["low", "normal", "high", "urgent"]
AUTHOR_ROLES = ["agent", "end-user", "system"]
NODE_TYPES = ["Ticket", "Component", "ErrorSignature", "Environment", "Feature", "Fix"]
EDGE_TYPES = ["mentions", "belongs_to", "caused_by", "mitigated_by", "duplicate_of"]

COMMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("author_role", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("body_redacted", T.StringType()),
    T.StructField("is_public", T.BooleanType()),
])

ATTACHMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("url", T.StringType()),
])

RAW_TICKETS = T.StructType([
    T.StructField("ticket_key", T.StringType()),
    T.StructField("raw_payload", T.VariantType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("source", T.StringType()),
])

TICKETS = T.StructType([
    T.StructField("ticket_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("solved_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("ticket_type", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("product_line", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_redacted", T.StringType()),
    T.StructField("comments", T.ArrayType(COMMENT)),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("custom_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("assignee_id", T.LongType()),
    T.StructField("requester_id", T.LongType()),
    T.StructField("group_id", T.LongType()),
    T.StructField("ticket_fulltext", T.StringType()),
    T.StructField("pii_redacted_text", T.StringType()),
    T.StructField("normalized_at", T.TimestampType()),
])

ASSIGNMENTS = T.StructType([
    T.StructField("ticket_id", T.StringType()),
    T.StructField("cluster_id", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("assigned_at", T.TimestampType()),
    T.StructField("assigned_by", T.StringType()),
])

NODES = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])

EDGES = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("edge_type", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
