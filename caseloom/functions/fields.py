"""Column expressions that turn raw payload fields into typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.schemas import PRIORITIES, STATUSES

# Platform word lists, tried in this order.
PLATFORM_WORDS = [
    ("windows", r"windows|win|win10|win11|w10|w11"),
    ("linux", r"linux|ubuntu|debian|centos|rhel|fedora"),
    ("macos", r"macos|mac|osx|darwin|macbook|imac"),
    ("arm", r"arm|arm64|aarch64|raspberry\s*pi"),
    ("ios", r"ios|iphone|ipad"),
    ("android", r"android"),
]
# Fixed value: a release number, with or without a leading v / version.
VERSION_PATTERN = r"\b(?:v(?:ersion)?\.?\s*)?(\d+\.\d+(?:\.\d+)?)\b"

_DASHED = r"^\d{4}-\d{2}-\d{2}(?:[T ].+)?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2}))?(Z|[+-]\d{2}:?\d{2})?$"


def parse_timestamp(value: Column) -> Column:
    """ISO-8601 text to a timestamp; anything else is null."""
    compact = F.regexp_replace(value, F.lit(_COMPACT), F.lit("$1-$2-$3T$4:$5:$6$7"))
    compact = F.regexp_replace(compact, F.lit("T::"), F.lit(""))
    return F.when(value.rlike(_DASHED), F.try_to_timestamp(value)).when(
        value.rlike(_COMPACT), F.try_to_timestamp(compact))


def parse_status(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin(STATUSES), lowered).otherwise(F.lit("open"))


def parse_priority(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin(PRIORITIES), lowered)


def detect_platform(text: Column) -> Column:
    """First platform, in list order, with a whole-word hit in the text."""
    result = F.lit(None).cast("string")
    for name, words in reversed(PLATFORM_WORDS):
        result = F.when(text.rlike(rf"(?iU)\b(?:{words})\b"), F.lit(name)).otherwise(result)
    return result


def detect_version(tags: Column) -> Column:
    """Release number of the first tag that carries one."""
    found = F.transform(tags, lambda tag: F.regexp_extract(tag, f"(?iU){VERSION_PATTERN}", 1))
    return F.get(F.filter(found, lambda v: v != ""), F.lit(0))


def build_fulltext(subject: Column, description: Column, bodies: Column) -> Column:
    """Parts that are not blank, untrimmed, separated by an empty line."""
    parts = F.concat(F.array(subject, description), bodies)
    return F.array_join(F.filter(parts, lambda p: p.rlike(r"(?U)\S")), "\n\n")


# Typed view of a raw payload.  Fields whose JSON type matters stay variants.
PAYLOAD = (
    "struct<id:string, url:string, created_at:variant, updated_at:variant, solved_at:variant, status:variant, "
    "priority:variant, type:string, subject:variant, description:variant, tags:array<string>, "
    "comments:array<struct<id:bigint, author_id:bigint, created_at:variant, body:string, public:variant>>, "
    "custom_fields:array<struct<id:string, value:variant>>, "
    "attachments:array<struct<id:bigint, file_name:string, filename:string, content_type:string, size:bigint, "
    "content_url:string>>, assignee_id:bigint, requester_id:bigint, group_id:bigint>")


def as_text(value: Column) -> Column:
    """A variant that is a string; null for any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def items(column: Column) -> Column:
    """Array entries that are present; empty when the field is missing or no array."""
    kind = F.filter(column, lambda i: i.isNotNull())
    return F.coalesce(kind, F.array())


def normalize_comments(comments: Column, fallback_time: Column) -> Column:
    """Comment structs; a comment marked ``public: false`` is a system note."""

    def one(item: Column) -> Column:
        # Only a JSON false hides a comment, the text "false" does not.
        hidden = F.coalesce((F.schema_of_variant(item["public"]) == "BOOLEAN")
                            & ~F.try_variant_get(item["public"], "$", "boolean"), F.lit(False))
        body = F.coalesce(item["body"], F.lit(""))
        return F.struct(
            item["id"].alias("id"), item["author_id"].alias("author_id"),
            F.when(hidden, F.lit("system")).otherwise(F.lit("end-user")).alias("author_role"),
            F.coalesce(parse_timestamp(as_text(item["created_at"])), fallback_time).alias("created_at"),
            body.alias("body_text"), body.alias("body_redacted"),
            F.coalesce(F.try_variant_get(item["public"], "$", "boolean"), F.lit(True)).alias("is_public"))

    return F.transform(comments, one)


def flatten_custom_fields(fields: Column) -> Column:
    """``[{id, value}]`` to a map of JSON text; the last value of an id stays."""
    last = F.filter(fields, lambda f, i: f["id"].isNotNull() & ~F.exists(
        F.slice(fields, i + 2, F.size(fields)), lambda later: later["id"].eqNullSafe(f["id"])))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(
        f["id"].alias("key"), F.to_json(f["value"]).alias("value"))))


def normalize_attachments(attachments: Column) -> Column:
    """Attachment metadata with the defaults for missing fields."""
    return F.transform(attachments, lambda a: F.struct(
        a["id"].alias("id"), F.coalesce(a["file_name"], a["filename"], F.lit("")).alias("filename"),
        F.coalesce(a["content_type"], F.lit("")).alias("content_type"),
        F.coalesce(a["size"], F.lit(0)).alias("size"), a["content_url"].alias("url")))
