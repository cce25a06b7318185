"""Mixing sources to target weights with Efraimidis-Spirakis keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.exact_dedup import row_key
from caseloom.operators.joins import salted_join
from caseloom.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of a source in one bucket of sorted keys, about.
BUCKET_ROWS = 4096
#: A table of sources up to this many rows is broadcast (about 100 bytes a row); a longer one is joined by salted keys.
BROADCAST_SOURCES = 10_000


def text_weight(text: Column, size: Column, floor: float = 0.1) -> Column:
    """A document quality weight from ``floor`` to 1: falls with the number of symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(floor), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add position, weight and target to (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes.  No target
    exceeds ``most`` times its source's size; what is above goes to the others by weight.  So a target is the smaller of
    the limit and weight times one common level.  Sorted by limit per weight, the level that would hold if just the
    sources before a row stopped at their limits rises as long as the row's source stops too and falls from then on: the
    level is the largest of them.  The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("position", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    limit = F.lit(float(most)) * F.col("source_size")
    weighed = weighed.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "position")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = weighed.select(
        "*", F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("__full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("__open"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("__all"))
    level = (F.col("__all") - F.col("__full")) / F.col("__open")
    found = levels.withColumn("__level", F.max(level).over(whole))
    return found.select("source", "source_size", "position",
                        F.least(F.col("limit"), F.col("weight") * F.col("__level")).alias("target"))


def mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): how often the mix takes each document.

    A document draws u from the hash of seed and identifier and gets the key -ln(u) / weight.  Whole epochs of a
    source come first; for the rest of its target the documents are sorted by key, and those are taken whose middle
    lies within the budget when sizes are summed up in that order.  So a source misses its target by half a document
    at most, and reruns agree.

    The sort is cut into buckets of keys: sums per bucket, a running sum over a source's buckets, and a window inside
    each bucket.  The number of buckets follows the source's rows, so a source with a third of all rows is many even
    groups.  A null text has size 0 and is never taken more often than its epochs; a null source is a source; ties of
    keys go by identifier; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = documents.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), text.alias("text"))
    base = base.select("id", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size"), "text")
    base = base.select("id", "source", "size", text_weight(F.col("text"), F.col("size")).alias("__weight"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 13), 16, 10)
    unit = (drawn.cast("double") + 0.5) / float(2**52)
    keyed = cut_lineage(base.select("id", "source", "size", (-F.log(unit) / F.col("__weight")).alias("key")))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    counted = cut_lineage(sizes)
    targets = source_targets(counted.drop("__rows"), weights, share, most)
    targets = cut_lineage(targets.join(
        counted.select(F.col("source").alias("__source"), "__rows"),
        F.col("source").eqNullSafe(F.col("__source"))).drop("__source").select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("epochs"),
        F.greatest(F.lit(1), F.floor(F.col("__rows") / bucket_rows)).alias("__buckets")).drop("__rows"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    keyed = keyed.withColumn("__name", _name(F.col("source")))
    named = targets.withColumn("__name", _name(F.col("source"))).drop("source")
    if targets.count() <= BROADCAST_SOURCES:
        placed = keyed.join(F.broadcast(named), "__name")
    else:
        placed = salted_join(keyed, named, "__name", "id")
    bucket = F.floor(F.col("key") / (F.col("key") + 1) * F.col("__buckets"))
    placed = placed.withColumn("bucket", bucket)
    sums = placed.groupBy("position", "bucket").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("position", "bucket", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("position", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("__upto", F.sum("size").over(inside)).join(offsets, ["position", "bucket"])
    middle = F.col("__offset") + F.col("__upto") - F.col("size") / 2
    copies = (F.col("epochs") + F.when((F.col("size") > 0) & (middle <= F.col("rest")), 1).otherwise(0)).cast("long")
    return ranked.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def repeat_by_mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                  **options) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as it is taken; cases as in ``mix``.

    Rows that repeat an identifier with different sources or sizes are each taken as often as their own draw says.
    """
    taken = mix(documents, id_column, text_column, source_column, **options).where("copies > 0")
    taken = taken.groupBy(row_key(F.col(id_column), F.col("size"), _name(F.col("source"))).alias("__key")).agg(F.max("copies").alias("__copies"))
    size = F.regexp_count(F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(WORDS)).cast("long")
    joined = documents.withColumn("__key", row_key(F.col(id_column), size, _name(F.col(source_column)))).join(taken, "__key")
    return joined.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(
        *[F.col(f"`{c}`") for c in documents.columns])


def _name(source: Column) -> Column:
    """A source as a key without nulls."""
    return F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(source.cast("string"), F.lit("")))
