"""Conversation threads from a table of single comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.functions.text import PROMPT_CHARS, TRUNCATION_MARK, density, thread_line, word_count

SEPARATOR = "\n\n"
BLOCK_TURNS = 256


def thread_lines(turns: DataFrame) -> DataFrame:
    """(ticket_id, turn, line) from (ticket_id, turn, role, name, body)."""
    return turns.select("ticket_id", "turn", thread_line(F.col("role"), F.col("name"), F.col("body")).alias("line"))


def prompt_threads(lines: DataFrame, limit: int = PROMPT_CHARS) -> DataFrame:
    """(ticket_id, thread, n_turns): the joined thread, its middle cut out beyond ``limit`` characters.

    A thread may be longer than a task can hold, but only its first and last
    ``limit / 2`` characters can be part of the result.  Lengths are summed per
    block of turns, blocks and turns that lie wholly inside the cut are left
    out, and only what remains of a thread is put together.
    """
    half, gap = limit // 2, len(SEPARATOR)
    sized = lines.select("ticket_id", "turn", "line", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
                         (F.length("line") + gap).cast("bigint").alias("size"))
    blocks = sized.groupBy("ticket_id", "block").agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("n"))
    ticket = W.partitionBy("ticket_id")
    past = ticket.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "ticket_id", "block", "block_size", F.coalesce(F.sum("block_size").over(past), F.lit(0)).alias("before"),
        (F.sum("block_size").over(ticket) - gap).alias("total"), F.sum("n").over(ticket).alias("n_turns"))

    def needed(before, size):
        return (F.col("total") <= limit) | (before < half) | (F.col("total") - before - size < half)

    kept = blocks.where(needed(F.col("before"), F.col("block_size"))).drop("block_size")
    inside = W.partitionBy("ticket_id", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(kept, ["ticket_id", "block"]).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.where(needed(F.col("before"), F.col("size")))
    part = F.struct("turn", "line", "before", "size")
    gathered = placed.groupBy("ticket_id", "total", "n_turns").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    head = F.filter("parts", lambda p: p["before"] < half)
    tail = F.filter("parts", lambda p: F.col("total") - p["before"] - p["size"] < half)
    whole = F.array_join(F.transform("parts", lambda p: p["line"]), SEPARATOR)
    first = F.array_join(F.transform(head, lambda p: F.concat(p["line"], F.lit(SEPARATOR))), "")
    last = F.array_join(F.transform(tail, lambda p: F.concat(F.lit(SEPARATOR), p["line"])), "")
    cut = F.concat(F.substring(first, 1, half), F.lit(TRUNCATION_MARK), F.right(last, F.lit(half)))
    return gathered.select("ticket_id", F.when(F.col("total") <= limit, whole).otherwise(cut).alias("thread"), "n_turns")


def thread_words(turns: DataFrame) -> DataFrame:
    """Word count and density class per ticket, counted before the shuffle."""
    counted = turns.groupBy("ticket_id").agg(F.sum(word_count(F.col("body"))).cast("bigint").alias("words"))
    return counted.withColumn("density", density(F.col("words")))
