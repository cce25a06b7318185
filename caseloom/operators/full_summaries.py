"""Summaries from a ticket's full context: thread, people, custom fields and images joined into one prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from caseloom.functions import prompts, text as X
from caseloom.operators.inference import Model, summarize
from caseloom.operators.threads import prompt_threads, thread_lines, thread_words
from caseloom.session import cut_lineage

#: No cut: as long as a text column can be.
WHOLE = (1 << 31) - 2
_FIELDS = "array<struct<name:string,value:string>>"
_IMAGES = "array<struct<filename:string,description:string>>"
_TEXTS = ("subject", "description", "status", "priority", "requester", "agent", "organization", "region")


def full_context(tickets: DataFrame, turns: DataFrame, images: DataFrame | None = None, *, limit: int = X.PROMPT_CHARS) -> DataFrame:
    """(ticket_id, subject, content, prompt, prompt_sha256, cut), one row per ticket.

    ``tickets`` holds ticket_id and whichever it has of subject, description, status, priority, created_at, requester,
    agent, organization, region, tags and custom_fields (structs of name and value); others count as null.  ``turns`` are
    (ticket_id, turn, role, name, body), ``images`` what ``describe_images`` returns.  A thread beyond ``limit`` characters
    loses its middle and is marked by ``cut``; ``WHOLE`` never cuts.  A ticket without turns shows its description.
    """
    have = set(tickets.columns)

    def given(name: str, kind: str = "string"):
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    base = tickets.select(
        "ticket_id", *[given(n).alias(n) for n in (*_TEXTS, "created_at")],
        F.coalesce(given("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(given("custom_fields", _FIELDS), F.array().cast(_FIELDS)).alias("fields"))
    lines = thread_lines(turns)
    threads = prompt_threads(lines, limit).join(thread_words(turns), "ticket_id", "left")
    sizes = lines.groupBy("ticket_id").agg((F.sum(F.length("line") + 2) - 2 > limit).alias("long"))
    joined = base.join(threads.join(sizes, "ticket_id"), "ticket_id", "left")
    if images is None:
        joined = joined.withColumn("images", F.array().cast(_IMAGES))
    else:
        told = images.select("ticket_id", F.col("image_descriptions").cast(_IMAGES).alias("images"))
        joined = joined.join(told, "ticket_id", "left").withColumn("images", F.coalesce("images", F.array().cast(_IMAGES)))
    thread = X.first_filled(F.col("thread"), F.col("description"), F.lit("No content"))
    content = F.concat(thread, X.image_block(F.col("images")))
    words = F.when(F.coalesce("words", F.lit(0)) > 0, F.col("words")).otherwise(X.word_count(F.col("description")).cast("bigint"))
    shown = joined.select("*", content.alias("content"), F.coalesce("n_turns", F.lit(0)).alias("comments"), words.alias("n_words"))
    prompt = prompts.full_prompt(
        ticket_id=F.col("ticket_id").cast("string"), subject=F.col("subject"), status=F.col("status"), priority=F.col("priority"),
        created_at=F.col("created_at"), requester=F.col("requester"), agent=F.col("agent"), organization=F.col("organization"),
        region=F.col("region"), tags=F.col("tags"), custom_fields=X.custom_field_lines(F.col("fields")),
        comment_count=F.col("comments"), word_count=F.col("n_words"), conversation=F.col("content"))
    return shown.select("ticket_id", "subject", "content", prompt.alias("prompt"), F.coalesce("long", F.lit(False)).alias("cut")).withColumn(
        "prompt_sha256", F.sha2("prompt", 256))


def sectioned_summary() -> Callable[[dict], str]:
    """Default model of full summaries: sections quoted from the thread and its most frequent words."""
    import re
    from collections import Counter
    word, blank_lines = re.compile(r"[^\W\d_]{4,}"), re.compile(r"\n\n+")

    def answer(row: dict) -> str:
        content = row.get("content") or ""
        if not content.strip():
            raise ValueError("no content")
        thread, _, shown = content.partition(X.IMAGE_HEADING)
        parts = blank_lines.split(thread)
        replies = [p for p in parts if p.startswith("[AGENT]")]
        counts = Counter(w.lower() for w in word.findall(thread) if w.lower() not in X.STOP_WORDS)
        common = sorted(counts, key=lambda w: (-counts[w], w))[:7]
        return "\n".join([
            f"Issue: {row.get('subject') or 'No subject'}", f"Problem: {parts[0]}",
            f"Resolution: {replies[-1] if replies else '[Not provided]'}", f"Images: {shown.strip() or 'None'}",
            f"Keywords: {', '.join(common)}"])

    return answer


def summarize_full(context: DataFrame, existing: DataFrame | None = None, *, model: Model = sectioned_summary,
                   version: str = "full-v1") -> DataFrame:
    """The columns of ``summarize`` and the prompt's digest, one row per ticket of ``full_context``.

    A run goes on where an earlier one of the same version ended: rows of ``existing`` (ticket_id, summary, status, version,
    prompt_sha256) are reused when they ended well, carry this version and were made from this prompt.  A ticket that
    has got a new comment, and a new version, are summarized anew.
    """
    context = cut_lineage(context)
    digests = context.select("ticket_id", "prompt_sha256")
    reusable = None
    if existing is not None:
        fitting = existing.where((F.col("version") == version) & (F.col("status") == "ok"))
        same = fitting.join(digests, ["ticket_id", "prompt_sha256"], "left_semi")
        reusable = cut_lineage(same.groupBy("ticket_id").agg(F.max("summary").alias("summary")).withColumn("status", F.lit("ok")))
    asked = context.select("ticket_id", "subject", "content", "prompt")
    return summarize(asked, reusable, model=model, version=version).join(digests, "ticket_id")
