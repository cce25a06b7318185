"""Batch model steps.  Models are plug-ins; resume, status, metrics and parsing live here.

A plug-in is a function without arguments.  It is called once per Python worker
task, loads whatever it needs, and returns a function from one input row (a
dict) to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.functions import prompts, text as X
from caseloom.operators.joins import split_resumable

Model = Callable[[], Callable[[dict], str]]

# Confidences of the labelling step and limits of the routing reply.
PARSED_CONFIDENCE = 0.8
UNPARSED_CONFIDENCE = 0.3
CONTEXT_ROWS = 5
CLUSTER_RELEVANCE = 0.5
MAX_CITATIONS = 10
CITATION_CHARS = 50


def run_model(frame: DataFrame, model: Model, keep: list) -> DataFrame:
    """The columns of ``keep`` with the model's answer and the metrics of the call.

    A failed call leaves an error.  Rows stream through in Arrow batches and the
    kept columns travel along, so no join brings them back.
    """
    added = [("output", T.StringType()), ("error", T.StringType()), ("output_tokens", T.LongType()),
             ("output_chars", T.LongType()), ("latency_seconds", T.DoubleType()),
             ("tokens_per_second", T.DoubleType()), ("started_at", T.DoubleType()), ("ended_at", T.DoubleType())]
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def call(batches):
        import time

        import pandas as pd
        answer = model()
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                began, start, output, error = time.time(), time.monotonic(), None, None
                try:
                    output = answer(row)
                except Exception as problem:
                    error = str(problem)[:200]
                spent = time.monotonic() - start
                tokens = len(output.split()) if output else 0
                rows.append((output, error, tokens, len(output or ""), spent, tokens / spent if spent > 0 else 0.0,
                             began, began + spent))
            answers = pd.DataFrame(rows, columns=[n for n, _ in added], index=batch.index)
            yield pd.concat([batch[keep], answers], axis=1)

    return frame.mapInPandas(call, schema)


def extractive_summary() -> Callable[[dict], str]:
    """Default summary model: the subject and the first sentence of the content."""
    import re
    sentence = re.compile(r"[^.]*\.?")

    def answer(row: dict) -> str:
        content = row.get("content") or ""
        if not content.strip():
            raise ValueError("no content")
        return f"Subject: {row.get('subject') or 'No subject'}\nProblem: {sentence.match(content).group(0)}"

    return answer


def keyword_label() -> Callable[[dict], str]:
    """Default labelling model: a JSON object made of the cluster keywords."""
    import json

    def answer(row: dict) -> str:
        words = [str(w) for w in (row["keywords"] if row["keywords"] is not None else [])]
        return json.dumps({
            "label": " ".join(words[:3]), "issue_description": "Tickets about " + ", ".join(words[:5]),
            "common_symptoms": words[:3], "environment": "not specified",
            "recommended_response": "Ask for details on " + ", ".join(words[:3]), "deflection_path": "",
        }, ensure_ascii=False)

    return answer


def nearest_reply() -> Callable[[dict], str]:
    """Default routing model: answers with the cluster of the most similar ticket."""
    import json

    def answer(row: dict) -> str:
        cluster = row.get("best_cluster")
        return "Answer: " + json.dumps({
            "predicted_cluster": cluster, "cluster_label": None if cluster is None else f"Cluster {cluster}",
            "confidence": row.get("best_score") or 0.0, "recommended_actions": ["review similar tickets"],
            "draft_reply": "Thank you for the report. We are looking into it.", "ask_for_info": [],
        })

    return answer


def image_placeholder() -> Callable[[dict], str]:
    """Default vision model: says which image was seen."""
    return lambda row: f"[Image: {row['filename']} - no vision model]"


def summarize(tickets: DataFrame, existing: DataFrame | None = None, *, model: Model = extractive_summary,
              version: str = "v1") -> DataFrame:
    """One row per ticket with summary, status and metrics.

    ``tickets`` holds ticket_id, subject, content and prompt.  Finished summaries
    in ``existing`` (ticket_id, summary, status) are reused; failed ones are tried
    again.  A failure keeps a placeholder text and the status ``failed``.
    """
    todo, reused = tickets, None
    if existing is not None:
        finished, todo = split_resumable(tickets, existing)
        reused = finished.select("ticket_id", "summary", "status", F.lit(True).alias("skipped"))
    sized = todo.withColumn("input_chars", F.length("content").cast("bigint"))
    answered = run_model(sized, model, ["ticket_id", "subject", "input_chars"])
    filled = F.coalesce(F.col("output"), F.lit("")) != ""
    reason = F.coalesce(F.concat(F.lit(": "), F.col("error")), F.lit(" - no output"))
    placeholder = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")),
                           F.lit("\n\n[Summary generation failed"), reason, F.lit("]"))
    fresh = answered.select(
        "ticket_id", F.when(filled, F.col("output")).otherwise(placeholder).alias("summary"),
        F.when(filled, F.lit("ok")).otherwise(F.lit("failed")).alias("status"), F.lit(False).alias("skipped"),
        "error", "input_chars", "output_tokens", "output_chars", "latency_seconds", "tokens_per_second", "started_at", "ended_at")
    every = fresh if reused is None else fresh.unionByName(reused, allowMissingColumns=True)
    return every.withColumn("version", F.lit(version))


def batch_metrics(calls: DataFrame) -> DataFrame:
    """Totals and rates of a summary run.

    ``calls`` holds status, skipped, input_chars, output_tokens, output_chars,
    latency_seconds, started_at and ended_at (seconds).
    """
    done = ~F.col("skipped") & (F.col("status") == "ok")
    tried = ~F.col("skipped")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0))

    sums = calls.agg(
        F.count(F.lit(1)).alias("total_tickets"), F.count_if(done).alias("completed"),
        F.count_if(tried & (F.col("status") != "ok")).alias("failed"), F.count_if("skipped").alias("skipped"),
        total("input_chars").alias("input_chars"), total("output_tokens").alias("output_tokens"),
        total("output_chars").alias("output_chars"), total("latency_seconds").alias("latency_seconds"),
        (F.max(F.when(tried, F.col("ended_at"))) - F.min(F.when(tried, F.col("started_at")))).alias("elapsed_seconds"))
    rate = F.coalesce(F.try_divide(F.col("completed") * 60.0, F.col("elapsed_seconds")), F.lit(0.0))
    remaining = F.col("total_tickets") - F.col("skipped") - F.col("completed") - F.col("failed")
    return sums.withColumns({
        "avg_tokens_per_second": F.coalesce(F.try_divide("output_tokens", "latency_seconds"), F.lit(0.0)),
        "avg_latency": F.coalesce(F.try_divide("latency_seconds", "completed"), F.lit(0.0)),
        "tickets_per_minute": rate,
        "eta_hours": F.coalesce(F.try_divide(remaining, rate * 60), F.lit(0.0)),
    })


def parse_answer(answer: Column) -> Column:
    """JSON of a model answer as a variant: fences stripped, else the first object in the text."""
    trimmed = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_replace(trimmed, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    body = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    # Fixed value: an object with at most one level of objects inside, as the label contract reads answers.
    inner = F.regexp_extract(body, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.nullif(inner, F.lit(""))))


def parse_reply(answer: Column) -> Column:
    """JSON between the first opening and the last closing brace."""
    return F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))


def label_clusters(clusters: DataFrame, *, model: Model = keyword_label) -> DataFrame:
    """Cluster summaries from representative texts and keywords.

    ``clusters`` holds cluster_id, texts (a handful per cluster) and keywords.
    """
    has_texts = F.size(F.coalesce("texts", F.array().cast("array<string>"))) > 0
    asked = clusters.where(has_texts).select(
        "cluster_id", "keywords", prompts.cluster_prompt(F.col("texts"), F.col("keywords")).alias("prompt"))
    answers = run_model(asked, model, ["cluster_id"]).select("cluster_id", "output")
    silent = clusters.where(~has_texts).select("cluster_id", F.lit(None).cast("string").alias("output"))
    return summary_fields(answers.unionByName(silent))


def summary_fields(answers: DataFrame) -> DataFrame:
    """Typed summary columns from (cluster_id, output), with the defaults for missing fields."""
    parsed = answers.select("cluster_id", "output", parse_answer(F.col("output")).alias("p"))
    kind = F.schema_of_variant("p")
    usable = kind.startswith("OBJECT")
    # An answer that is JSON but no object counts as a failed call.
    confidence = (F.when(F.col("output").isNull(), F.lit(0.0))
                  .when(F.col("p").isNull() | (kind == "OBJECT<>"), F.lit(UNPARSED_CONFIDENCE))
                  .when(usable, F.lit(PARSED_CONFIDENCE)).otherwise(F.lit(0.0)))

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.when(usable, F.try_variant_get("p", f"$.{name}", "string")), default).alias(name)

    symptoms = F.when(usable, F.try_variant_get("p", "$.common_symptoms", "array<string>"))
    return parsed.select(
        "cluster_id", field("label", F.concat(F.lit("Cluster-"), F.col("cluster_id").cast("string"))),
        field("issue_description", F.lit("")),
        F.coalesce(symptoms, F.array().cast("array<string>")).alias("common_symptoms"),
        field("environment", F.lit("")), field("recommended_response", F.lit("")),
        field("deflection_path", F.lit("")), confidence.alias("confidence"))


def route_messages(messages: DataFrame, hits: DataFrame, tickets: DataFrame, clusters: DataFrame, *,
                   model: Model = nearest_reply, include_citations: bool = True) -> DataFrame:
    """A reply per message from its nearest tickets and the largest clusters.

    ``messages``: id, text.  ``hits``: query_id, neighbour_id, score, rank.
    ``tickets``: id, subject, summary, cluster_id.  ``clusters``: cluster_id,
    label, size, issue_description, recommended_response.
    """
    # Five rows at most, so they travel as literals of the plan.
    top = clusters.orderBy(F.desc("size"), "cluster_id").limit(CONTEXT_ROWS).collect()
    context = "\n".join(
        f"- {r['label'] or 'Unknown'} (size: {r['size'] or 0}): {(r['issue_description'] or '')[:300]} "
        f"{(r['recommended_response'] or '')[:200]}" for r in top)
    cited = [F.struct(F.lit("cluster").alias("type"), F.lit(str(r["cluster_id"])).alias("id"),
                      F.lit(r["label"] or "").alias("label"), F.lit(CLUSTER_RELEVANCE).alias("relevance")) for r in top]
    empty = F.array().cast("array<struct<type:string,id:string,label:string,relevance:double>>")
    near = hits.where(F.col("rank") <= CONTEXT_ROWS).join(
        tickets.select(F.col("id").alias("neighbour_id"), "subject", "summary", "cluster_id"), "neighbour_id")
    line = F.concat(F.lit("- ["), F.coalesce("subject", F.lit("No subject")), F.lit("] (similarity: "),
                    F.format_number("score", 2), F.lit("): "), F.substring(F.coalesce("summary", F.lit("")), 1, 500))
    row = F.struct("rank", line.alias("line"), F.struct(
        F.lit("ticket").alias("type"), F.col("neighbour_id").cast("string").alias("id"),
        F.substring(F.coalesce("subject", F.lit("")), 1, CITATION_CHARS).alias("label"),
        F.col("score").alias("relevance")).alias("citation"), "cluster_id", "score")
    # At most five rows per message.
    gathered = near.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("near"))
    lines = F.coalesce(F.array_join(F.transform("near", lambda n: n["line"]), "\n"), F.lit(""))
    asked = messages.join(gathered, messages["id"] == gathered["query_id"], "left").select(
        "id", "text", F.coalesce(F.transform("near", lambda n: n["citation"]), empty).alias("cited"),
        F.get("near", F.lit(0))["cluster_id"].cast("string").alias("best_cluster"),
        F.get("near", F.lit(0))["score"].alias("best_score"),
        prompts.routing_prompt(F.col("text"), F.lit(context), lines).alias("prompt"))
    full = run_model(asked, model, ["id", "cited"])
    p = parse_reply(F.col("output"))
    citations = F.slice(F.concat("cited", F.array(*cited) if cited else empty), 1, MAX_CITATIONS)
    texts = lambda path: F.coalesce(F.try_variant_get("p", path, "array<string>"),
                                    F.array().cast("array<string>"))
    return full.withColumn("p", p).select(
        F.col("id").alias("message_id"), F.col("output").alias("response"),
        F.try_variant_get("p", "$.predicted_cluster", "string").alias("predicted_cluster"),
        F.try_variant_get("p", "$.cluster_label", "string").alias("cluster_label"),
        F.coalesce(F.try_variant_get("p", "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        texts("$.recommended_actions").alias("recommended_actions"),
        F.try_variant_get("p", "$.draft_reply", "string").alias("draft_reply"),
        (citations if include_citations else empty).alias("citations"), texts("$.ask_for_info").alias("ask_for_info"))


def describe_images(tickets: DataFrame, files: DataFrame | None = None, *, model: Model = image_placeholder) -> DataFrame:
    """(ticket_id, image_descriptions) for the first images of every ticket.

    ``tickets`` holds ticket_id and images (structs of filename and path);
    ``files`` is a ``binaryFile`` frame with path and content.  Images without a
    path are passed over; images whose file is missing get a placeholder.
    """
    first = tickets.select("ticket_id", F.posexplode(F.slice("images", 1, X.MAX_IMAGES)).alias("pos", "image"))
    first = first.select("ticket_id", "pos", F.coalesce("image.filename", F.lit("unknown.jpg")).alias("filename"),
                         F.col("image.path").alias("path")).where(F.col("path").isNotNull())
    if files is None:
        loaded = first.withColumn("content", F.lit(b""))
    else:
        loaded = first.join(files.select("path", "content"), "path", "left")
    keep = ["ticket_id", "pos", "filename"]
    seen = run_model(loaded.where(F.col("content").isNotNull()), model, keep).select(*keep, "output")
    told = seen.unionByName(loaded.where(F.col("content").isNull()).select(*keep, F.lit(None).cast("string").alias("output")))
    text = F.coalesce("output", F.concat(F.lit("[Image: "), F.col("filename"), F.lit(" - not available]")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "filename", text.alias("description"))))
    return told.groupBy("ticket_id").agg(F.transform(ordered, lambda i: F.struct(
        i["filename"].alias("filename"), i["description"].alias("description"))).alias("image_descriptions"))
