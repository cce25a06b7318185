"""Batch model steps with the deterministic default models."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.catalog.text_queries import _THREADS, _TOKENS, _WORDS, _longest, _quoted, _source_texts, _turns
from caseloom.catalog.vector_queries import message_hits
from caseloom.functions import prompts as P, text as X
from caseloom.operators import clusters as C, full_summaries as S, inference as I, joins as J


def _asked(spark, folder):
    d = V.table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("ticket_id"), F.col("source").alias("subject"), F.col("text").alias("content"),
                    P.simple_prompt(F.col("source"), F.col("text")).alias("prompt"))


def _existing(spark, folder):
    """Labelled documents have a summary already; those of low quality count as failed."""
    return V.table(spark, folder, "labels").select(
        F.col("doc_id").alias("ticket_id"), F.concat(F.lit("stored "), F.col("doc_id").cast("string")).alias("summary"),
        F.when(F.col("quality") == 1, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))


_SUMMARY = """done AS (SELECT doc_id FROM labels WHERE quality = 1),
s AS (SELECT doc_id AS ticket_id, doc_id IN (SELECT doc_id FROM done) AS skipped,
        CASE WHEN doc_id IN (SELECT doc_id FROM done) THEN 'stored ' || doc_id
             ELSE 'Subject: ' || source || E'\\nProblem: ' || regexp_extract(text, '^[^.]*\\.?') END AS summary,
        length(text) AS input_chars FROM documents)"""


@named("summarize_batch", "WITH " + _SUMMARY + """
SELECT ticket_id, summary, 'ok' AS status, skipped, CASE WHEN NOT skipped THEN input_chars END AS input_chars,
       CASE WHEN NOT skipped THEN length(summary) END AS output_chars, 'v1' AS version FROM s""")
def summarize_batch(spark, folder):
    found = I.summarize(_asked(spark, folder), _existing(spark, folder))
    return found.select("ticket_id", "summary", "status", "skipped", "input_chars", "output_chars", "version")


def _failing():
    """A model that fails on long inputs, to show how failures are kept."""
    answer = I.extractive_summary()

    def call(row):
        if len(row["content"]) > 5000:
            raise ValueError("input too long")
        return answer(row)

    return call


@named("summarize_failures", """
SELECT doc_id AS ticket_id, CASE WHEN length(text) > 5000 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN length(text) > 5000 THEN 'Subject: ' || source || E'\\n\\n[Summary generation failed: input too long]'
            ELSE 'Subject: ' || source || E'\\nProblem: ' || regexp_extract(text, '^[^.]*\\.?') END AS summary FROM documents""")
def summarize_failures(spark, folder):
    return I.summarize(_asked(spark, folder), model=lambda: _failing()).select("ticket_id", "status", "summary")


@named("summary_metrics", """
WITH c AS (SELECT *, doc_id % 5 = 0 AS skipped, CASE WHEN n_chars > 5000 THEN 'failed' ELSE 'ok' END AS status FROM documents),
d AS (SELECT count(*) AS total_tickets, count(*) FILTER (NOT skipped AND status = 'ok') AS completed,
  count(*) FILTER (NOT skipped AND status <> 'ok') AS failed, count(*) FILTER (skipped) AS skipped,
  CAST(coalesce(sum(n_chars) FILTER (NOT skipped AND status = 'ok'), 0) AS BIGINT) AS input_chars,
  CAST(coalesce(sum(n_chars // 4) FILTER (NOT skipped AND status = 'ok'), 0) AS BIGINT) AS output_tokens,
  sum(n_chars / 100) FILTER (NOT skipped AND status = 'ok') AS latency_seconds,
  max(doc_id + n_chars / 100) FILTER (NOT skipped) - min(doc_id) FILTER (NOT skipped) AS elapsed_seconds FROM c)
SELECT total_tickets, completed, failed, skipped, input_chars, output_tokens, round(latency_seconds, 4) AS latency_seconds,
  round(elapsed_seconds, 4) AS elapsed_seconds, round(output_tokens / latency_seconds, 4) AS avg_tokens_per_second,
  round(latency_seconds / completed, 4) AS avg_latency, round(completed * 60.0 / elapsed_seconds, 4) AS tickets_per_minute
FROM d""")
def summary_metrics(spark, folder):
    """A call log derived from the documents: one second per hundred characters."""
    d = V.table(spark, folder, "documents")
    latency = F.col("n_chars") / 100
    calls = d.select(
        F.when(F.col("n_chars") > 5000, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        (F.col("doc_id") % 5 == 0).alias("skipped"), F.col("n_chars").alias("input_chars"),
        F.floor(F.col("n_chars") / 4).alias("output_tokens"), F.col("n_chars").alias("output_chars"),
        latency.alias("latency_seconds"), F.col("doc_id").cast("double").alias("started_at"),
        (F.col("doc_id") + latency).alias("ended_at"))
    m = I.batch_metrics(calls)
    r4 = lambda c: F.round(c, 4).alias(c)
    return m.select("total_tickets", "completed", "failed", "skipped", "input_chars", "output_tokens", r4("latency_seconds"),
                    r4("elapsed_seconds"), r4("avg_tokens_per_second"), r4("avg_latency"), r4("tickets_per_minute"))


@named("label_clusters", "WITH " + _TOKENS + """, n AS (SELECT source, word, count(*) AS n FROM tokens GROUP BY 1, 2),
k AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM n),
a AS (SELECT source, list(word ORDER BY rank) FILTER (rank <= 5) AS w FROM k GROUP BY 1)
SELECT source AS cluster_id, coalesce(array_to_string(w[1:3], ' '), '') AS label,
  'Tickets about ' || coalesce(array_to_string(w, ', '), '') AS issue_description,
  coalesce(array_to_string(w[1:3], '|'), '') AS common_symptoms, 'not specified' AS environment,
  'Ask for details on ' || coalesce(array_to_string(w[1:3], ', '), '') AS recommended_response,
  '' AS deflection_path, 0.8::DOUBLE AS confidence
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN a USING (source)""")
def label_clusters(spark, folder):
    texts = V.table(spark, folder, "documents").select(F.col("doc_id").alias("ticket_id"), "text")
    told = J.representative_texts(_longest(spark, folder, 3), texts)
    words = C.keywords(_source_texts(spark, folder), tie="word").groupBy("cluster_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("keywords"))
    labels = I.label_clusters(told.join(words, "cluster_id", "left"))
    return labels.withColumn("common_symptoms", F.array_join("common_symptoms", "|"))


@named("parse_answers", """
SELECT o_orderkey AS cluster_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'plain ' || o_custkey WHEN 1 THEN 'fenced' WHEN 2 THEN 'led'
       ELSE 'Cluster-' || o_orderkey END AS label,
  CASE o_orderkey % 6 WHEN 2 THEN '{"a":1}' ELSE '' END AS environment,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN 0.8 WHEN o_orderkey % 6 = 3 THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence
FROM orders""")
def parse_answers(spark, folder):
    """Answers in the forms models give: plain, fenced, led by prose, broken, a list, none at all."""
    o = V.table(spark, folder, "orders")
    form = F.col("o_orderkey") % 6
    output = (F.when(form == 0, F.concat(F.lit('{"label":"plain '), F.col("o_custkey").cast("string"), F.lit('"}')))
              .when(form == 1, F.lit('```json\n{"label":"fenced"}\n```'))
              .when(form == 2, F.lit('Here it is: {"label":"led","environment":{"a":1}} as asked'))
              .when(form == 3, F.lit('{"label": broken')).when(form == 4, F.lit("[1, 2]")))
    answers = o.select(F.col("o_orderkey").alias("cluster_id"), output.alias("output"))
    return I.summary_fields(answers).select("cluster_id", "label", "environment", "confidence")


@named("routing_reply", """
SELECT item_id AS message_id, true AS answered, CAST(10 AS BIGINT) AS n_citations, 'review similar tickets' AS actions
FROM benchmark""")
def routing_reply(spark, folder):
    d = V.table(spark, folder, "documents")
    messages = V.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    tickets = d.select(F.col("doc_id").alias("id"), F.col("source").alias("subject"),
                       F.substring("text", 1, 500).alias("summary"), F.col("source").alias("cluster_id"))
    clusters = d.groupBy(F.col("source").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size")).select(
        "cluster_id", F.col("cluster_id").alias("label"), "size", F.lit("texts of one source").alias("issue_description"),
        F.lit("see the source").alias("recommended_response"))
    replies = I.route_messages(messages, message_hits(spark, folder), tickets, clusters)
    return replies.select("message_id", F.col("draft_reply").isNotNull().alias("answered"),
                          F.size("citations").cast("bigint").alias("n_citations"),
                          F.array_join("recommended_actions", ",").alias("actions"))


@named("image_descriptions", """
WITH p AS (SELECT page_id, list_slice(string_split(url, '/'), 1, 5) AS parts FROM pages)
SELECT page_id AS ticket_id, len(parts) AS n_images,
       array_to_string(list_transform(parts, lambda x: '[Image: ' || x || ' - no vision model]'), ' ') AS described
FROM p""")
def image_descriptions(spark, folder):
    """The parts of a page address stand for the attached images."""
    p = V.table(spark, folder, "pages")
    images = F.transform(F.split("url", "/"), lambda x: F.struct(x.alias("filename"), x.alias("path")))
    found = I.describe_images(p.select(F.col("page_id").alias("ticket_id"), images.alias("images")))
    return found.select("ticket_id", F.size("image_descriptions").cast("bigint").alias("n_images"),
                        F.array_join(F.transform("image_descriptions", lambda i: i["description"]), " ").alias("described"))


@named("summarize_full", "WITH " + _THREADS + f""", w AS (
  SELECT conv_id, CAST(sum({_WORDS}) AS BIGINT) AS words, count(DISTINCT role) AS roles FROM conversations GROUP BY 1)
SELECT ticket_id, sha256('Ticket: ' || ticket_id || E'\\nSubject: Conversation ' || ticket_id
  || E'\\nStatus: open\\nPriority: Not set\\nCreated: unknown'
  || E'\\nRequester: Unknown\\nAgent: Unassigned\\nOrganization: Unknown\\nRegion: Unknown\\nTags: chat'
  || E'\\nCustom fields:\\n  - roles: ' || roles || E'\\nConversation (' || n_turns || ' comments, ' || words || E' words):\\n'
  || thread || {_quoted(X.IMAGE_HEADING)} || '  - ' || ticket_id || '.png: [Image: ' || ticket_id || '.png - no vision model]') AS tail_sha256,
  'ok' AS status, 'full-v2' AS version, n_turns >= 4 AS skipped
FROM threads JOIN w ON conv_id = ticket_id""")
def summarize_full(spark, folder):
    """Conversations with all their context; those of four turns and more have a summary of this version already."""
    turns = _turns(spark, folder)
    sizes = V.table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("ticket_id")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_distinct("role").cast("string").alias("roles"))
    name = F.col("ticket_id").cast("string")
    tickets = sizes.select("ticket_id", F.concat(F.lit("Conversation "), name).alias("subject"), F.lit("open").alias("status"),
                           F.array(F.lit("chat")).alias("tags"), F.array(F.struct(F.lit("roles").alias("name"), F.col("roles").alias("value"))).alias("custom_fields"))
    images = I.describe_images(sizes.select("ticket_id", F.array(F.struct(
        F.concat(name, F.lit(".png")).alias("filename"), F.lit("shared").alias("path"))).alias("images")))
    context = S.full_context(tickets, turns, images, limit=S.WHOLE)
    stored = context.join(sizes, "ticket_id").select(
        "ticket_id", F.concat(F.lit("stored "), name).alias("summary"), F.lit("ok").alias("status"),
        F.when(F.col("n_turns") >= 4, F.lit("full-v2")).otherwise(F.lit("full-v1")).alias("version"), "prompt_sha256")
    made = S.summarize_full(context, stored, version="full-v2")
    tails = context.select("ticket_id", F.sha2(F.regexp_replace("prompt", r"^[^\n]*\n", ""), 256).alias("tail_sha256"))
    return made.join(tails, "ticket_id").select("ticket_id", "tail_sha256", "status", "version", "skipped")
