"""Redaction, text shaping, threads, prompts and keywords."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.functions import prompts as P, redaction as R, text as X
from caseloom.operators import clusters as C, embedding as E, threads as H
from caseloom.operators.joins import representative_texts as with_texts

# DuckDB's word boundary knows ASCII only.  The SQL checks therefore hide the ASCII letters of words
# that hold other letters (they are moved to private code points) and put them back at the end.
_PLAIN = string.ascii_letters + string.digits + "_"
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))
_RUN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HIDE = (f"array_to_string(list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: CASE WHEN "
         f"regexp_matches(x, '[^\\x00-\\x7F]') AND regexp_matches(x, '^[\\p{{L}}\\p{{M}}\\p{{N}}_]') "
         f"THEN translate(x, '{_PLAIN}', '{_HIDDEN}') ELSE x END), '')")


def _unhide(column: str) -> str:
    return f"translate({column}, '{_HIDDEN}', '{_PLAIN}')"


def _redacted_sql(column: str) -> str:
    for name, pattern, fold in R.PATTERNS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, '[REDACTED_{name}]', '{'gi' if fold else 'g'}')"
    return column


@named("redact", f"""
WITH h AS (SELECT doc_id, {_HIDE} AS t FROM documents)
SELECT doc_id, {_unhide(_redacted_sql('t'))} AS redacted_text FROM h""")
def redact(spark, folder):
    return V.texts(spark, folder, "documents").select("doc_id", R.redact(F.col("text")).alias("redacted_text"))


def _stats_sql() -> str:
    steps, previous, parts = [f"s0 AS (SELECT doc_id, {_HIDE} AS t FROM documents)"], "s0", []
    for i, (name, pattern, fold) in enumerate(R.PATTERNS, 1):
        flag = "'i'" if fold else "''"
        kept = "".join(f", n{j}" for j in range(1, i))
        steps.append(
            f"s{i} AS (SELECT doc_id, regexp_replace(t, {_quoted(pattern)}, '[REDACTED_{name}]', "
            f"'{'gi' if fold else 'g'}') AS t, len(regexp_extract_all(t, {_quoted(pattern)}, 0, {flag})) AS n{i}{kept} "
            f"FROM {previous})")
        previous = f"s{i}"
        parts.append(f"SELECT doc_id, '{name}' AS pattern, CAST(n{i} AS INTEGER) AS hits FROM s{len(R.PATTERNS)} WHERE n{i} > 0")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(parts)


@named("redact_stats", _stats_sql())
def redact_stats(spark, folder):
    found = R.redact_with_stats(V.texts(spark, folder, "documents"), "text")
    return found.select("doc_id", F.explode("counts").alias("pattern", "hits"))


@named("redacted_threads", f"""
WITH h AS (SELECT conv_id, turn, role, {_HIDE} AS t FROM conversations)
SELECT conv_id, turn, {_unhide(_redacted_sql('t'))} AS body_redacted FROM h""")
def redacted_threads(spark, folder):
    return V.texts(spark, folder, "conversations").select(
        "conv_id", "turn", R.redact(F.col("text")).alias("body_redacted"))


@named("text_hash_dupes", """
WITH h AS (SELECT substr(md5(text), 1, 16) AS text_hash, doc_id FROM documents)
SELECT text_hash, count(*) AS n, min(doc_id) AS first_doc FROM h GROUP BY 1 HAVING count(*) > 1""")
def text_hash_dupes(spark, folder):
    d = V.table(spark, folder, "documents")
    return d.groupBy(X.text_hash(F.col("text")).alias("text_hash")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > 1)


@named("truncate", "SELECT doc_id, substr(text, 1, 200) AS head FROM documents")
def truncate(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", X.truncate(F.col("text"), X.SUBJECT_CHARS).alias("head"))


@named("truncate_middle", f"""
SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 500) || {_quoted(X.TRUNCATION_MARK)} || right(text, 500)
                    ELSE text END AS shortened FROM documents""")
def truncate_middle(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", X.truncate_middle(F.col("text"), 1000).alias("shortened"))


@named("embedding_text", """
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE text END, ''), nullif(source, '')) AS chosen
FROM documents""")
def embedding_text(spark, folder):
    d = V.table(spark, folder, "documents")
    redacted = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("text"))
    return d.select("doc_id", E.stored_text(redacted, F.col("source")).alias("chosen"))


@named("payload", """
SELECT doc_id, substr(text, 1, 200) AS subject, lang AS status, source AS priority, CAST(n_chars AS VARCHAR) AS created_at,
       array_to_string(list_slice(string_split(text, ' '), 1, 10), ' ') AS tags FROM documents""")
def payload(spark, folder):
    d = V.table(spark, folder, "documents")
    columns = X.payload_columns(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("string"),
                                F.split("text", " "))
    return d.select("doc_id", *columns).withColumn("tags", F.array_join("tags", " "))


def _turns(spark, folder):
    c = V.table(spark, folder, "conversations")
    role = F.when(F.col("role") == "assistant", F.lit("agent")).otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("ticket_id"), "turn", role.alias("role"), F.col("role").alias("name"),
                    F.col("text").alias("body"))


_LINES = """lines AS (SELECT conv_id AS ticket_id, turn, text,
  CASE WHEN role = 'assistant' THEN '[AGENT] ' ELSE '[CUSTOMER] ' END || role || ': ' || text AS line FROM conversations)"""
_THREADS = _LINES + """, threads AS (
  SELECT ticket_id, string_agg(line, E'\\n\\n' ORDER BY turn) AS thread, count(*) AS n_turns FROM lines GROUP BY 1)"""


@named("thread_lines", "WITH " + _LINES + " SELECT ticket_id, turn, line FROM lines")
def thread_lines(spark, folder):
    return H.thread_lines(_turns(spark, folder))


@named("thread_build", "WITH " + _THREADS + " SELECT ticket_id, thread, n_turns FROM threads")
def thread_build(spark, folder):
    return H.prompt_threads(H.thread_lines(_turns(spark, folder)))


@named("thread_build_cut", "WITH " + _THREADS + f"""
SELECT ticket_id, CASE WHEN length(thread) > 700 THEN left(thread, 350) || {_quoted(X.TRUNCATION_MARK)} || right(thread, 350)
                       ELSE thread END AS thread, n_turns FROM threads""")
def thread_build_cut(spark, folder):
    return H.prompt_threads(H.thread_lines(_turns(spark, folder)), limit=700)


_WORDS = "CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT)"


@named("word_count", f"""
WITH w AS (SELECT conv_id AS ticket_id, CAST(sum({_WORDS}) AS BIGINT) AS words FROM conversations GROUP BY 1)
SELECT *, CASE WHEN words < 100 THEN 'sparse' WHEN words <= 300 THEN 'moderate' ELSE 'detailed' END AS density FROM w""")
def word_count(spark, folder):
    return H.thread_words(_turns(spark, folder))


@named("custom_field_lines", """
SELECT p_partkey, '  - brand: ' || p_brand || E'\\n  - kind: ' || p_type ||
       CASE WHEN p_size % 3 = 0 THEN '' ELSE E'\\n  - size: ' || p_size END AS fields FROM part""")
def custom_field_lines(spark, folder):
    p = V.table(spark, folder, "part")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    size = F.when(F.col("p_size") % 3 == 0, F.lit("None")).otherwise(F.col("p_size").cast("string"))
    fields = F.array(one("brand", F.col("p_brand")), one("kind", F.col("p_type")), one("size", size),
                     one("empty", F.lit("")))
    return p.select("p_partkey", X.custom_field_lines(fields).alias("fields"))


@named("image_block", f"""
WITH s AS (SELECT s_suppkey, s_name, list_transform(range(CAST(least(s_suppkey % 8, 5) AS BIGINT)),
             lambda i: '  - img' || i || '.png: ' || s_name) AS a FROM supplier)
SELECT s_suppkey, CASE WHEN len(a) > 0 THEN {_quoted(X.IMAGE_HEADING)} || array_to_string(a, E'\\n') ELSE '' END AS block
FROM s""")
def image_block(spark, folder):
    s = V.table(spark, folder, "supplier")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: i < F.col("s_suppkey") % 8)
    images = F.transform(numbers, lambda i: F.struct(
        F.concat(F.lit("img"), i.cast("string"), F.lit(".png")).alias("filename"), F.col("s_name").alias("description")))
    return s.select("s_suppkey", X.image_block(images).alias("block"))


# The first line of a prompt is fixed wording; the checks compare everything after it.
@named("prompt_simple", """
SELECT doc_id, 'Subject: ' || source || E'\\nContent: ' || text AS tail FROM documents""")
def prompt_simple(spark, folder):
    d = V.table(spark, folder, "documents")
    prompt = P.simple_prompt(F.col("source"), F.col("text"))
    return d.select("doc_id", F.regexp_replace(prompt, r"^[^\n]*\n", "").alias("tail"))


@named("prompt_full", "WITH " + _THREADS + f""", w AS (
  SELECT conv_id, CAST(sum({_WORDS}) AS BIGINT) AS words FROM conversations GROUP BY 1)
SELECT ticket_id, 'Ticket: ' || ticket_id || E'\\nSubject: No subject\\nStatus: open\\nPriority: Not set\\nCreated: unknown'
  || E'\\nRequester: Unknown\\nAgent: Unassigned\\nOrganization: Unknown\\nRegion: Unknown\\nTags: chat, web'
  || E'\\nCustom fields:\\n  None provided\\nConversation (' || n_turns || ' comments, ' || words || E' words):\\n'
  || thread AS tail
FROM threads JOIN w ON conv_id = ticket_id""")
def prompt_full(spark, folder):
    turns = _turns(spark, folder)
    threads = H.prompt_threads(H.thread_lines(turns)).join(H.thread_words(turns), "ticket_id")
    none = F.lit(None).cast("string")
    prompt = P.full_prompt(
        ticket_id=F.col("ticket_id").cast("string"), subject=none, status=F.lit("open"), priority=none, created_at=none,
        requester=none, agent=none, organization=none, region=none, tags=F.array(F.lit("chat"), F.lit("web")),
        custom_fields=X.custom_field_lines(F.array().cast("array<struct<name:string,value:string>>")),
        comment_count=F.col("n_turns"), word_count=F.col("words"), conversation=F.col("thread"))
    return threads.select("ticket_id", F.regexp_replace(prompt, r"^[^\n]*\n", "").alias("tail"))


_TOKENS = """tokens AS (
  SELECT source, doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM (
    SELECT source, doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 3
      AND regexp_full_match(w, '\\p{L}+') AND w NOT IN (%s)) AS a FROM documents))""" % ", ".join(
    _quoted(w) for w in X.STOP_WORDS)


def _source_texts(spark, folder):
    d = V.texts(spark, folder, "documents")
    return d.select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("ticket_id"), "text")


@named("keywords", "WITH " + _TOKENS + """, n AS (
  SELECT source, word, count(*) AS n, min((doc_id, pos)) AS first_seen FROM tokens GROUP BY 1, 2)
SELECT source AS cluster_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen) AS INTEGER) AS rank,
       word, n FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen) <= 10""")
def keywords(spark, folder):
    return C.keywords(_source_texts(spark, folder))


@named("keywords_by_word", "WITH " + _TOKENS + """, n AS (SELECT source, word, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT source AS cluster_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INTEGER) AS rank,
       word, n FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 10""")
def keywords_by_word(spark, folder):
    return C.keywords(_source_texts(spark, folder), tie="word")


_LONGEST = """longest AS (
  SELECT source AS cluster_id, doc_id AS ticket_id, text,
         row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= %d)"""


def _longest(spark, folder, top):
    d = V.table(spark, folder, "documents").select(
        F.col("source").alias("cluster_id"), F.col("doc_id").alias("ticket_id"), "n_chars")
    return C.ranked(d, "cluster_id", [F.desc("n_chars"), "ticket_id"], top).select("cluster_id", "rank", "ticket_id")


@named("representative_texts", "WITH " + _LONGEST % 3 + """
SELECT cluster_id, md5(string_agg(text, '|' ORDER BY rank)) AS digest, count(*) AS n FROM longest GROUP BY 1""")
def representative_texts(spark, folder):
    texts = V.table(spark, folder, "documents").select(F.col("doc_id").alias("ticket_id"), "text")
    found = with_texts(_longest(spark, folder, 3), texts)
    return found.select("cluster_id", F.md5(F.array_join("texts", "|")).alias("digest"),
                        F.size("texts").cast("bigint").alias("n"))


@named("prompt_cluster", "WITH " + _LONGEST % 5 + """
SELECT cluster_id, string_agg('Ticket ' || rank || E':\\n' || substr(text, 1, 2000), E'\\n' ORDER BY rank)
       || E'\\nKeywords: key, word' AS tail FROM longest GROUP BY 1""")
def prompt_cluster(spark, folder):
    texts = V.table(spark, folder, "documents").select(F.col("doc_id").alias("ticket_id"), "text")
    found = with_texts(_longest(spark, folder, 5), texts)
    prompt = P.cluster_prompt(F.col("texts"), F.array(F.lit("key"), F.lit("word")))
    return found.select("cluster_id", F.regexp_replace(prompt, r"^[^\n]*\n", "").alias("tail"))
