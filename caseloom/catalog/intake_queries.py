"""Raw payloads, normalization, landing, chunk planning, delta joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.operators import joins as J
from caseloom.operators import normalize as N
from caseloom.session import shared_dir
from caseloom.sources import raw as R, tables as S

NOW = "2002-01-01 00:00:00"

# Descriptions given to the derived tickets, by customer number.
DESCRIPTIONS = ["Fails on Windows with error 500", "Client crash on macbook, code 7001", "",
                "Upload to cloud storage hangs", "Call 555-123-4567 please"]


def payload_text(spark, folder):
    """(ticket_id, payload): orders written as raw ticket JSON, with gaps and odd values."""
    o = V.texts(spark, folder, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    code = F.substring("o_orderpriority", 1, 1)
    description = F.get(F.array(*[F.lit(d) for d in DESCRIPTIONS]), (customer % 5).cast("int"))
    tags = F.concat(F.array(F.concat(F.lit("seg-"), code)),
                    F.when(key % 3 != 0, F.array(F.concat(F.lit("v"), customer % 7, F.lit("."), key % 10)))
                    .otherwise(F.array().cast("array<string>")),
                    F.when(customer % 7 == 2, F.array(F.lit("linux"))).otherwise(F.array().cast("array<string>")))
    comments = F.to_json(F.struct(
        (key * 10 + 1).alias("id"), customer.alias("author_id"), F.concat(day, F.lit("Z")).alias("created_at"),
        F.concat(F.lit("note on "), key.cast("string")).alias("body"), F.lit(True).alias("public")))
    hidden = F.concat(F.lit('{"id":'), (key * 10 + 2).cast("string"), F.lit(',"body":null,"public":false}'))
    fields = F.concat(F.lit('[{"id":1,"value":'), F.col("o_totalprice").cast("decimal(20,2)").cast("string"),
                      F.lit('},{"id":2,"value":true},{"value":"lost"},{"id":1,"value":"last"}]'))
    attached = F.concat(F.lit('[{"id":'), key.cast("string"),
                        F.lit(',"file_name":"log.txt","size":10,"content_type":"text/plain","content_url":"u"},'
                              '{"filename":"old.txt"},"stray"]'))
    head = F.to_json(F.struct(
        key.alias("id"), F.concat(F.lit("https://desk.example/"), key.cast("string")).alias("url"),
        F.when(key % 97 == 5, F.lit("unknown")).otherwise(F.concat(day, F.lit("Z"))).alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(
            F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")).alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Solved")).when(F.col("o_orderstatus") == "P", F.lit("CLOSED"))
        .otherwise(F.lit("odd")).alias("status"),
        F.when(code == "1", F.lit("Urgent")).when(code == "2", F.lit("HIGH")).when(code == "3", F.lit("normal"))
        .when(code == "4", F.lit("")).otherwise(F.lit("low")).alias("priority"),
        F.lit("problem").alias("type"), F.concat(F.lit("Order "), key.cast("string")).alias("subject"),
        description.alias("description"), tags.alias("tags"), customer.alias("assignee_id")))
    whole = F.concat(F.regexp_replace(head, r"\}$", ',"comments":['), comments, F.lit(","), hidden,
                     F.lit('],"custom_fields":'), fields, F.lit(',"attachments":'), attached, F.lit("}"))
    return o.select(key.alias("ticket_id"), whole.alias("payload"))


def raw_payloads(spark, folder):
    return R.parse_payloads(payload_text(spark, folder), "payload")


def normalized(spark, folder, redaction=False):
    return N.normalize(raw_payloads(spark, folder), F.lit(NOW).cast("timestamp"), redaction=redaction)


RAW_SQL = """raw AS (
  SELECT *, CAST(o_orderkey AS VARCHAR) AS ticket_id, substr(o_orderpriority, 1, 1) AS code,
         (['Fails on Windows with error 500', 'Client crash on macbook, code 7001', '', 'Upload to cloud storage hangs',
           'Call 555-123-4567 please'])[o_custkey % 5 + 1] AS description,
         o_orderkey % 97 <> 5 AS dated FROM orders)"""


@named("normalize_tickets", "WITH " + RAW_SQL + """
SELECT ticket_id, 'https://desk.example/' || ticket_id AS source_url,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(CASE o_orderstatus WHEN 'P' THEN o_orderdate ELSE date_trunc('day', o_orderdate + INTERVAL 1 DAY) END,
                '%Y-%m-%d %H:%M:%S') AS updated_at,
       CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'P' THEN 'closed' ELSE 'open' END AS status,
       CASE code WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' WHEN '5' THEN 'low' END AS priority,
       'problem' AS ticket_type, 'Order ' || ticket_id AS subject, description, o_custkey AS assignee_id
FROM raw WHERE dated""")
def normalize_tickets(spark, folder):
    t = N.accepted(normalized(spark, folder))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.select("ticket_id", "source_url", shown("created_at"), shown("updated_at"), "status", "priority",
                    "ticket_type", "subject", "description", "assignee_id")


@named("normalize_rejects", "WITH " + RAW_SQL + """
SELECT ticket_id, 'created_at' AS errors FROM raw WHERE NOT dated""")
def normalize_rejects(spark, folder):
    return N.rejected(normalized(spark, folder)).select("ticket_id", F.array_join("errors", ",").alias("errors"))


@named("platform_version", "WITH " + RAW_SQL + """
SELECT ticket_id,
       CASE WHEN o_custkey % 5 = 0 THEN 'windows' WHEN o_custkey % 7 = 2 THEN 'linux'
            WHEN o_custkey % 5 = 1 THEN 'macos' END AS platform,
       CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 7) || '.' || (o_orderkey % 10) END AS version
FROM raw WHERE dated""")
def platform_version(spark, folder):
    return N.accepted(normalized(spark, folder)).select("ticket_id", "platform", "version")


@named("fulltext", "WITH " + RAW_SQL + """
SELECT ticket_id, 'Order ' || ticket_id || CASE WHEN description <> '' THEN E'\\n\\n' || description ELSE '' END
       || E'\\n\\nnote on ' || ticket_id AS ticket_fulltext FROM raw WHERE dated""")
def fulltext(spark, folder):
    return N.accepted(normalized(spark, folder)).select("ticket_id", "ticket_fulltext")


@named("redacted_document", "WITH " + RAW_SQL + """
SELECT ticket_id, replace(description, '555-123-4567', '[REDACTED_PHONE]') AS description_redacted,
       regexp_replace('Order ' || ticket_id || CASE WHEN description <> '' THEN E'\\n\\n'
         || replace(description, '555-123-4567', '[REDACTED_PHONE]') ELSE '' END || E'\\n\\nnote on ' || ticket_id,
         '\\b[A-Z0-9]{4,5}[-\\s][A-Z0-9]{4,5}[-\\s][A-Z0-9]{4,5}[-\\s][A-Z0-9]{4,5}\\b', '[REDACTED_LICENSE]', 'gi')
         AS pii_redacted_text,
       'note on ' || ticket_id AS first_comment FROM raw WHERE dated""")
def redacted_document(spark, folder):
    t = N.accepted(normalized(spark, folder, redaction=True))
    return t.select("ticket_id", "description_redacted", "pii_redacted_text",
                    F.get("comments", F.lit(0))["body_redacted"].alias("first_comment"))


@named("comments_normalized", "WITH " + RAW_SQL + """
SELECT ticket_id, o_orderkey * 10 + 1 AS id, o_custkey AS author_id, 'end-user' AS author_role,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, 'note on ' || ticket_id AS body_text, true AS is_public
FROM raw WHERE dated
UNION ALL
SELECT ticket_id, o_orderkey * 10 + 2, NULL, 'system', '2002-01-01 00:00:00', '', false FROM raw WHERE dated""")
def comments_normalized(spark, folder):
    c = N.accepted(normalized(spark, folder)).select("ticket_id", F.explode("comments").alias("c")).select("ticket_id", "c.*")
    return c.drop("body_redacted").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@named("custom_fields", "WITH " + RAW_SQL + """
SELECT ticket_id, '1' AS field, '"last"' AS value FROM raw WHERE dated
UNION ALL SELECT ticket_id, '2', 'true' FROM raw WHERE dated""")
def custom_fields(spark, folder):
    return N.accepted(normalized(spark, folder)).select("ticket_id", F.explode("custom_fields").alias("field", "value"))


@named("attachments", "WITH " + RAW_SQL + """
SELECT ticket_id, o_orderkey AS id, 'log.txt' AS filename, 'text/plain' AS content_type, CAST(10 AS BIGINT) AS size, 'u' AS url
FROM raw WHERE dated
UNION ALL SELECT ticket_id, NULL, 'old.txt', '', 0, NULL FROM raw WHERE dated""")
def attachments(spark, folder):
    return N.accepted(normalized(spark, folder)).select("ticket_id", F.explode("attachments").alias("a")).select(
        "ticket_id", "a.*")


@named("upsert_normalized", "WITH " + RAW_SQL + """, b AS (
  SELECT ticket_id, o_orderdate AS moment, o_orderstatus AS status FROM raw WHERE dated
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), l_shipdate, max(l_returnflag) FROM lineitem GROUP BY 1, 2)
SELECT ticket_id, strftime(max(moment), '%Y-%m-%d') AS updated_at FROM b GROUP BY 1""")
def upsert_normalized(spark, folder):
    """Tickets overwritten by later versions of themselves."""
    t = N.accepted(normalized(spark, folder)).select("ticket_id", F.col("created_at").alias("updated_at"), "status")
    later = V.table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("ticket_id"), F.col("l_shipdate").cast("timestamp").alias("updated_at")).agg(
        F.max("l_returnflag").alias("status"))
    latest = N.upsert_latest(t, later, "ticket_id", "updated_at")
    return latest.select("ticket_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))


def _envelopes(spark, folder):
    """Tool answers in all their forms around one ticket each."""
    o = V.table(spark, folder, "orders")
    ticket = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    listed, wrapped = F.concat(F.lit("["), ticket, F.lit("]")), F.concat(F.lit('{"tickets":['), ticket, F.lit("]}"))
    item = F.to_json(F.struct(F.lit("text").alias("type"), wrapped.alias("text")))
    broken = F.lit('{"type":"text","text":"{not json"}')
    content = F.concat(F.lit('{"isError":false,"content":['), broken, F.lit(","), item, F.lit("]}"))
    form = F.col("o_orderkey") % 5
    answer = (F.when(form == 0, listed).when(form == 1, wrapped).when(form == 2, content)
              .when(form == 3, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.lit('"just text"')))
    return o.select(F.col("o_orderkey").alias("answer_id"), answer.alias("answer"))


@named("unwrap_envelope", """
SELECT o_orderkey AS answer_id, o_orderkey AS ticket_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 4""")
def unwrap_envelope(spark, folder):
    found = _envelopes(spark, folder).select(
        "answer_id", F.explode(R.unwrap_envelope(F.parse_json("answer"))).alias("t"))
    return found.select("answer_id", F.try_variant_get("t", "$.id", "bigint").alias("ticket_id"),
                        F.try_variant_get("t", "$.status", "string").alias("status"))


@named("landed_raw", """
SELECT CAST(o_orderkey AS VARCHAR) AS ticket_key, CASE o_orderstatus WHEN 'P' THEN 'job-2' ELSE 'job-1' END AS job_id,
       'Order ' || o_orderkey AS subject FROM orders""")
def landed_raw(spark, folder):
    """Two jobs land the same tickets, the second only some of them; the last write stays."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    first = raw_payloads(spark, folder)
    again = first.where(F.try_variant_get("raw_payload", "$.status", "string") == "CLOSED")
    for job, rows, at in (("job-1", first, "2002-01-01"), ("job-2", again, "2002-01-02")):
        R.land_raw(R.landing_rows(rows, job_id=job, ingested_at=F.lit(at).cast("timestamp")), path)
    current = R.current_raw(R.read_landed(spark, path))
    return current.select("ticket_key", "job_id", F.try_variant_get("raw_payload", "$.subject", "string").alias("subject"))


@named("raw_backup", "SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_custkey AS assignee_id FROM orders")
def raw_backup(spark, folder):
    """The JSON-lines backup of a landed job, read back as an export."""
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    rows = R.landing_rows(raw_payloads(spark, folder), job_id="job-1", ingested_at=F.lit(NOW).cast("timestamp"))
    R.land_raw(rows, f"{path}/table", f"{path}/raw")
    back = R.read_raw_lines(spark, f"{path}/raw")
    return back.select(F.try_variant_get("raw_payload", "$.id", "string").alias("ticket_id"),
                       F.try_variant_get("raw_payload", "$.assignee_id", "bigint").alias("assignee_id"))


@named("report_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS cluster_id, c_name AS label, substr(repeat(c_mktsegment || ', "' || c_name || '" ', 40), 1, 500)
  AS recommended_response FROM customer""")
def report_csv(spark, folder):
    """Cluster report written as CSV and read back."""
    c = V.table(spark, folder, "customer")
    text = F.repeat(F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_name"), F.lit('" ')), 40)
    summaries = c.select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("label"),
                         F.lit("d").alias("issue_description"), F.lit("e").alias("environment"),
                         text.alias("recommended_response"), F.lit("p").alias("deflection_path"),
                         F.lit(0.8).alias("confidence"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    S.csv_report(summaries, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("cluster_id", "label", "recommended_response")


@named("chunk_plan", """
WITH s AS (SELECT o_custkey AS span_id, date_trunc('day', min(o_orderdate)) AS a, date_trunc('day', max(o_orderdate)) AS b
           FROM orders GROUP BY 1),
c AS (SELECT span_id, a, b, unnest(range(greatest(1, CAST(ceil(date_diff('day', a, b) / 30.0) AS BIGINT)))) AS i FROM s)
SELECT span_id, CAST(i + 1 AS INTEGER) AS chunk_no, strftime(a + to_days(CAST(30 * i AS INTEGER)), '%Y-%m-%d') AS chunk_start,
       strftime(least(a + to_days(CAST(30 * (i + 1) AS INTEGER)), b), '%Y-%m-%d') AS chunk_end FROM c""")
def chunk_plan(spark, folder):
    spans = V.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("span_id")).agg(
        F.date_trunc("day", F.min("o_orderdate")).cast("timestamp").alias("start_date"),
        F.date_trunc("day", F.max("o_orderdate")).cast("timestamp").alias("end_date"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return R.plan_chunks(spans).select("span_id", "chunk_no", day("chunk_start"), day("chunk_end"))


@named("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey <> 0
QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def dedupe_keep_first(spark, folder):
    """Lines as chunk rows of tickets, two chunk frames united; the first row per ticket stays."""
    lines = V.table(spark, folder, "lineitem")
    united = R.union_chunks([lines.where(F.col("l_linenumber") <= 3), lines.where(F.col("l_linenumber") > 3)])
    order = ["chunk_no", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return R.keep_first(united, "l_orderkey", order).select("l_orderkey", "l_linenumber", "l_partkey")


@named("delta_new", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delta_new(spark, folder):
    d, known = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    return J.delta(d, known, "doc_id").select("doc_id", "n_chars")


@named("delta_known", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def delta_known(spark, folder):
    d, known = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    return J.already_known(d, known, "doc_id").select("doc_id", "n_chars")


@named("resume_work", """
WITH l AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN 'reuse' ELSE 'todo' END AS step FROM documents""")
def resume_work(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id")
    done = V.table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))
    finished, todo = J.split_resumable(d, done, "doc_id")
    return finished.select("doc_id", F.lit("reuse").alias("step")).unionByName(
        todo.select("doc_id", F.lit("todo").alias("step")))
