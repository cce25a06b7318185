"""The named queries of the dealt operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import (
    byte_bpe, conversation_repair, decontamination, exact_dedup, html_extract, jaccard_join, language_id, mixing,
    packed_output, quality_classifier, quality_rules, substring_dedup, target_resampling)
from caseloom.llm.tasks import BATCH_BYTES, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _named(name: str, sql: str | None = None, batch_bytes: int = BATCH_BYTES):
    def keep(function):
        QUERIES[name] = lambda spark, folder: function(prepare(spark, batch_bytes), folder)
        if sql is not None:
            CHECKS[name] = sql
        return function

    return keep


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@_named("op5_byte_bpe")
def op5_byte_bpe(spark, folder):
    return byte_bpe.round_trip(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_named("op8_exact_dedup", sql="""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
""")
def op8_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(_documents(spark, folder))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / greatest(0.1, 1.0 - symbols / greatest(size, 1)) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(position % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM p),
r AS (SELECT *, lim / weight AS ratio FROM w),
a AS (SELECT sum(source_size) * 1.5::DOUBLE AS everything FROM r),
b AS (SELECT x.ratio, sum(least(y.lim, y.weight * x.ratio)) AS filled FROM r x, r y GROUP BY x.ratio),
f AS (SELECT coalesce(max(ratio), -1) AS full_to FROM b, a WHERE filled <= everything),
v AS (SELECT (any_value(everything) - coalesce(sum(lim) FILTER (ratio <= full_to), 0)) / sum(weight) FILTER (ratio > full_to) AS level,
             any_value(full_to) AS full_to FROM r, a, f),
t AS (SELECT source, source_size, CASE WHEN ratio <= full_to THEN lim ELSE weight * level END AS target FROM r, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size / 2 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN size > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""


@_named("op9_mixing", sql=MIX_SQL)
def op9_mixing(spark, folder):
    return mixing.mix(_documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@_named("op10_packed_output")
def op10_packed_output(spark, folder):
    shards = packed_output.new_folder(spark, "packed")
    packed_output.write_tokens(_documents(spark, folder), shards, public_tokenizers.path("word_bpe_49k.json"))
    return packed_output.read_tokens(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_named("op7_substring_dedup")
def op7_substring_dedup(spark, folder):
    return substring_dedup.remove_repeated(_documents(spark, folder))


@_named("op6_jaccard_join", batch_bytes=jaccard_join.BATCH_BYTES)
def op6_jaccard_join(spark, folder):
    return jaccard_join.shingle_components(_documents(spark, folder))


def _rules_sql(rounds: int = quality_rules.ROUNDS) -> str:
    """The measures, votes and rounds of the label model, one common table expression each."""
    k = range(len(quality_rules.RULES))
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}"
                      for i, (good, bad) in enumerate(quality_rules.RULES.values()))
    names = ", ".join(f"v{i}" for i in k)
    parts = [r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents),
s AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g3 AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
       FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM s)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM g3) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) o(d) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda w: regexp_matches(w, '^\p{L}'))) AS n_letter_words,
             len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}{2}'))) AS n_capital_words
      FROM s LEFT JOIN cov USING (rid)),
""", f"v AS (SELECT *, {votes} FROM m),\np AS (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),\n",
             "q0 AS (SELECT *, CASE WHEN " + " OR ".join(f"v{i} = -1" for i in k) + " THEN 0.1::DOUBLE ELSE 0.9 END AS q FROM p),\n"]
    for r in range(1, rounds + 1):
        sums = ", ".join(
            f"sum(CASE WHEN v{i} = {vote} THEN n * {weight} ELSE 0 END) AS {name}{y}_{i}"
            for i in k for name, vote in (("b", -1), ("f", 1)) for y, weight in ((1, "q"), (0, "(1 - q)")))
        terms = " + ".join(
            f"CASE v{i} WHEN -1 THEN ln((b1_{i} + 1) / (g1 + 3)) - ln((b0_{i} + 1) / (g0 + 3)) WHEN 1 THEN ln((f1_{i} + 1) / (g1 + 3)) - ln((f0_{i} + 1) / (g0 + 3)) "
            f"ELSE ln((g1 - b1_{i} - f1_{i} + 1) / (g1 + 3)) - ln((g0 - b0_{i} - f0_{i} + 1) / (g0 + 3)) END" for i in k)
        parts.append(f"e{r} AS MATERIALIZED (SELECT *, least(greatest(g1 / (g1 + g0), 0.05), 0.95) AS s FROM "
                     f"(SELECT sum(n * q) AS g1, sum(n * (1 - q)) AS g0, {sums} FROM q{r - 1})),\n"
                     f"q{r} AS MATERIALIZED (SELECT {names}, n, 1 / (1 + exp(-(ln(s / (1 - s)) + {terms}))) AS q FROM q{r - 1}, e{r}),\n")
    parts.append(f"""f AS (SELECT v.*, q, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v JOIN q{rounds} USING ({names}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept
FROM f
""")
    return "".join(parts)


@_named("op3_quality_rules", sql=_rules_sql())
def op3_quality_rules(spark, folder):
    return quality_rules.judge(_documents(spark, folder)).drop("posterior")


@_named("op1_language_id")
def op1_language_id(spark, folder):
    documents = _documents(spark, folder)
    found = language_id.identify(documents, language_id.fit(documents))
    return found.select("doc_id", (language_id.fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


@_named("op2_quality_classifier")
def op2_quality_classifier(spark, folder):
    scored = quality_classifier.score(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return scored.select("doc_id", (language_id.fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


@_named("op4_html_extract")
def op4_html_extract(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return html_extract.extract(pages, html_extract.fit(pages))


_NORMAL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                 r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@_named("op11_decontamination", sql=f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_NORMAL_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_NORMAL_WORDS} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n,
             unnest(list_transform(generate_series(1, greatest(len(ws) - 9, 1)), lambda k: array_to_string(ws[k:k + 9], ' '))) AS w
      FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM i),
s AS (SELECT rid, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda k: struct_pack(k := k, w := array_to_string(ws[k:k + n - 1], ' ')))) AS x
      FROM d, sizes WHERE len(ws) >= n),
h AS MATERIALIZED (SELECT rid, s.n, x.k AS k, x.w AS w FROM s WHERE (x.w, s.n) IN (SELECT w, n FROM i)),
c AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(generate_series(k, k + n - 1)) AS place FROM h) GROUP BY 1),
m AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS items FROM h JOIN i USING (w, n) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
""")
def op11_decontamination(spark, folder):
    found = decontamination.find_contamination(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# CRC-32 of a text's bytes; the table of the polynomial comes from its rule.
_CRC_TABLE = ("t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: "
              "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, x::BIGINT)) AS tab)")


def _crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::BIGINT, 2))::BIGINT), "
            "lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)")


@_named("op13_target_resampling", sql=f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_NORMAL_WORDS} AS ws FROM documents),
b AS (SELECT -row_number() OVER () AS rid, {_NORMAL_WORDS} AS ws FROM benchmark),
w AS (SELECT rid, list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda k: ws[k] || ' ' || ws[k + 1])) AS fs
      FROM (SELECT rid, ws FROM d UNION ALL SELECT * FROM b)),
f AS MATERIALIZED (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest(fs) AS f FROM w) GROUP BY ALL),
k AS MATERIALIZED (SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), t),
g AS MATERIALIZED (SELECT rid, bucket, sum(n)::BIGINT AS n FROM f JOIN k USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (rid > 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (rid < 0), 0)::BIGINT AS t FROM g GROUP BY 1),
a AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM c),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM c, a),
m AS (SELECT rid, floor(sum(gain * n)::DOUBLE / sum(n))::BIGINT AS weight FROM g JOIN gains USING (bucket) GROUP BY 1),
x AS (SELECT rid, doc_id, len(ws) AS n_words, (len(ws) + greatest(len(ws) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN m USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)
""")
def op13_target_resampling(spark, folder):
    drawn = target_resampling.resample(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@_named("op12_conversation_repair", sql=f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT o.*, {_crc_sql('name')} % 20 AS kind FROM o, t),
e AS (SELECT coalesce('1' || conv_id, '0') AS conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM e),
f AS MATERIALIZED (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS c,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM n),
ins(q, k, q1) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
act(c, letter, q1, q2, price) AS (
  SELECT c, 'D', q, q, 3 FROM (VALUES ('s'), ('u'), ('a'), ('o')) x(c), (VALUES (0), (1), (2), (3)) y(q)
  UNION ALL SELECT c, 'R', q, CASE q WHEN 2 THEN 3 ELSE 2 END, 2 FROM (VALUES ('s'), ('u'), ('a'), ('o')) x(c), (VALUES (0), (1), (2), (3)) y(q)
  UNION ALL SELECT * FROM (VALUES ('s', 'K', 0, 1, 0), ('u', 'K', 0, 2, 0), ('u', 'K', 1, 2, 0), ('u', 'K', 3, 2, 0), ('a', 'K', 2, 3, 0))),
way(conv, i, q, best) AS (
  SELECT conv, 0::BIGINT, 0, {{'cost': 0, 'audit': ''}} FROM f WHERE i = 1
  UNION ALL
  SELECT conv, i, q2, min({{'cost': cost, 'audit': audit}}) FROM (
    SELECT f.conv, f.i, a.q2, w.best.cost + 2 * x.k + a.price + CASE WHEN f.fault = 'truncated' AND a.letter <> 'D' THEN 1 ELSE 0 END AS cost,
           w.best.audit || repeat('I', x.k) || a.letter AS audit
    FROM way w JOIN f ON f.conv = w.conv AND f.i = w.i + 1 JOIN ins x ON x.q = w.q JOIN act a ON a.c = f.c AND a.q1 = x.q1
    WHERE a.letter = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate'))
  GROUP BY conv, i, q2),
size AS (SELECT conv, max(i) AS n FROM f GROUP BY 1),
done AS (
  SELECT conv, min({{'cost': best.cost + [0, 4, 2, 0][q + 1], 'audit': best.audit || ['', 'II', 'I', ''][q + 1]}}) AS best
  FROM way JOIN size USING (conv) WHERE i = n GROUP BY 1),
let AS (SELECT conv, p, best.audit[p] AS letter FROM (SELECT conv, best, unnest(generate_series(1, length(best.audit))) AS p FROM done)),
spot AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS i FROM let),
own AS (SELECT spot.*, f.role, f.text, letter = 'K' AND c = 's' AS system FROM spot LEFT JOIN f ON f.conv = spot.conv AND f.i = spot.i AND letter <> 'I'
        WHERE letter <> 'D'),
line AS (SELECT conv, p, letter, text, role,
                count(*) FILTER (NOT system) OVER (PARTITION BY conv ORDER BY p) AS nth FROM own),
rep AS (SELECT conv, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE nth % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' ||
                                       CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM line GROUP BY 1),
facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv ORDER BY i) AS before FROM f) GROUP BY 1),
every AS (SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM every LEFT JOIN facts USING (conv) LEFT JOIN done USING (conv) LEFT JOIN rep USING (conv)
""")
def op12_conversation_repair(spark, folder):
    return conversation_repair.repair_damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
