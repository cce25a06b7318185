"""Nearest neighbours, votes, duplicates and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseloom.catalog import named
from caseloom.catalog import views as V
from caseloom.operators import embedding as E, hashing as L, neighbours as B, quality as Q, retrieval as T, routing as R, vector_index as X
from caseloom.session import cut_lineage, shared_dir

_SCORES = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
scores AS (SELECT q.id AS query_id, c.id AS neighbour_id, round(list_cosine_similarity(q.e, c.e), 9) AS score,
                  q.label AS query_label, c.label AS label FROM v q, v c WHERE q.id <> c.id)"""


def _top(k: int, where: str = "true", name: str = "hits") -> str:
    return f"""{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank
  FROM scores WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) <= {k})"""


def _hits(spark, folder, k, **options):
    v = V.vectors(spark, folder)
    return B.nearest(v, v, k, exclude_self=True, **options)


@named("knn_topk", "WITH " + _SCORES + ", " + _top(10) + """
SELECT query_id, rank, neighbour_id, round(score, 6) AS score FROM hits""")
def knn_topk(spark, folder):
    return _hits(spark, folder, 10).select("query_id", "rank", "neighbour_id", F.round("score", 6).alias("score"))


@named("knn_topk_cells", "WITH " + _SCORES + ", " + _top(5) + """
SELECT query_id, rank, neighbour_id, round(score, 6) AS score FROM hits""")
def knn_topk_cells(spark, folder):
    """The same search on the many-cell path that large corpora take."""
    found = _hits(spark, folder, 5, cells=6, column_rows=128)
    return found.select("query_id", "rank", "neighbour_id", F.round("score", 6).alias("score"))


@named("knn_threshold", "WITH " + _SCORES + ", " + _top(10, "score >= 0.4") + """
SELECT query_id, rank, neighbour_id, round(score, 6) AS score FROM hits""")
def knn_threshold(spark, folder):
    found = _hits(spark, folder, 10, min_score=0.4)
    return found.select("query_id", "rank", "neighbour_id", F.round("score", 6).alias("score"))


@named("vector_index_search", "WITH " + _SCORES + ", " + _top(10) + """
SELECT query_id, rank, neighbour_id, round(score, 6) AS score FROM hits""")
def vector_index_search(spark, folder):
    """A stored index of all vectors: made with stale vectors of label 3 and without label 7, put right, then searched."""
    given = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    stale = given.where("label <> 7").withColumn("vec", F.when(F.col("label") == 3, F.reverse("vec")).otherwise(F.col("vec")))
    first = given.select(F.size("vec").alias("d")).first()
    index = X.create(stale, f"{shared_dir(spark)}/index-{uuid.uuid4()}", dimension=first["d"] if first else E.DIMENSION)
    X.put(index, given.where("label IN (3, 7)"))
    found = X.search(index, V.vectors(spark, folder), 10, exclude_self=True)
    return found.select("query_id", "rank", "neighbour_id", F.round("score", 6).alias("score"))


def _payload(spark, folder):
    e = V.table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("Ticket "), F.col("vec_id").cast("string")).alias("subject"),
                    F.lit("open").alias("status"), F.col("label").cast("bigint").alias("cluster_id"))


@named("search_filtered", f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
scores AS (SELECT q.id AS query_id, c.id AS neighbour_id, round(list_cosine_similarity(q.e, c.e), 9) AS score
           FROM v q, v c WHERE c.label = 3), {_top(5)}
SELECT query_id, rank, neighbour_id AS ticket_id, 'Ticket ' || neighbour_id AS subject, 'open' AS status,
       CAST(3 AS BIGINT) AS cluster_id, round(score, 6) AS similarity FROM hits""")
def search_filtered(spark, folder):
    corpus = V.vectors(spark, folder).join(_payload(spark, folder).select("id", "cluster_id"), "id")
    found = R.search(V.vectors(spark, folder), corpus, _payload(spark, folder), 5, cluster_id=3)
    return found.withColumn("similarity", F.round("similarity", 6))


_VOTE = "WITH " + _SCORES + ", " + _top(10) + """, votes AS (
  SELECT query_id, label, sum(score) AS weight, min(rank) AS first_rank FROM hits WHERE label <> 9 GROUP BY 1, 2),
winner AS (SELECT *, sum(weight) OVER (PARTITION BY query_id) AS total FROM votes
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, first_rank) = 1),
best AS (SELECT query_id, max(score) AS best, string_agg(CAST(neighbour_id AS VARCHAR), ',' ORDER BY rank)
           FILTER (rank <= 5) AS similar_tickets FROM hits GROUP BY 1)
SELECT query_id, CAST(label AS BIGINT) AS cluster_id, 'Cluster ' || label AS cluster_label,
       round(CASE WHEN label IS NULL THEN best WHEN total > 0 THEN weight / total ELSE 0 END, 6) AS confidence,
       similar_tickets FROM best LEFT JOIN winner USING (query_id)"""


@named("knn_vote", _VOTE)
def knn_vote(spark, folder):
    """Neighbours of label 9 count as not clustered yet."""
    labels = V.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") != 9, F.col("label").cast("bigint")).alias("cluster_id"))
    names = labels.where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct().select(
        "cluster_id", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("label"))
    voted = R.with_labels(R.vote(_hits(spark, folder, 10), labels), names)
    return voted.select("query_id", "cluster_id", "cluster_label", F.round("confidence", 6).alias("confidence"),
                        F.array_join(F.col("similar_tickets").cast("array<string>"), ",").alias("similar_tickets"))


@named("near_duplicates", "WITH " + _SCORES + """
SELECT query_id AS id, neighbour_id AS duplicate_of, round(score, 6) AS score FROM scores
WHERE score >= 0.45 AND neighbour_id < query_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) = 1""")
def near_duplicates(spark, folder):
    found = B.duplicate_edges(V.vectors(spark, folder), 0.45)
    return found.withColumn("score", F.round("score", 6))


@named("near_duplicate_groups", "WITH RECURSIVE " + _SCORES + """,
links AS MATERIALIZED (SELECT query_id AS src, neighbour_id AS dst FROM scores WHERE score >= 0.45),
reach AS (SELECT src AS id, src AS other FROM links UNION SELECT id, dst FROM reach JOIN links ON src = other),
n AS (SELECT src AS id, count(*) AS n_links FROM links GROUP BY 1)
SELECT id, min(other) AS group_id, any_value(n_links) AS n_links FROM reach JOIN n USING (id) GROUP BY 1""")
def near_duplicate_groups(spark, folder):
    """All pairs count here, where near_duplicates names one earlier ticket."""
    return B.duplicate_groups(V.vectors(spark, folder), 0.45)


@named("near_duplicates_hashed")
def near_duplicates_hashed(spark, folder):
    """Groups of near copies among all documents by hashed vectors; recall is measured in the tests."""
    documents = V.texts(spark, folder, "documents").select("doc_id", "text")
    return L.hashed_groups(E.embed(documents, "doc_id").withColumnRenamed("doc_id", "id"), 0.8)


@named("duplicate_hit_rate", "WITH " + _SCORES + ", " + _top(20) + """,
q AS (SELECT query_id, bool_or(query_label = label) AS hit FROM hits GROUP BY 1)
SELECT count(*) AS n_queries, count(*) FILTER (hit) AS n_hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM q""")
def duplicate_hit_rate(spark, folder):
    truth = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cause"))
    rate = Q.duplicate_hit_rate(_hits(spark, folder, 20), truth)
    return rate.withColumn("hit_rate", F.round("hit_rate", 6))


_BUCKETS = """w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word
  FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS bucket,
             CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w),
s AS (SELECT doc_id, bucket, sum(sign) AS x FROM b GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)"""


@named("embed_text", "WITH " + _BUCKETS + """
SELECT doc_id, count(*) FILTER (x <> 0) AS n_filled, count(*) FILTER (x > 0) AS n_positive,
       CAST(sum(CASE WHEN x <> 0 THEN bucket + 1 ELSE 0 END) AS BIGINT) AS places, true AS unit_length
FROM s JOIN n USING (doc_id) WHERE norm > 0 GROUP BY 1""")
def embed_text(spark, folder):
    """Vectors of all documents, compared by their filled places, signs and length."""
    d = V.texts(spark, folder, "documents").select("doc_id", "text")
    vectors = E.assert_dimension(E.embed(d, "doc_id"), E.DIMENSION)
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    places = F.transform("vec", lambda x, i: F.when(x != 0, i + 1).otherwise(F.lit(0)))
    return vectors.where(F.exists("vec", lambda x: x != 0)).select(
        "doc_id", F.size(F.filter("vec", lambda x: x != 0)).cast("bigint").alias("n_filled"),
        F.size(F.filter("vec", lambda x: x > 0)).cast("bigint").alias("n_positive"),
        F.aggregate(places, F.lit(0).cast("bigint"), lambda total, p: total + p).alias("places"),
        (F.abs(squares - 1) < 1e-5).alias("unit_length"))


def message_hits(spark, folder, k=5):
    """Incoming messages (benchmark texts) against all documents, through the default embedder."""
    messages = V.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    documents = V.texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    # Stored once: the search reads the corpus more than one time.
    return B.nearest(cut_lineage(E.embed(messages, "id")), cut_lineage(E.embed(documents, "id")), k)


@named("search_messages", f"""
WITH texts AS (SELECT 'q' || item_id AS key, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents),
w AS (SELECT key, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM texts),
b AS (SELECT key, ('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS bucket,
             CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w),
s AS (SELECT key, bucket, CAST(sum(sign) AS DOUBLE) AS x FROM b GROUP BY 1, 2),
n AS (SELECT key, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1),
u AS (SELECT key, bucket, x / norm AS x FROM s JOIN n USING (key) WHERE norm > 0),
scores AS (SELECT q.key AS query_id, d.key AS neighbour_id, sum(q.x * d.x) AS score
           FROM u q JOIN u d USING (bucket) WHERE q.key[1] = 'q' AND d.key[1] = 'd' GROUP BY 1, 2)
SELECT query_id, round(max(score), 3) AS best FROM scores GROUP BY 1""")
def search_messages(spark, folder):
    """Best similarity of every message."""
    best = message_hits(spark, folder).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_id"),
                       F.round("best", 3).alias("best"))


@named("nearest_clusters", """
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS val, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT label, list(mean ORDER BY dim) AS e FROM (SELECT label, dim, avg(val) AS mean FROM x GROUP BY 1, 2) GROUP BY 1),
scores AS (SELECT vec_id AS query_id, c.label AS label, round(list_cosine_similarity(embedding::DOUBLE[], e), 9) AS score FROM embeddings v, c)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS rank,
       CAST(label AS BIGINT) AS cluster_id, 'Cluster ' || label AS label, round(score, 6) AS similarity
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) <= 3""")
def nearest_clusters(spark, folder):
    """The three nearest clusters of every ticket; clusters without a summary stand for the mean of their members."""
    members = V.member_vectors(spark, folder)
    clusters = members.select("cluster_id").distinct().withColumn("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    means = T.cluster_vectors(clusters.withColumn("summary", F.lit(None).cast("string")), members, fields=("summary",))
    found = T.nearest_clusters(V.vectors(spark, folder), cut_lineage(means), 3, clusters=clusters)
    return found.withColumn("similarity", F.round("similarity", 6))


@named("cluster_search", f"""
WITH texts AS (SELECT 'c' || item_id AS key, 'Item ' || item_id || chr(10) || text AS text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents),
w AS (SELECT key, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM texts),
b AS (SELECT key, ('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS bucket,
             CASE WHEN ('0x' || substr(md5(word), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w),
s AS (SELECT key, bucket, CAST(sum(sign) AS DOUBLE) AS x FROM b GROUP BY 1, 2),
n AS (SELECT key, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1),
u AS (SELECT key, bucket, x / norm AS x FROM s JOIN n USING (key) WHERE norm > 0),
scores AS (SELECT d.key AS id, c.key AS item, sum(d.x * c.x) AS score FROM u c JOIN u d USING (bucket) WHERE c.key[1] = 'c' AND d.key[1] = 'd' GROUP BY 1, 2)
SELECT substr(id, 2)::BIGINT AS doc_id, round(max(score), 3) AS best, count(*) FILTER (score >= 0.5) AS n_near FROM scores GROUP BY 1 HAVING max(score) >= 0.5""")
def cluster_search(spark, folder):
    """Documents as tickets against items as clusters with a summary: all clusters at a score of 0.5 or more."""
    items = V.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("cluster_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("label"), F.col("text").alias("issue_description"))
    vectors = cut_lineage(T.summary_vectors(items, fields=("label", "issue_description")))
    documents = cut_lineage(E.embed(V.texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), "id"))
    found = T.nearest_clusters(documents, vectors, max(1, vectors.count()), clusters=items, min_score=0.5)
    return found.groupBy(F.col("query_id").alias("doc_id")).agg(F.round(F.max("similarity"), 3).alias("best"), F.count(F.lit(1)).alias("n_near"))
