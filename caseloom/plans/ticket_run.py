"""The whole batch run: raw payloads to labelled clusters, each stage a stored table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions import prompts
from caseloom.functions.redaction import redact
from caseloom.operators import clusters as C, inference, joins
from caseloom.operators.density import density_clusters
from caseloom.operators.embedding import DIMENSION, Embedder, embed, summary_text
from caseloom.operators.normalize import accepted, normalize, rejected
from caseloom.session import cut_lineage
from caseloom.sources import tables


@dataclass
class RunOptions:
    """Models and switches of a run.

    A finished stage is read again, unless it is named in ``redo`` or an earlier stage was made anew.  Finished summaries
    are kept when only an earlier stage changed.  With ``redaction`` the models see redacted texts only.
    """

    root: str
    normalized_at: str
    redaction: bool = False
    redo: set = field(default_factory=set)
    summary_model: inference.Model = inference.extractive_summary
    label_model: inference.Model = inference.keyword_label
    embedder: Embedder | None = None
    dimension: int = DIMENSION
    eps: float | str = "auto"
    search: dict = field(default_factory=dict)


class _Stages:
    """Stored stages in order; once one is made, all later ones are."""

    def __init__(self, spark: SparkSession, options: RunOptions):
        self.spark, self.options, self.stale = spark, options, False

    def __call__(self, name: str, build) -> DataFrame:
        path = f"{self.options.root}/{name}"
        if self.stale or name in self.options.redo or not tables.exists(self.spark, path):
            tables.write_table(build(), path)
            self.stale = True
        return self.spark.read.parquet(path)

    def before(self, name: str) -> DataFrame | None:
        """What a stage held until now, unless it was asked for anew."""
        path = f"{self.options.root}/{name}"
        if name in self.options.redo or not tables.exists(self.spark, path):
            return None
        return cut_lineage(self.spark.read.parquet(path))


def run(raw: DataFrame, options: RunOptions) -> dict[str, DataFrame]:
    """Tables of the run by name.  ``raw`` holds raw_payload (variant)."""
    spark = raw.sparkSession
    at = F.lit(options.normalized_at).cast("timestamp")

    stage = _Stages(spark, options)
    description, fulltext = ("description_redacted", "pii_redacted_text") if options.redaction else ("description", "ticket_fulltext")

    # Stored once with its errors, so payloads are parsed a single time.
    staged = stage("normalized", lambda: normalize(raw, at, redaction=options.redaction))
    tickets = accepted(staged)

    def asked() -> DataFrame:
        content = F.coalesce(F.nullif(F.col(description), F.lit("")), F.col(fulltext))
        subject = redact(F.col("subject")) if options.redaction else F.col("subject")
        return tickets.select("ticket_id", subject.alias("subject"), content.alias("content"),
                              prompts.simple_prompt(subject, content).alias("prompt"))

    summaries = stage("summaries", lambda: inference.summarize(
        asked(), stage.before("summaries"), model=options.summary_model))

    def texts() -> DataFrame:
        good = summaries.where(F.col("status") == "ok").select("ticket_id", "summary")
        text = summary_text(F.col("summary"), F.col(fulltext), F.col("subject"), F.col(description))
        return tickets.join(good, "ticket_id", "left").select("ticket_id", text.alias("text"))

    vectors = stage("vectors", lambda: embed(texts(), "ticket_id", embedder=options.embedder,
                                             dimension=options.dimension))
    assignments = stage("assignments", lambda: density_clusters(
        vectors.select(F.col("ticket_id").alias("id"), "vec"), eps=options.eps, **options.search)
        .withColumnRenamed("id", "ticket_id"))
    members = assignments.where(F.col("cluster_id") != C.NOISE)

    def described() -> DataFrame:
        placed = tickets.select("ticket_id", F.col(fulltext).alias("text"))
        words = C.keywords(members.join(placed, "ticket_id"))
        words = words.groupBy("cluster_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("keywords"))
        near = C.representatives(members.join(vectors.withColumnRenamed("vec", "vector"), "ticket_id"))
        told = joins.representative_texts(near, placed)
        return C.cluster_sizes(members).join(words, "cluster_id", "left").join(told, "cluster_id", "left")

    found = stage("clusters", described)
    labels = stage("cluster_summaries", lambda: inference.label_clusters(found, model=options.label_model))
    return {"tickets": tickets, "rejected": rejected(staged), "summaries": summaries, "vectors": vectors,
            "assignments": assignments, "clusters": found, "cluster_summaries": labels}
