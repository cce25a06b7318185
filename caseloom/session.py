"""Session settings and lineage control shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on.  Everything here can be set on a
# live session, so a session made elsewhere can be prepared too.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of long texts is bounded by its bytes, not by its rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def build_session(app_name: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session.  Cluster deployments pass no master and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**RUNTIME_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach.

    ``spark.checkpoint.dir`` names it on a cluster.  Only a session without that
    setting (a local test) gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
        current = context.getCheckpointDir()
    return current


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame to reliable storage and go on from there."""
    shared_dir(frame.sparkSession)
    return _bounded(frame.checkpoint(eager=True))


def _bounded(cut: DataFrame) -> DataFrame:
    """The stored frame, without an estimate of its size that is larger than any table.

    A checkpoint hands on the optimizer's estimate, and a join multiplies those of its sides: over rounds of joins the
    digits of one number multiply, until it fills the driver's memory.
    """
    plan = cut._jdf.queryExecution().analyzed()
    size = plan.stats().simpleString()
    if "EiB" not in size and "E+" not in size:
        return cut
    session, none = cut.sparkSession, cut.sparkSession._jvm.scala.Option.empty()
    plain = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session._jsparkSession, none, none)
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plain), session)


def cut_and_free(frame: DataFrame) -> DataFrame:
    """As ``cut_lineage``, and the shuffle files behind the frame go at once instead of with the driver's next collection."""
    conf, name = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return cut_lineage(frame.select("*"))  # a new frame takes up the setting
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def written(frame: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and go on from there.

    For tables that go through many rounds of joins with themselves: a checkpoint hands on what the optimizer has
    estimated and inferred, and that grows from round to round; a table that is read anew does not.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4()}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; an input with enough splits stays as it is.

    Meant in front of costly row-wise work.  A table of many files never pays
    for the extra shuffle.
    """
    wanted = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame
