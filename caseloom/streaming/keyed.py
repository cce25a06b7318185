"""Ticket events with keyed state: which tickets are known, in which version, is kept per key by the stream itself.

The state (RocksDB) holds a version and a digest per ticket, so telling new from known tickets costs what the batch costs
and not what came before.  Accepted tickets are routed over a stored vector index, of which a batch reads the cells that
it visits and rewrites those that it adds to.  A batch first stores its routed tickets, then adds them to the index,
and records its counts last; a batch that is run again goes on behind its stored tickets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from caseloom.operators import vector_index
from caseloom.operators.embedding import DIMENSION, Embedder, embed
from caseloom.operators.normalize import accepted, normalize, payload_errors
from caseloom.operators.routing import VOTERS, vote
from caseloom.session import cut_lineage
from caseloom.sources.tables import exists
from caseloom.streaming.incremental import parse_events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lines without a ticket, and rejected ones, have no key: they pass through this many keys of their own.
BLANKS = 64
_STATE = "version string, digest string"
_PASSED = "ticket_id string, verdict string, payload string, seen bigint"
_COUNTS = ("received", "processed", "skipped", "without_ticket", "rejected")


class NewestVersion(StatefulProcessor):
    """Hands on a ticket when it is unknown or, in the mode ``update``, newer than the version handed on last.

    A version is the ticket's time of update, then the digest of its payload, so the last version that a stream hands on
    does not depend on how the lines are cut into batches.  Keys that are blank only hand on rejected payloads
    and counts.  State that was not touched for ``expires`` milliseconds is forgotten.
    """

    def __init__(self, mode: str, expires: int | None):
        self.mode, self.expires = mode, expires

    def init(self, handle):
        self.state = handle.getValueState("newest", _STATE, self.expires)

    def handleInputRows(self, key, rows, timerValues):
        import hashlib

        import pandas as pd
        names = ["ticket_id", "verdict", "payload", "seen"]
        if key[1] >= 0:
            for batch in rows:
                kept = batch["payload"].notna()
                yield pd.DataFrame({"ticket_id": batch["given_id"][kept], "verdict": "rejected", "payload": batch["payload"][kept], "seen": 1})[names]
                yield pd.DataFrame([(None, "without_ticket", None, int((~kept).sum()))], columns=names)
            return
        known = self.state.get() if self.state.exists() else None
        best, seen = None, 0
        for batch in rows:
            seen += len(batch)
            for version, payload in zip(batch["version"], batch["payload"]):
                one = (version, hashlib.sha256(payload.encode()).hexdigest(), payload)
                best = one if best is None or one > best else best
        newer = known is None or (self.mode == "update" and best[:2] > tuple(known))
        if newer:
            self.state.update(best[:2])
        elif self.expires:
            self.state.update(tuple(known))
        yield pd.DataFrame([(key[0], "taken" if newer else "known", best[2] if newer else None, seen)], columns=names)

    def handleInitialState(self, key, initialState, timerValues):
        self.state.update(("", ""))

    def close(self):
        pass


@dataclass
class KeyedStore:
    """Folders of the stream's tables, in the shared file system."""

    root: str
    normalized_at: str
    seeds: DataFrame | None = None      # (ticket_id, vec, cluster_id) known before the stream began
    dimension: int = DIMENSION
    embedder: Embedder | None = None
    mode: str = "new"                   # 'new' skips known tickets, 'update' takes newer versions of them
    expires: int | None = None          # milliseconds after which an untouched ticket is unknown again
    voters: int = VOTERS

    def part(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    @property
    def index(self) -> str:
        return f"{self.root}/index"


def versions(lines: DataFrame, store: KeyedStore) -> DataFrame:
    """The stream of tickets to take, known ones, rejected ones and counts of lines without a ticket."""
    events = parse_events(lines)
    payload = F.col("raw_payload")
    given = events.select(
        F.col("ticket_id").alias("given_id"), F.to_json(payload).alias("payload"),
        F.coalesce(F.try_variant_get(payload, "$.updated_at", "string"), F.lit("")).alias("version"),
        (payload.isNotNull() & F.col("ticket_id").isNotNull() & (F.size(payload_errors(payload)) == 0)).alias("good"))
    usable = F.coalesce("good", F.lit(False))
    spread = F.pmod(F.xxhash64("payload", F.rand(7)), F.lit(BLANKS)).cast("int")
    keyed = given.select(
        F.when(usable, F.col("given_id")).otherwise(F.lit("")).alias("ticket_id"),
        F.when(usable, F.lit(-1)).otherwise(spread).alias("blank"), "given_id",
        F.when(F.col("given_id").isNotNull(), F.col("payload")).alias("payload"), "version")
    known = None
    if store.seeds is not None:
        known = store.seeds.where(F.col("ticket_id").isNotNull()).select(F.col("ticket_id").cast("string").alias("ticket_id"), F.lit(-1).alias("blank"))
        known = known.distinct().groupBy("ticket_id", "blank")
    return keyed.groupBy("ticket_id", "blank").transformWithStateInPandas(
        NewestVersion(store.mode, store.expires), _PASSED, "Append", "None" if store.expires is None else "ProcessingTime", known)


def _routed(queries: DataFrame, store: KeyedStore) -> DataFrame:
    """(query_id, cluster_id, confidence) by the vote of the stored neighbours; a row without any has (null, 0)."""
    spark = queries.sparkSession
    none = queries.select(F.col("id").alias("query_id"), F.lit(None).cast("bigint").alias("cluster_id"), F.lit(0.0).alias("confidence"))
    if not vector_index.ready(spark, store.index):
        return none
    index = vector_index.load(spark, store.index, queries.schema["id"].dataType)
    hits = cut_lineage(vector_index.search(index, queries, store.voters, exclude_self=True, tagged=True))
    tags = hits.select(F.col("neighbour_id").alias("id"), F.col("tag").alias("cluster_id")).distinct()
    voted = vote(hits.drop("tag"), tags, unvoted="zero").select("query_id", "cluster_id", "confidence")
    return none.select("query_id").join(voted, "query_id", "left").select(
        "query_id", "cluster_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def process(passed: DataFrame, batch_id: int, store: KeyedStore) -> None:
    """Normalize, embed, route and store what one micro-batch hands on."""
    spark = passed.sparkSession
    tickets = store.part("tickets", batch_id)
    held = cut_lineage(passed)
    if not exists(spark, tickets):
        raw = held.where("verdict = 'taken'").select(F.parse_json("payload").alias("raw_payload"))
        rows = accepted(normalize(raw, F.lit(store.normalized_at).cast("timestamp")))
        rows = cut_lineage(rows.withColumn("custom_fields", F.to_json("custom_fields")))
        vectors = cut_lineage(embed(rows.select("ticket_id", F.col("ticket_fulltext").alias("text")), "ticket_id",
                                    embedder=store.embedder, dimension=store.dimension))
        routed = _routed(vectors.select(F.col("ticket_id").alias("id"), "vec"), store)
        found = routed.select(F.col("query_id").alias("ticket_id"), "cluster_id", F.col("confidence").alias("cluster_confidence"))
        rows.drop("cluster_id", "cluster_confidence").join(vectors, "ticket_id").join(found, "ticket_id").write.mode("overwrite").parquet(tickets)
    done = spark.read.parquet(tickets)
    new = done.select(F.col("ticket_id").alias("id"), "vec", F.col("cluster_id").alias("tag"))
    if vector_index.ready(spark, store.index):
        vector_index.put(vector_index.load(spark, store.index, new.schema["id"].dataType), new, replaces=store.mode == "update")
    else:
        vector_index.create(new, store.index, dimension=store.dimension)
    (held.where("verdict = 'rejected'").select(F.col("ticket_id"), payload_errors(F.parse_json("payload")).alias("errors"), "payload")
     .write.mode("overwrite").parquet(store.part("rejected", batch_id)))
    # The run record comes last: its presence says that the batch is whole.
    taken = F.count_if(F.col("verdict") == "taken")
    blank = F.coalesce(F.sum(F.when(F.col("verdict") == "without_ticket", F.col("seen"))), F.lit(0))
    rejected = F.count_if(F.col("verdict") == "rejected")
    received = F.coalesce(F.sum("seen"), F.lit(0))
    counts = held.agg(received.alias("received"), taken.alias("processed"), (received - taken - blank - rejected).alias("skipped"),
                      blank.alias("without_ticket"), rejected.alias("rejected"))
    newest = done.agg(F.max("updated_at").alias("newest")).first()["newest"]
    counts.withColumn("synced_to", F.lit(newest).cast("timestamp")).write.mode("overwrite").parquet(store.part("runs", batch_id))


def run_keyed(lines: DataFrame, store: KeyedStore, available_now: bool = True):
    """Start the stream; seeds become the first rows of the index and the initial state.

    Expiry runs on the clock, and a stream that watches the clock always has a next batch: it cannot end by itself.
    """
    if store.expires is not None and available_now:
        raise ValueError("expires needs available_now=False")
    spark = lines.sparkSession
    if store.seeds is not None and not vector_index.ready(spark, store.index):
        seeds = store.seeds.select(F.col("ticket_id").cast("string").alias("id"), "vec", F.col("cluster_id").cast("bigint").alias("tag"))
        vector_index.create(seeds, store.index, dimension=store.dimension)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        writer = versions(lines, store).writeStream.foreachBatch(lambda batch, number: process(batch, number, store)).option(
            "checkpointLocation", f"{store.root}/_progress")
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    if available_now:
        query.awaitTermination()
    return query


def _parts(spark: SparkSession, store: KeyedStore, table: str) -> DataFrame:
    return spark.read.parquet(f"{store.root}/{table}")


def current_tickets(spark: SparkSession, store: KeyedStore) -> DataFrame:
    """The newest version of each ticket: the one of its last batch, found over narrow rows."""
    parts = _parts(spark, store, "tickets")
    last = parts.groupBy("ticket_id").agg(F.max("batch_id").alias("batch_id"))
    return parts.join(last, ["ticket_id", "batch_id"], "left_semi").drop("batch_id", "vec")


def totals(spark: SparkSession, store: KeyedStore) -> DataFrame:
    """Counts of all whole batches."""
    return _parts(spark, store, "runs").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _COUNTS], F.max("synced_to").alias("synced_to"))
