import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators.embedding import embed, hash_embedder
from caseloom.operators.normalize import normalize, payload_errors
from caseloom.streaming import incremental as I, keyed as K
from tests.test_streaming import event, write

AT = "2024-02-01 00:00:00"


def store_at(path, dimension=16, **options):
    return K.KeyedStore(str(path), AT, dimension=dimension, embedder=hash_embedder(dimension), **options)


def run(spark, folder, store):
    K.run_keyed(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)), store)
    row = K.totals(spark, store).first()
    return (row.received, row.processed, row.skipped, row.without_ticket, row.rejected)


def subjects(spark, store):
    return {r.ticket_id: r.subject for r in K.current_tickets(spark, store).collect()}


def test_errors_of_a_payload_are_those_of_the_whole_row(spark):
    lines = ['{"id": 1, "created_at": "2024-01-01"}', '{"id": 2}', '{"id": 3, "created_at": 5, "subject": {"a": 1}}',
             '{"id": 4, "created_at": "x", "description": 7, "subject": null}', '{"id": 5, "created_at": "2024-01-01", "description": ["a"]}']
    raw = spark.createDataFrame([(x,) for x in lines], "line string").select(F.parse_json("line").alias("raw_payload"))
    whole = {r.ticket_id: r.errors for r in normalize(raw, F.lit(AT).cast("timestamp")).collect()}
    short = {r.id: r.errors for r in raw.select(F.try_variant_get("raw_payload", "$.id", "string").alias("id"), payload_errors(F.col("raw_payload")).alias("errors")).collect()}
    assert short == whole and whole["3"] and whole["5"]


def test_modes_counts_and_restarts(spark, tmp_path):
    first = [event(1), event(1), event(2), '{"event_type":"ticket.updated","ticket_id":"5"}', "no json",
             json.dumps({"id": 9, "subject": "plain ticket", "created_at": "2024-01-02"}), event(4, created_at=None)]
    later = [event(1, subject="changed", updated_at="2024-01-09"), event(2, subject="stale", updated_at="2023-01-01"), event(4)]
    for mode, subject, counts in (("new", "word1 issue", (10, 4, 3, 2, 1)), ("update", "changed", (10, 5, 2, 2, 1))):
        write(tmp_path / mode, "0.txt", first)
        store = store_at(tmp_path / f"{mode}-out", mode=mode)
        assert run(spark, tmp_path / mode, store) == (7, 3, 1, 2, 1)
        write(tmp_path / mode, "1.txt", later)
        assert run(spark, tmp_path / mode, store) == counts
        assert subjects(spark, store) == {"1": subject, "2": "word2 issue", "9": "plain ticket", "4": "word0 issue"}
        assert spark.read.parquet(f"{store.root}/rejected").first().errors == ["created_at"]


def test_any_split_ends_in_the_same_tickets(spark, tmp_path):
    lines = [event(n % 5, subject=f"s{n}", updated_at=f"2024-01-{1 + n * 7 % 20:02d}") for n in range(1, 16)]
    ends = []
    for files in (1, 3):
        for f in range(files):
            write(tmp_path / f"in{files}", f"{f}.txt", lines[f::files])
        store = store_at(tmp_path / f"out{files}", mode="update")
        run(spark, tmp_path / f"in{files}", store)
        ends.append(subjects(spark, store))
    assert ends[0] == ends[1] and len(ends[0]) == 4


def test_routing_with_seeds_and_a_batch_run_again(spark, tmp_path):
    words = [("s1", "billing invoice refund", 1), ("s2", "invoice refund money", 1), ("s3", "login password reset", 2), ("7", "known seed", 2)]
    seeds = spark.createDataFrame(words, "ticket_id string, text string, cluster_id bigint")
    vectors = embed(seeds, "ticket_id", embedder=hash_embedder(256), dimension=256).join(seeds.drop("text"), "ticket_id")
    ticket = lambda n, text: event(n, subject=text, description="")
    write(tmp_path / "in", "0.txt", [ticket(11, "invoice refund"), ticket(12, "password reset"), ticket(7, "changed")])
    store = store_at(tmp_path / "out", seeds=vectors, voters=1, dimension=256)
    assert run(spark, tmp_path / "in", store) == (3, 2, 1, 0, 0)
    rows = lambda: {r.ticket_id: (r.cluster_id, round(r.cluster_confidence, 6)) for r in K.current_tickets(spark, store).collect()}
    assert rows() == {"11": (1, 1.0), "12": (2, 1.0)}
    before = rows()
    passed = spark.createDataFrame([("11", "taken", ticket(11, "invoice refund"), 1), ("12", "taken", ticket(12, "password reset"), 1), ("7", "known", None, 1)],
                                   "ticket_id string, verdict string, payload string, seen bigint")
    K.process(passed, 0, store)
    assert rows() == before and K.vector_index.load(spark, store.index).rows().count() == 6
    # The stored tickets vote in the next batch.
    write(tmp_path / "in", "1.txt", [ticket(13, "password reset")])
    run(spark, tmp_path / "in", store)
    assert rows()["13"] == (2, 1.0)


def test_same_tickets_and_clusters_as_the_stream_without_state(spark, tmp_path):
    write(tmp_path / "in", "0.txt", [event(n) for n in range(1, 9)])
    keyed, plain = store_at(tmp_path / "keyed"), I.Store(str(tmp_path / "plain"), dimension=16, embedder=hash_embedder(16))
    run(spark, tmp_path / "in", keyed)
    I.run_stream(spark.readStream.text(str(tmp_path / "in")), plain, AT)
    columns = ["ticket_id", "subject", "created_at", "updated_at", "status", "custom_fields", "cluster_id", "cluster_confidence"]
    pick = lambda f: sorted(map(str, f.select(*columns).collect()))
    assert pick(K.current_tickets(spark, keyed)) == pick(I.current_tickets(spark, plain))


def test_a_forgotten_ticket_is_new_again():
    class State:
        """A value that the test may forget, as the store does after its time."""

        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        def getValueState(self, name, schema, expires):
            self.expires, self.state = expires, State()
            return self.state

    handle, processor = Handle(), K.NewestVersion("new", 60_000)
    processor.init(handle)
    rows = pd.DataFrame({"given_id": ["1"], "payload": ["{}"], "version": ["2024"]})
    verdict = lambda: next(processor.handleInputRows(("1", -1), iter([rows]), None))["verdict"].tolist()
    assert handle.expires == 60_000 and verdict() == ["taken"] and verdict() == ["known"]
    handle.state.value = None
    assert verdict() == ["taken"]


def test_expiry_needs_a_stream_that_goes_on(spark, tmp_path):
    with pytest.raises(ValueError, match="available_now"):
        K.run_keyed(spark.readStream.text(str(tmp_path)), store_at(tmp_path / "out", expires=1))
