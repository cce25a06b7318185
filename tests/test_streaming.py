import json

import pytest

from caseloom.operators.embedding import embed, hash_embedder
from caseloom.streaming import incremental as I, volume as L

AT = "2024-02-01 00:00:00"


def event(n, **more):
    ticket = {"id": n, "created_at": "2024-01-01", "updated_at": f"2024-01-0{1 + n % 8}", "subject": f"word{n % 4} issue", **more}
    return json.dumps({"ticket_id": str(n), "event_type": "ticket.created", "ticket": ticket})


def store_at(path, **options):
    return I.Store(str(path), dimension=16, embedder=hash_embedder(16), **options)


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def run(spark, folder, store, per_trigger=1):
    stream = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(str(folder))
    I.run_stream(stream, store, AT)


@pytest.mark.parametrize("files", [1, 3])
def test_any_split_gives_the_same_tickets(spark, tmp_path, files):
    lines = [event(n) for n in range(1, 13)]
    for f in range(files):
        write(tmp_path / "in", f"{f}.txt", lines[f::files])
    store = store_at(tmp_path / "out")
    run(spark, tmp_path / "in", store)
    got = {(r.ticket_id, r.subject) for r in I.current_tickets(spark, store).collect()}
    assert got == {(str(n), f"word{n % 4} issue") for n in range(1, 13)}


def test_repeats_updates_and_bad_rows(spark, tmp_path):
    first = [event(1), event(1), event(2), '{"event_type":"ticket.updated","ticket_id":"5"}', "no json",
             json.dumps({"id": 9, "subject": "plain ticket", "created_at": "2024-01-02"}), event(4, created_at=None)]
    write(tmp_path / "in", "0.txt", first)
    for mode, subject in (("new", "word1 issue"), ("update", "changed")):
        store = store_at(tmp_path / mode, mode=mode)
        run(spark, tmp_path / "in", store)
        row = I.read_part_table(spark, store, "runs").first()
        assert (row.received, row.processed, row.skipped, row.without_ticket, row.rejected) == (7, 3, 1, 2, 1)
        assert str(I.last_sync(spark, store).first().synced_to) == "2024-01-03 00:00:00"
        write(tmp_path / "more", "1.txt", [event(1, subject="changed", updated_at="2024-01-09")])
        # A later batch through the same step the stream uses.
        I.process_batch(spark.read.text(str(tmp_path / "more")), 1, store, AT)
        got = {r.ticket_id: r.subject for r in I.current_tickets(spark, store).collect()}
        assert got == {"1": subject, "2": "word2 issue", "9": "plain ticket"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write(tmp_path / "in", "0.txt", [event(n) for n in range(1, 6)])
    store = store_at(tmp_path / "out")
    lines = spark.read.text(str(tmp_path / "in"))
    I.process_batch(lines, 0, store, AT)
    before = sorted(r.ticket_id for r in I.read_part_table(spark, store, "tickets").collect())
    I.process_batch(lines, 0, store, AT)
    assert sorted(r.ticket_id for r in I.read_part_table(spark, store, "tickets").collect()) == before
    assert I.read_part_table(spark, store, "runs").first().processed == 5


def test_new_tickets_join_the_cluster_of_their_neighbours(spark, tmp_path):
    texts = spark.createDataFrame([("s1", "word1 issue"), ("s2", "word2 issue"), ("s3", "word2 issue")], "ticket_id string, text string")
    seeds = embed(texts, "ticket_id", embedder=hash_embedder(16), dimension=16).selectExpr(
        "*", "case ticket_id when 's1' then 10L else 20L end as cluster_id")
    write(tmp_path / "in", "0.txt", [event(1), event(2)])
    store = store_at(tmp_path / "out", seeds=seeds, options={"k": 1})
    run(spark, tmp_path / "in", store)
    got = {r.ticket_id: (r.cluster_id, r.cluster_confidence) for r in I.current_tickets(spark, store).collect()}
    assert got == {"1": (10, 1.0), "2": (20, 1.0)}


def test_volume_windows_and_late_rows(spark, tmp_path):
    def write_rows(n, times):
        rows = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp_ntz) as ts")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    write_rows(0, ["2024-01-04 00:00:00", "2024-01-05 00:00:00", "2024-01-12 00:00:00"])

    def go():
        stream = spark.readStream.schema("ts timestamp_ntz").parquet(str(tmp_path / "in/*"))
        L.run_volume(stream, "ts", str(tmp_path / "out"), delay="1 day")
    go()
    write_rows(1, ["2024-03-01 00:00:00"])
    go()
    write_rows(2, ["2024-01-06 00:00:00", "2024-03-02 00:00:00"])
    go()
    got = {str(r.window_start)[:10]: r.n for r in L.current_volume(spark, str(tmp_path / "out")).collect()}
    # The row of January 6 comes after the watermark passed its window.
    assert got == {"2024-01-04": 2, "2024-01-11": 1, "2024-02-29": 2}


def test_streaming_delta(spark, tmp_path):
    rows = spark.sql("""select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:05:00'),
        ('b', timestamp'2024-01-01 00:00:00'), ('k', timestamp'2024-01-01 00:00:00') as t(ticket_id, at)""")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k",)], "ticket_id string")
    query = (I.known_filter(stream, known, "at", "1 hour").writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.ticket_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_seeds_are_made_once_for_all_batches(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    texts = spark.createDataFrame([("s1", "word1 issue"), ("s2", "word2 issue")], "ticket_id string, text string").mapInPandas(
        count, "ticket_id string, text string")
    seeds = embed(texts, "ticket_id", embedder=hash_embedder(16), dimension=16).selectExpr("*", "10L as cluster_id")
    for n in (1, 2):
        write(tmp_path / "in", f"{n}.txt", [event(n)])
    store = store_at(tmp_path / "out", seeds=seeds)
    run(spark, tmp_path / "in", store)
    assert {(r.ticket_id, r.cluster_id) for r in I.current_tickets(spark, store).collect()} == {("1", 10), ("2", 10)}
    assert made.value == 2
