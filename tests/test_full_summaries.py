from caseloom.functions import text as X
from caseloom.operators import full_summaries as S

TURNS = "ticket_id string, turn bigint, role string, name string, body string"
IMAGES = "ticket_id string, image_descriptions array<struct<filename:string,description:string>>"


def context(spark, extra=(), **options):
    tickets = spark.createDataFrame(
        [("a", "Printer", "it is broken", ["hw"], [("floor", "3"), ("none", None)]), ("b", None, "only a description here", None, None), ("c", None, None, None, None)],
        "ticket_id string, subject string, description string, tags array<string>, custom_fields array<struct<name:string,value:string>>")
    turns = spark.createDataFrame([("a", 0, "end-user", "Ann", "the printer jams"), ("a", 1, "agent", "Bob", "clean the printer rollers"), *extra], TURNS)
    images = spark.createDataFrame([("a", [("p.png", "a jam")])], IMAGES)
    return S.full_context(tickets, turns, images, **options)


def test_prompt_holds_thread_fields_and_images(spark):
    rows = {r.ticket_id: r for r in context(spark).collect()}
    assert set(rows) == {"a", "b", "c"}
    thread = "[CUSTOMER] Ann: the printer jams\n\n[AGENT] Bob: clean the printer rollers"
    assert rows["a"].prompt.endswith(f"Tags: hw\nCustom fields:\n  - floor: 3\nConversation (2 comments, 7 words):\n{thread}{X.IMAGE_HEADING}  - p.png: a jam")
    assert rows["b"].prompt.endswith("Conversation (0 comments, 4 words):\nonly a description here")
    assert rows["c"].prompt.endswith("Conversation (0 comments, 0 words):\nNo content") and "Status: unknown" in rows["c"].prompt
    assert not any(r.cut for r in rows.values())


def test_long_threads_are_marked(spark):
    extra = [("b", n, "agent", "Bob", "word " * 400) for n in range(30)]
    cut = {r.ticket_id: r for r in context(spark, extra, limit=3000).collect()}
    assert cut["b"].cut and not cut["a"].cut and X.TRUNCATION_MARK in cut["b"].content
    whole = {r.ticket_id: r for r in context(spark, extra, limit=S.WHOLE).collect()}
    assert not whole["b"].cut and whole["b"].content.count("word") == 12_000


def test_a_run_goes_on_per_version_and_prompt(spark):
    first = S.summarize_full(context(spark), version="v1").cache()
    assert {r.ticket_id: (r.status, r.skipped) for r in first.collect()} == {"a": ("ok", False), "b": ("ok", False), "c": ("ok", False)}
    summary = {r.ticket_id: r.summary for r in first.collect()}["a"]
    assert summary.startswith("Issue: Printer\nProblem: [CUSTOMER] Ann: the printer jams\nResolution: [AGENT] Bob: clean the printer rollers\nImages: - p.png: a jam\nKeywords: printer")
    again = S.summarize_full(context(spark, [("b", 0, "agent", None, "new")]), first, version="v1")
    assert {r.ticket_id: r.skipped for r in again.collect()} == {"a": True, "b": False, "c": True}
    assert not any(r.skipped for r in S.summarize_full(context(spark), first, version="v2").collect())


def test_failures_are_tried_again(spark):
    def failing():
        def answer(row):
            if row["subject"] == "Printer":
                raise ValueError("no answer")
            return "fine"
        return answer

    first = S.summarize_full(context(spark), model=failing).cache()
    assert {r.ticket_id: r.status for r in first.collect()} == {"a": "failed", "b": "ok", "c": "ok"}
    later = {r.ticket_id: (r.status, r.skipped) for r in S.summarize_full(context(spark), first).collect()}
    assert later == {"a": ("ok", False), "b": ("ok", True), "c": ("ok", True)}


def test_empty_tables(spark):
    none = context(spark).limit(0)
    assert S.summarize_full(none).count() == 0 and S.summarize_full(context(spark), S.summarize_full(none)).count() == 3
