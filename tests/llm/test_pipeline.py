import collections

import numpy as np

import corpus_pipeline
from caseloom.llm import language_id, tasks
from tests.llm.common import components, documents
from tests.llm.test_byte_bpe import PLAIN
from tests.llm.test_exact_dedup import plain as exact_plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, name, rows, tmp_path):
    frame = spark.createDataFrame(rows, SCHEMA)
    function = dict(corpus_pipeline.STAGES)[name]
    out = function(spark, frame, str(tmp_path))
    return frame, out


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixed", "tokens"]
    rows = [(*r, len(r[1] or "")) for r in documents()]
    for name in ("language", "exact", "near", "mixed"):
        frame, out = stage(spark, name, rows, tmp_path)
        assert out.columns == frame.columns
        got = [tuple(r) for r in out.collect()]
        assert not collections.Counter(set(got)) - collections.Counter(set(rows))
        if name == "language":
            assert {r for r in set(rows) - set(got)} == {r for r in set(rows) if not any(c.isalpha() for c in r[1] or "")}
        if name == "exact":
            want = [r[0] for r, p in zip(rows, exact_plain(rows)) if p[3]]
            assert sorted(str(r[0]) for r in got) == sorted(map(str, want))
        if name == "near":
            goes = {i for i, _, c in components(rows, 80, 5) if i != c}
            assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows if r[0] not in goes or r[0] is None)
        if name == "mixed":
            words = sum(len((r[1] or "").split()) for r in rows)
            assert abs(sum(len((r[1] or "").split()) for r in got) - 1.5 * words) <= 0.4 * words
    frame, out = stage(spark, "tokens", rows, tmp_path)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out.collect()) == sorted(
        (str(r[0]), len(PLAIN.encode_ordinary(r[1] or ""))) for r in rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "n_tokens"} <= set(out.columns)


def test_empty_table(spark, tmp_path):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, [], tmp_path)[1].count() == 0


def test_the_network_decides_what_goes_on(spark, tmp_path, monkeypatch):
    """Of three languages equally likely none is known; a document goes on if one outweighs the others."""
    rows = [(i, f"words of text {i}", "a", "s", 1) for i in range(20)]
    zeros = [np.zeros((w, 256, language_id.FILTERS), np.float32) for w in language_id.WIDTHS]
    hidden = len(language_id.WIDTHS) * language_id.FILTERS
    for offset, kept in (([0, 0, 0], 0), ([0.5, 0, 0], 0), ([3, 0, 0], 20)):
        network = language_id.ByteNetwork(["a", "b", "c"], zeros, np.zeros(hidden, np.float32), np.zeros((hidden, 3), np.float32), np.array(offset, np.float32))
        monkeypatch.setattr(language_id, "fit", lambda *_, **__: network)
        assert stage(spark, "language", rows, tmp_path)[1].count() == kept


def test_language_drops_what_another_operator_remembered():
    tasks.worker_cache("byte_bpe")["pieces"] = [1]
    language_id._predictor(None)
    assert tasks.worker_cache("language_id") == {} and "pieces" not in tasks.worker_cache("byte_bpe")


def test_workers_give_free_memory_back_after_their_batches(monkeypatch):
    from caseloom.llm import tasks
    told = []
    monkeypatch.setattr(tasks, "give_back", lambda: told.append("back"))
    run = tasks.trimmed(lambda batches: (told.append(b) or b + 1 for b in batches))
    assert list(run([1, 2])) == [2, 3] and told == [1, 2, "back"]
