import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import language_id, quality_classifier
from caseloom.llm.quality_classifier import isotonic
from tests.llm.common import documents, empty, frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_on_held_out_texts(spark, given):
    network = language_id.fit(given)
    found = language_id.identify(given, network).join(given.select("doc_id", "lang", "text"), "doc_id")
    held_out = found.where((language_id.fold(F.col("doc_id")) == 1) & (F.length("text") > 20))
    assert held_out.where("lang = lang_pred").count() >= 0.97 * held_out.count()


def test_language_of_odd_cases(spark, given):
    network = language_id.fit(given)
    rows = language_id.identify(frame(spark), network).collect()
    assert len(rows) == len(documents())
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {4000, 4001, 4002, 4007} <= unknown and 4003 not in unknown
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(empty(spark), network).count() == 0
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.identify(frame(spark), None).collect()} == {"und"}
    kept = language_id.filter_known(frame(spark), network, 0.0)
    assert kept.columns == frame(spark).columns
    assert kept.count() == sum(r["lang_pred"] != "und" for r in rows)


def test_language_reads_whole_texts(spark, given):
    network = language_id.fit(given)
    texts = {r["lang"]: r["text"] for r in given.where("length(text) > 500").dropDuplicates(["lang"]).collect()}
    mixed = texts["en"][:260] + texts["de"][:500] * 60
    rows = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert language_id.identify(rows, network).first()["lang_pred"] == "de"


def test_quality_on_held_out_labels(spark, given):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality_classifier.score(given, labels).join(labels, "doc_id").where(language_id.fold(F.col("doc_id")) == 1)
    assert scored.where("quality = predicted").count() >= 0.95 * scored.count()


def test_quality_of_odd_cases(spark):
    labels = spark.createDataFrame([(1000 - i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = quality_classifier.score(frame(spark), labels).collect()
    assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    none = quality_classifier.score(frame(spark), labels.where("quality > 5")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.score(empty(spark), labels).count() == 0


def test_isotonic_levels():
    levels = isotonic(np.arange(6), np.array([0.0, 0.5, 0.2, 0.9, 0.8, 1.0]), np.ones(6))
    assert np.allclose(levels, [0, 0.35, 0.35, 0.85, 0.85, 1])
