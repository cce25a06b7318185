"""The corpus pipeline: language, exact copies, near copies, mix of sources, token ids."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import caseloom  # noqa: E402
from caseloom.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing  # noqa: E402
from caseloom.llm.packed_output import new_folder  # noqa: E402
from caseloom.llm.tasks import prepare  # noqa: E402

cloudpickle.register_pickle_by_value(caseloom)

#: A predicted language counts from this probability on: when it is likelier than all others together.
LEAST_LANGUAGE_SCORE = 0.5
#: Bytes of an Arrow batch of the first stage: it hands whole rows on, beside its network and an executor full of their columns.
LANGUAGE_BATCH_BYTES = 2 << 20
#: Bytes of pieces that a worker remembers: after the other stages, the executors' memory is no longer empty.
REMEMBERED = 16 << 20
#: Bytes of an Arrow batch of its last stage, for the same reason.
TOKEN_BATCH_BYTES = 2 << 20


def _same_columns(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: the network prefers one to all others together, and there is a letter."""
    prepare(spark, LANGUAGE_BATCH_BYTES)
    network = language_id.fit(docs)
    judged = language_id.filter_known(docs, network, LEAST_LANGUAGE_SCORE)
    return _same_columns(judged, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the largest identifier."""
    prepare(spark)
    return _same_columns(exact_dedup.keep_one(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts (Jaccard similarity of five-word shingles, 0.8 or more)."""
    prepare(spark, jaccard_join.BATCH_BYTES)
    return _same_columns(jaccard_join.keep_one(docs, percent=80, length=5), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    prepare(spark)
    return _same_columns(mixing.repeat_by_mix(docs), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, encoded and decoded again: count and digests."""
    prepare(spark)
    prepare(spark, TOKEN_BATCH_BYTES)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("tokens", tokens)]

#: Trained languages and byte-pair merges are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
