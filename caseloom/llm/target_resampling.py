"""Importance resampling towards a target distribution over hashed word and word-pair features.

Every document gets a weight from an array of gains per bucket and a score with Gumbel noise; the documents with the
highest scores are a draw without replacement by weight.  The cutoff is found by bisection: jobs that count the rows
beyond given thresholds over the stored scores.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.decontamination import normal_words, raw_texts
from caseloom.operators.components import numbered
from caseloom.session import cut_lineage

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 2
LEAST_WORDS = 20
#: Hundredths of the eligible documents that are drawn.
PERCENT = 25
#: Thresholds that one counting job tries: four halvings at once.
TRIED = 15


def feature_buckets(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature): runs of 1 to ``longest`` words joined by one space, repeats too."""
    words = normal_words(text)
    if not words:
        return 0, np.zeros(0, np.int64)
    sums = list(map(crc32, words))
    every = [sums]
    spaced = list(map(b" ".__add__, words))
    for size in range(1, longest):
        # The checksum of a longer run goes on from that of the run before its last word.
        sums = list(map(crc32, spaced[size:], sums))
        every.append(sums)
    return len(words), np.fromiter(chain.from_iterable(every), np.int64, sum(map(len, every))) % buckets


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket over all rows: one sum per task and bucket, then one per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                total += np.bincount(feature_buckets(text, buckets, longest)[1], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier each bucket is in the target), one added to every count."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + buckets) / (float(s + 1) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(identifier: str, seed: int = 7) -> int:
    """Thousandths of the Gumbel noise that seed and identifier draw, floored."""
    drawn = int(hashlib.sha256(f"{seed}:{identifier}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def score_documents(documents: DataFrame, gains: np.ndarray, id_column: str = "doc_id", text_column: str = "text",
                    seed: int = 7, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight, score): the floored mean gain of the features, and the same with noise."""
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"),
                            F.col(text_column).cast("string").alias("text"))
    columns = ["n_words", "n_features", "weight", "score"]

    def run(batches):
        for batch in batches:
            found = []
            for name, text in zip(batch.column("name").to_pylist(), raw_texts(batch.column("text"))):
                n_words, own = feature_buckets(text, len(gains), longest)
                weight = int(gains[own].sum()) // len(own) if len(own) else 0
                found.append((n_words, len(own), weight, weight + noise(name, seed)))
            numbers = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(numbers[:, i], pa.int64()) for i in range(4)]], names=["id", *columns])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in columns)).withColumnRenamed("id", id_column)


def cutoff(rows: DataFrame, value: Column, wanted: int, tried: int = TRIED) -> tuple[int, int]:
    """(v, n): the smallest v with at least ``wanted`` values up to it, and the n values below v.

    ``value`` is a column of whole numbers; ``wanted`` is from 1 to the number of rows.  Bisection: each job counts the
    rows up to a few thresholds between the bounds that are left.
    """
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high, below = int(ends["low"]), int(ends["high"]), 0
    # Up to low - 1 are ``below`` rows, fewer than wanted; up to high are enough.
    while low < high:
        points = sorted({low + (high - low) * i // (tried + 1) for i in range(1, tried + 1)})
        counts = rows.agg(*[F.count_if(value <= F.lit(p)).alias(f"c{i}") for i, p in enumerate(points)]).first()
        for i, point in enumerate(points):
            if counts[i] >= wanted:
                high = point
                break
            low, below = point + 1, counts[i]
    return low, below


def _drawn(rows: DataFrame, wanted: int, keys: list) -> Column:
    """A condition that holds for exactly ``wanted`` rows: those that come first by ``keys``, the last of which is unique."""
    if wanted <= 0:
        return F.lit(False)
    if rows.count() <= wanted:
        return F.lit(True)
    value, *rest = keys
    nulls = value.isNull()
    filled = rows.where(~nulls)
    known = filled.count()
    if wanted >= known:
        return ~nulls | (nulls & _drawn(rows.where(nulls), wanted - known, rest)) if rest else ~nulls
    last, below = cutoff(filled, value, wanted)
    tied = rows.where(value == F.lit(last))
    return F.coalesce((value < F.lit(last)) | ((value == F.lit(last)) & (_drawn(tied, wanted - below, rest) if rest else F.lit(True))), F.lit(False))


def resample(documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             target_text_column: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7,
             buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): a draw of ``percent`` hundredths of the documents towards ``target``.

    Documents with at least ``least_words`` words are eligible; those with the highest scores are drawn, ties by the
    smaller identifier.  Drawn rows have ranks 1, 2, 3, ... in that order, the others null.

    Scores are stored once, in the shared folder.  The cutoff is found by counting jobs over them; only the drawn rows
    are sorted, in ranges, and their ranks are the row counts of the ranges before.  The driver holds one number per
    bucket and one per range.

    A null text has no features and weight 0, as an empty one; a null identifier draws noise as an empty one and comes
    last in a tie; rows that repeat an identifier are drawn each by itself, full ties in the order in which they are
    stored; an empty target counts nothing in every bucket; an empty table gives no rows; identifiers are whole numbers;
    other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(documents, text_column, buckets, longest), bucket_counts(target, target_text_column, buckets, longest))
    scored = score_documents(documents, gains, id_column, text_column, seed, longest).withColumnRenamed(id_column, "__id")
    stored = cut_lineage(scored.withColumn("__row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    eligible = stored.where(able)
    wanted = percent * eligible.count() // 100
    taken = able & _drawn(eligible, wanted, [-F.col("score"), F.col("__id"), F.col("__row")])
    ranked = numbered(stored.where(taken), [F.desc("score"), F.col("__id").asc_nulls_last(), F.asc("__row")])
    rest = stored.where(~taken).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.col("number") + 1).drop("number").unionByName(rest).select(
        F.col("__id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")
