"""Quality scores by kernel ridge regression: random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import textscan
from caseloom.llm.language_id import fold
from caseloom.llm.tasks import bytes_of, pieces, texts_of
from caseloom.session import cut_lineage

FEATURES, RIDGE, BINS = 256, 1.0, 1000
#: Partial sums are added in this many groups before the last addition.
GROUPS = 64

_CLASSES = ("letters", "upper", "digits", "stops", "symbols", "marks", "bars", "breaks")
_CLASS = np.zeros((256, len(_CLASSES)), np.float32)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
_CLASS[range(65, 91), 1] = 1
_CLASS[range(48, 58), 2] = 1
_CLASS[[ord(c) for c in ".,;:"], 3] = 1
_CLASS[[ord(c) for c in "#*$%&<>{}[]=~^_\\/@+"], 4] = 1
_CLASS[[ord(c) for c in "!?"], 5] = 1
_CLASS[ord("|"), 6] = 1
_CLASS[10, 7] = 1
STATISTICS = 18


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of statistics per text: sizes, shares of byte classes, and how much repeats itself."""
    starts, ends, first = textscan.word_spans(data, bounds)
    words = textscan.word_hashes(data, starts, ends)
    counts, lengths = np.diff(first), np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    per_word, per_byte = np.maximum(counts, 1), np.maximum(lengths, 1)
    out = np.zeros((len(counts), STATISTICS))
    for k in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(_CLASS[:, k][data], dtype=np.float64)])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        out[:, k] = total / (per_byte if k < 3 else per_word)
    size = (ends - starts).astype(np.float64)
    out[:, 8] = np.log1p(counts)
    out[:, 9] = np.bincount(text, size, len(counts)) / per_word
    out[:, 10] = np.sqrt(np.maximum(np.bincount(text, size * size, len(counts)) / per_word - out[:, 9] ** 2, 0))
    capital = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    out[:, 11] = np.bincount(text, capital, len(counts)) / per_word
    out[:, 12] = _distinct(words, text, len(counts)) / per_word
    pairs = words[1:] * np.uint64(3) + textscan.mix(words[:-1])
    inside = text[1:] == text[:-1]
    out[:, 13] = _distinct(pairs[inside], text[1:][inside], len(counts)) / np.maximum(counts - 1, 1)
    twins = np.zeros(len(words))
    twins[1:] = (words[1:] == words[:-1]) & inside
    out[:, 14] = np.bincount(text, twins, len(counts)) / per_word
    line_starts, line_ends, line_text = _lines(data, bounds)
    lines = textscan.family(8).spans(textscan.family(8).values[data], line_starts, line_ends)
    n_lines = np.maximum(np.bincount(line_text, minlength=len(counts)), 1)
    out[:, 15] = _distinct(lines, line_text, len(counts)) / n_lines
    out[:, 16] = np.log1p(n_lines)
    out[:, 17] = np.log1p(lengths)
    return out


def _distinct(marks: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    order = np.lexsort((marks, text))
    marks, text = marks[order], text[order]
    fresh = np.ones(len(marks), bool)
    fresh[1:] = (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[fresh], minlength=count)


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the lines that are not empty, and their texts."""
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    starts, ends = cuts[:-1], cuts[1:]
    full = (ends > starts) & (data[np.minimum(starts, max(len(data) - 1, 0))] != 10) if len(data) else np.zeros(len(starts), bool)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray | None = None  # raw scores, ascending
    levels: np.ndarray | None = None  # the calibrated score at each

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Cosines that approximate a Gaussian kernel, and a constant."""
        scaled = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(rows), 1))], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -0.5, 1.5)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.levels)


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing levels closest to ``labels`` by pooling adjacent violators; ``scores`` ascend."""
    blocks: list[list[float]] = []
    for label, weight in zip(labels, weights):
        blocks.append([label, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, mass, size = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + value * mass) / (blocks[-1][1] + mass), blocks[-1][1] + mass, blocks[-1][2] + size]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def document_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, stats) of each whole text; a null text counts as empty and has statistics too."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, bounds = bytes_of(texts_of(batch.column("text")))
            parts = [statistics(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]) for a, b in pieces(bounds, textscan.SLICE_BYTES)]
            rows = np.concatenate(parts) if parts else np.zeros((0, STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * STATISTICS, pa.int32()), pa.array(rows.ravel()))],
                names=["id", "stats"])

    return documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, stats array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", seed: int = 5) -> QualityModel | None:
    """Fit on every labelled row whose fold is not 1.  Without such a row there is no model.

    Each partition adds up its part of the normal equations, the parts are added in two steps, and the solution takes one
    small linear system.  The calibration needs no more than the label sums of ``BINS`` bins of the raw score.
    """
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label")).where(
        "label IS NOT NULL AND id IS NOT NULL")
    rows = cut_lineage(stats.join(marks, "id").where(fold(F.col("id")) != 1).select("stats", "label"))
    first = rows.agg(*[f(F.col("stats")[k]).alias(f"{n}{k}") for k in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
                     F.count(F.lit(1)).alias("n")).first()
    if not first["n"]:
        return None
    draw = np.random.default_rng(seed)
    scale = np.array([first[f"s{k}"] for k in range(STATISTICS)])
    model = QualityModel(
        np.array([first[f"m{k}"] for k in range(STATISTICS)]), np.where(scale > 1e-9, scale, 1.0),
        draw.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1))
    width = FEATURES + 2

    def sums(batches):
        total = np.zeros((FEATURES + 1, width))
        for batch in batches:
            z = model.features(_matrix(batch.column("stats")))
            total += z.T @ np.concatenate([z, batch.column("label").to_numpy()[:, None]], axis=1)
        lines = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2) * width, pa.int32()), pa.array(total.ravel()))
        group = np.full(FEATURES + 1, TaskContext.get().partitionId() % GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(group), lines], names=["line", "part", "cells"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [frame["line"].iloc[0]], "part": [0], "cells": [np.sum(np.stack(frame["cells"]), axis=0)]})

    schema = "line long, part long, cells array<double>"
    parts = rows.mapInArrow(sums, schema).groupBy("line", "part").applyInPandas(added, schema)
    lines = parts.groupBy("line").applyInPandas(added, schema).collect()
    normal = np.array([r["cells"] for r in sorted(lines, key=lambda r: r["line"])])
    model.weights = np.linalg.solve(normal[:, :-1] + RIDGE * np.eye(FEATURES + 1), normal[:, -1])

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 0.5) / 2 * BINS).astype(np.int64)), batch.column("label")], names=["bin", "label"])

    bins = rows.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(
        F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    centres = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    # One text of each kind is added to every bin's count, so no level is quite 0 or 1.
    total = sum(r["n"] for r in bins)
    mean = sum(r["n"] * r["label"] for r in bins) / total
    model.levels = np.clip(isotonic(centres, np.array([(r["n"] * r["label"] + mean) / (r["n"] + 1) for r in bins]),
                                    np.array([r["n"] + 1.0 for r in bins])), 0, 1)
    model.knots = centres
    return model


def score(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality") -> DataFrame:
    """(id, score, predicted): the calibrated chance that a text is labelled 1, and whether that is 0.5 or more.

    Empty and null texts are scored by their (zero) statistics; without any usable label every score is 0.5; null
    identifiers, which no label names, and repeated rows are scored like others; an empty table gives no rows; other
    columns are ignored.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    stats = cut_lineage(document_statistics(documents, id_column, text_column))
    model = fit(stats, labels, id_column, label_column)

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("stats"))
            scores = np.full(len(rows), 0.5) if model is None else model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["id", "score", "predicted"])

    return stats.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)
