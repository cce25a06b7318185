"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.tasks import bytes_of, pieces, texts_of, trimmed, worker_cache

#: Bytes of a window; the last one of a text is filled up with zero bytes.
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
#: Labelled texts per language used for training, and characters of the excerpt taken from each: the stated bound.
TRAIN_ROWS, EXCERPT = 1500, 1000
_TAIL = max(WIDTHS) - 1
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Filters over bytes of several widths, the largest response of each in a window, and a softmax over languages."""

    languages: list[str]
    filters: list[np.ndarray]  # (width, 256, FILTERS) for each width
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    offset: np.ndarray

    def tables(self) -> list:
        """Responses to byte pairs: a filter of width 4 is two pairs, one of width 3 a pair and a byte."""
        pairs = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        two, three, four = self.filters
        return [pairs(two[0], two[1]), pairs(three[0], three[1]), three[2], pairs(four[0], four[1]), pairs(four[2], four[3])]

    def log_probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        """windows: (count, WINDOW + 3) bytes, the last three from the next window."""
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for first in range(0, len(windows), 128):
            own, one = pair[first:first + 128], windows[first:first + 128]
            into = out[first:first + 128]
            into[:, :FILTERS] = tables[0].take(own[:, :WINDOW], axis=0).max(axis=1)
            response = tables[1].take(own[:, :WINDOW], axis=0)
            response += tables[2].take(one[:, 2:WINDOW + 2], axis=0)
            into[:, FILTERS:2 * FILTERS] = response.max(axis=1)
            response = tables[3].take(own[:, :WINDOW], axis=0)
            response += tables[4].take(own[:, 2:WINDOW + 2], axis=0)
            into[:, 2 * FILTERS:] = response.max(axis=1)
        hidden = np.maximum(out + self.bias, 0)
        scores = hidden @ self.weights + self.offset
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each window, bytes of text in each window): whole texts cut into windows of a fixed length."""
    lengths = np.diff(bounds)
    counts = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[:-1][text] + number * WINDOW
    at = start[:, None] + np.arange(WINDOW + _TAIL)
    padded = np.concatenate([data, np.zeros(WINDOW + _TAIL, np.uint8)])
    windows = padded[at]
    windows[at >= bounds[1:][text][:, None]] = 0
    return windows, text, np.minimum(WINDOW, bounds[1:][text] - start)


def train(texts: list[str], languages: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Fit the network to labelled excerpts with Adam; one window per excerpt and epoch, cut at random.

    A window is shortened at random, so that short texts are familiar too.
    """
    draw = np.random.default_rng(seed)
    names = sorted(set(languages))
    label = np.array([names.index(one) for one in languages])
    raw = [text.encode() for text in texts]
    hidden = len(WIDTHS) * FILTERS
    network = ByteNetwork(
        names, [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(hidden, np.float32),
        draw.normal(0, 0.1, (hidden, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    parameters = [*network.filters, network.bias, network.weights, network.offset]
    means, squares, steps = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    # Rare languages are drawn as often as frequent ones.
    chance = (1 / np.bincount(label, minlength=len(names)))[label]
    for _ in range(epochs):
        order = draw.choice(len(raw), len(raw), p=chance / chance.sum())
        for first in range(0, len(order), 64):
            own = order[first:first + 64]
            windows = np.zeros((len(own), WINDOW + _TAIL), np.uint8)
            for i, k in enumerate(own):
                size = min(len(raw[k]), WINDOW if draw.random() < 0.6 else int(draw.integers(8, WINDOW)))
                start = int(draw.integers(0, len(raw[k]) - size + 1))
                part = np.frombuffer(raw[k][start:start + size + (_TAIL if size == WINDOW else 0)], np.uint8)
                windows[i, :len(part)] = part
            peaks, places = [], []
            for w, table in zip(WIDTHS, network.filters):
                response = sum(table[j][windows[:, j:j + WINDOW]] for j in range(w))
                places.append(response.argmax(axis=1))
                peaks.append(response.max(axis=1))
            before = np.concatenate(peaks, axis=1) + network.bias
            active = np.maximum(before, 0)
            scores = active @ network.weights + network.offset
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), label[own]] -= 1
            error = (error / len(own)).astype(np.float32)
            back = (error @ network.weights.T) * (before > 0)
            slopes = []
            for k, (w, table) in enumerate(zip(WIDTHS, network.filters)):
                slope, mine = np.zeros_like(table), back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    chosen = np.take_along_axis(windows[:, j:j + WINDOW], places[k], axis=1)
                    np.add.at(slope[j], (chosen, np.arange(FILTERS)[None, :]), mine)
                slopes.append(slope)
            slopes += [back.sum(axis=0), active.T @ error + 1e-4 * network.weights, error.sum(axis=0)]
            steps += 1
            for p, g, m, s in zip(parameters, slopes, means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    return network


def fold(identifier: Column) -> Column:
    """The fold of a document: crc32 of its identifier as text, modulo 3."""
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")) % 3


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
        train_rows: int = TRAIN_ROWS, excerpt: int = EXCERPT) -> ByteNetwork | None:
    """Train on labelled rows whose fold is not 1: at most ``train_rows`` per language, in the order of a hash.

    From each text an excerpt of ``excerpt`` characters is taken at a place that the hash picks.  Without a labelled row
    there is no network.
    """
    text = F.col("text")
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"),
                            F.col(label_column).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")) & (fold(F.col("id")) != 1))
    place = F.xxhash64(F.lit("excerpt"), "id", F.length(text))
    start = F.pmod(place, F.greatest(F.length(text) - excerpt, F.lit(0)) + 1) + 1
    short = rows.select("label", place.alias("place"), F.substring(text, start.cast("int"), F.lit(excerpt)).alias("part"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("place", "part"))
    sample = short.withColumn("turn", turn).where(F.col("turn") <= train_rows).orderBy("label", "turn").collect()
    sample = [r for r in sample if r["part"]]
    return train([r["part"] for r in sample], [r["label"] for r in sample]) if sample else None


def _predictor(network: ByteNetwork | None):
    """A function from texts to their languages and probabilities; a text without bytes is unknown."""
    worker_cache("language_id")  # what another operator remembered goes
    tables = network.tables() if network is not None else None

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, bounds = bytes_of(texts)
        best, score = np.full(len(bounds) - 1, -1), np.zeros(len(bounds) - 1)
        for first, last in pieces(bounds, 1 << 19) if network is not None else ():
            windows, text, sizes = _windows(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
            if not len(windows):
                continue
            sums = np.zeros((last - first, len(network.languages)))
            np.add.at(sums, text, network.log_probabilities(windows, tables) * sizes[:, None])
            lengths = np.diff(bounds[first:last + 1])
            full = lengths > 0
            mean = sums[full] / lengths[full, None]
            odds = np.exp(mean - mean.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            where = np.flatnonzero(full) + first
            best[where], score[where] = odds.argmax(axis=1), odds.max(axis=1)
        return [network.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()], score

    return predict


def identify(documents: DataFrame, network: ByteNetwork | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language of each whole text and its probability.

    A text's windows are scored by themselves and their log-probabilities averaged by bytes.  A text that is null,
    empty or without a letter is ``und`` with score 0, as is any text without a network; null identifiers and
    repeated rows are rows like any other; an empty table gives no rows; other columns are ignored.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    text = F.col(text_column).cast("string")
    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    rows = documents.select(F.col(id_column).alias("id"), F.when(letters, text).alias("text"))

    def run(batches):
        predict = _predictor(network)
        for batch in batches:
            names, score = predict(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def filter_known(documents: DataFrame, network: ByteNetwork | None, least: float, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a probability of at least ``least``.

    Cases as in ``identify``: without a letter, or without a network, a row is unknown and goes.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.toDF(*names)
    text_name = names[documents.columns.index(text_column)]

    def run(batches):
        predict = _predictor(network)
        for batch in batches:
            languages, score = predict(texts_of(batch.column(text_name)))
            known = np.array([one != UNKNOWN for one in languages], bool)
            yield batch.filter(pa.array(known & (score >= least)))

    letters = F.coalesce(F.regexp_like(F.col(text_name).cast("string"), F.lit(r"\p{L}")), F.lit(False))
    return plain.where(letters).mapInArrow(trimmed(run), plain.schema).toDF(*documents.columns)
