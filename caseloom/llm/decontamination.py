"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items scans every text once.

Texts and items are normalised alike: A-Z are lower-cased, and words are runs of digits, letters and characters beyond
ASCII.  The automaton's letters are words, so a match begins and ends at words, and the words' places map it back to the
original text.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tasks import worker_cache
from caseloom.session import cut_lineage

#: Consecutive words of a test item that make a window.
WINDOW = 10
#: Bytes of windows and item names in one automaton; more of them go to further automata, each of which scans the texts.
AUTOMATON_BYTES = 8 << 20

#: Bytes of words stay, A-Z become lower case, everything else becomes a space.
_NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_SPANS = "array<struct<first: int, last: int, start: int, end: int>>"


def normal_words(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_NORMAL).split()


def raw_texts(column) -> list[bytes]:
    """The UTF-8 bytes of a text column of a batch, nulls as empty texts."""
    return pc.fill_null(pc.cast(pc.cast(column, pa.large_string()), pa.large_binary()), b"").to_pylist()


def item_windows(benchmark: DataFrame, id_column: str = "item_id", text_columns: tuple = ("text",), window: int = WINDOW) -> DataFrame:
    """(window, item): the different windows of each item, words joined by one space.

    Every run of ``window`` words of a text is one; a text of fewer words, but not none, is one window itself.
    """
    names = [f"t{i}" for i in range(len(text_columns))]
    rows = benchmark.select(F.col(id_column).cast("string").alias("item"),
                            *[F.col(c).cast("string").alias(n) for c, n in zip(text_columns, names)])

    def run(batches):
        for batch in batches:
            found = []
            items = batch.column("item").to_pylist()
            for name in names:
                for item, text in zip(items, raw_texts(batch.column(name))):
                    words = normal_words(text)
                    size = min(window, len(words))
                    if size:
                        found += {(b" ".join(words[k:k + size]), item) for k in range(len(words) - size + 1)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["window", "item"])

    return rows.mapInArrow(run, "window string, item string").distinct()


class WindowMatcher:
    """An automaton over the words of windows; ``pairs`` are (window, item), an item may be null."""

    def __init__(self, pairs: list[tuple]):
        self.numbers: dict[bytes, int] = {}
        items: dict[tuple, set] = {}
        for window, item in pairs:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" "))
            items.setdefault(key, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in items.items():
            self.automaton.add_word(key, (len(key), own))
        if items:
            self.automaton.make_automaton()
        self.filled = bool(items)

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[str]]:
        """(number of words, hit stretches, items): one pass over the whole text.

        A stretch is (first word, last word, start, end), its place in the original text in characters, end excluded.
        """
        plain = text.translate(_NORMAL)
        words = plain.split()
        stretches: list[list[int]] = []
        items: set = set()
        if self.filled and words:
            known = tuple(map(self.numbers.get, words, itertools.repeat(0)))
            matches = sorted((last - size + 1, last, id(own), own) for last, (size, own) in self.automaton.iter(known))
            for first, last, _, own in matches:
                items |= own
                if stretches and first <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], last)
                else:
                    stretches.append([first, last])
        if not stretches:
            return len(words), [], []
        places = [m.span() for m in _WORD.finditer(plain)]
        before = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        whole = [(a, b, int(before[places[a][0]]) - 1, int(before[places[b][1] - 1])) for a, b in stretches]
        return len(words), whole, sorted(i for i in items if i is not None)


def _matcher(shard) -> WindowMatcher:
    """The automaton of a broadcast shard; a worker keeps one."""
    name, sent = shard
    cache = worker_cache("decontamination")
    if cache.get("matcher", (None,))[0] != name:
        cache["matcher"] = (name, WindowMatcher(sent.value))
    return cache["matcher"][1]


def _scanned(rows: DataFrame, shard, kind: str) -> DataFrame:
    def run(batches):
        matcher = _matcher(shard)
        for batch in batches:
            found = [matcher.scan(text) for text in raw_texts(batch.column("text"))]
            spans = [[dict(zip(("first", "last", "start", "end"), one)) for one in own] for _, own, _ in found]
            place = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, place),
                 pa.array([items for _, _, items in found], pa.list_(pa.string()))], names=["id", "key", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"id {kind}, key string, n_words long, spans {_SPANS}, items array<string>")


def _united(spans):
    """Stretches of several automata as disjoint ones in order (a column)."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"),
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def find_contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       item_column: str = "item_id", item_text_columns: tuple = ("text",), window: int = WINDOW,
                       automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, n_words, n_hit, spans, items): where windows of test items occur in each whole text.

    ``spans`` are disjoint stretches of hit words: first and last word, and start and end of the original text in
    characters (end excluded).  ``items`` are the identifiers, as sorted strings, of all items with an occurring window;
    a window of an item without identifier hits words and names nobody.  ``n_hit`` counts the words of the stretches.

    The windows are counted first.  Up to ``automaton_bytes`` of them are sent to the tasks as one automaton, and no row
    is shuffled.  More of them are dealt out to several automata; each scans all texts, and the few rows with hits meet.

    A null text has no words, as an empty one; null identifiers and repeated rows are rows like any other; equal windows
    of several items name them all; an empty table of items hits nothing and an empty table of documents gives no rows;
    other columns are ignored.
    """
    spark = documents.sparkSession
    pairs = cut_lineage(item_windows(benchmark, item_column, item_text_columns, window))
    size = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 8
    total = pairs.agg(F.sum(size).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / automaton_bytes))
    text = F.col(text_column).cast("string")
    # Only several automata need a name for equal rows: their answers are equal.
    key = F.sha2(F.to_json(F.struct(F.col(id_column), text)), 256) if shards > 1 else F.lit("")
    rows = documents.select(F.col(id_column).alias("id"), key.alias("key"), text.alias("text"))
    kind = documents.schema[id_column].dataType.simpleString()

    def shard(number: int):
        own = pairs if shards == 1 else pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == number)
        return str(uuid.uuid4()), spark.sparkContext.broadcast([(r["window"], r["item"]) for r in own.collect()])

    found = _scanned(rows, shard(0), kind)
    if shards > 1:
        more = None
        for number in range(1, shards):
            own = _scanned(rows, shard(number), kind).where(F.size("spans") > 0).groupBy("key").agg(
                F.any_value("spans").alias("spans"), F.any_value("items").alias("items"))
            more = own if more is None else more.unionByName(own)
        more = more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
        found = found.join(more, "key", "left").select(
            "id", "n_words", _united(F.concat("spans", F.coalesce("__spans", F.array().cast(_SPANS)))).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", F.array().cast("array<string>"))))).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(F.col("id").alias(id_column), "n_words", hit.alias("n_hit"), "spans", "items")


def without_hits(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(id, text): the texts with every hit stretch cut out, everything else unchanged; cases as in ``find_contamination``."""
    both = documents.select(F.struct(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).alias("row"))
    carried = both.select(F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), F.col("row.text").alias("text"))
    found = find_contamination(carried, benchmark, "row", "text", **options)
    row = F.from_json("row", f"id {documents.schema[id_column].dataType.simpleString()}, text string")
    found = found.select(row.alias("row"), "spans")
    text = F.col("row.text")
    ends = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.length(text)))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    return found.select(F.col("row.id").alias(id_column), F.when(F.size("spans") == 0, text).otherwise(F.array_join(kept, "")).alias("text"))
