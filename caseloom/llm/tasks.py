"""Helpers of code that runs inside Spark tasks on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from caseloom.session import prepare_session

#: Bytes of one Arrow batch sent to a Python task: texts may be long, and two tasks share a worker's memory.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def worker_cache(owner: str) -> dict:
    """A dictionary that outlives a task in the Python worker that ran it.

    A worker serves one operator after the other.  It keeps what belongs to one owner: another one finds the dictionary
    empty, and the memory given back to the system.
    """
    held = sys.modules.setdefault("_caseloom_worker_cache", types.ModuleType("_caseloom_worker_cache")).__dict__
    if held.get("owner") != owner:
        held["owner"], held["cache"] = owner, {}
        gc.collect()
        give_back()
    return held["cache"]


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def trimmed(run):
    """``run`` over batches; the worker, which then waits beside those of the next stages, holds no free memory afterwards."""
    def call(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


class Memory:
    """What was met lately: the present generation of about ``limit`` bytes, filled from the one before when one is met again.

    ``weigh`` tells the bytes of an entry.
    """

    def __init__(self, limit: int, weigh):
        self.limit, self.weigh = limit, weigh
        self.now: dict = {}
        self.before: dict = {}
        self.size = 0

    def missing(self, wanted: set) -> list:
        """Those of ``wanted`` that are unknown; the others are in the present generation afterwards."""
        now, before, missing = self.now, self.before, []
        for one in wanted:
            if one not in now:
                old = before.get(one)
                if old is None:
                    missing.append(one)
                else:
                    now[one] = old
                    self.size += self.weigh(one, old)
        return missing

    def learn(self, entries) -> None:
        now, weigh = self.now, self.weigh
        for one, value in entries:
            now[one] = value
            self.size += weigh(one, value)

    def age(self) -> None:
        if self.size > self.limit:
            self.before, self.now, self.size = self.now, {}, 0


def texts_of(column) -> pa.Array:
    """A text column of a batch, nulls as empty texts."""
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without copying it; text i is bytes[offsets[i]:offsets[i + 1]]."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int):
    """Ranges (first, last) of whole texts with about ``limit`` bytes; a longer text stands alone."""
    first, count = 0, len(bounds) - 1
    while first < count:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last
