"""Rows that equal marks bring together: settle what a batch knows itself, let one row per batch tell the owner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import textscan

#: Bits of a table of marks (2 MB, sent to every task, however many marks there are).
TABLE_BITS = 24


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (column.split() for column in schema.split(", "))])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, f.type) for c, f in zip(columns, types)], schema=types)


def settle(schema: str, marks: np.ndarray, key: np.ndarray, rest: list, more: np.ndarray | None = None):
    """Rows for the owners of ``marks``: rows whose mark repeats here are settled and go anywhere, one tells the owner.

    The columns are the mark, perhaps ``more`` of it, whether the row is settled, ``key``, and ``rest``, named and typed by
    ``schema``.  A telling row has -1 throughout ``rest``.
    """
    order = np.argsort(marks, kind="stable") if more is None else np.lexsort((more, marks))
    sorted_ = marks[order]
    same = sorted_[1:] == sorted_[:-1]
    if more is not None:
        same &= more[order][1:] == more[order][:-1]
    twin = np.zeros(len(marks), bool)
    twin[1:] = same
    first = ~twin
    first[:-1] &= same
    twin[:-1] |= same
    settled = np.zeros(len(marks), bool)
    settled[order] = twin
    heads = order[first & twin]
    # A settled row is dealt out by what nobody shares; the telling row carries position -1.
    place = np.where(settled, textscan.mix(key.view(np.uint64) + np.arange(len(key), dtype=np.uint64)), marks)
    columns = [np.concatenate([place, marks[heads]])]
    if more is not None:
        columns.append(np.concatenate([more, more[heads]]))
    columns += [np.concatenate([settled, np.zeros(len(heads), bool)]), np.concatenate([key, key[heads]])]
    columns += [np.concatenate([c, np.full(len(heads), -1, np.int64).astype(c.dtype)]) for c in rest]
    return _batch(schema, *columns)


def neighbours(batches, names: list[str], place: str):
    """Batches of rows sorted by ``names`` with a mask of those that equal a neighbour, across batches too.

    ``place`` is a column that is negative in telling rows only.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if rows.num_rows == 0:
            continue
        marks = [rows.column(n).to_numpy() for n in names]
        same = np.ones(rows.num_rows - 1, bool)
        for mark in marks:
            same &= mark[1:] == mark[:-1]
        # The last group may go on in the next batch: two of its rows at most are needed to know.
        last = rows.num_rows - 1
        twin = np.zeros(rows.num_rows, bool)
        twin[1:] |= same
        twin[:-1] |= same
        yield rows.slice(0, last), twin[:last]
        tail = rows.slice(last, 1).to_batches()[0]
        if twin[last]:
            yield rows.slice(last, 1), twin[last:]
            column = rows.schema.get_field_index(place)
            blank = pa.array([-1], rows.schema.field(column).type)
            tail = pa.RecordBatch.from_arrays(
                [blank if i == column else tail.column(i) for i in range(tail.num_columns)], schema=tail.schema)
        held = tail
    if held is not None:
        rows = pa.Table.from_batches([held])
        yield rows, np.zeros(1, bool)


def _slots(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(64 - TABLE_BITS)) ^ (marks & np.uint64(2**TABLE_BITS - 1))


def marked(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slots = _slots(marks)
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _marks_of(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(textscan.mix(batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))], names=["mark"])


def _slots_of(batches):
    for batch in batches:
        slots = np.unique(_slots(batch.column("mark").to_numpy().view(np.uint64))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 12), pa.array(slots & 4095)], names=["part", "slot"])


def table_of(marks: DataFrame, before: bytes | None = None) -> bytes:
    """A bit for every mark, added to those of ``before``; of a fixed size however many marks there are."""
    table = np.zeros(2**TABLE_BITS // 8, np.uint8) if before is None else np.frombuffer(before, np.uint8).copy()
    slots = marks.select("mark").mapInArrow(_slots_of, "part long, slot long").groupBy("part").agg(F.collect_set("slot").alias("slots"))
    for row in slots.toLocalIterator():
        own = np.array(row["slots"], np.int64) + (row["part"] << 12)
        np.bitwise_or.at(table, own >> 3, (1 << (own & 7)).astype(np.uint8))
    return table.tobytes()


def only(rows: DataFrame, column: str, wanted: DataFrame, name: str, *, outside: bool = False) -> DataFrame:
    """Rows whose ``column`` (long) may be among ``wanted``.``name``, or with ``outside`` those where it surely is not.

    It goes by a table of fixed size, so others that share a bit are taken for wanted: meant in front of a join.
    """
    marks = wanted.select(F.col(name).alias("mark")).mapInArrow(_marks_of, "mark long")
    table = rows.sparkSession.sparkContext.broadcast(table_of(marks))

    def run(batches):
        known = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            ids = textscan.mix(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            found = marked(known, ids)
            yield batch.filter(pa.array(~found if outside else found))

    return rows.mapInArrow(run, rows.schema)
