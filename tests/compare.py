"""Run named queries on Spark and their SQL on DuckDB and compare the results.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE"}


def sql_rows(folder: str, sql: str):
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    return columns, result.fetchall()


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def difference(frame, folder: str, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    columns, expected = sql_rows(folder, sql)
    got_kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema.fields}
    want_kinds = dict(columns)
    if got_kinds != want_kinds:
        return f"schema {got_kinds} != {want_kinds}"
    names = sorted(got_kinds)
    order = [[c for c, _ in columns].index(n) for n in names]
    got = sorted(tuple(_key(r[n]) for n in names) for r in frame.collect())
    want = sorted(tuple(_key(r[i]) for i in order) for r in expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            wrong = sum(a != b for a, b in zip(got, want))
            return f"{wrong} rows differ, first {str(g)[:300]} != {str(w)[:300]}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry_points
    from caseloom import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", f"local[{os.environ.get('COMPARE_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in checks:
                problem = difference(frame, folder, checks[name])
            else:
                problem = None if frame.count() else "no rows"
            state = "ok" if problem is None else f"WRONG {problem}"
        except Exception as error:
            state = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not state.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s {'sql ' if name in checks else 'rows'} {state}", flush=True)
    print(f"{len(wanted or queries)} queries, {bad} wrong")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
