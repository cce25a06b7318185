"""Exact nearest-neighbour search between two tables of vectors.

The store of the ticket contract ranks by cosine.  For unit vectors the squared
distance is ``2 - 2 * cosine``, so ranking by cosine is ranking by distance and
the triangle inequality may rule out whole regions without losing a result:

1. A bounded number of pivot vectors is picked; every vector belongs to the cell
   of its nearest pivot.  Per cell the row count and the smallest and largest
   distance to the pivot are kept (one row per pivot, so the driver may hold it).
2. A query first searches its own cell.  Its k-th best distance is then a proven
   radius, and only cells that can hold something inside it are visited.
3. Cells are cut into columns of bounded size, on the query side too.  One task
   compares one query column with one corpus column, so a cell holding most of
   the rows becomes many tasks of equal size, and only k rows per query leave a
   task.

A corpus that fits one cell skips steps 1 and 2.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from caseloom.operators.components import components
from caseloom.operators.joins import salted_join
from caseloom.session import cut_lineage

CELL_ROWS = 200_000
MAX_CELLS = 1024
COLUMN_BYTES = 16 << 20
#: Scores that a task holds at once, and the corpus rows of one look: such a block stays in the processor's cache.
SCORES_HELD = 1 << 20
RUN_ROWS = 4096
#: Pairs that a task hands on, and those whose scores it makes exact at once.
PAIRS_HELD = 1 << 21
PAIRS_EXACT = 1 << 14
MIN_COLUMN_ROWS = 2048
SCORE_DIGITS = 9
#: Partners that the first search for groups of duplicates takes; full lists are searched again for more.
GROUP_NEIGHBOURS = 15


def is_zero(vector: Column) -> Column:
    """Stops at the first element that is not zero."""
    return ~F.exists(vector, lambda x: x != 0)


def _matrix_reader():
    """A function from a column of vectors to rows of length one; zero rows stay zero.

    Vectors travel as they are stored and are scaled where they are compared.
    """
    def read(column):
        import numpy as np
        points = np.stack(column.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        return np.divide(points, norms, out=points, where=norms > 0)

    return read


def _few_rows(batches, cells: int):
    """Runs of rows that make a bounded number of pairs with so many cells."""
    step = max(1, (1 << 16) // max(1, cells))
    for batch in batches:
        for first in range(0, len(batch), step):
            yield batch.iloc[first:first + step]


def _unit_reader():
    """A function from a column of vectors to their unit vectors in single precision, and a function of places to exact ones."""
    def read(column):
        import numpy as np
        stored = np.stack(column.to_numpy())
        lengths, units = np.ones(len(stored)), np.empty(stored.shape, np.float32)
        for first in range(0, len(stored), 4096):
            some = stored[first:first + 4096].astype(np.float64)
            norms = np.linalg.norm(some, axis=1)
            own = lengths[first:first + 4096]
            own[norms > 0] = norms[norms > 0]
            units[first:first + 4096] = some / own[:, None]
        return units, lambda at: stored[at].astype(np.float64) / lengths[at, None]

    return read


def _slack(dimension: int) -> float:
    """More than the score of two unit vectors in single precision can be off."""
    return (dimension + 8) * 2.4e-7


def _exact_scores(exact_q, exact_c, at, col):
    """Rounded scores of pairs of places, a few at once."""
    import numpy as np
    scores = np.empty(len(at))
    for first in range(0, len(at), PAIRS_EXACT):
        some = slice(first, first + PAIRS_EXACT)
        scores[some] = np.einsum("ij,ij->i", exact_q(at[some]), exact_c(col[some]))
    return np.round(scores, SCORE_DIGITS) + 0.0


def _hidden(q_ids, c_ids, exclude_self: bool, earlier_only: bool):
    """Per query the first and last place of the corpus rows that it must not find; those are in the order of ids, nulls last."""
    import numpy as np
    import pandas as pd
    first, last = np.zeros(len(q_ids), np.int64), np.zeros(len(q_ids), np.int64)
    if exclude_self or earlier_only:
        known, asks = len(c_ids) - int(pd.isna(c_ids).sum()), ~pd.isna(q_ids)
        first[asks] = np.searchsorted(c_ids[:known], q_ids[asks], "left")
        last[asks] = known if earlier_only else np.searchsorted(c_ids[:known], q_ids[asks], "right")
        if q_ids.dtype == object:  # a missing text is equal to another
            first[~asks], last[~asks] = known, len(c_ids)
    return first, last


def _hide(score, start: int, first, last) -> None:
    """Leave the places from ``first`` to ``last`` out of the scores of corpus rows that begin at ``start``."""
    import numpy as np
    stop = start + score.shape[1]
    some = np.flatnonzero((first < stop) & (last > start) & (first < last))
    if len(some):
        place = np.arange(start, stop)
        part = score[some]
        part[(place >= first[some, None]) & (place < last[some, None])] = -np.inf
        score[some] = part


def _best_places(q, c, exact_q, exact_c, take: int, hidden, shut, min_score: float | None):
    """(query places, corpus places, scores): the ``take`` best of each query, the first of equals.

    Single precision tells which pairs may count, less its slack; those are made exact.  ``shut`` gives the pairs that do
    not meet, for a run of queries and of corpus rows.
    """
    import numpy as np
    slack, out = 2 * _slack(q.shape[1]), []
    block = min(_block(RUN_ROWS), _block(4 * take))
    for begin in range(0, len(q), block):
        own = q[begin:begin + block]
        first, last = hidden[0][begin:begin + block], hidden[1][begin:begin + block]
        floor = np.full(len(own), -2.0 if min_score is None else min_score - slack, np.float32)
        best, waiting, held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

        def settle():
            at, col = (np.concatenate(x) for x in zip(*waiting))
            score = _exact_scores(exact_q, exact_c, at + begin, col)
            if min_score is not None:
                fine = score >= min_score
                at, col, score = at[fine], col[fine], score[fine]
            at, col, score = (np.concatenate(x) for x in zip(best, (at, col, score)))
            order = np.lexsort((col, -score, at))
            at, col, score = at[order], col[order], score[order]
            turn = np.arange(len(at)) - np.searchsorted(at, at, "left")
            full = turn == take - 1
            floor[at[full]] = np.maximum(floor[at[full]], (score[full] - slack).astype(np.float32))
            return at[turn < take], col[turn < take], score[turn < take]

        for start in range(0, len(c), RUN_ROWS):
            if len(own) and (first <= start).all() and (last >= min(start + RUN_ROWS, len(c))).all():
                continue
            score = own @ c[start:start + RUN_ROWS].T
            _hide(score, start, first, last)
            if shut is not None:
                score[shut(begin, begin + len(own), start, start + score.shape[1])] = -np.inf
            may = score >= floor[:, None]
            if take < score.shape[1] and np.count_nonzero(may) > 4 * take * len(own):
                below = np.negative(score)
                below.partition(take - 1, axis=1)
                np.fmax(floor, -below[:, take - 1] - np.float32(slack), out=floor)
                may = score >= floor[:, None]
            at, col = np.divmod(np.flatnonzero(may), score.shape[1])
            if len(at):
                waiting.append((at, col + start))
                held += len(at)
            if held > 2 * take * len(own):
                best, waiting, held = settle(), [], 0
        if waiting:
            best = settle()
        out.append((best[0] + begin, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Cells:
    """Pivots and per-cell facts of one corpus.  Bounded by ``MAX_CELLS`` rows."""

    pivots: list
    rows: list
    nearest: list
    farthest: list

    @property
    def single(self) -> bool:
        return len(self.pivots) <= 1


def _home_cells(frame: DataFrame, pivots: list) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    schema = T.StructType(frame.schema.fields + [T.StructField("cell", T.IntegerType()),
                                                 T.StructField("reach", T.DoubleType())])

    read, few = _matrix_reader(), _few_rows

    def assign(batches):
        import numpy as np
        table = np.asarray(pivots, dtype=np.float64)
        for batch in few(batches, len(table)):
            points = read(batch["vec"])
            squared = np.maximum(0.0, (points ** 2).sum(1)[:, None] + (table ** 2).sum(1)[None, :] - 2 * points @ table.T)
            home = squared.argmin(axis=1)
            yield batch.assign(cell=home.astype("int32"), reach=np.sqrt(squared[np.arange(len(home)), home]))

    return frame.mapInPandas(assign, schema)


def _column_rows(corpus: DataFrame, rows: int) -> int:
    """Rows one task holds per side: as many as memory allows, fewer while cores would idle.

    Longer columns mean fewer copies of the other side in the shuffle.
    """
    share = math.ceil(rows / _useful_columns(corpus))
    return min(_most_rows(corpus), max(MIN_COLUMN_ROWS, share))


def _most_rows(corpus: DataFrame) -> int:
    first = corpus.select(F.size("vec").alias("d")).first()
    return max(1, COLUMN_BYTES // (4 * max(1, first["d"] or 1 if first else 1)))


def _useful_columns(corpus: DataFrame) -> int:
    """Columns per side whose pairs keep all cores busy."""
    return math.ceil(math.sqrt(corpus.sparkSession.sparkContext.defaultParallelism))


def _build_cells(corpus: DataFrame, wanted: int | None, total: int) -> tuple[DataFrame, Cells]:
    number = wanted or max(1, min(MAX_CELLS, math.ceil(total / CELL_ROWS)))
    if number == 1:
        return corpus.withColumn("cell", F.lit(0)), Cells([None], [total], [0.0], [2.0])
    picked = corpus.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(number).collect()
    pivots = []
    for row in picked:
        length = math.sqrt(sum(x * x for x in row["vec"]))
        pivots.append([x / length if length else 0.0 for x in row["vec"]])
    placed = cut_lineage(_home_cells(corpus, pivots))
    facts = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect()}
    order = range(len(pivots))
    return placed.drop("reach"), Cells(
        pivots,
        [facts[c]["n"] if c in facts else 0 for c in order],
        [facts[c]["lo"] if c in facts else 0.0 for c in order],
        [facts[c]["hi"] if c in facts else 0.0 for c in order])


def _visits(queries: DataFrame, cells: Cells, own_cell: bool, other_cells: bool) -> DataFrame:
    """One row per query and cell to search; ``radius`` is the query's proven search radius."""
    schema = T.StructType([queries.schema["id"], queries.schema["vec"], T.StructField("cell", T.IntegerType())])
    pivots, rows, lo, hi = cells.pivots, cells.rows, cells.nearest, cells.farthest
    read, few = _matrix_reader(), _few_rows

    def plan(batches):
        import numpy as np
        import pandas as pd
        table = np.asarray(pivots, dtype=np.float64)
        filled = np.asarray(rows) > 0
        near, far = np.asarray(lo), np.asarray(hi)
        slack = 1e-6
        for batch in few(batches, len(table)):
            points = read(batch["vec"])
            squared = np.maximum(0.0, (points ** 2).sum(1)[:, None] + (table ** 2).sum(1)[None, :] - 2 * points @ table.T)
            dist = np.sqrt(squared)
            home = dist.argmin(axis=1)
            base = dist[np.arange(len(home)), home]
            bound = np.maximum((dist - base[:, None]) / 2, np.maximum(dist - far[None, :], near[None, :] - dist))
            visit = (bound <= batch["radius"].to_numpy()[:, None] + slack) & filled[None, :]
            own = np.zeros_like(visit)
            own[np.arange(len(home)), home] = True
            if own_cell and other_cells:
                visit |= own & filled[None, :]
            elif own_cell:
                visit = own & filled[None, :]
            else:
                visit &= ~own
            at, cell = np.nonzero(visit)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "vec": batch["vec"].to_numpy()[at],
                                "cell": cell.astype("int32")})

    return queries.mapInPandas(plan, schema)


def _columns(counts: list, column_rows: int, useful: int | None = None, most_rows: int | None = None) -> list:
    """Columns of each cell: as short as wanted, yet no more than cores can use (``useful``) or memory calls for (``most_rows``).

    Every row of the other side is copied to each column, so short columns of a long cell would fill the disk.
    """
    if useful is None:
        return [max(1, math.ceil(n / column_rows)) for n in counts]
    return [max(1, min(math.ceil(n / column_rows), max(useful, math.ceil(n / most_rows)))) for n in counts]


def _query_columns(columns: list, query_rows: list, corpus_rows: list, corpus_columns: list, k: int) -> list:
    """A task hands on ``k`` rows per query, so a large ``k`` calls for more and shorter query columns."""
    return [max(own, math.ceil(n * min(k, math.ceil(m / c)) / PAIRS_HELD))
            for own, n, m, c in zip(columns, query_rows, corpus_rows, corpus_columns)]


def _block(rows: int) -> int:
    """Queries compared at once with so many rows."""
    return max(1, min(512, SCORES_HELD // max(1, rows)))


def _search(visits: DataFrame, placed: DataFrame, corpus_rows: list, query_rows: list, k: int, *,
            exclude_self: bool, earlier_only: bool, min_score: float | None, column_rows: int,
            weighed: bool = False, packed: bool = False) -> DataFrame:
    """Best k corpus rows per query and corpus column; ``weighed`` sums the ``n`` of all that reach the score instead.

    A ``packed`` cell stands for several small ones: corpus rows tell their place ``part`` among them, and the bits ``parts``
    of a query those that it visits.
    """
    def lookup(values: list) -> Column:
        # One constant however many cells there are.
        return F.element_at(F.from_json(F.lit(json.dumps(values)), "array<int>"), F.col("cell") + 1)

    # Short columns that a caller asks for hold for short cells alone.
    bounds = (_useful_columns(placed), _most_rows(placed)) if max([*corpus_rows, *query_rows, 0]) > column_rows else ()
    c_counts = _columns(corpus_rows, column_rows, *bounds)
    q_counts = _query_columns(_columns(query_rows, column_rows, *bounds), query_rows, corpus_rows, c_counts, k)
    q_cols, c_cols = lookup(q_counts), lookup(c_counts)

    def spread(frame: DataFrame, own: str, own_cols: Column, other: str, other_cols: Column) -> DataFrame:
        return frame.select(*frame.columns,
                            F.pmod(F.xxhash64("id"), own_cols).cast("int").alias(own),
                            F.explode(F.sequence(F.lit(0), other_cols - 1)).alias(other))

    left = spread(visits, "q_col", q_cols, "c_col", c_cols)
    right = spread(placed.select("cell", "id", "vec", *(["n"] if weighed else []), *(["part"] if packed else [])), "c_col", c_cols, "q_col", q_cols)
    key = ["cell", "q_col", "c_col"]
    id_type = visits.schema["id"].dataType
    other_type = placed.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("neighbour_id", other_type),
                           T.StructField("score", T.DoubleType())])
    read = _unit_reader()

    def compare(a, b):
        import numpy as np
        import pandas as pd
        empty = pd.DataFrame({"query_id": a["id"].head(0), "neighbour_id": b["id"].head(0),
                              "score": np.zeros(0)})
        if len(a) == 0 or len(b) == 0:
            return empty
        b = b.sort_values("id", kind="stable")
        q_ids, c_ids = a["id"].to_numpy(), b["id"].to_numpy()
        (q, exact_q), (c, exact_c) = read(a["vec"]), read(b["vec"])
        shut = None
        if packed:
            bits = np.stack([np.frombuffer(one, np.uint8) for one in a["parts"]])
            part = b["part"].to_numpy()

            def shut(q_first, q_last, c_first, c_last):
                return np.unpackbits(bits[q_first:q_last], axis=1).take(part[c_first:c_last], axis=1) == 0
        at, col, score = _best_places(q, c, exact_q, exact_c, min(k, len(c_ids)),
                                      _hidden(q_ids, c_ids, exclude_self, earlier_only), shut, min_score)
        return pd.DataFrame({"query_id": q_ids[at], "neighbour_id": c_ids[col], "score": score})

    def weigh(a, b):
        import numpy as np
        import pandas as pd
        total = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            q_ids, c_ids, n = a["id"].to_numpy(), b["id"].to_numpy(), b["n"].to_numpy()
            (q, exact_q), (c, exact_c) = read(a["vec"]), read(b["vec"])
            slack, block = _slack(q.shape[1]), _block(RUN_ROWS)
            for start in range(0, len(c), RUN_ROWS):
                for first in range(0, len(q), block):
                    score = q[first:first + block] @ c[start:start + RUN_ROWS].T
                    flat = np.flatnonzero(score >= min_score - slack)
                    at, col = np.divmod(flat, score.shape[1])
                    at, col = at + first, col + start
                    fine = score.ravel()[flat] >= min_score + slack
                    fine[~fine] = _exact_scores(exact_q, exact_c, at[~fine], col[~fine]) >= min_score
                    fine &= q_ids[at] != c_ids[col]
                    np.add.at(total, at[fine], n[col[fine]])
        return pd.DataFrame({"query_id": a["id"], "links": total})

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key))
    if weighed:
        return pairs.applyInPandas(weigh, T.StructType([schema["query_id"], T.StructField("links", T.LongType())]))
    return pairs.applyInPandas(compare, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, *, exclude_self: bool = False,
            earlier_only: bool = False, min_score: float | None = None, cells: int | None = None,
            column_rows: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, score, rank): exact cosine top-k, ties by the smaller id.

    Both inputs have columns ``id`` and ``vec``.  ``min_score`` keeps scores at or
    above it; ``earlier_only`` keeps neighbours with a smaller id than the query.
    A zero vector scores 0 against everything.
    """
    queries = queries.select("id", "vec").where(F.col("vec").isNotNull())
    corpus = corpus.select("id", "vec").where(F.col("vec").isNotNull())
    # An upper bound is enough to size the columns, and counting before any filter stays cheap.
    n_queries, n_corpus = queries.count(), corpus.count()
    options = dict(exclude_self=exclude_self, earlier_only=earlier_only, min_score=min_score,
                   column_rows=column_rows or _column_rows(corpus, max(n_queries, n_corpus)))
    blank = None
    if not earlier_only and (min_score is None or min_score <= 0):
        blank = _blank_answers(queries.where(is_zero(F.col("vec"))), corpus, k, exclude_self)
        queries = queries.where(~is_zero(F.col("vec")))
    placed, layout = _build_cells(corpus, cells, n_corpus)
    if layout.single:
        visits = queries.withColumn("cell", F.lit(0))
        found = _search(visits, placed, layout.rows, [n_queries], k, **options)
    else:
        found = _search_cells(cut_lineage(queries), placed, layout, k, options)
    best = _best(found, k)
    return best if blank is None else best.unionByName(blank)


def _search_cells(queries: DataFrame, placed: DataFrame, layout: Cells, k: int, options: dict) -> DataFrame:
    def search(visits: DataFrame) -> DataFrame:
        counts = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        return _search(visits, placed, layout.rows, [counts.get(c, 0) for c in range(len(layout.rows))], k, **options)

    threshold = options["min_score"]
    # A score of s at least means a distance of sqrt(2 - 2s) at most.  Zero vectors sit at distance one
    # with score zero, so the bound holds for them only while it admits them: widen it to two then.
    limit = math.sqrt(max(0.0, 2 - 2 * threshold)) if threshold is not None and threshold > 0 else 2.0
    if threshold is not None and threshold > 0:
        return search(_visits(queries.withColumn("radius", F.lit(limit)), layout, True, True))
    first = cut_lineage(search(_visits(queries.withColumn("radius", F.lit(limit)), layout, True, False)))
    best = _best(first, k)
    reached = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    chord = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))
    # Scores at or below zero may tie with zero vectors anywhere: search everything then.
    radius = F.when((F.col("n") >= k) & (F.col("worst") > 0), chord).otherwise(F.lit(limit))
    widened = queries.join(reached, queries["id"] == reached["query_id"], "left").select(
        "id", "vec", F.coalesce(radius, F.lit(limit)).alias("radius"))
    return best.drop("rank").unionByName(search(_visits(cut_lineage(widened), layout, False, True)))


def _blank_answers(zero_queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Zero queries tie with everything, so each gets the smallest ids; k + 1 ids serve them all."""
    firsts = [r["id"] for r in corpus.select("id").orderBy("id").limit(k + 1).collect()]
    kind = corpus.schema["id"].dataType
    ids = F.array(*[F.lit(v).cast(kind) for v in firsts]) if firsts else F.array().cast(T.ArrayType(kind))
    if exclude_self:
        ids = F.filter(ids, lambda v: v != F.col("id"))
    return zero_queries.select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(ids, 1, k)).alias("pos", "neighbour_id")).select(
        "query_id", "neighbour_id", F.lit(0.0).alias("score"), (F.col("pos") + 1).alias("rank"))


def _marked(vectors: DataFrame, min_score: float) -> DataFrame:
    """Vectors with a digest; zero vectors are left out."""
    if min_score <= 0:
        raise ValueError("duplicates need a positive score")
    return vectors.where(~is_zero(F.col("vec"))).select(
        "id", "vec", F.md5(F.to_json(F.struct("vec"))).alias("digest"))


def _by_digest(marked: DataFrame) -> DataFrame:
    """One row per different vector: its first id and its number of rows."""
    return marked.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.min_by("vec", "id").alias("vec"), F.count(F.lit(1)).alias("n"))


def _folded(vectors: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Vectors with a digest, and one row per different vector."""
    marked = _marked(vectors, min_score)
    return marked, _by_digest(marked)


def duplicate_edges(vectors: DataFrame, min_score: float, **layout) -> DataFrame:
    """(ticket, duplicate_of, score): the most similar earlier ticket at or above the score.

    One edge per ticket keeps the result linear.  Exact copies are folded onto
    their first row before the search, so a large group of copies costs one
    comparison and not one per pair.
    """
    marked, groups = _folded(vectors, min_score)
    repeated = groups.where(F.col("n") > 1).select("digest", "first_id")
    copies = salted_join(marked.select("id", "digest"), repeated, "digest", "id").where(
        F.col("id") != F.col("first_id")).select("id", F.col("first_id").alias("duplicate_of"), F.lit(1.0).alias("score"))
    firsts = cut_lineage(groups.select(F.col("first_id").alias("id"), "vec"))
    searched = nearest(firsts, firsts, 1, earlier_only=True, min_score=min_score, **layout)
    edges = searched.select(F.col("query_id").alias("id"), F.col("neighbour_id").alias("duplicate_of"), "score")
    return edges.unionByName(copies)


def duplicate_groups(vectors: DataFrame, min_score: float, **layout) -> DataFrame:
    """(id, group_id, n_links): tickets linked by any pairs at or above the score, named by the smallest ticket.

    ``n_links`` counts all other tickets at or above the score.  Every pair counts, yet none is stored: links are summed
    where they are compared, and groups come from lists of nearest partners that grow until no link left out can join
    two groups.  Tickets without a link are left out.
    """
    marked, groups = _folded(vectors, min_score)
    firsts = cut_lineage(groups.select(F.col("first_id").alias("id"), "vec", "n", "digest"))
    found = _linked(firsts.select("id", "vec"), min_score, layout)
    counts = _link_counts(firsts, min_score, **layout).groupBy("query_id").agg(F.sum("links").alias("links"))
    named = firsts.join(found, firsts["id"] == found["node"]).join(counts, firsts["id"] == counts["query_id"], "left").select(
        "digest", F.col("component").alias("group_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links")).where(F.col("n_links") > 0)
    return salted_join(marked.select("id", "digest"), named, "digest", "id").select("id", "group_id", "n_links")


def _linked(firsts: DataFrame, min_score: float, layout: dict) -> DataFrame:
    """(node, component) of all links: one that a search leaves out has two ends with full lists.

    As long as rows with full lists lie in different components, those outside the largest one search again, among such
    rows, for four times as many.
    """
    def near(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
        found = nearest(queries, corpus, k, exclude_self=True, min_score=min_score, **layout)
        return cut_lineage(found.select(F.col("query_id").alias("src"), F.col("neighbour_id").alias("dst")))

    def filled(found: DataFrame, k: int) -> DataFrame:
        return found.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("src").alias("node"))

    k = GROUP_NEIGHBOURS
    nodes = firsts.select(F.col("id").alias("node"))
    links = near(firsts, firsts, k)
    full = filled(links, k)
    while True:
        labels = components(nodes, links)
        open_ = cut_lineage(labels.join(full, "node", "left_semi"))
        sizes = open_.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(2).collect()
        if len(sizes) < 2:
            return labels
        largest = F.col("component") == F.lit(sizes[0]["component"])
        corpus = cut_lineage(firsts.join(open_.select(F.col("node").alias("id")), "id", "left_semi"))
        queries = cut_lineage(corpus.join(open_.where(~largest).select(F.col("node").alias("id")), "id", "left_semi"))
        k *= 4
        more = near(queries, corpus, k)
        links = links.unionByName(more)
        again = cut_lineage(filled(more, k))
        # The largest component's rows stay partners of those whose lists are full again.
        full = again if again.isEmpty() else again.unionByName(open_.where(largest).select("node"))


def _link_counts(firsts: DataFrame, min_score: float, cells: int | None = None, column_rows: int | None = None) -> DataFrame:
    """(query_id, links): per pair of columns, the tickets behind the other vectors at or above the score."""
    total = firsts.count()
    placed, layout = _build_cells(firsts.select("id", "vec", "n"), cells, total)
    options = dict(exclude_self=True, earlier_only=False, min_score=min_score, weighed=True,
                   column_rows=column_rows or _column_rows(firsts, total))
    queries = firsts.select("id", "vec")
    if layout.single:
        return _search(queries.withColumn("cell", F.lit(0)), placed, layout.rows, [total], 0, **options)
    return _search_cells(queries, placed, layout, 0, options)
