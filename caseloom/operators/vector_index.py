"""A stored vector index: two levels of k-means cells as a partitioned table, with bounds that keep the search exact.

The index is three tables in one folder of the shared file system:

- ``centres``: the cells.  A coarse level is fitted on a bounded sample, then every coarse cell is cut by its own sample;
  there are about as many cells as the square root of the rows, ``MAX_CELLS`` at most, so tasks may hold the centres.
- ``rows/cell=…``: every vector in its cell, with its distance to the centre.  A search reads the folders it visits.
- ``facts``: per cell the number of rows and the least and largest distance to the centre, one generation per change.

``put`` adds vectors or replaces those of the same id and rewrites the touched cells alone.  Its steps may stop anywhere:
bounds are widened before rows move and narrowed afterwards, and the same call made again ends in the same index.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caseloom.operators.neighbours import _best, _blank_answers, _column_rows, _matrix_reader, _search, is_zero
from caseloom.session import cut_lineage
from caseloom.sources.tables import exists

#: Coarse cells, and cells within one of them; their product bounds what the driver and a task hold.
MAX_COARSE, MAX_FINE = 128, 128
MAX_CELLS = MAX_COARSE * MAX_FINE
#: Rows of the sample that a centre is fitted on.
SAMPLE_ROWS = 64
ROUNDS = 10
#: Rows of one stored file.
FILE_ROWS = 1_000_000
#: Distances held at once while cells are picked.
_BLOCK = 1 << 21
_SLACK = 1e-6


def _kmeans(points, number: int, rounds: int = ROUNDS):
    """Centres of at most ``number`` cells; the first different points are the start, so reruns agree."""
    import numpy as np
    _, firsts = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(firsts)[:number]].copy()
    for _ in range(rounds):
        home = _nearest_centre(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        counts = np.bincount(home, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(points, centres):
    import numpy as np
    return np.sqrt(np.maximum(0.0, (points ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * points @ centres.T))


def _nearest_centre(points, centres):
    import numpy as np
    home, reach = np.zeros(len(points), np.int64), np.zeros(len(points))
    step = max(1, _BLOCK // len(centres))
    for first in range(0, len(points), step):
        distance = _distances(points[first:first + step], centres)
        home[first:first + step] = distance.argmin(axis=1)
        reach[first:first + step] = distance.min(axis=1)
    return home, reach


@dataclass
class Index:
    """The centres and facts of a stored index, ``MAX_CELLS`` rows at most."""

    spark: SparkSession
    path: str
    coarse: list      # centres of the coarse level
    group: list       # coarse cell of each cell
    centres: list     # centre of each cell
    kind: T.DataType  # of the identifiers

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", self.kind), T.StructField("vec", T.ArrayType(T.DoubleType())),
                             T.StructField("tag", T.LongType()), T.StructField("reach", T.DoubleType()),
                             T.StructField("cell", T.IntegerType())])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def facts(self) -> tuple[list, list, list]:
        """Rows, least and largest distance of every cell in the newest whole generation."""
        number = _generation(self.spark, self.path)
        counts, near, far = ([0] * len(self.centres), [0.0] * len(self.centres), [0.0] * len(self.centres))
        for row in self.spark.read.parquet(f"{self.path}/facts/{number}").collect():
            counts[row["cell"]], near[row["cell"]], far[row["cell"]] = row["n"], row["lo"], row["hi"]
        return counts, near, far


def _generation(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/facts")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return -1
    numbers = [int(s.getPath().getName()) for s in system.listStatus(folder)]
    return max((n for n in numbers if exists(spark, f"{path}/facts/{n}")), default=-1)


def _measured(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))


def _store_facts(index: Index, facts: DataFrame) -> None:
    number = _generation(index.spark, index.path) + 1
    # An unfinished folder of this number is no generation yet.
    facts.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/facts/{number}")


def _store_rows(placed: DataFrame, counts: dict, path: str, others: str = "dynamic") -> None:
    """Each cell in files of bounded size; cells that are given replace the stored ones, others stay unless ``static``."""
    files = F.from_json(F.lit(json.dumps([math.ceil(counts.get(c, 0) / FILE_ROWS) or 1 for c in range(max(counts, default=0) + 1)])), "array<int>")
    salt = F.pmod(F.xxhash64("id"), F.element_at(files, F.col("cell") + 1))
    (placed.repartition("cell", salt).write.mode("overwrite").option("partitionOverwriteMode", others)
     .partitionBy("cell").parquet(f"{path}/rows"))


def _checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """(id, vec, tag) without null ids or vectors; a wrong dimension is an error."""
    wrong = F.raise_error(F.concat(F.lit("vector of dimension "), F.size("vec").cast("string")))
    vec = F.transform("vec", lambda x: x.cast("double"))
    tag = F.col("tag").cast("bigint") if "tag" in vectors.columns else F.lit(None).cast("bigint")
    return vectors.select("id", "vec", tag.alias("tag")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(
        "id", F.when(F.size("vec") == dimension, vec).otherwise(wrong).alias("vec"), "tag")


def _newest(vectors: DataFrame, dimension: int) -> DataFrame:
    """One vector per id: of repeats the one that is largest as an array, so reruns agree."""
    newest = F.max(F.struct("vec", "tag")).alias("row")
    return _checked(vectors, dimension).groupBy("id").agg(newest).select("id", "row.vec", "row.tag")


def _placed(vectors: DataFrame, index: Index) -> DataFrame:
    """Vectors with their cell, found over the two levels, and their distance to its centre."""
    coarse, group, centres, read = index.coarse, index.group, index.centres, _matrix_reader()

    def place(batches):
        import numpy as np
        tops, fine, owner = np.asarray(coarse), np.asarray(centres), np.asarray(group)
        own = {g: np.flatnonzero(owner == g) for g in range(len(tops))}
        for batch in batches:
            if len(batch) == 0:
                continue
            points = read(batch["vec"])
            top = _nearest_centre(points, tops)[0]
            cell, reach = np.zeros(len(points), np.int32), np.zeros(len(points))
            for g in np.unique(top):
                at = np.flatnonzero(top == g)
                home, far = _nearest_centre(points[at], fine[own[g]])
                cell[at], reach[at] = own[g][home], far
            yield batch.assign(reach=reach, cell=cell)

    return vectors.mapInPandas(place, index.schema)


def create(vectors: DataFrame, path: str, *, dimension: int, cells: int | None = None) -> Index:
    """Fit the cells and store all vectors; ``vectors`` holds (id, vec), and a number ``tag`` if wanted.

    Rows with a null id or vector are left out, an id that repeats keeps one vector, a vector of another dimension is an
    error, other columns are ignored.  An empty table gives an index of one empty cell.  The cells are fitted on at most
    ``SAMPLE_ROWS`` rows per centre and level, those with the smallest hashes; every row is stored.
    """
    spark = vectors.sparkSession
    given = cut_lineage(_newest(vectors, dimension))
    total = given.count()
    wanted = min(MAX_CELLS, cells or max(1, math.isqrt(total)))
    tops = min(MAX_COARSE, math.ceil(math.sqrt(wanted)))
    read = _matrix_reader()
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    sample = given.select("vec", mark.alias("h")).orderBy("h").limit(tops * SAMPLE_ROWS).toPandas()
    coarse = _kmeans(read(sample["vec"]), tops).tolist() if len(sample) else [[0.0] * dimension]
    kind = vectors.schema["id"].dataType
    first = Index(spark, path, coarse, list(range(len(coarse))), coarse, kind)
    grouped = cut_lineage(_placed(given, first)) if wanted > 1 else None
    if grouped is None:
        group, centres = list(range(len(coarse))), coarse
    else:
        sizes = {r["cell"]: r["count"] for r in grouped.groupBy("cell").count().collect()}
        numbers = [min(MAX_FINE, math.ceil(sizes.get(g, 0) * wanted / max(1, total))) or 1 for g in range(len(coarse))]
        # A hash below a cell's own limit: at most some MAX_FINE * SAMPLE_ROWS rows of a cell, however large it is.
        limits = [min(1 << 40, (1 << 40) * numbers[g] * SAMPLE_ROWS // max(1, sizes.get(g, 1))) for g in range(len(coarse))]
        limit = F.element_at(F.from_json(F.lit(json.dumps(limits)), "array<bigint>"), F.col("cell") + 1)
        fitted = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])

        def cut(part):
            import pandas as pd
            part = part.sort_values("h", kind="stable")
            own = _kmeans(read(part["vec"]), numbers[part["cell"].iloc[0]])
            return pd.DataFrame({"cell": part["cell"].iloc[0], "centre": list(own)})

        found = grouped.select("cell", "vec", mark.alias("h")).where(F.col("h") < limit).groupBy("cell").applyInPandas(cut, fitted)
        by_group = sorted((r["cell"], r["centre"]) for r in found.collect())
        missing = set(range(len(coarse))) - {g for g, _ in by_group}
        by_group = sorted(by_group + [(g, coarse[g]) for g in missing])
        group, centres = [g for g, _ in by_group], [c for _, c in by_group]
    index = Index(spark, path, coarse, group, centres, kind)
    tables = [("coarse", i, 0, c) for i, c in enumerate(coarse)] + [("cell", i, g, c) for i, (g, c) in enumerate(zip(group, centres))]
    spark.createDataFrame(tables, "level string, number int, coarse int, centre array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/centres")
    placed = cut_lineage(_placed(given, index))
    facts = cut_lineage(_measured(placed))
    _store_rows(placed, {r["cell"]: r["n"] for r in facts.collect()}, path, "static")
    _store_facts(index, facts)
    return index


def ready(spark: SparkSession, path: str) -> bool:
    """True for an index whose creation was finished."""
    return _generation(spark, path) >= 0


def load(spark: SparkSession, path: str, kind: T.DataType | None = None) -> Index:
    """An index stored before; ``kind`` is the type of its identifiers, by default that of the stored rows."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["number"])
    cells = [r for r in rows if r["level"] == "cell"]
    return Index(spark, path, [r["centre"] for r in rows if r["level"] == "coarse"], [r["coarse"] for r in cells],
                 [r["centre"] for r in cells], kind or spark.read.parquet(f"{path}/rows").schema["id"].dataType)


def _only(cells) -> str:
    return f"cell IN ({','.join(str(c) for c in sorted(cells))})" if cells else "false"


def put(index: Index, vectors: DataFrame, *, replaces: bool = True) -> None:
    """Add vectors, or replace those of the same id; cells that neither held nor get one of the ids are not rewritten.

    The ids of all cells are read once, narrow, to find those to replace; with ``replaces=False``, for ids that are not
    stored or lie in the same cell, just the cells that get a row are read.  Cases as in ``create``.
    """
    fresh = cut_lineage(_placed(_newest(vectors, len(index.centres[0])), index))
    ids = fresh.select("id")
    touched = {r["cell"] for r in fresh.select("cell").distinct().collect()}
    if replaces:
        held = index.rows().select("id", "cell").join(ids, "id", "left_semi")
        touched |= {r["cell"] for r in held.select("cell").distinct().collect()}
    if not touched:
        return
    kept = index.rows().where(_only(touched)).join(ids, "id", "left_anti").select(*index.schema.names)
    after = cut_lineage(kept.unionByName(fresh))
    number = _generation(index.spark, index.path)
    before = index.spark.read.parquet(f"{index.path}/facts/{number}")
    changed = cut_lineage(_measured(after))
    # Wide enough for the rows before and after the change.
    _store_facts(index, before.unionByName(changed).groupBy("cell").agg(
        F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    counts = {r["cell"]: r["n"] for r in changed.collect()}
    _store_rows(after, counts, index.path)
    emptied = touched - set(counts)
    jvm = index.spark.sparkContext._jvm
    for cell in sorted(emptied):  # no row is left that could replace the folder
        folder = jvm.org.apache.hadoop.fs.Path(f"{index.path}/rows/cell={cell}")
        folder.getFileSystem(index.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _store_facts(index, before.where(f"NOT {_only(touched)}").unionByName(changed))


def _packs(counts: list, rows: int) -> list:
    """First cell of each pack: neighbouring cells of about ``rows`` rows together."""
    firsts, held = [0], 0
    for cell, n in enumerate(counts):
        if held and held + n > rows:
            firsts.append(cell)
            held = 0
        held += n
    return firsts


def _planned(queries: DataFrame, index: Index, facts: tuple, firsts: list, pick) -> DataFrame:
    """One row per query and pack with a cell that ``pick`` (distances, lower bounds, rows of the batch) chooses.

    ``parts`` holds a bit for each cell of the pack, set for those to visit; so a query travels once to a pack.
    """
    schema = T.StructType([queries.schema["id"], queries.schema["vec"], T.StructField("cell", T.IntegerType()), T.StructField("parts", T.BinaryType())])
    centres, read = index.centres, _matrix_reader()

    def plan(batches):
        import numpy as np
        import pandas as pd
        fine = np.asarray(centres)
        counts, near, far = (np.asarray(one) for one in facts)
        step = max(1, _BLOCK // len(fine))
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.iloc[first:first + step]
                distance = _distances(read(part["vec"]), fine)
                distance[:, counts == 0] = np.inf
                bound = np.maximum(0.0, np.maximum(distance - far[None, :], near[None, :] - distance))
                chosen = pick(distance, bound, counts, part) & (counts > 0)[None, :]
                for pack, (begin, end) in enumerate(zip(firsts, [*firsts[1:], len(counts)])):
                    at = np.flatnonzero(chosen[:, begin:end].any(axis=1))
                    if len(at):
                        bits = np.packbits(chosen[at, begin:end], axis=1)
                        yield pd.DataFrame({"id": part["id"].to_numpy()[at], "vec": part["vec"].to_numpy()[at],
                                            "cell": np.int32(pack), "parts": [one.tobytes() for one in bits]})

    return queries.mapInPandas(plan, schema)


def _asked(visits: DataFrame, firsts: list, cells: int) -> dict:
    """Queries that visit each cell, for the cells that any visits."""
    def add(batches):
        import numpy as np
        import pandas as pd
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for pack, parts in batch.groupby("cell")["parts"]:
                end = firsts[pack + 1] if pack + 1 < len(firsts) else cells
                bits = np.unpackbits(np.stack([np.frombuffer(one, np.uint8) for one in parts]), axis=1)
                total[firsts[pack]:end] += bits[:, :end - firsts[pack]].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype("int32"), "n": total[at]})

    found = visits.select("cell", "parts").mapInPandas(add, "cell int, n bigint")
    return {r["cell"]: r["n"] for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def _first_cells(least: int):
    """The nearest cells that together hold ``least`` rows."""
    def pick(distance, bound, counts, part):
        import numpy as np
        order = np.argsort(distance, axis=1, kind="stable")
        held = counts[order]
        wanted = np.cumsum(held, axis=1) - held < least
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, order, wanted, axis=1)
        return chosen

    return pick


def _probed(number: int):
    def pick(distance, bound, counts, part):
        import numpy as np
        order = np.argsort(distance, axis=1, kind="stable")[:, :number]
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen

    return pick


def _within(least: int):
    """Cells that may hold a row within the radius, but for the ones of the first search."""
    first = _first_cells(least) if least else None

    def pick(distance, bound, counts, part):
        reached = bound <= part["radius"].to_numpy()[:, None] + _SLACK
        return reached & ~first(distance, bound, counts, part) if first else reached

    return pick


def search(index: Index, queries: DataFrame, k: int, *, exclude_self: bool = False, min_score: float | None = None,
           probes: int | None = None, column_rows: int | None = None, tagged: bool = False, report: dict | None = None) -> DataFrame:
    """(query_id, neighbour_id, score, rank): the rows of ``neighbours.nearest`` over the stored vectors.

    A query first searches the cells nearest to it that hold k rows; its k-th best distance then tells which other cells
    may hold a better row.  Only their folders are read.  With ``probes`` just that many nearest cells are searched, which
    is faster and may miss rows.  ``report`` gets the numbers of cells, of cells read by any query, of stored rows,
    and of pairs of query and row compared; ``tagged`` adds the tags of the neighbours.  Queries with a null id or vector have no rows; a zero vector scores 0 against all.
    """
    queries = cut_lineage(_checked(queries, len(index.centres[0])).drop("tag"))
    facts = index.facts()
    counts, n_queries = facts[0], queries.count()
    stored, total = index.rows(), sum(counts)
    options = dict(exclude_self=exclude_self, earlier_only=False, min_score=min_score,
                   column_rows=column_rows or _column_rows(queries, max(n_queries, 1)))
    firsts = _packs(counts, options["column_rows"])
    pack_rows = [sum(counts[a:b]) for a, b in zip(firsts, [*firsts[1:], len(counts)])]
    place = [pack for pack, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(counts)])) for _ in range(a, b)]
    lookup = lambda values, at: F.element_at(F.from_json(F.lit(json.dumps(values)), "array<int>"), F.col(at) + 1)
    read: set = set()
    compared = 0

    def run(visits: DataFrame) -> DataFrame:
        nonlocal compared
        visits = cut_lineage(visits)
        asked = _asked(visits, firsts, len(counts))
        read.update(asked)
        compared += sum(n * counts[c] for c, n in asked.items())
        sent = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        held = stored.where(_only(asked)).select(lookup(place, "cell").alias("cell"), "id", "vec", (
            F.col("cell") - lookup([firsts[p] for p in place], "cell")).alias("part"))
        return _search(visits, held, pack_rows, [sent.get(p, 0) for p in range(len(firsts))], k, packed=True, **options)

    blank, positive = None, min_score is not None and min_score > 0
    if not positive:
        blank = _blank_answers(queries.where(is_zero(F.col("vec"))), stored, k, exclude_self)
    queries = queries.where(~is_zero(F.col("vec")))
    if probes is not None:
        found = run(_planned(queries, index, facts, firsts, _probed(probes)))
    elif positive:
        limit = math.sqrt(max(0.0, 2 - 2 * min_score))
        found = run(_planned(queries.withColumn("radius", F.lit(limit)), index, facts, firsts, _within(0)))
    else:
        least = k + int(exclude_self)
        first = cut_lineage(_best(cut_lineage(run(_planned(queries, index, facts, firsts, _first_cells(least)))), k))
        reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        # Scores at or below zero may tie with zero vectors anywhere: everything is searched then.
        radius = F.when((F.col("n") >= k) & (F.col("worst") > 0), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))))
        widened = queries.join(reached, queries["id"] == reached["query_id"], "left").select(
            "id", "vec", F.coalesce(radius, F.lit(2.0)).alias("radius"))
        found = first.drop("rank").unionByName(run(_planned(widened, index, facts, firsts, _within(least))))
    if report is not None:
        report.update(cells=len(counts), cells_read=len(read), rows=total, queries=n_queries, pairs_compared=compared)
    best = _best(found, k)
    folders = stored.where(_only(read))
    if blank is not None and not blank.isEmpty():
        best, folders = best.unionByName(blank), stored
    if tagged:
        best = best.join(folders.select(F.col("id").alias("neighbour_id"), "tag"), "neighbour_id", "left").select(*best.columns, "tag")
    return best
