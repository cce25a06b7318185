"""Near duplicates by locality-sensitive hashing: signs against random hyperplanes, cut into bands.

Two vectors at an angle t agree in a sign with probability 1 - t / pi, so pairs of a high score share the whole key of
some band almost surely.  Rows of one key meet; scores are exact, so nothing below the limit is ever linked.  What a
search may miss is a matter of bits and bands: ``expected_recall`` says it beforehand.

A hot bucket is no single task: its rows are dealt out to columns, and every pair of columns is a task.  A task hands on a
spanning forest of the links it finds, so output stays linear however dense a bucket is, and groups stay whole.  Rows that
are known to be in one group are not compared with each other: a task joins rows up as it goes, and long tables give it the
groups that the first bands have found.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from caseloom.operators.components import components
from caseloom.operators.joins import salted_join
from caseloom.operators.neighbours import RUN_ROWS, _block, _by_digest, _exact_scores, _marked, _matrix_reader, _most_rows, _slack, _unit_reader
from caseloom.session import cut_and_free, cut_lineage

BITS, BANDS = 10, 40
#: Rows of different groups that a task compares first; dense buckets join up most of their rows by them.
FIRST_ROWS = 32
#: Copies of vectors under way at once, about; one band at least.
COPIES_AT_ONCE = 1_000_000


def expected_recall(score: float, bits: int = BITS, bands: int = BANDS) -> float:
    """The share of pairs of this cosine score that meet in at least one band."""
    agree = 1 - math.acos(max(-1.0, min(1.0, score))) / math.pi
    return 1 - (1 - agree ** bits) ** bands


def _band_keys(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """Vectors with ``keys``: the signs of each vector, ``bits`` of them a band."""
    first = vectors.select(F.size("vec").alias("d")).first()
    dimension = first["d"] if first else 1
    schema = T.StructType([vectors.schema["id"], vectors.schema["vec"], T.StructField("keys", T.ArrayType(T.LongType()))])
    read = _matrix_reader()

    def run(batches):
        import numpy as np
        planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(dimension, bits * bands))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if len(batch):
                signs = (read(batch["vec"]) @ planes > 0).reshape(len(batch), bands, bits)
                yield batch.assign(keys=list(signs @ weights))

    return vectors.select("id", "vec").mapInPandas(run, schema)


def band_keys(vectors: DataFrame, bits: int = BITS, bands: int = BANDS, seed: int = 11) -> DataFrame:
    """(id, band, key): the signs of each vector, ``bits`` of them a band."""
    return _band_keys(vectors, bits, bands, seed).select("id", F.posexplode("keys").alias("band", "key"))


def _forest(units, exact, sides, group, min_score: float) -> list:
    """Pairs of places at or above the score that join all groups which such pairs join, and no more of them than it takes.

    ``units`` are in single precision, ``exact`` gives exact ones; ``group`` numbers what is joined before.  ``sides`` tells
    the rows of one column from those of the other, which alone are compared; with None all are.  Rows take turns: some meet
    all rows that had no turn yet and are not in their group.  The largest group goes first, so most pairs within a group
    are never looked at.
    """
    import numpy as np
    group, root, found = group.copy(), list(range(int(group.max()) + 1)), []
    slack, waits, mixed = _slack(units.shape[1]), np.ones(len(units), bool), FIRST_ROWS
    low, sure = np.float32(min_score - slack), np.float32(min_score + slack)
    most = _block(RUN_ROWS)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(at, col):
        for x, y, i, j in zip(group[at].tolist(), group[col].tolist(), at.tolist(), col.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((i, j))

    def renumber():
        names = np.fromiter(map(find, range(len(root))), np.int64, len(root))
        np.take(names, group, out=group)

    def apart(at, col):
        other = group[at] != group[col]
        return at[other], col[other]

    while True:
        rest = np.flatnonzero(waits)
        if sides is not None and (not len(rest) or sides[rest].all() or not sides[rest].any()):
            return found
        if len(rest) < 2:
            return found
        sizes = np.bincount(group[rest])
        large = sizes.argmax()
        if sizes[large] == len(rest):
            return found
        if sizes[large] >= FIRST_ROWS:
            own = rest[group[rest] == large]
            if sides is not None:
                one = sides[own]
                own = own[one] if 2 * np.count_nonzero(one) > len(own) else own[~one]
            turn = own[:most]
            others = rest[group[rest] != large]
        else:
            own = rest
            if sides is not None:
                one = sides[rest]
                own = rest[one] if 2 * np.count_nonzero(one) < len(rest) else rest[~one]
            turn, mixed = own[:mixed], min(most, 2 * mixed)
            others = rest
        if sides is not None:
            others = others[sides[others] != sides[turn[0]]]
        waits[turn] = False
        q = units[turn]
        for start in range(0, len(others), RUN_ROWS):
            run = others[start:start + RUN_ROWS]
            score = q @ units[run].T
            at, col = np.divmod(np.flatnonzero(score >= low), len(run))
            if not len(at):
                continue
            clear = score[at, col] >= sure
            at, col = turn[at], run[col]
            for sharp in (True, False):
                # What is above the score beyond doubt joins first, one partner for each row of the corpus and then the others.
                some_at, some_col = apart(at[clear == sharp], col[clear == sharp])
                if not sharp and len(some_at):
                    fine = _exact_scores(exact, exact, some_at, some_col) >= min_score
                    some_at, some_col = some_at[fine], some_col[fine]
                while len(some_at):
                    first = np.unique(some_col, return_index=True)[1]
                    join(some_at[first], some_col[first])
                    renumber()
                    some_at, some_col = apart(some_at, some_col)


def similar_links(vectors: DataFrame, min_score: float, *, bits: int = BITS, bands: int = BANDS, seed: int = 11,
                  column_rows: int | None = None) -> DataFrame:
    """(src, dst): links at or above the score between rows that share a band's key, enough of them to join all groups.

    Vectors travel only to buckets that hold several rows, once for each pair of columns they are in.  All rows travel once
    a band: long tables take a few bands at a time and give back the disk in between, so what is stored at once follows the
    rows and not the bands too.  The links of the first such bands name the groups that further bands need not join again.
    """
    held = cut_lineage(_band_keys(vectors.where(F.col("id").isNotNull()), bits, bands, seed))
    keyed = held.select(F.posexplode("keys").alias("band", "key"))
    sizes = cut_lineage(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    read, forest = _unit_reader(), _forest
    per_column = column_rows or _most_rows(vectors)
    kind = vectors.schema["id"].dataType
    place = ["band", "key", "a", "b"]
    linked = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])

    def link(key, rows):
        import pandas as pd
        ids, found = rows["id"].to_numpy(), []
        if len(ids) > 1:
            units, exact = read(rows["vec"])
            sides = None if key[2] == key[3] else (rows["own"] == key[2]).to_numpy()
            found = forest(units, exact, sides, pd.factorize(rows["known"])[0], min_score)
        if not found:
            return pd.DataFrame({"src": rows["id"].head(0), "dst": rows["id"].head(0)})
        at, col = zip(*found)
        return pd.DataFrame({"src": ids[list(at)], "dst": ids[list(col)]})

    def links_of(some: DataFrame, first: int, last: int) -> DataFrame:
        copies = some.select("id", "vec", "known", F.posexplode(F.slice("keys", first + 1, last - first + 1)).alias("turn", "key"))
        copies = copies.withColumn("band", F.col("turn") + first).drop("turn")
        own_sizes = sizes.where(F.col("band").between(first, last))
        # So many buckets are few rows beside the vectors, which then need not be dealt out by them.
        own_sizes = F.broadcast(own_sizes) if bits <= BITS else own_sizes
        shared = copies.join(own_sizes, ["band", "key"]).withColumn("cols", F.ceil(F.col("n") / per_column).cast("int")).drop("n")
        # Column a of a bucket meets each column b >= a, itself too.
        shared = shared.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cols")).cast("int"))
        shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
        met = shared.select("id", "vec", "known", "band", "key", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        links = met.groupBy(*place).applyInPandas(link, linked)
        return links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    alone = held.withColumn("known", F.col("id"))
    at_once = max(1, COPIES_AT_ONCE // max(1, held.count()))
    if at_once >= bands:
        return links_of(alone, 0, bands - 1)
    parts = [cut_and_free(links_of(alone, 0, at_once - 1))]
    labels = components(held.select(F.col("id").alias("node")), parts[0])
    named = cut_and_free(held.join(labels, held["id"] == labels["node"]).select("id", "vec", "keys", F.col("component").alias("known")))
    for b in range(at_once, bands, at_once):
        parts.append(cut_and_free(links_of(named, b, min(bands, b + at_once) - 1)))
    return reduce(DataFrame.unionByName, parts).distinct()


def hashed_groups(vectors: DataFrame, min_score: float, **options) -> DataFrame:
    """(id, group_id): rows linked by pairs at or above the score that hashing brings together, named by the smallest id.

    Equal vectors are folded before hashing and always found.  Rows without a link, zero vectors and rows without a
    vector are left out.  ``duplicate_groups`` is the exact way beside it.
    """
    marked = cut_lineage(_marked(vectors.where(F.col("vec").isNotNull()), min_score))
    firsts = cut_lineage(_by_digest(marked).select(F.col("first_id").alias("id"), "vec", "n", "digest"))
    links = cut_lineage(similar_links(firsts, min_score, **options))
    labels = components(firsts.select(F.col("id").alias("node")), links)
    named = firsts.join(labels, firsts["id"] == labels["node"]).select("id", "digest", "n", F.col("component").alias("group_id"))
    linked = named.groupBy("group_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("group_id")
    named = named.join(linked, "group_id", "left_semi").select("digest", "group_id")
    return salted_join(marked.select("id", "digest"), named, "digest", "id").select("id", "group_id")
