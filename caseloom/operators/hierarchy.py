"""Hierarchical density clusters: spanning tree of mutual reachability, dendrogram, condensed tree, excess of mass.

Every step is a table:

1. Boruvka rounds: each component takes its least edge to a row outside, so a round stores one candidate per row at most
   and at least halves the number of components.
2. The dendrogram from the sorted tree edges, by halves: light edges are contracted before heavy ones are looked at, so no
   task merges more than ``LOCAL_ROWS`` edges.
3. Merges where both sides are large enough split a cluster; chains of other merges belong to one, found by doubling
   pointers.  Stabilities are sums per chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.operators.clusters import NOISE
from caseloom.operators.components import components, numbered
from caseloom.operators.density import GRAPH_NEIGHBOURS, MIN_CLUSTER_SIZE, MIN_SAMPLES, name_clusters
from caseloom.operators.neighbours import (
    RUN_ROWS, _block, _build_cells, _column_rows, _columns, _exact_scores, _few_rows, _matrix_reader, _slack, _unit_reader, nearest)
from caseloom.session import cut_lineage, written

#: Edges or clusters that one task works off in sequence; longer tables are divided first.
LOCAL_ROWS = 100_000
#: Lengths below this count as this: scores have nine digits, so the least positive length is above it.
LEAST_LENGTH = 1e-5
_FARTHEST = 2.0


def _length(score: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * score))


def _edge(reach: Column, a: Column, b: Column) -> Column:
    """Edges are ordered by reach, then by their ends: a total order, so rounds never close a cycle."""
    return F.struct(reach.alias("reach"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _least_reach(query, corpus, radius):
    """(place, reach) per query: the nearest corpus row of another component within the radius, the first of equals.

    A side is (unit vectors in single precision, function to exact ones, components, core distances).  Reaches are compared as
    the scores that belong to them; what may be the least, less the slack of single precision, is made exact.
    """
    import numpy as np
    (q, exact_q, q_owner, q_core), (c, exact_c, c_owner, c_core) = query, corpus
    slack, block = 2 * _slack(q.shape[1]), _block(RUN_ROWS)
    near = lambda length: 1 - length * length / 2
    q_near, c_near = near(q_core).astype(np.float32), near(c_core).astype(np.float32)
    floors = (near(radius) - slack).astype(np.float32)
    place, least = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
    for begin in range(0, len(q), block):
        rows = slice(begin, begin + block)
        floor = floors[rows]
        for start in range(0, len(c), RUN_ROWS):
            run = slice(start, start + RUN_ROWS)
            score = q[rows] @ c[run].T
            np.minimum(score, c_near[None, run], out=score)
            np.minimum(score, q_near[rows, None], out=score)
            may = score >= floor[:, None]
            if np.count_nonzero(may) > 4 * len(floor):
                score[q_owner[rows, None] == c_owner[None, run]] = -np.inf
                np.fmax(floor, score.max(axis=1) - np.float32(slack), out=floor)
                may = score >= floor[:, None]
            at, col = np.divmod(np.flatnonzero(may), score.shape[1])
            at, col = at + begin, col + start
            other = q_owner[at] != c_owner[col]
            at, col = at[other], col[other]
            if not len(at):
                continue
            length = np.sqrt(np.maximum(0.0, 2 - 2 * _exact_scores(exact_q, exact_c, at, col)))
            reach = np.maximum(np.maximum(length, c_core[col]), q_core[at])
            order = np.lexsort((col, reach, at))
            order = order[np.diff(at[order], prepend=-1) > 0]
            # Rows are in id order, so the first of equals has the smallest id.
            order = order[reach[order] < least[at[order]]]
            least[at[order]], place[at[order]] = reach[order], col[order]
            floor[at[order] - begin] = np.maximum(floor[at[order] - begin], (near(reach[order]) - slack).astype(np.float32))
    return place, least


def _outside(queries: DataFrame, placed: DataFrame, layout, column_rows: int) -> DataFrame:
    """(component, edge): the least edge from any of the query rows to a row of another component, one row per task and query.

    ``queries`` are (id, vec, core, component, radius): no cell beyond the radius is visited, nor one that holds just the
    query's own component.  ``placed`` are (id, vec, core, component, cell).
    """
    owners = {r["cell"]: (r["n"], r["low"], r["high"]) for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).collect()}
    cells = range(len(layout.pivots))
    sizes = [owners.get(c, (0, None, None))[0] for c in cells]
    alone = [owners[c][1] if c in owners and owners[c][1] == owners[c][2] else None for c in cells]
    pivots, low, high, read = layout.pivots, layout.nearest, layout.farthest, _matrix_reader()
    few = _few_rows
    fields = [queries.schema[c] for c in ("id", "vec", "core", "component", "radius")]

    def plan(batches):
        import numpy as np
        import pandas as pd
        single = len(pivots) <= 1
        table = None if single else np.asarray(pivots, dtype=np.float64)
        filled, near, far = np.asarray(sizes) > 0, np.asarray(low), np.asarray(high)
        for batch in few(batches, len(pivots)):
            owner = batch["component"].to_numpy()
            visit = np.repeat(filled[None, :], len(batch), axis=0)
            if not single:
                points = read(batch["vec"])
                squared = (points ** 2).sum(1)[:, None] + (table ** 2).sum(1)[None, :] - 2 * points @ table.T
                dist = np.sqrt(np.maximum(0.0, squared))
                bound = np.maximum((dist - dist.min(axis=1)[:, None]) / 2, np.maximum(dist - far[None, :], near[None, :] - dist))
                visit &= bound <= batch["radius"].to_numpy()[:, None] + 1e-6
            for c, one in enumerate(alone):
                if one is not None:
                    visit[:, c] &= owner != one
            at, cell = np.nonzero(visit)
            found = pd.DataFrame({f.name: batch[f.name].to_numpy()[at] for f in fields})
            yield found.assign(cell=cell.astype("int32"))

    visits = cut_lineage(queries.select(*[f.name for f in fields]).mapInPandas(plan, T.StructType([*fields, T.StructField("cell", T.IntegerType())])))
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    lookup = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
    q_cols, c_cols = lookup(_columns([asked.get(c, 0) for c in cells], column_rows)), lookup(_columns(sizes, column_rows))

    def spread(frame: DataFrame, own: str, own_cols: Column, other: str, other_cols: Column) -> DataFrame:
        return frame.select("*", F.pmod(F.xxhash64("id"), own_cols).cast("int").alias(own), F.explode(F.sequence(F.lit(0), other_cols - 1)).alias(other))

    left = spread(visits, "q_col", q_cols, "c_col", c_cols)
    right = spread(placed.select("id", "vec", "core", "component", "cell"), "c_col", c_cols, "q_col", q_cols)
    kind, unit, least = queries.schema["id"].dataType, _unit_reader(), _least_reach
    schema = T.StructType([T.StructField("id", kind), T.StructField("component", queries.schema["component"].dataType),
                           T.StructField("other", kind), T.StructField("reach", T.DoubleType())])

    def compare(a, b):
        import numpy as np
        import pandas as pd
        parts = []
        if len(a) and len(b):
            b = b.sort_values("id", kind="stable")
            sides = [(*unit(x["vec"]), x["component"].to_numpy(), x["core"].to_numpy()) for x in (a, b)]
            best, reach = least(*sides, a["radius"].to_numpy())
            fine = np.isfinite(reach)
            parts.append(pd.DataFrame({"id": a["id"].to_numpy()[fine], "component": a["component"].to_numpy()[fine],
                                       "other": b["id"].to_numpy()[best[fine]], "reach": reach[fine]}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": a["id"].head(0), "component": a["component"].head(0), "other": b["id"].head(0), "reach": np.zeros(0)})

    found = left.groupBy("cell", "q_col", "c_col").cogroup(right.groupBy("cell", "q_col", "c_col")).applyInPandas(compare, schema)
    return found.select("component", _edge(F.col("reach"), F.col("id"), F.col("other")).alias("edge"))


def spanning_edges(vectors: DataFrame, *, min_samples: int = MIN_SAMPLES, neighbours: int = GRAPH_NEIGHBOURS,
                   cells: int | None = None, column_rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(lo, hi, reach): the minimum spanning tree of the vectors under mutual reachability distance, ties by the ends.

    Lists of nearest neighbours come first.  A row's list proves its least edge to the outside when that is shorter
    than the list reaches; and a row whose list reaches farther than the least edge its component has found cannot
    have a better one.  Only the others search, and no farther than that edge.
    """
    rows = vectors.select("id", "vec").where(F.col("vec").isNotNull())
    total = rows.count()
    found = nearest(rows, rows, neighbours, exclude_self=True, cells=cells, column_rows=column_rows)
    lists = cut_lineage(found.select(F.col("query_id").alias("id"), F.col("neighbour_id").alias("other"), "rank", _length(F.col("score")).alias("length")))
    ends = cut_lineage(lists.groupBy("id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == min_samples, F.col("length"))), F.max("length")).alias("core"),
        F.when(F.count(F.lit(1)) >= neighbours, F.max("length")).otherwise(F.lit(math.inf)).alias("beyond")))
    core = ends.select("id", "core")
    other = core.select(F.col("id").alias("other"), F.col("core").alias("other_core"))
    lists = cut_lineage(lists.join(core, "id").join(other, "other").select(
        "id", "other", F.greatest("length", "core", "other_core").alias("reach")))
    placed, layout = _build_cells(rows, cells, total)
    placed = cut_lineage(placed.join(core, "id"))
    per_column = column_rows or _column_rows(rows, total)
    labels = cut_lineage(rows.select("id", F.col("id").alias("component")))
    tree, left = None, total
    for _ in range(max_rounds):
        if left <= 1:
            break
        near = labels.select(F.col("id").alias("other"), F.col("component").alias("other_component"))
        known = lists.join(labels, "id").join(near, "other").where(F.col("component") != F.col("other_component"))
        own = known.groupBy("id").agg(F.min(_edge(F.col("reach"), F.col("id"), F.col("other"))).alias("edge"))
        state = cut_lineage(labels.join(ends, "id").join(own, "id", "left"))
        best = cut_lineage(state.groupBy("component").agg(F.min("edge").alias("edge")))
        unproven = F.col("edge").isNull() | (F.col("edge.reach") >= F.col("beyond"))
        open_ = state.where(unproven & (F.col("beyond") < math.inf)).select("id", "core", "component", "beyond").join(
            best.select("component", F.col("edge.reach").alias("limit")), "component")
        open_ = cut_lineage(open_.where(F.col("limit").isNull() | (F.col("beyond") <= F.col("limit"))))
        if not open_.isEmpty():
            corpus = cut_lineage(placed.join(labels, "id"))
            vecs = corpus.select("id", "vec")
            unbounded = open_.where(F.col("limit").isNull())
            if not unbounded.isEmpty():
                # One row of a component without any edge gives a first bound for all its rows.
                first = unbounded.groupBy("component").agg(F.min("id").alias("id"))
                asked = first.join(corpus.select("id", "vec", "core"), "id").withColumn("radius", F.lit(_FARTHEST))
                bounds = cut_lineage(_outside(asked, corpus, layout, per_column).groupBy("component").agg(F.min("edge").alias("edge")))
                best = cut_lineage(best.where(F.col("edge").isNotNull()).unionByName(bounds))
                limits = bounds.select("component", F.col("edge.reach").alias("found"))
                open_ = open_.join(limits, "component", "left").withColumn("limit", F.coalesce("limit", "found")).drop("found")
                open_ = cut_lineage(open_.where(F.col("beyond") <= F.col("limit")))
            asked = open_.join(vecs, "id").withColumn("radius", F.col("limit"))
            more = _outside(asked, corpus, layout, per_column).groupBy("component").agg(F.min("edge").alias("edge"))
            best = best.where(F.col("edge").isNotNull()).unionByName(more).groupBy("component").agg(F.min("edge").alias("edge"))
        chosen = cut_lineage(best.select("edge.*").groupBy("lo", "hi").agg(F.min("reach").alias("reach")))
        tree = chosen if tree is None else tree.unionByName(chosen)
        sides = [labels.select(F.col("id").alias(end), F.col("component").alias(name)) for end, name in (("lo", "src"), ("hi", "dst"))]
        links = chosen.join(sides[0], "lo").join(sides[1], "hi").select("src", "dst")
        merged = components(labels.select(F.col("component").alias("node")).distinct(), links)
        renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("renamed"))
        labels = cut_lineage(labels.join(renamed, "component").select("id", F.col("renamed").alias("component")))
        left = merged.select("component").distinct().count()
    if tree is None:
        return rows.select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit(0.0).alias("reach")).limit(0)
    return tree.select("lo", "hi", "reach")


def _merged_locally(edges: DataFrame) -> DataFrame:
    """(rank, small, large, parent) of the merges of each block, in the order of rank; a parent in another block is null."""
    def run(key, block):
        import pandas as pd
        block = block.sort_values("rank")
        parent_of, size, last, out, place = {}, {}, {}, [], {}

        def find(x):
            while parent_of[x] != x:
                parent_of[x] = parent_of[parent_of[x]]
                x = parent_of[x]
            return x

        for rank, u, n_u, v, n_v in block[["rank", "u", "u_size", "v", "v_size"]].itertuples(index=False):
            for x, n in ((u, n_u), (v, n_v)):
                if x not in parent_of:
                    parent_of[x], size[x] = x, n
            a, b = find(u), find(v)
            for x in (a, b):
                if x in last:
                    out[place[last[x]]][3] = rank
            place[rank] = len(out)
            out.append([rank, min(size[a], size[b]), max(size[a], size[b]), None])
            parent_of[b] = a
            size[a] += size[b]
            last[a] = rank
        found = pd.DataFrame(out, columns=["rank", "small", "large", "parent"])
        return found.assign(parent=found["parent"].astype("Int64"))

    return edges.groupBy("block").applyInPandas(run, "rank long, small long, large long, parent long")


def dendrogram(tree: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(rank, lo, hi, reach, small, large, parent): the merges of single linkage in the order of reach and ends.

    ``small`` and ``large`` are the sizes of the two sides; ``parent`` is the merge that takes the result up next, null
    for the last.  Edges are cut into blocks by rank.  From all blocks down to single ones, the light half of every range
    of blocks is contracted, and the heavy half goes on between the contracted groups: the heaviest edge of a group has
    as parent the lightest edge of the other half that touches it.
    """
    ranked = cut_lineage(numbered(tree, ["reach", "lo", "hi"]).withColumnRenamed("number", "rank"))
    blocks = max(1, math.ceil(ranked.count() / local_rows))
    state = ranked.select("rank", F.floor(F.col("rank") / local_rows).cast("long").alias("block"), F.col("lo").alias("u"), F.lit(1).cast("long").alias("u_size"),
                          F.col("hi").alias("v"), F.lit(1).cast("long").alias("v_size"))
    across = None
    for level in range(max(0, (blocks - 1).bit_length()), 0, -1):
        state = cut_lineage(state.withColumn("range", F.shiftright("block", level)))
        heavy = F.shiftright("block", level - 1).bitwiseAND(F.lit(1)) == 1
        light, rest = state.where(~heavy), state.where(heavy)
        key = lambda end: F.struct("range", F.col(end).alias("node"))
        touched = light.select(F.explode(F.array(*[F.struct(key(e).alias("node"), F.col(f"{e}_size").alias("size")) for e in "uv"])).alias("t")).select("t.*").distinct()
        groups = components(touched.select("node"), light.select(key("u").alias("src"), key("v").alias("dst")))
        sized = cut_lineage(groups.join(touched, "node"))
        totals = sized.groupBy("component").agg(F.sum("size").alias("size"))
        named = cut_lineage(sized.select("node", "component").join(totals, "component"))
        for end in "uv":
            label = named.select(F.col("node").alias("__node"), F.col("component.node").alias("__name"), F.col("size").alias("__size"))
            rest = rest.join(label, key(end) == F.col("__node"), "left").withColumn(end, F.coalesce("__name", end)).withColumn(
                f"{end}_size", F.coalesce("__size", f"{end}_size")).drop("__node", "__name", "__size")
        rest = cut_lineage(rest)
        last = light.join(named, key("u") == F.col("node")).groupBy("component").agg(F.max("rank").alias("rank"))
        touching = rest.select("rank", F.explode(F.array(key("u"), key("v"))).alias("component")).groupBy("component").agg(F.min("rank").alias("parent"))
        above = last.join(touching, "component").select("rank", F.col("parent").alias("above"))
        across = above if across is None else across.unionByName(above)
        state = light.unionByName(rest).drop("range")
    merges = _merged_locally(state)
    if across is not None:
        merges = merges.join(across, "rank", "left").withColumn("parent", F.coalesce("parent", "above")).drop("above")
    return cut_lineage(ranked.join(merges, "rank"))


def _followed(pointers: DataFrame) -> DataFrame:
    """(rank, end): where pointers (rank, to) lead; an end points to itself.  Pointers double in each round."""
    now = written(pointers)
    while True:
        step = now.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        moved = written(now.join(step, "to").select("rank", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        now = moved.select("rank", "to")
        if moved.where("moved").isEmpty():
            return now.withColumnRenamed("to", "end")


def condensed_tree(merges: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE) -> tuple[DataFrame, DataFrame]:
    """(clusters, chains): (cluster, parent, size, stability) and (rank, cluster) of every merge of enough rows.

    A merge whose sides are both large enough splits its cluster in two.  A cluster is named by its highest merge; rows
    fall out of it at the density (one by reach) of the merge that brought them in.  Its stability sums, over its rows,
    how far the density rises from the cluster's birth until they fall out.
    """
    size, split = F.col("small") + F.col("large"), F.col("small") >= min_cluster_size
    density = 1 / F.greatest("reach", F.lit(LEAST_LENGTH))
    fallen = F.when(split | (F.col("large") < min_cluster_size), size).otherwise(F.col("small"))
    large = cut_lineage(merges.where(size >= min_cluster_size).select("rank", "parent", size.alias("size"), split.alias("split"),
                                                                      density.alias("density"), fallen.alias("fallen")))
    above = large.select(F.col("rank").alias("parent"), F.col("split").alias("parent_split"), F.col("density").alias("birth"))
    linked = cut_lineage(large.join(above, "parent", "left"))
    top = F.col("parent").isNull() | F.col("parent_split")
    chains = _followed(linked.select("rank", F.when(top, F.col("rank")).otherwise(F.col("parent")).alias("to"))).withColumnRenamed("end", "cluster")
    sums = linked.join(chains, "rank").groupBy("cluster").agg(F.sum(F.col("fallen") * F.col("density")).alias("mass"))
    heads = linked.where(top).select(F.col("rank").alias("cluster"), F.col("parent").alias("rank"), "size", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    heads = heads.join(chains.select("rank", F.col("cluster").alias("parent")), "rank", "left").drop("rank")
    clusters = heads.join(sums, "cluster").select("cluster", "parent", "size", (F.col("mass") - F.col("size") * F.col("birth")).alias("stability"))
    return cut_lineage(clusters), chains


def _weighed(clusters: DataFrame) -> DataFrame:
    """(cluster, parent, wins): whether a cluster is at least as stable as the best choice below it; the root never wins."""
    children = clusters.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("children"))
    open_ = cut_lineage(clusters.join(children, "cluster", "left").select(
        "cluster", "parent", "stability", F.coalesce("children", F.lit(0)).alias("waits"), F.lit(0.0).alias("below")))
    done = None
    while not open_.isEmpty():
        ready = cut_lineage(open_.where("waits = 0").select("cluster", "parent", ((F.col("stability") >= F.col("below")) & F.col("parent").isNotNull()).alias("wins"),
                                                            F.greatest("stability", "below").alias("mass")))
        done = ready if done is None else done.unionByName(ready)
        sums = ready.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("cluster")).agg(
            F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
        open_ = written(open_.where("waits > 0").join(sums, "cluster", "left").select(
            "cluster", "parent", "stability", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), (F.col("below") + F.coalesce("mass", F.lit(0.0))).alias("below")))
    return cut_lineage(done.select("cluster", "parent", "wins"))


def _highest(weighed: DataFrame) -> DataFrame:
    """(cluster, chosen): the highest winner among a cluster and all above it, null without one; steps double."""
    now = written(weighed.select("cluster", F.col("parent").alias("to"), F.when(F.col("wins"), F.col("cluster")).alias("chosen")))
    while not now.where(F.col("to").isNotNull()).isEmpty():
        step = now.select(F.col("cluster").alias("to"), F.col("to").alias("next"), F.col("chosen").alias("higher"))
        now = written(now.join(step, "to", "left").select("cluster", F.col("next").alias("to"), F.coalesce("higher", "chosen").alias("chosen")))
    return now.select("cluster", "chosen")


def _chosen_locally(clusters: DataFrame) -> DataFrame:
    """What ``_weighed`` and ``_highest`` find, in one task; for a checked number of clusters."""
    def run(key, rows):
        import pandas as pd
        rows = rows.sort_values("cluster")
        below, wins, chosen = {}, {}, {}
        # A cluster's name is above those of its children.
        listed = [(int(c), None if pd.isna(p) else int(p), s) for c, p, s in rows[["cluster", "parent", "stability"]].itertuples(index=False)]
        for cluster, parent, stability in listed:
            wins[cluster] = parent is not None and stability >= below.get(cluster, 0.0)
            if parent is not None:
                below[parent] = below.get(parent, 0.0) + max(stability, below.get(cluster, 0.0))
        for cluster, parent, _ in reversed(listed):
            higher = chosen.get(parent)
            chosen[cluster] = higher if higher is not None else cluster if wins[cluster] else None
        return pd.DataFrame({"cluster": list(chosen), "chosen": pd.array(list(chosen.values()), "Int64")})

    return clusters.groupBy(F.lit(0).alias("all")).applyInPandas(run, "cluster long, chosen long")


def hierarchical_clusters(vectors: DataFrame, *, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES,
                          local_rows: int = LOCAL_ROWS, **options) -> DataFrame:
    """(id, cluster_id): clusters of any density by excess of mass, numbered by falling size, -1 for noise.

    Empty below the minimum size.  A zero vector scores 0 against all.  Rows without a vector are left out; identifiers
    must differ.  Clusters can have different densities, where ``density_clusters`` cuts at one distance.
    """
    rows = vectors.select("id", "vec").where(F.col("vec").isNotNull())
    if rows.limit(min_cluster_size).count() < min_cluster_size:
        return rows.limit(0).select("id", F.lit(NOISE).cast("bigint").alias("cluster_id"))
    # Read anew: what the optimizer has estimated over the rounds of the tree would make each round of the dendrogram slower.
    merges = dendrogram(written(spanning_edges(rows, min_samples=min_samples, **options)), local_rows)
    clusters, chains = condensed_tree(merges, min_cluster_size)
    if clusters.count() <= local_rows:
        chosen = _chosen_locally(clusters)
    else:
        chosen = _highest(_weighed(clusters))
    # A row enters the tree at the first merge above it that is large enough: fewer steps than the minimum size.
    entry = merges.select("rank", F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.min("rank").alias("rank"))
    sized = merges.select("rank", "parent", (F.col("small") + F.col("large") >= min_cluster_size).alias("enough"))
    for _ in range(min_cluster_size):
        entry = written(entry.join(sized, "rank").select("id", F.when(F.col("enough"), F.col("rank")).otherwise(F.col("parent")).alias("rank")))
    placed = entry.join(chains, "rank").join(chosen, "cluster", "left").select("id", "chosen")
    placed = cut_lineage(placed)
    names = placed.where(F.col("chosen").isNotNull()).groupBy("chosen").agg(F.min("id").alias("component"))
    labelled = placed.join(names, "chosen", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"),
                                                           F.col("chosen").isNotNull().alias("member"))
    kept = name_clusters(labelled.where("member").select("node", "component"), 1)
    return kept.unionByName(labelled.where("NOT member").select(F.col("node").alias("id"), F.lit(NOISE).cast("bigint").alias("cluster_id")))
