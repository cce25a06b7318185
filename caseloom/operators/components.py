"""Connected components by iterated joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from caseloom.session import cut_lineage

#: Rows that one task of a round works on; short tables go through few tasks, so a round leaves few files.
ROWS_PER_TASK = 250_000
#: So many links, in both directions, go through one task instead of rounds of joins.
LOCAL_LINKS = 200_000


def _in_one_task(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """The components of a counted, short table of links."""
    kind = nodes.schema["node"].dataType

    def run(key, links):
        import pandas as pd
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(links["src"].tolist(), links["dst"].tolist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": list(root), "component": [find(x) for x in root]})

    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    linked = both.groupBy(F.lit(0).alias("all")).applyInPandas(run, schema)
    return nodes.select("node").distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): the component is named by its smallest node.

    ``nodes`` has a column ``node``; ``edges`` has ``src`` and ``dst``, in any
    direction.  In each round a node is offered the smallest label among its
    neighbours.  The offer goes to the node and to the node it is labelled with,
    so whole groups move at once, and then every label is replaced by the label
    of that label.  The number of rounds grows with the logarithm of the longest
    path.  Minima are combined before the shuffle, so a hub costs one row per
    task; a hub on the probe side of a join is split by the adaptive skew join.

    Up to ``local_links`` links between plain identifiers are counted and then joined up in one task.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(both.where(F.col("src") != F.col("dst")).distinct())
    n_links = both.count()
    if n_links <= local_links and not isinstance(nodes.schema["node"].dataType, T.StructType):
        return cut_lineage(_in_one_task(nodes, both))
    labels = cut_lineage(nodes.select("node").distinct().withColumn("component", F.col("node")))
    tasks = max(1, math.ceil(max(n_links, labels.count()) / ROWS_PER_TASK))
    both, labels = both.coalesce(tasks), labels.coalesce(tasks)
    for _ in range(max_rounds):
        offered = (both.join(labels, both["src"] == labels["node"]).groupBy("dst")
                   .agg(F.min("component").alias("offer")))
        known = labels.join(offered, labels["node"] == offered["dst"], "left")
        own = known.select(F.col("node").alias("target"), F.col("component").alias("old"),
                           F.least("component", F.coalesce("offer", "component")).alias("value"))
        passed_on = known.where(F.col("offer") < F.col("component")).select(
            F.col("component").alias("target"), F.lit(None).cast(labels.schema["component"].dataType).alias("old"),
            F.col("offer").alias("value"))
        # Both sides of the next join start from this shuffle, which Spark runs once.
        hooked = own.unionByName(passed_on).groupBy("target").agg(
            F.min("value").alias("value"), F.max("old").alias("old"))
        jumps = hooked.select(F.col("target").alias("step"), F.col("value").alias("jump"))
        moved = cut_lineage(hooked.join(jumps, F.col("value") == F.col("step")).select(
            F.col("target").alias("node"), "old", F.least("value", "jump").alias("component")).coalesce(tasks))
        labels = moved.select("node", "component")
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def numbered(groups: DataFrame, order: list) -> DataFrame:
    """Add ``number`` 0, 1, ... in global order, with no single-task sort.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the row counts of the partitions before (one count per partition).
    """
    marked = cut_lineage(groups.orderBy(*order).withColumn("__mark", F.monotonically_increasing_id()))
    part = F.shiftright("__mark", 33)
    counts = sorted((r["p"], r["n"]) for r in
                    marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    if not starts:
        return marked.withColumn("number", F.lit(0).cast("bigint")).drop("__mark")
    offset = F.element_at(F.create_map(*[F.lit(v) for pair in starts.items() for v in pair]), part)
    local = F.col("__mark") - F.shiftleft(part, 33)
    return marked.withColumn("number", (offset + local).cast("bigint")).drop("__mark")
