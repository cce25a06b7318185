"""Dense communities of tickets and entities: modularity moves and contraction, level by level.

The graph joins tickets to the entities they name; a mention weighs ``UNIT // n`` where n tickets name the entity, so
all weights are whole numbers and every sum is exact.  No pair of tickets is formed: work grows with the mentions.

A round lets nodes move to the neighbouring community of the largest gain.  Nodes that move together must not chase each
other: in the first level tickets and entities take turns, and no two of a side are neighbours; later, odd rounds
allow moves to smaller labels only and even rounds to larger ones.  A level ends with the labels of its best round,
measured exactly, so modularity never falls.  Then each community becomes a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.operators.components import numbered
from caseloom.operators.joins import long_join
from caseloom.session import cut_lineage, written

#: Weight of the mentions of one entity together.
UNIT = 1_000_000
LEVELS = 3
ROUNDS = 4


def _whole(value: Column) -> Column:
    """A sum of products beyond 64 bits."""
    return value.cast("decimal(19,0)")


def mention_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (ticket_id, node_type, name): nodes are numbered by side and name, entities before tickets.

    Nodes hold node, side, name, degree and loop; edges hold src, dst and w, once in each direction.  Repeated mentions
    count once; rows with a null ticket or name are no mentions.
    """
    pairs = found.where("ticket_id IS NOT NULL AND name IS NOT NULL").select(
        F.col("ticket_id").cast("string").alias("ticket"), F.concat_ws(":", "node_type", "name").alias("entity")).distinct()
    sizes = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select(
        "entity", F.greatest(F.floor(F.lit(UNIT) / F.col("n")), F.lit(1)).cast("bigint").alias("w"))
    pairs = cut_lineage(long_join(pairs, sizes, "entity"))
    ends = {side: pairs.groupBy(F.col(column).alias("name")).agg(F.sum("w").alias("degree")).select(F.lit(side).alias("side"), "name", "degree")
            for side, column in (("E", "entity"), ("T", "ticket"))}
    nodes = cut_lineage(numbered(ends["E"].unionByName(ends["T"]), ["side", "name"]).withColumnRenamed("number", "node")
                        .withColumn("loop", F.lit(0).cast("bigint")))
    keys = {side: nodes.where(F.col("side") == side).select(F.col("name").alias(column), F.col("node").alias(side))
            for side, column in (("E", "entity"), ("T", "ticket"))}
    joined = cut_lineage(long_join(long_join(pairs, keys["E"], "entity"), keys["T"], "ticket").select("E", "T", "w"))
    edges = joined.select(F.col("E").alias("src"), F.col("T").alias("dst"), "w").unionByName(
        joined.select(F.col("T").alias("src"), F.col("E").alias("dst"), "w"))
    return nodes, edges


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, community, w): the weight between each node and each community it touches."""
    ends = labels.select(F.col("node").alias("dst"), "community")
    return long_join(edges, ends, "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))


def _offers(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes, once for each community (``target``) they touch with weight ``w``, and once for their own."""
    touched = _between(edges, labels).select(F.col("src").alias("node"), F.col("community").alias("target"), "w")
    stay = labels.select("node", F.col("community").alias("target"), F.lit(0).cast("bigint").alias("w"))
    weights = touched.unionByName(stay).groupBy("node", "target").agg(F.sum("w").alias("w"))
    return written(long_join(weights, labels.select("node", "side", "degree", "loop", "community"), "node"))


def _at_home(offers: DataFrame) -> DataFrame:
    return offers.where("target = community")


def _volumes(offers: DataFrame) -> DataFrame:
    return _at_home(offers).groupBy("target").agg(F.sum("degree").alias("volume"))


def quality(offers: DataFrame, total: int) -> int:
    """Modularity times the square of ``total`` (twice the weight of the graph), as an exact whole number."""
    per = _at_home(offers).groupBy("target").agg(F.sum(F.col("w") + F.col("loop")).alias("inner"), F.sum("degree").alias("volume"))
    row = per.agg(F.sum(_whole(F.col("inner"))).alias("inner"), F.sum(_whole(F.col("volume")) * _whole(F.col("volume"))).alias("squares")).first()
    return int(row["inner"] or 0) * total - int(row["squares"] or 0)


def _moved(offers: DataFrame, total: int, may_move: Column, may_take: Column) -> DataFrame:
    """The labels after one round: the gain of a community is w - degree * volume / total, its volume without the node."""
    own = F.col("target") == F.col("community")
    sized = long_join(offers.where(own | (may_move & may_take)), _volumes(offers), "target")
    others = F.col("volume") - F.when(own, F.col("degree")).otherwise(F.lit(0))
    gain = F.col("w").cast("double") - F.col("degree").cast("double") * others.cast("double") / F.lit(float(total))
    best = F.max(F.struct(gain.alias("gain"), own.alias("own"), (-F.col("target")).alias("low"), "side", "degree", "loop")).alias("best")
    return written(sized.groupBy("node").agg(best).select(
        "node", "best.side", "best.degree", "best.loop", (-F.col("best.low")).alias("community")))


def _level(nodes: DataFrame, edges: DataFrame, total: int, first: bool, rounds: int) -> tuple[DataFrame, int]:
    """(offers after the best round, number of that round); round 0 leaves every node alone."""
    best = offers = _offers(edges, nodes.select("node", "side", "degree", "loop", F.col("node").alias("community")))
    best_round, best_quality = 0, quality(offers, total)
    for r in range(1, rounds + 1):
        if first:
            may_move, may_take = F.col("side") == ("E" if r % 2 else "T"), F.lit(True)
        else:
            lower = F.col("target") < F.col("community")
            may_move, may_take = F.lit(True), lower if r % 2 else ~lower
        offers = _offers(edges, _moved(offers, total, may_move, may_take))
        now = quality(offers, total)
        if now > best_quality:
            best, best_round, best_quality = offers, r, now
    return best, best_round


def _contracted(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes; what lies within one becomes its loop."""
    joined = written(offers.groupBy(F.col("community").alias("src"), F.col("target").alias("dst")).agg(F.sum("w").alias("w")))
    sums = _at_home(offers).groupBy("community").agg(F.sum("degree").alias("degree"), F.sum("loop").alias("loop"))
    loops = joined.where("src = dst").select(F.col("src").alias("community"), F.col("w").alias("within"))
    nodes = long_join(sums, loops, "community").select(
        F.col("community").alias("node"), F.lit("C").alias("side"), "degree", (F.col("loop") + F.col("within")).alias("loop"))
    return cut_lineage(nodes), joined.where("src <> dst")


def dense_communities(found: DataFrame, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """(ticket_id, community) for every ticket that names an entity; a community is called by its smallest ticket.

    Ticket identifiers come back as text.  An empty table gives no rows.
    """
    nodes, edges = mention_graph(found)
    total = int(nodes.agg(F.sum(_whole(F.col("degree"))).alias("s")).first()["s"] or 0)
    members = nodes.where("side = 'T'").select(F.col("name").alias("ticket_id"), F.col("node").alias("label"))
    if total:
        for level in range(levels):
            offers, at = _level(nodes, edges, total, level == 0, rounds)
            if at == 0 and level:
                break
            step = _at_home(offers).select(F.col("node").alias("label"), F.col("community").alias("next"))
            members = cut_lineage(long_join(members, step, "label").select("ticket_id", F.col("next").alias("label")))
            if level + 1 < levels:
                nodes, edges = _contracted(offers)
    names = members.groupBy("label").agg(F.min("ticket_id").alias("community"))
    return long_join(members, names, "label").select("ticket_id", "community")


def modularity(found: DataFrame, communities: DataFrame) -> float:
    """Modularity of (ticket_id, community); an entity counts to the community it weighs most in, ties to the smaller one."""
    nodes, edges = mention_graph(found)
    total = int(nodes.agg(F.sum(_whole(F.col("degree"))).alias("s")).first()["s"] or 0)
    if not total:
        return 0.0
    named = communities.select(F.col("ticket_id").cast("string").alias("name"), "community")
    tickets = nodes.where("side = 'T'").join(named, "name").select("node", "side", "degree", "loop", "community")
    reached = _between(edges.join(nodes.where("side = 'E'").select(F.col("node").alias("src")), "src", "left_semi"), tickets)
    # Communities are numbered by name, so that the smaller one wins a tie by the larger negative number.
    placed = cut_lineage(numbered(reached.select("community").distinct(), ["community"]))
    leading = reached.join(placed, "community").groupBy("src").agg(F.max(F.struct("w", (-F.col("number")).alias("low"))).alias("best"))
    entities = nodes.where("side = 'E'").join(leading, nodes["node"] == leading["src"]).select(
        "node", "side", "degree", "loop", (-F.col("best.low")).alias("community"))
    labels = tickets.join(placed, "community").select("node", "side", "degree", "loop", F.col("number").alias("community")).unionByName(entities)
    return quality(_offers(edges, cut_lineage(labels)), total) / total**2
