"""Knowledge graph of tickets, entities and clusters, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.operators.joins import long_join, salted_join
from caseloom.schemas import EDGE_TYPES
from caseloom.session import cut_lineage

# Component names looked for in ticket text.
COMPONENTS = ["media server", "client", "cloud", "mobile", "storage", "sso"]
# Fixed value: an error code after a word that announces one.
ERROR_CODE = r"(?iU)\b(?:error|err|code)[\s:#-]*(\d{3,5})\b"


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.md5(name), 1, 16))


def ticket_node(ticket_id: Column) -> Column:
    return F.concat(F.lit("Ticket:"), ticket_id.cast("string"))


def cluster_node(cluster_id: Column) -> Column:
    return F.concat(F.lit("IssueCluster:"), cluster_id.cast("string"))


def edge(kind: str, src: Column, dst: Column, weight: Column | None = None, properties: Column | None = None) -> list:
    if kind not in EDGE_TYPES:
        raise ValueError(f"unknown edge type {kind!r}")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return [F.md5(F.concat_ws("|", F.lit(kind), src, dst)).alias("edge_id"), F.lit(kind).alias("edge_type"),
            src.alias("src"), dst.alias("dst"), (weight if weight is not None else F.lit(1.0)).alias("weight"),
            (properties if properties is not None else empty).alias("properties")]


def entities(tickets: DataFrame) -> DataFrame:
    """(ticket_id, node_type, name), one row per ticket and entity, from row-local expressions."""
    text = F.lower(F.concat_ws(" ", "subject", "description"))
    one = lambda kind, name: F.struct(F.lit(kind).alias("node_type"), name.alias("name"))
    parts = [F.array(one("Environment", F.col("platform"))),
             F.array(one("Environment", F.concat(F.lit("version "), F.col("version")))),
             F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(1))),
                         lambda code: one("ErrorSignature", code))]
    for word in COMPONENTS:
        parts.append(F.array(one("Component", F.when(text.rlike(rf"(?U)\b{word}\b"), F.lit(word)))))
    found = F.array_distinct(F.filter(F.concat(*parts), lambda e: e["name"].isNotNull()))
    return tickets.select("ticket_id", F.explode(found).alias("e")).select("ticket_id", "e.node_type", "e.name")


def ticket_nodes(tickets: DataFrame) -> DataFrame:
    return tickets.select(
        ticket_node(F.col("ticket_id")).alias("node_id"), F.lit("Ticket").alias("node_type"),
        F.col("subject").alias("name"), F.create_map(F.lit("status"), F.col("status")).alias("properties"))


def entity_nodes(found: DataFrame) -> DataFrame:
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return found.select("node_type", "name").distinct().select(
        node_id(F.col("node_type"), F.col("name")).alias("node_id"), "node_type", "name", empty.alias("properties"))


def nodes(tickets: DataFrame, found: DataFrame) -> DataFrame:
    return ticket_nodes(tickets).unionByName(entity_nodes(found))


def mentions(found: DataFrame) -> DataFrame:
    return found.select(*edge("mentions", ticket_node(F.col("ticket_id")), node_id(F.col("node_type"), F.col("name"))))


def belongs_to(assignments: DataFrame) -> DataFrame:
    confidence = F.create_map(F.lit("confidence"), F.col("confidence").cast("string"))
    return assignments.where(F.col("cluster_id") >= 0).select(*edge(
        "belongs_to", ticket_node(F.col("ticket_id")), cluster_node(F.col("cluster_id")), properties=confidence))


def duplicate_of(duplicates: DataFrame) -> DataFrame:
    score = F.create_map(F.lit("similarity_score"), F.col("score").cast("string"))
    return duplicates.select(*edge("duplicate_of", ticket_node(F.col("id")), ticket_node(F.col("duplicate_of")),
                                   properties=score))


def cluster_edges(found: DataFrame, assignments: DataFrame, kind: str, node_types: list, min_share: float) -> DataFrame:
    """Cluster to entity edges for entities named by at least ``min_share`` of the cluster's tickets.

    Counts are made per (cluster, entity) before anything is compared with the
    cluster size, so the second join sees one row per pair.
    """
    members = assignments.where(F.col("cluster_id") >= 0).select("ticket_id", "cluster_id")
    named = long_join(found.where(F.col("node_type").isin(node_types)), members, "ticket_id")
    counts = named.groupBy("cluster_id", "node_type", "name").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    share = F.col("n") / F.col("size")
    return counts.join(sizes, "cluster_id").where(share >= min_share).select(*edge(
        kind, cluster_node(F.col("cluster_id")), node_id(F.col("node_type"), F.col("name")), weight=share))


def caused_by(found: DataFrame, assignments: DataFrame, min_share: float = 0.2) -> DataFrame:
    return cluster_edges(found, assignments, "caused_by", ["Component", "Feature"], min_share)


def mitigated_by(fixes: DataFrame, assignments: DataFrame, min_share: float = 0.2) -> DataFrame:
    """``fixes`` holds (ticket_id, node_type='Fix', name)."""
    return cluster_edges(fixes, assignments, "mitigated_by", ["Fix"], min_share)


def edge_weights(found: DataFrame) -> DataFrame:
    """How many tickets name each entity."""
    return found.groupBy("node_type", "name").agg(F.count(F.lit(1)).alias("n_tickets"))


def shared_entities(found: DataFrame) -> DataFrame:
    """Per ticket: its entities and how many other tickets it meets through them.

    The links are counted from the entity frequencies, so no pair of tickets is
    ever formed.
    """
    counted = salted_join(found, edge_weights(found), ["node_type", "name"], "ticket_id")
    return counted.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum(F.col("n_tickets") - 1).alias("n_links"),
        F.min("n_tickets").alias("rarest"))


def communities(found: DataFrame, rounds: int = 5) -> DataFrame:
    """(ticket_id, community): labels spread between tickets and their entities for a fixed number of rounds.

    A ticket starts with its own id as label.  In each round an entity takes the most
    frequent label among its tickets, then a ticket takes the label with the largest
    sum of 1/n over its entities, n being the number of tickets that name the entity;
    ties go to the smaller label.  Every entity counts, a frequent one little; work
    per round grows with the mentions, and no pair of tickets is formed.
    """
    pairs = found.select("ticket_id", F.concat_ws(":", "node_type", "name").alias("entity")).distinct()
    sizes = pairs.groupBy("entity").agg((1.0 / F.count(F.lit(1))).alias("share"))
    pairs = cut_lineage(salted_join(pairs, sizes, "entity", "ticket_id"))
    labels = pairs.select("ticket_id", F.col("ticket_id").alias("community")).distinct()
    for _ in range(rounds):
        counts = long_join(pairs, labels, "ticket_id").groupBy("entity", "community").agg(F.count(F.lit(1)).alias("n"))
        leading = counts.groupBy("entity").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("first")).select(
            "entity", F.col("first.community").alias("community"))
        votes = salted_join(pairs, leading, "entity", "ticket_id").groupBy("ticket_id", "community").agg(
            F.round(F.sum("share"), 9).alias("weight"))
        labels = cut_lineage(votes.groupBy("ticket_id").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "community")).alias("first"))
                             .select("ticket_id", F.col("first.community").alias("community")))
    return labels


def stabilize(assignments: DataFrame, community: DataFrame) -> DataFrame:
    """Give noise rows the most frequent cluster of their community."""
    joined = long_join(assignments, community, "ticket_id", "left")
    counts = joined.where((F.col("cluster_id") >= 0) & F.col("community").isNotNull()).groupBy(
        "community", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    leading = counts.groupBy("community").agg(
        F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("leading"))
    fused = salted_join(joined, leading, "community", "ticket_id", "left")
    return fused.select("ticket_id", F.when((F.col("cluster_id") < 0) & F.col("leading").isNotNull(), F.col("leading"))
                        .otherwise(F.col("cluster_id")).alias("cluster_id"))


def tickets_for_node(tickets: DataFrame, edges: DataFrame, node: Column) -> DataFrame:
    """Tickets with an edge to the selected node."""
    picked = edges.where(F.col("dst") == node).select("src")
    return tickets.join(picked.hint("merge"), ticket_node(tickets["ticket_id"]) == picked["src"], "left_semi")
