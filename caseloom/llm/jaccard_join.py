"""Similarity join on word shingles: prefix filters under several global token orders, then exact verification.

Two sets with a Jaccard similarity of at least t share one of their first ``n - ceil(t * n) + 1`` tokens under any
order of all tokens.  The first order puts frequent tokens last and goes by fingerprint otherwise; candidates come from
its prefixes.  They must also share prefix tokens under further, unrelated orders: those prefixes travel as narrow rows,
and only candidates that pass the filter of every order are verified on whole texts.

Only the components of the links are asked for, so pairs already connected need no look: each set is first compared
with one hub of its prefix lists, and afterwards only sets that are still in different components meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import textscan
from caseloom.llm.passing import marked, neighbours, only, settle, table_of
from caseloom.llm.tasks import bytes_of, pieces, texts_of, trimmed
from caseloom.operators.components import components
from caseloom.session import cut_lineage

#: A token counted more often than this is frequent: it goes to the end of the first order.
FREQUENT = 64
#: Bytes of an Arrow batch: sets and pairs take several times as much as their texts.
BATCH_BYTES = 4 << 20
#: Slots of a sketch.
SLOTS = 256
#: Further orders, by seed.
ORDERS = (11, 12)
_POSTINGS = "mark long, settled boolean, id long, n int, pos int, token long"


class Threshold:
    """A similarity of at least ``percent`` hundredths, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def holds(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def needed(self, sizes):
        """The least overlap for two sets of together ``sizes`` tokens (a column)."""
        return F.ceil(sizes * self.percent / F.lit(100 + self.percent) - F.lit(1e-9))


def shingle_sets(texts: pa.Array, length: int):
    """The set of each text as sorted distinct fingerprints of ``length`` lower-cased words (A-Z only).

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    data, bounds = bytes_of(texts)
    for first, last in pieces(bounds, textscan.SLICE_BYTES):
        part, own = data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        starts, ends, index = textscan.word_spans(part, own)
        words = textscan.word_values(part, starts, ends, lower=True)[0]
        counts = np.diff(index)
        at = np.arange(len(words))
        stop = np.repeat(index[1:], counts)
        short = np.repeat(counts < length, counts)
        wanted = (at + length <= stop) | (short & (at == np.repeat(index[:-1], counts)))
        at = at[wanted]
        marks = textscan.family(6).spans(words, at, np.minimum(at + length, stop[wanted]))
        text = np.repeat(np.arange(len(counts)), counts)[wanted]
        order = np.lexsort((marks, text))
        marks, text = marks[order], text[order]
        fresh = np.ones(len(marks), bool)
        fresh[1:] = (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])
        marks, text = marks[fresh], text[fresh]
        edges = np.searchsorted(text, np.arange(len(counts) + 1))
        for i in range(len(counts)):
            yield marks[edges[i]:edges[i + 1]]


def _folds(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for own in shingle_sets(texts_of(batch.column("text")), length):
                    one = textscan.mix(own ^ np.uint64(0x1234567)).sum(dtype=np.uint64).astype(np.int64)
                    two = textscan.mix(own + np.uint64(0x7654321)).sum(dtype=np.uint64).astype(np.int64)
                    rows.append((len(own), int(one), int(two)))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=["id", "n", "one", "two"])

    return run


def _counted(threshold: Threshold, length: int, least: int, table):
    """Local counts of tokens: of a prefix and a half, or of whole sets where frequent tokens fill that."""

    def run(batches):
        known = None if table is None else np.frombuffer(table.value, np.uint8)
        for batch in batches:
            held = []
            for own in shingle_sets(texts_of(batch.column("text")), length):
                if len(own) < least:
                    continue
                prefix = threshold.prefix(len(own))
                first = own[:_looked_at(prefix)]
                if known is None:
                    held.append(first)
                elif (~marked(known, first)).sum() < prefix:
                    held.append(own)
            if held:
                marks, counts = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(counts)], names=["mark", "n"])

    return run


def _looked_at(prefix: int) -> int:
    return prefix + prefix // 2 + 4


def _frequent_tokens(counts: DataFrame) -> DataFrame:
    return counts.groupBy("mark").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)


def _prefixes(threshold: Threshold, length: int, least: int, table):
    def run(batches):
        known = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            marks, owner, sizes, places = [], [], [], []
            for i, own in enumerate(shingle_sets(texts_of(batch.column("text")), length)):
                if len(own) < least:
                    continue
                prefix = threshold.prefix(len(own))
                frequent = marked(known, own)
                own = np.concatenate([own[~frequent], own[frequent]])[:prefix] if frequent.any() else own[:prefix]
                marks.append(own)
                owner.append(np.full(prefix, ids[i], np.int64))
                sizes.append(np.full(prefix, len(frequent), np.int32))
                places.append(np.arange(prefix, dtype=np.int32))
            if marks:
                marks = np.concatenate(marks)
                yield settle(_POSTINGS, marks, np.concatenate(owner),
                             [np.concatenate(sizes), np.concatenate(places), marks.view(np.int64)])

    return run


def _shared(batches):
    """Postings of tokens that several sets have in their prefixes."""
    for rows, twin in neighbours(batches, ["mark"], "pos"):
        wanted = (twin | rows.column("settled").to_numpy()) & (rows.column("pos").to_numpy() >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows.column(n).to_numpy()[wanted]) for n in ("token", "id", "n", "pos")],
                                         names=["token", "id", "n", "pos"])


def _verified(threshold: Threshold, length: int):
    def run(batches):
        last, held = None, None
        for batch in batches:
            ids = [batch.column(n).to_pylist() for n in ("src", "dst")]
            found = []
            for first in range(0, len(ids[0]), 64):
                some = slice(first, first + 64)
                texts = [texts_of(batch.column(n).slice(first, 64)) for n in ("src_text", "dst_text")]
                own = list(shingle_sets(texts[0], length))
                others = texts[1].to_pylist()
                for src, dst, mine, text in zip(ids[0][some], ids[1][some], own, others):
                    if text is not last and text != last:
                        last, held = text, next(iter(shingle_sets(pa.array([text], pa.large_string()), length)))
                    if threshold.holds(len(np.intersect1d(mine, held, assume_unique=True)), len(mine), len(held)):
                        found.append((src, dst))
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["src", "dst"])

    return run


def _prefix(threshold: Threshold, own: np.ndarray, seed: int) -> np.ndarray:
    """The first tokens of a set under the order of ``seed``, as sorted 4-byte values; equal values of unlike tokens only let more pass."""
    rank = textscan.mix(own ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    size = threshold.prefix(len(own))
    first = rank if size >= len(rank) else np.partition(rank, size - 1)[:size]
    return np.sort(first.astype(np.uint32))


def _digests(threshold: Threshold, length: int):
    """What further filters know of each set: its prefix under every further order, end to end, and a sketch of the whole.

    The sketch counts how many tokens fall into each of ``SLOTS`` slots, as 2-byte numbers.
    """

    def run(batches):
        for batch in batches:
            sizes, prefixes, sketches = [], [], []
            for own in shingle_sets(texts_of(batch.column("text")), length):
                sizes.append(len(own))
                parts = [_prefix(threshold, own, seed) for seed in ORDERS] if len(own) else []
                prefixes.append(b"".join(part.astype("<u4").tobytes() for part in parts))
                sketches.append(np.bincount((textscan.mix(own) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).clip(0, 65535).astype("<u2").tobytes())
            digests = pa.StructArray.from_arrays([pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())], names=["prefixes", "sketch"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), digests], names=["id", "digest"])

    return run


def _meet(a: bytes, b: bytes) -> bool:
    """Whether two sets share a prefix token under each of the further orders."""
    if not a or not b:
        return False
    ones, twos = np.frombuffer(a, "<u4").reshape(len(ORDERS), -1), np.frombuffer(b, "<u4").reshape(len(ORDERS), -1)
    for one, two in zip(ones, twos):
        at = np.searchsorted(two, one)
        if not (two[np.minimum(at, len(two) - 1)] == one).any():
            return False
    return True


def _may_link(threshold: Threshold):
    """Candidates that meet under every order and whose sketches leave room for enough overlap.

    The orders are intersected first.  Two sets share at most the smaller count of each slot of a sketch.
    """

    def run(batches):
        for batch in batches:
            ends = [batch.column(n) for n in ("src_digest", "dst_digest")]
            pairs = zip(*[end.field("prefixes").to_pylist() for end in ends])
            kept = np.flatnonzero(np.fromiter((_meet(*pair) for pair in pairs), bool, len(batch)))
            if not len(kept):
                continue
            a, b = (np.frombuffer(b"".join(end.field("sketch").take(pa.array(kept)).to_pylist()), "<u2").reshape(-1, SLOTS) for end in ends)
            common = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            sizes = a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
            full = (a == 65535).any(axis=1) | (b == 65535).any(axis=1)
            room = full | (100 * common >= threshold.percent * (sizes - common))
            yield batch.select(["src", "dst"]).take(pa.array(kept[room]))

    return run


def _with_ends(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    ends = [rows.select(F.col("id").alias(name), F.col(column).alias(f"{name}_{column}")) for name in ("src", "dst")]
    joined = pairs.select("src", "dst").join(ends[0], "src").join(ends[1], "dst")
    return joined.select("src", "dst", f"src_{column}", f"dst_{column}")


def _links(pairs: DataFrame, texts: DataFrame, threshold: Threshold, length: int) -> DataFrame:
    """The pairs (src, dst) that are similar enough; dst is the end that many pairs share.

    Candidates share prefix tokens under the first order.  Narrow rows come next: prefixes under the further orders, which
    are intersected, and a sketch of half a kilobyte.  They leave few pairs for whole texts.  A table of the wanted
    identifiers, 2 MB whatever their number, spares most texts the shuffle.
    """

    def ids(frame: DataFrame) -> DataFrame:
        return frame.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    digests = only(texts, "id", ids(pairs), "id").mapInArrow(
        trimmed(_digests(threshold, length)), "id long, digest struct<prefixes: binary, sketch: binary>")
    left = cut_lineage(_with_ends(pairs, digests, "digest").mapInArrow(trimmed(_may_link(threshold)), "src long, dst long").distinct())
    wanted = only(texts, "id", ids(left), "id")
    return cut_lineage(_with_ends(left, wanted, "text").mapInArrow(trimmed(_verified(threshold, length)), "src long, dst long").distinct())


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _possible(threshold: Threshold):
    """Whether sizes and the places of a common prefix token leave room for enough overlap (columns a_, b_)."""
    room = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    return room >= threshold.needed(F.col("a_n") + F.col("b_n"))


def shingle_components(documents: DataFrame, percent: int = 90, length: int = 3, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): each row's set size and the smallest identifier reachable by links.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``length``-word shingles (A-Z lower-
    cased; fewer words are one shingle).  Rows without a word, and rows with a null identifier, link with nothing and
    are components of their own (null for a null identifier).  Rows that repeat an identifier are one node.  Equal sets
    are folded onto their smallest identifier first.  An empty table gives no rows; other columns are ignored.

    No list of a token is capped.  Lists of frequent tokens are never gathered: rows of one token that a task sees
    twice are settled there, hubs come from partial minima, and sets of one list meet only while their components
    differ, by classes of equal size, place and component.
    """
    spark = documents.sparkSession
    threshold = Threshold(percent)
    # Below this size no other set is similar enough: one token more already lowers the share too far.
    least = next(n for n in range(1, 10_000) if threshold.holds(n, n, n + 1)) if percent < 100 else 10_000_000
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    folded = cut_lineage(rows.mapInArrow(trimmed(_folds(length)), "id long, n long, one long, two long"))
    sets = folded.where("n > 0 AND id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("id").alias("rep"))
    named = rows.where("id IS NOT NULL")

    counts = "mark long, n long"
    table = table_of(_frequent_tokens(named.mapInArrow(trimmed(_counted(threshold, length, least, None)), counts)))
    sent = spark.sparkContext.broadcast(table)
    table = table_of(_frequent_tokens(named.mapInArrow(trimmed(_counted(threshold, length, least, sent)), counts)), table)
    sent = spark.sparkContext.broadcast(table)

    reps = cut_lineage(sets.select("rep").distinct())
    postings = named.mapInArrow(trimmed(_prefixes(threshold, length, least, sent)), _POSTINGS)
    shared = postings.repartition("mark").sortWithinPartitions("mark").mapInArrow(trimmed(_shared), "token long, id long, n int, pos int")
    shared = cut_lineage(shared.join(reps, shared["id"] == reps["rep"], "left_semi"))

    hubs = shared.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    hubs = hubs.select("token", F.col("hub.pos").alias("b_pos"), F.col("hub.n").alias("b_n"), F.col("hub.id").alias("dst"))
    near = shared.select("token", F.col("pos").alias("a_pos"), F.col("n").alias("a_n"), F.col("id").alias("src")).join(hubs, "token")
    near = near.where((F.col("src") != F.col("dst")) & _possible(threshold)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("many"))
    first = cut_lineage(near.groupBy("src").agg(F.max(F.struct("many", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst")))
    # An identifier that names several sets joins their groups.
    several = folded.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("one").alias("low"), F.max("one").alias("high")).where("low <> high")
    joints = folded.join(several.select("id"), "id", "left_semi").join(sets, ["n", "one", "two"]).where("id <> rep").select(
        F.col("id").alias("src"), F.col("rep").alias("dst"))
    links = cut_lineage(_links(first, named, threshold, length).unionByName(joints))

    labels = components(_ends(links), links)
    placed = shared.join(labels, shared["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    mixed = placed.groupBy("token").agg(F.min("component").alias("__low"), F.max("component").alias("__high")).where("__low <> __high").select("token")
    placed = cut_lineage(placed.join(mixed, "token", "left_semi"))
    classes = placed.select("token", "n", "pos", "component").distinct()
    sides = [classes.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "pos", "component")]) for side in ("a", "b")]
    meeting = sides[0].join(sides[1], "token").where((F.col("a_component") < F.col("b_component")) & _possible(threshold))
    members = [placed.select("token", F.col("id").alias(name), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "pos", "component")])
               for side, name in (("a", "src"), ("b", "dst"))]
    second = meeting.join(members[0], ["token", "a_n", "a_pos", "a_component"]).join(members[1], ["token", "b_n", "b_pos", "b_component"])
    more = _links(cut_lineage(second.select("src", "dst").distinct()), named, threshold, length)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(_ends(links), links)
    joined = folded.join(sets, ["n", "one", "two"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    return joined.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def keep_one(documents: DataFrame, percent: int = 80, length: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest identifier.

    Rows without a word or an identifier are components of their own and stay; rows that repeat the identifier that
    stays do so too.  Other cases as in ``shingle_components``.
    """
    found = shingle_components(documents, percent, length, id_column, text_column)
    goes = cut_lineage(found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__goes")).distinct())
    keyed = documents.withColumn("__id", F.col(id_column).cast("long"))
    known = keyed.where("__id IS NOT NULL")
    # Texts of documents that surely stay need no shuffle.
    stay = [keyed.where("__id IS NULL"), only(known, "__id", goes, "__goes", outside=True),
            only(known, "__id", goes, "__goes").join(goes, F.col("__id") == F.col("__goes"), "left_anti")]
    return stay[0].unionByName(stay[1]).unionByName(stay[2]).select(*[F.col(f"`{c}`") for c in documents.columns])
