"""Repair of conversation structure: the cheapest edits that make the roles follow (system?) (user assistant)+.

The edits of a conversation are a path through a lattice of (turns read, state of the roles so far).  Two Dijkstra
searches, from its start and from its end, meet in the middle and go on until every crossing of the least cost is found;
a walk over what they reached then takes the least letter at every node, which gives the least concatenated audit.

Letters are K(eep), R(erole), D(elete) and I(nsert).  A long conversation is cut into blocks of turns.  A block is searched
for every pair of states at its ends, blocks meet as edges of a lattice of the same kind, and the pairs chosen there say
which path of each block counts.  So no task holds more than one block of turns or one group of blocks.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.operators.components import numbered
from caseloom.session import cut_lineage

#: A block of turns is what shares all but so many bits of the turn's number; so many blocks make a block of blocks.
BLOCK_BITS = 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing so far, after the system's turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: A turn's code: initial of the role (other: o), upper case if truncated, a digit if it has to go.
CODES = "suaoSUAO0123"
_SPACE = " \t\n\x0b\x0c\r"
_END = {EMPTY: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _turn_edges(code: str) -> list[list[tuple]]:
    """By state: (letter, turns read, next state, cost) of the edits of one turn."""
    kind, fault = CODES.index(code) % 4, CODES.index(code) // 4
    edges = []
    for state in range(4):
        own = [("D", 1, state, DELETE)]
        if fault < 2:
            after = _NEXT[state]
            if kind == 0 and state == EMPTY:
                own.append(("K", 1, SYSTEM, KEEP + TRUNCATED * fault))
            elif kind == after - 1:
                own.append(("K", 1, after, KEEP + TRUNCATED * fault))
            own.append(("R", 1, after, REROLE + TRUNCATED * fault))
        edges.append(own)
    return edges


_TURN_EDGES = {code: _turn_edges(code) for code in CODES}
_INSERTS = [("I", 0, _NEXT[state], INSERT) for state in range(4)]


class Lattice:
    """Edges by place and state; an edge is (letter, places ahead, next state, cost).  Letters of a node differ."""

    def __init__(self, edges: list[list[list[tuple]]]):
        self.edges = edges
        self.back: list[list[list[tuple]]] = [[[] for _ in range(4)] for _ in edges]
        for place, states in enumerate(edges):
            for state, own in enumerate(states):
                for letter, ahead, after, cost in own:
                    self.back[place + ahead][after].append((place, state, cost))

    @classmethod
    def of_turns(cls, codes: str, tail: bool) -> Lattice:
        """The edits of a block of turns; behind the last turn, insertions belong to the next block unless ``tail``."""
        edges = [[[*own, _INSERTS[state]] for state, own in enumerate(_TURN_EDGES[code])] for code in codes]
        return cls([*edges, [[insert] if tail else [] for insert in _INSERTS]])

    @classmethod
    def of_blocks(cls, blocks: list[dict]) -> Lattice:
        """Blocks as edges: {(state before, state after): (cost, rank of the audit)}."""
        edges = [[[(rank, 1, after, cost) for (before, after), (cost, rank) in block.items() if before == state] for state in range(4)]
                 for block in blocks]
        return cls([*edges, [[] for _ in range(4)]])

    def least(self, start: int, goals: tuple) -> tuple[int, list, list[int]] | None:
        """(cost, letters, states passed) of the cheapest path, ties by the least letters; None without a path."""
        last = len(self.edges) - 1
        ahead, behind = {(0, start): 0}, {(last, goal): 0 for goal in goals}
        sides = ([(0, 0, start)], [(0, last, goal) for goal in goals])
        known: tuple[set, set] = (set(), set())
        best = min((0 for goal in goals if (last, goal) == (0, start)), default=None)
        while sides[0] and sides[1] and (best is None or sides[0][0][0] + sides[1][0][0] <= best):
            side = 0 if sides[0][0][0] <= sides[1][0][0] else 1
            cost, place, state = heappop(sides[side])
            if (place, state) in known[side]:
                continue
            known[side].add((place, state))
            own, other = (ahead, behind) if side == 0 else (behind, ahead)
            if side == 0:
                steps = [(place + far, after, price) for _, far, after, price in self.edges[place][state]]
            else:
                steps = self.back[place][state]
            for to, after, price in steps:
                node, total = (to, after), cost + price
                if total < own.get(node, total + 1):
                    own[node] = total
                    heappush(sides[side], (total, to, after))
                if node in other and (best is None or total + other[node] < best):
                    best = total + other[node]
        if best is None:
            return None
        known[0].add((0, start))
        known[1].update((last, goal) for goal in goals)
        return (best, *self._walk(start, best, ahead, behind, known))

    def _walk(self, start: int, best: int, ahead: dict, behind: dict, known: tuple) -> tuple[list, list[int]]:
        """The least letters over all paths of cost ``best`` that cross from what the one search settled to the other."""
        reached, settled = known
        on_path = set()
        open_ = [node for node in reached if node in settled and ahead[node] + behind[node] == best]
        for place, state in reached:
            for _, far, after, price in self.edges[place][state]:
                if (place + far, after) in settled and ahead[place, state] + price + behind[place + far, after] == best:
                    open_.append((place, state))
        while open_:
            node = open_.pop()
            if node not in on_path:
                on_path.add(node)
                open_ += [(p, s) for p, s, price in self.back[node[0]][node[1]] if (p, s) in reached and ahead[p, s] + price == ahead[node]]
        place, state, spent = 0, start, 0
        letters, states = [], [start]
        last = len(self.edges) - 1
        while place < last or spent < best:
            for letter, far, after, price in sorted(self.edges[place][state]):
                node = (place + far, after)
                if (node in settled and spent + price + behind[node] == best) or (node in on_path and spent + price == ahead[node]):
                    break
            else:
                raise AssertionError("a path of least cost is lost")
            letters.append(letter)
            states.append(after)
            place, state, spent = *node, spent + price
        return letters, states


def block_entries(lattice: Lattice) -> list[tuple]:
    """(before, after, cost, rank, states passed) for every pair of states; ranks order the different audits."""
    found = {}
    for before in range(4):
        for after in range(4):
            way = lattice.least(before, (after,))
            if way is not None:
                found[before, after] = way
    order = {audit: k for k, audit in enumerate(sorted({tuple(letters) for _, letters, _ in found.values()}))}
    return [(b, a, cost, order[tuple(letters)], "".join(map(str, states))) for (b, a), (cost, letters, states) in found.items()]


def written_edits(codes: str, audit: str, state: int) -> list[dict]:
    """The edits of a block in order: turn it concerns, turn within the block, letter, and the role given."""
    edits, at, turn = [], 0, 0
    for letter in audit:
        role = None
        if letter in "IR":
            role = "user" if _NEXT[state] == USER else "assistant"
        if letter == "K" and codes[turn] in "sS":
            state = SYSTEM
        elif letter != "D":
            state = _NEXT[state]
        edits.append({"turn": min(turn, len(codes) - 1), "seq": at, "edit": letter, "role": role})
        at += 1
        turn += letter != "I"
    return edits


def damage(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after planted faults, by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.  A null role or
    text reads as one space, and so does a null identifier or turn in the checksum.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_column), F.lit(":"), space(turn_column)).cast("binary")) % 20
    rows = conversations.select(F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), space(role_column).alias("role"),
                                space(text_column).alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key(identifier: Column) -> Column:
    """An identifier as a key without nulls."""
    return F.concat(F.when(identifier.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(identifier.cast("string"), F.lit("")))


def marked_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, conv, turn, role, text, number, fault, code): turns in order with their first fault, stored.

    Numbers count the turns of all conversations, each conversation by turn, nulls first, ties by the hash of role and
    text.  Faults: blank, duplicate (same role and text earlier in the conversation), truncated.
    """
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = turns.select("conv_id", _key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text")).withColumn("mark", mark)
    stored = numbered(rows, [F.asc("conv"), F.col("turn").asc_nulls_first(), F.asc("mark")])
    trimmed = F.rtrim("text", F.lit(_SPACE))
    blank = F.length(trimmed) == 0
    firsts = stored.where(~blank).groupBy("conv", "mark").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    fault = (F.when(blank, F.lit("blank")).when(F.col("first").isNull(), F.lit("duplicate"))
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), F.lit("truncated")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", F.lit(1)).when(initial == "u", F.lit(2)).when(initial == "a", F.lit(3)).otherwise(F.lit(4))
    group = F.when(F.col("fault").isNull(), F.lit(0)).when(F.col("fault") == "truncated", F.lit(4)).otherwise(F.lit(8))
    return cut_lineage(stored.drop("mark").join(firsts, "number", "left").withColumn("fault", fault).drop("first").withColumn(
        "code", F.substring(F.lit(CODES), group + kind, F.lit(1))))


def _blocks(marked: DataFrame, bits: int) -> DataFrame:
    """(conv, block, start, codes): the codes of the turns of each conversation's blocks."""
    block = F.shiftright("number", bits)
    listed = F.array_sort(F.collect_list(F.struct("number", "code")))
    return marked.groupBy("conv", block.alias("block")).agg(listed.alias("turns")).select(
        "conv", "block", F.col("turns")[0]["number"].alias("start"), F.array_join(F.col("turns.code"), "").alias("codes"))


_ENTRIES = "array<struct<before: int, after: int, cost: long, rank: int, states: string>>"
_ENTRY = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("states", pa.string())]))


def _entry_array(found: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("before", "after", "cost", "rank", "states"), e)) for e in own] for own in found], _ENTRY)


def _entered(blocks: DataFrame) -> DataFrame:
    """Blocks of turns with the least path of every pair of states."""
    def run(batches):
        for batch in batches:
            # What a path passes inside a block of turns is found again from its letters.
            found = [[(*e[:4], "") for e in block_entries(Lattice.of_turns(codes, False))] for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv", "block", "start")] + [_entry_array(found)],
                                             names=["conv", "block", "start", "entries"])

    return blocks.select("conv", "block", "start", "codes").mapInArrow(run, f"conv string, block long, start long, entries {_ENTRIES}")


def _ordered_blocks(children) -> tuple[list[int], Lattice]:
    children = sorted(children, key=lambda c: c["start"])
    edges = [{(e["before"], e["after"]): (e["cost"], e["rank"]) for e in c["entries"]} for c in children]
    return [c["start"] for c in children], Lattice.of_blocks(edges)


def _joined(level: DataFrame, bits: int) -> DataFrame:
    """Blocks of blocks: (conv, block, start, children, entries)."""
    listed = level.groupBy("conv", F.shiftright("block", bits).alias("block")).agg(
        F.min("start").alias("start"), F.collect_list(F.struct("start", "entries")).alias("children"))

    def run(batches):
        for batch in batches:
            both = [_ordered_blocks(own) for own in batch.column("children").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv", "block", "start")], pa.array([s for s, _ in both], pa.list_(pa.int64())),
                 _entry_array([block_entries(lattice) for _, lattice in both])], names=["conv", "block", "start", "children", "entries"])

    return cut_lineage(listed.mapInArrow(run, f"conv string, block long, start long, children array<long>, entries {_ENTRIES}"))


def _topped(level: DataFrame) -> DataFrame:
    """(start, before, after, last) of the blocks that a whole conversation's cheapest path passes; few blocks each."""
    listed = level.groupBy("conv").agg(F.collect_list(F.struct("start", "entries")).alias("children"))
    place = pa.list_(pa.struct([("start", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))

    def run(batches):
        for batch in batches:
            out = []
            for own in batch.column("children").to_pylist():
                starts, lattice = _ordered_blocks(own)
                ways = [(w[0] + price, tuple(w[1]), w[2]) for goal, (price, _) in _END.items() if (w := lattice.least(EMPTY, (goal,)))]
                _, _, states = min(ways)
                out.append([{"start": s, "before": states[k], "after": states[k + 1], "last": k == len(starts) - 1} for k, s in enumerate(starts)])
            yield pa.RecordBatch.from_arrays([pa.array(out, place)], names=["chosen"])

    chosen = listed.mapInArrow(run, "chosen array<struct<start: long, before: int, after: int, last: boolean>>")
    return chosen.select(F.inline("chosen"))


def _chosen_states(blocks: DataFrame, bits: int) -> DataFrame | None:
    """(start, before, after, last) of the blocks of turns of conversations with several; None where there are none."""
    mask = (1 << bits) - 1
    # A conversation with several blocks touches a border of each.
    edge = (F.col("start").bitwiseAND(F.lit(mask)) == 0) | ((F.col("start") + F.length("codes")).bitwiseAND(F.lit(mask)) == 0)
    several = blocks.where(edge).groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    several = cut_lineage(several)
    most = several.agg(F.max("n").alias("n")).first()["n"]
    if most is None:
        return None
    level = cut_lineage(_entered(blocks.where(edge).join(several.select("conv"), "conv", "left_semi")))
    above = []
    while most > 1 << bits:
        level = _joined(level, bits)
        above.append(level)
        most = level.groupBy("conv").count().agg(F.max("count").alias("n")).first()["n"]
    chosen = _topped(level)
    for level in reversed(above):
        pair = F.filter("entries", lambda e: (e["before"] == F.col("before")) & (e["after"] == F.col("after")))[0]["states"]
        states = chosen.join(level.select("start", "children", "entries"), "start").select("children", "last", pair.alias("states"))
        child = states.select("states", F.col("last").alias("whole"), F.size("children").alias("n"), F.posexplode("children").alias("k", "start"))
        digit = lambda k: F.substring("states", k, F.lit(1)).cast("int")
        chosen = child.select("start", digit(F.col("k") + 1).alias("before"), digit(F.col("k") + 2).alias("after"),
                              (F.col("whole") & (F.col("k") == F.col("n") - 1)).alias("last"))
    return cut_lineage(chosen)


def cheapest_edits(marked: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv, start, codes, cost, audit, edits): the edits of every block of turns, stored.

    ``edits`` are, in order, the number of the turn they concern (an insertion: the turn before which it stands, or the
    last one), their place in the block, the letter and the role that is given.
    """
    blocks = cut_lineage(_blocks(marked, bits))
    chosen = _chosen_states(blocks, bits)
    if chosen is None:
        rows = blocks.select("conv", "start", "codes", F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"), F.lit(True).alias("last"))
    else:
        rows = blocks.join(chosen, "start", "left").select("conv", "start", "codes", "before", "after", "last")
    place = pa.list_(pa.struct([("turn", pa.int64()), ("seq", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))

    def run(batches):
        for batch in batches:
            out = []
            for codes, start, before, after, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "start", "before", "after", "last")]):
                if before is None:
                    cost, letters, _ = Lattice.of_turns(codes, True).least(EMPTY, (EMPTY, ASSISTANT))
                    audit = "".join(letters)
                else:
                    cost, letters, _ = Lattice.of_turns(codes, False).least(before, (after,))
                    price, end = _END[after] if last else (0, "")
                    cost, audit = cost + price, "".join(letters) + end
                out.append((cost, audit, [{**e, "turn": e["turn"] + start} for e in written_edits(codes, audit, before or EMPTY)]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv", "start", "codes")], pa.array([c for c, _, _ in out], pa.int64()),
                 pa.array([a for _, a, _ in out], pa.string()), pa.array([e for _, _, e in out], place)],
                names=["conv", "start", "codes", "cost", "audit", "edits"])

    return cut_lineage(rows.mapInArrow(
        run, "conv string, start long, codes string, cost long, audit string, edits array<struct<turn: long, seq: int, edit: string, role: string>>"))


def repaired_turns(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, conv, turn, number, seq, edit, role, text): the turns that remain, in the order of number and seq.

    An inserted turn has an empty text and no turn of its own.
    """
    steps = edits.select("conv", F.explode("edits").alias("e")).where(F.col("e.edit") != "D").select(
        F.col("conv").alias("__conv"), F.col("e.turn").alias("number"), F.col("e.seq").alias("seq"), F.col("e.edit").alias("edit"), F.col("e.role").alias("given"))
    own = steps.join(marked.select("number", "conv_id", "turn", "role", "text"), "number")
    inserted = F.col("edit") == "I"
    return own.select("conv_id", F.col("__conv").alias("conv"), F.when(~inserted, F.col("turn")).alias("turn"), "number", "seq", "edit",
                      F.coalesce("given", "role").alias("role"), F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the ``role:text`` lines of each conversation.

    A digest is made in order, so the lines of a conversation pass one task, batch by batch; none keeps them.
    """
    lines = turns.select("conv", "number", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_ = lines.repartition("conv").sortWithinPartitions("conv", "number", "seq").select("conv", "line")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
                if conv == now:
                    digest.update(b"\n")
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["conv", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])

    return sorted_.mapInArrow(run, "conv string, sha256 string")


def _illegal(edits: DataFrame) -> DataFrame:
    """(conv, illegal): neighbouring turns whose roles may not follow each other, inside blocks and across them."""
    kind = F.translate(F.lower("codes"), "0123", "suao")
    before = Window.partitionBy("conv").orderBy("start")
    border = F.lag(F.substring(kind, -1, 1)).over(before)
    known = edits.select("conv", F.concat(F.coalesce(border, F.lit("")), kind).alias("kinds"))
    # Every legal pair is counted by the places of its second letter; pairs overlap, so each kind is counted by itself.
    legal = sum((F.length("kinds") - F.length(F.replace(F.col("kinds"), F.lit(pair), F.lit(pair[0])))) for pair in ("su", "ua", "au"))
    return known.groupBy("conv").agg(F.sum(F.greatest(F.length("kinds") - 1, F.lit(0)) - legal).alias("illegal"))


def repair(turns: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(turns, report): the repaired turns, and one row of facts per conversation with a turn.

    Takes (conv_id, turn, role, text).  The report has gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.  Cases: a null role or text reads as one space, so such a turn is blank or of another role; null
    turns come first and count for no gap; turns of equal number go by the hash of role and text; rows that repeat are
    duplicates; turns without identifier are one conversation; an empty table gives no rows; other columns are ignored.
    """
    marked = marked_turns(turns)
    edits = cheapest_edits(marked, bits)
    after = repaired_turns(marked, edits)
    counts = marked.groupBy("conv").agg(
        F.any_value("conv_id").alias("conv_id"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    spans = marked.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    parts = F.array_sort(F.collect_list(F.struct("start", "audit")))
    plans = edits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    digests = conversation_digests(after)
    every = counts
    for more in (spans, _illegal(edits), plans, digests):
        every = every.join(more, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return after, every.select("conv_id", zero("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                               F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                   text_column: str = "text", bits: int = BLOCK_BITS) -> DataFrame:
    """The report of ``repair`` over damaged rows for every original conversation; one that lost all rows has zeros."""
    _, report = repair(damage(conversations, id_column, turn_column, role_column, text_column), bits)
    original = conversations.select(F.col(id_column).alias("conv_id")).distinct().withColumn("conv", _key(F.col("conv_id")))
    facts = report.withColumn("conv", _key(F.col("conv_id"))).drop("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return original.join(facts, "conv", "left").select(
        F.col("conv_id").alias(id_column), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
