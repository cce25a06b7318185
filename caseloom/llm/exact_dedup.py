"""Exact duplicates by compressed radix tries (Patricia tries) that own disjoint sets of texts."""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.llm.tasks import bytes_of, pieces, texts_of, trimmed

#: Bytes a trie may hold before it hands on (map side) or writes out (owner side) what it has.
TRIE_BYTES = 48 << 20
_NODE_BYTES = 250
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GROUPS = "n_bytes long, sha256 string, text binary, keep_id long, group_size long"


class _Node:
    __slots__ = ("label", "children", "end", "spill")

    def __init__(self, label: bytes, end: list | None = None):
        self.label, self.children, self.end, self.spill = label, {}, end, None


class TextTrie:
    """A Patricia trie over byte strings; the terminal node of a string holds its identifier and its count.

    ``better`` picks the identifier that stays out of two.  Beyond ``budget`` bytes the largest subtree's strings go to
    a scratch file; later strings of that subtree are appended to it, and it is worked off at the end by a trie of
    its own.  The file is private to the task and vanishes with it.
    """

    def __init__(self, better, budget: int = TRIE_BYTES):
        self.root, self.size, self.better, self.budget = _Node(b""), 0, better, budget

    def insert(self, text: bytes, identifier, count: int, tag=None) -> None:
        self._place(text, identifier, count, tag)
        if self.size > self.budget:
            self._spill()

    def _place(self, text: bytes, identifier, count: int, tag) -> None:
        node, at = self.root, 0
        while at < len(text):
            if node.spill is not None:
                pickle.dump((text[at:], identifier, count, tag), node.spill)
                return
            child = node.children.get(text[at])
            if child is None:
                child = _Node(text[at:], [identifier, count, tag])
                node.children[text[at]] = child
                self.size += len(child.label) + _NODE_BYTES
                return
            label = child.label
            if text.startswith(label, at):
                at += len(label)
                node = child
                continue
            same = _common(label, text, at)
            fork = _Node(label[:same])
            child.label = label[same:]
            fork.children[child.label[0]] = child
            node.children[text[at]] = fork
            self.size += _NODE_BYTES
            node, at = fork, at + same
        if node.end is None:
            node.end = [identifier, count, tag]
        else:
            node.end[0] = self.better(node.end[0], identifier)
            node.end[1] += count

    def _spill(self) -> None:
        """Write the largest subtree below the first fork to a file."""
        node = self.root
        while len(node.children) == 1 and node.spill is None:
            node = next(iter(node.children.values()))
        choices = [(_held(child), child) for child in node.children.values() if child.spill is None]
        size, chosen = max(choices, key=lambda c: c[0], default=(0, None))
        if chosen is None or not chosen.children:
            return
        chosen.spill = tempfile.TemporaryFile()
        for rest, end in _strings(chosen.children.values()):
            pickle.dump((rest, *end), chosen.spill)
        chosen.children = {}
        self.size -= size

    def terminals(self):
        """(identifier, count, tag) of every distinct string."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.end is not None:
                yield tuple(node.end)
            stack.extend(node.children.values())
            node.children = {}
            if node.spill is not None:
                below = TextTrie(self.better, self.budget)
                node.spill.seek(0)
                while True:
                    try:
                        below.insert(*pickle.load(node.spill))
                    except EOFError:
                        break
                node.spill.close()
                yield from below.terminals()


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of ``label`` equal ``text`` from ``at`` on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _held(node: _Node) -> int:
    size, stack = 0, list(node.children.values())
    while stack:
        one = stack.pop()
        size += len(one.label) + _NODE_BYTES
        if one.spill is None:
            stack.extend(one.children.values())
    return size


def _strings(nodes):
    stack = [(n, b"") for n in nodes]
    while stack:
        node, before = stack.pop()
        own = before + node.label
        if node.end is not None:
            yield own, node.end
        if node.spill is not None:
            node.spill.seek(0)
            while True:
                try:
                    rest, *end = pickle.load(node.spill)
                except EOFError:
                    break
                yield own + rest, end
            node.spill.close()
        stack.extend((child, own) for child in node.children.values())


def _larger(a, b):
    return a if b is None or (a is not None and a >= b) else b


def _smaller(a, b):
    return a if b is None or (a is not None and a <= b) else b


def _normal(batch: pa.RecordBatch, lower: bool):
    """The texts of a batch as bytes, few at a time."""
    data, bounds = bytes_of(texts_of(batch.column("text")))
    for first, last in pieces(bounds, 1 << 20):
        block = data[bounds[first]:bounds[last]].tobytes()
        block = block.translate(_LOWER) if lower else block
        base = bounds[first]
        for i in range(first, last):
            yield i, block[bounds[i] - base:bounds[i + 1] - base]


def _schema() -> pa.Schema:
    return pa.schema([("n_bytes", pa.int64()), ("sha256", pa.string()), ("text", pa.binary()), ("keep_id", pa.int64()),
                      ("group_size", pa.int64())])


def _table(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _schema())], schema=_schema())


def _combine(better, lower: bool, budget: int):
    """Map side: one row for each distinct text a task has met since it last handed on."""

    def run(batches):
        trie, size = TextTrie(better, 1 << 62), 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, text in _normal(batch, lower):
                before = trie.size
                trie.insert(text, ids[i], 1)
                size += trie.size - before
                if size > budget:
                    yield from _hand_on(trie)
                    trie, size = TextTrie(better, 1 << 62), 0
        yield from _hand_on(trie)

    return run


def _hand_on(trie: TextTrie):
    rows, size = [], 0
    ends = [(b"", trie.root.end)] if trie.root.end is not None else []
    for text, (keep, count, _) in (*ends, *_strings(trie.root.children.values())):
        rows.append((len(text), hashlib.sha256(text).hexdigest(), text, keep, count))
        size += len(text) + 200
        if size > 4 << 20:
            yield _table(rows)
            rows, size = [], 0
    if rows:
        yield _table(rows)


def _own(better, budget: int):
    """Owner side: all rows of a text meet here, whatever other texts do."""

    def run(batches):
        trie = TextTrie(better, budget)
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("text", "keep_id", "group_size", "sha256", "n_bytes")]
            for text, keep, count, sha, length in zip(*columns):
                trie.insert(text, keep, count, (sha, length))
        seen, rows = set(), []
        for keep, count, (sha, length) in trie.terminals():
            if (sha, length) in seen:
                raise ValueError(f"two texts share length {length} and hash {sha}")
            seen.add((sha, length))
            rows.append((length, sha, None, keep, count))
            if len(rows) == 10_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    return run


def _hashes(lower: bool):
    def run(batches):
        for batch in batches:
            rows = [(hashlib.sha256(text).hexdigest(), len(text)) for _, text in _normal(batch, lower)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.int64())], names=["id", "sha256", "n_bytes"])

    return run


def text_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lower: bool = True,
                keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(n_bytes, sha256, keep_id, group_size): one row per distinct text.

    Each task first folds its own rows in a trie, so a text that fills a third of the corpus costs one row per task.
    The folded rows go to owners by length and content hash; an owner inserts the whole byte strings into its trie, so
    equality is decided by bytes.  ``keep`` is "smallest" or "largest"; a null identifier gives way to any other.
    """
    better = {"smallest": _smaller, "largest": _larger}[keep]
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    folded = rows.mapInArrow(trimmed(_combine(better, lower, trie_bytes)), _GROUPS)
    owned = folded.repartition("n_bytes", "sha256").mapInArrow(trimmed(_own(better, trie_bytes)), _GROUPS)
    return owned.drop("text")


def exact_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lower: bool = True,
                     keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per input row, dropped ones too.

    Texts are equal when their bytes are, after lower-casing A-Z if ``lower``; a null text counts as empty.  Of equal
    texts the row with the largest (or smallest) identifier stays; among repeated rows with that same identifier just
    one does.  Null identifiers stay only where a group has no other.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    groups = text_groups(documents, id_column, text_column, lower, keep, trie_bytes)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    hashed = rows.mapInArrow(trimmed(_hashes(lower)), "id long, sha256 string, n_bytes long")
    joined = hashed.join(groups, ["sha256", "n_bytes"])
    turn = F.row_number().over(Window.partitionBy("sha256", "n_bytes", "id").orderBy("group_size"))
    return joined.select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"), F.col("sha256").alias("text_sha256"))


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lower: bool = True,
             keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns; cases as in ``exact_duplicates``.

    Rows that repeat both identifier and text are folded onto one of them.
    """
    judged = exact_duplicates(documents, id_column, text_column, lower, keep)
    stays = judged.where("kept").select(row_key(F.col(id_column), F.col("text_sha256")).alias("__key"))
    hashed = F.sha2(_lowered(F.coalesce(F.col(text_column).cast("string"), F.lit("")), lower), 256)
    found = documents.withColumn("__key", row_key(F.col(id_column), hashed)).join(stays, "__key", "left_semi")
    # The join leaves rows of a key together and sorted, so the ranking moves nothing.
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return found.withColumn("__turn", turn).where("__turn = 1").select(*[F.col(f"`{c}`") for c in documents.columns])


def row_key(identifier, *others):
    """A key without nulls for joins on an identifier and more."""
    return F.concat_ws("/", F.coalesce(identifier.cast("string"), F.lit("null")), *[o.cast("string") for o in others])


def _lowered(text, lower: bool):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else text
