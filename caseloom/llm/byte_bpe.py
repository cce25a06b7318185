"""Byte-level BPE as DuckDB queries inside Spark tasks: token rows meet the merge table until nothing merges."""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tasks import Memory, bytes_of, pieces, texts_of, worker_cache

#: Pieces that one recursive query works on, in bytes, and the rounds it takes before unfinished pieces start anew.
#: A query keeps the rows of all its rounds, so the two bound its memory.
QUERY_BYTES, QUERY_ROUNDS = 100_000, 24
#: A piece of more bytes is worked off a few rounds at a time.
LONG = 64
#: Bytes of pieces, and of stretches between spaces, in one of the two generations that a worker remembers.
REMEMBERED = 144 << 20
#: What the pattern's white space is.  A text is cut at a space that none of it touches; an odd text has other spaces too.
_SPACE = " \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD, _CUT = f"[{_SPACE}] | [{_SPACE}]", regex.compile(r"(?<=\S) (?=\S)")
#: Text whose tokens are decoded by one query.
DECODE_BYTES = 1 << 20
_DUCKDB = {"threads": 1, "memory_limit": "160MB", "preserve_insertion_order": False}

# A token-position row is (spot, tok, nxt): spot = piece * 2**32 + position, where positions of a piece count from 0
# without gaps; nxt is the token of the next row, -1 at the end.
# The id of a merged token is its rank, so rank * 2**32 + position orders pairs by rank, then from the left.
_CONTRACT = """
WITH RECURSIVE state(spot, tok, nxt, round) AS (
  SELECT a.spot, a.tok, coalesce(n.tok, -1), 0 FROM pieces a LEFT JOIN pieces n ON n.spot = a.spot + 1
  UNION ALL
  SELECT CASE WHEN r.spot > b.spot THEN r.spot - 1 ELSE r.spot END,
         CASE WHEN r.spot = b.spot THEN b.merged ELSE r.tok END,
         CASE WHEN r.spot = b.spot THEN b.beyond WHEN r.spot = b.spot - 1 THEN b.merged ELSE r.nxt END, r.round + 1
  FROM state r JOIN (
    SELECT y.piece, x.spot - 1 AS spot, (y.best >> 32)::INTEGER AS merged, x.nxt AS beyond
    FROM (SELECT a.spot >> 32 AS piece, min((m.merged::BIGINT << 32) + (a.spot & 4294967295)) AS best
          FROM state a JOIN merges m ON m.pair = (a.tok::BIGINT << 32) + a.nxt GROUP BY 1) y
    JOIN state x ON x.spot = (y.piece << 32) + (y.best & 4294967295) + 1) b ON r.spot >> 32 = b.piece
  WHERE r.spot <> b.spot + 1 AND r.round < $rounds
)
"""

# What is left of each piece: its token rows, or its tokens in decimal and decoded, both in order.
_ROWS = """SELECT spot, tok, round
FROM state JOIN (SELECT spot >> 32 AS piece, max(round) AS last FROM state GROUP BY 1) ON piece = spot >> 32 AND round = last
ORDER BY spot
"""
_TEXTS = """SELECT piece, count(*), string_agg(state.tok::VARCHAR, ' ' ORDER BY spot), string_agg(text, '' ORDER BY spot)
FROM state JOIN (SELECT spot >> 32 AS piece, max(round) AS last FROM state GROUP BY 1) ON piece = spot >> 32 AND round = last
JOIN vocabulary v ON v.tok = state.tok GROUP BY piece
"""

_DECODE = """
SELECT document, string_agg(v.text, '' ORDER BY position) AS text
FROM tokens JOIN vocabulary v USING (tok) GROUP BY document
"""


#: What a stretch of text becomes: the number of tokens, their ids in decimal, the bytes they decode to.
Stretch = tuple[int, str, bytes]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BpeTables:
    """The vocabulary and the merge table in a DuckDB connection of one worker.

    The merge table holds every way to cut a token into two tokens: a pair merges when its concatenation is a token,
    and the rank of that token decides.
    """

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = np.array(cuts, np.int64).T
        self.sql = duckdb.connect(config=_DUCKDB)
        self._put("merges", pair=(left << 32) + right, merged=merged.astype(np.int32))
        self.sql.register("given", pa.table({
            "tok": pa.array(self.ranks.values(), pa.int32()),
            "text": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())}))
        self.sql.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.known = Memory(remembered, lambda piece, became: 350 + 2 * len(piece) + len(became[1]) + len(became[2]))
        # A stretch of one piece shares what that piece became.
        self.stretches = Memory(remembered, lambda one, became: 160 + (4 * len(one) if became[0] < 2 else 200 + 2 * len(one) + len(became[1]) + len(became[2])))

    def _put(self, name: str, **columns: np.ndarray) -> None:
        self.sql.register("given", pa.table(columns))
        self.sql.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")

    def encode_pieces(self, pieces: list[bytes]) -> list[Stretch]:
        """What each piece becomes."""
        found: list = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        open_, size, wholes = [], 0, []
        for i in order:
            piece = pieces[i]
            whole = self.ranks.get(piece)
            if whole is not None:
                wholes.append((i, whole))
                continue
            if open_ and (size + len(piece) > QUERY_BYTES or len(piece) > LONG >= len(pieces[open_[0]])):
                self._merge(open_, pieces, found)
                open_, size = [], 0
            open_.append(i)
            size += len(piece)
        if open_:
            self._merge(open_, pieces, found)
        for (i, whole), back in zip(wholes, self.decode([np.array([whole]) for _, whole in wholes])):
            found[i] = (1, str(whole), back)
        return found

    def _merge(self, open_: list[int], pieces: list[bytes], found: list) -> None:
        lengths = np.array([len(pieces[i]) for i in open_])
        number = np.repeat(np.arange(len(open_), dtype=np.int64), lengths)
        starts = np.cumsum(lengths) - lengths
        at = (number << 32) + np.arange(len(number)) - starts[number]
        tok = self.bytes[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
        if lengths[-1] <= LONG:
            self._put("pieces", spot=at, tok=tok)
            for i, count, decimal, text in self.sql.execute(_CONTRACT + _TEXTS, {"rounds": int(lengths[-1])}).fetchall():
                found[open_[i]] = (count, decimal, text.encode("latin-1"))
            return
        while len(at):
            self._put("pieces", spot=at, tok=tok)
            rows = self.sql.execute(_CONTRACT + _ROWS, {"rounds": QUERY_ROUNDS}).fetchnumpy()
            at, tok, done = rows["spot"], rows["tok"], rows["round"] < QUERY_ROUNDS
            ready, ids = at[done] >> 32, tok[done]
            edges = np.flatnonzero(np.diff(ready, prepend=-1, append=-1))
            own = [ids[first:last] for first, last in zip(edges[:-1], edges[1:])]
            for first, one, back in zip(edges[:-1], own, self.decode(own)):
                found[open_[ready[first]]] = (len(one), " ".join(map(str, one.tolist())), back)
            at, tok = at[~done], tok[~done]

    def resolve(self, stretches: list[str]) -> list[Stretch]:
        """What each stretch becomes; new ones are cut into pieces and their new pieces merged."""
        memory, known = self.stretches, self.known
        new = memory.missing(set(stretches))
        matches = [self.pattern.findall(one) for one in new]
        pieces = known.missing({piece for own in matches for piece in own})
        known.learn(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
        became = []
        for own in matches:
            parts = [known.now[piece] for piece in own]
            became.append(parts[0] if len(parts) == 1 else (
                sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])))
        memory.learn(zip(new, became))
        out = list(map(memory.now.__getitem__, stretches))
        memory.age()
        known.age()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of its tokens, their ids in decimal joined by a space, and the decoded bytes.

        A text is cut into stretches at the spaces between two characters that are not white space, each stretch with
        the space before it: such a space starts a match in any case, so stretches can be cut by themselves.  A space
        that touches other white space may stand inside a match and stays within its stretch.  Each distinct stretch is
        resolved once.
        """
        if not len(texts):
            return np.zeros(0, np.int64), pa.array([], pa.string()), pa.array([], pa.binary())
        odd = pc.match_substring_regex(texts, _ODD)
        parts = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
        if pc.any(odd).as_py():
            own = pa.array([_CUT.split(text) for text in texts.filter(odd).to_pylist()], parts.type)
            order = np.arange(len(texts))
            order[odd.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(own))
            parts = pa.concat_arrays([parts, own]).take(pa.array(order))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        at = words.indices.to_numpy().astype(np.int64)
        firsts = [distinct[i] for i in at[bounds[:-1]].tolist()]
        at[bounds[:-1]] = len(distinct) + np.arange(len(firsts))
        counts, decimals, backs = zip(*self.resolve([" " + word for word in distinct] + firsts))
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind).take(pa.array(at)))
                 for values, kind in ((decimals, pa.string()), (backs, pa.binary()))]
        ids = pc.utf8_ltrim(pc.binary_join(lists[0], " "), " ")
        return np.add.reduceat(np.array(counts)[at], bounds[:-1]), ids, pc.binary_join(lists[1], b"")

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids, by an aggregation ordered by position."""
        out = [b""] * len(ids)
        first, size = 0, 0
        for last in range(1, len(ids) + 1):
            size += len(ids[last - 1])
            if last < len(ids) and size < DECODE_BYTES // 4:
                continue
            lengths = np.array([len(one) for one in ids[first:last]])
            document = np.repeat(np.arange(first, last), lengths)
            self.sql.register("tokens", pa.table({
                "document": document, "position": np.arange(len(document)),
                "tok": np.concatenate(ids[first:last]).astype(np.int32)}))
            for at, text in self.sql.execute(_DECODE).fetchall():
                out[at] = text.encode("latin-1")
            first, size = last, 0
        return out


def tables(path: str, pattern: str, remembered: int = REMEMBERED) -> BpeTables:
    cache = worker_cache("byte_bpe")
    key = ("byte_bpe", path, pattern)
    if key not in cache:
        cache[key] = BpeTables(path, pattern, remembered)
    return cache[key]


def _few(texts: pa.Array):
    """Runs of texts of about a megabyte."""
    _, bounds = bytes_of(texts)
    for first, last in pieces(bounds, 1 << 20):
        yield texts.slice(first, last - first)


def encode(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text as an array.

    Every match of ``pattern`` is encoded by itself: as long as two neighbouring tokens concatenate to a token, the
    pair of the smallest rank, the leftmost of equals, becomes that token.  A null or empty text gives an empty array;
    a null identifier and repeated rows stay as they are; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        own = tables(path, pattern)
        for batch in batches:
            out = [[int(i) for i in decimal.split()] for some in _few(texts_of(batch.column("text")))
                   for decimal in own.encode(some)[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of each sequence of ids; a null sequence counts as empty, an unknown id gives nothing."""

    def run(batches):
        own = tables(path, pattern)
        for batch in batches:
            ids = [np.array(one or [], np.int32) for one in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.decode(ids), pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInArrow(
        run, f"id {kind}, bytes binary").withColumnRenamed("id", id_column)


def round_trip(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
               remembered: int = REMEMBERED) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass and return digests.

    The first digest is of the decimal ids joined by one space, the second of the decoded bytes; the ids of each
    distinct piece are decoded once, and a text's bytes are those of its pieces in order.  Cases as in
    ``encode``; the digests of an empty text are those of no bytes.  ``remembered`` bounds what a worker keeps of
    earlier pieces; it changes no result.
    """

    def run(batches):
        own = tables(path, pattern, remembered)
        for batch in batches:
            counts, digests = [np.zeros(0, np.int64)], ([], [])
            for some in _few(texts_of(batch.column("text"))):
                count, *texts = own.encode(some)
                counts.append(count)
                for digest, values in zip(digests, texts):
                    digest.extend(hashlib.sha256(value.as_buffer()).hexdigest() for value in values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(counts)), *[pa.array(d, pa.string()) for d in digests]],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
