"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A record frames one serialized sequence:

    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum of those 8 bytes
    payload   8 bytes identifier, 1 byte whether it is null, 1 byte width of an id, then the ids, little-endian
    4 bytes   masked checksum of the payload

The checksum is CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that a checksum stored within data does not look
like one.  An id takes 2 bytes where the vocabulary allows it, else 4.  The index is a Parquet table of its own.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caseloom.llm.tasks import Memory, bytes_of, pieces, texts_of, worker_cache
from caseloom.session import shared_dir

#: Bytes of stretches between spaces, in one of the two generations whose ids a worker remembers.
REMEMBERED = 96 << 20
#: Bytes of records that one reading task takes, about.
READ_BYTES = 32 << 20
#: Bytes of texts whose distinct stretches are looked up at once.
LOOKED_UP = 4 << 20
#: Stretches that are one token group whatever stands around them: letters that keep their number in lower case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORD_END = "</w>"
_INDEX = "part int, file string, number long, offset long, length long, n_tokens long, before long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload_of(record: bytes) -> bytes:
    """The payload of a framed record; a damaged record raises."""
    length, check = struct.unpack_from("<QI", record)
    payload = record[12:-4]
    if check != masked(record[:8]) or length != len(payload) or struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


class WordEncoder:
    """Encode texts with a tokenizer whose tokens never cross white space, one distinct stretch at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(REMEMBERED, lambda stretch, ids: 200 + 2 * len(stretch) + len(ids))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[n for token, n in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def _encoded(self, stretches: list) -> list:
        """The ids of each stretch, encoded by itself."""
        encoded = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (one.ids for one in encoded)]

    def _encoded_words(self, words: list, together: int = 200) -> list:
        """The ids of words of letters, many in one text: a word ends with the one token that carries the mark of an end."""
        groups = [words[k:k + together] for k in range(0, len(words), together)]
        found: list = []
        for group, one in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(one.ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):  # a vocabulary without such marks
                found += self._encoded(group)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                found.append(raw[start:end])
                start = end
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as 4-byte little-endian integers."""
        if not len(texts):
            return pa.array([], pa.binary())
        # A comma or full stop between a letter and a space is a token group of its own, so a cut before it is safe.
        loose = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"([a-z])([,.])( |$)", r"\1 \2\3")
        parts = pc.split_pattern(loose, " ")
        words = parts.flatten().dictionary_encode()
        distinct, known = words.dictionary.to_pylist(), self.known
        plain, other = [], []
        for one in known.missing(set(distinct)):
            (plain if _LETTERS.fullmatch(one) else other).append(one)
        for new, encode in ((plain, self._encoded_words), (other, self._encoded)):
            for first in range(0, len(new), 4000):
                some = new[first:first + 4000]
                known.learn(zip(some, encode(some)))
        ids = pa.array(list(map(known.now.__getitem__, distinct)), pa.binary()).take(words.indices)
        known.age()
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets.cast(pa.int32()), ids), b"")


def _encoder(path: str) -> WordEncoder:
    cache = worker_cache("packed_output")
    if ("word_encoder", path) not in cache:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache["word_encoder", path] = WordEncoder(path)
    return cache["word_encoder", path]


def _file_system(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, vocabulary: int = 49_408,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending order of identifier under ``folder``; return the index.

    Rows are range-partitioned by identifier (repeated identifiers by a hash of the text too) and sorted; each task
    encodes its rows and appends their records to a file named by partition and attempt.  Only what the index names
    is ever read, so files of failed attempts do no harm and a lost task is simply run again.  The index has a row per
    record: part and file, number within the file, offset and length in bytes, tokens, and tokens of the file before it.

    A null or empty text is a sequence of just the end id; a null identifier comes first; repeated rows are written
    each; an empty table writes no file and an empty index; other columns are ignored.
    """
    width = 2 if vocabulary <= 65_536 else 4

    def run(batches):
        context = TaskContext.get()
        part, file, sink, offset, before, number = context.partitionId(), "", None, 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        encoder = _encoder(tokenizer_path)
        system, base = _file_system(folder)
        try:
            for batch in batches:
                if sink is None:
                    file = f"part-{part:06d}-{context.taskAttemptId()}.records"
                    sink = system.open_output_stream(f"{base}/{file}")
                rows = []
                texts, ids = texts_of(batch.column("text")), batch.column("id").to_pylist()
                for first, last in pieces(bytes_of(texts)[1], LOOKED_UP):
                    encoded = encoder.encode(texts.slice(first, last - first)).to_pylist()
                    for identifier, tokens in zip(ids[first:last], encoded):
                        tokens = np.frombuffer(tokens + end, "<u4")
                        record = frame(struct.pack("<qBB", identifier or 0, identifier is None, width)
                                       + tokens.astype(f"<u{width}").tobytes())
                        sink.write(record)
                        rows.append((part, file, number, offset, len(record), len(tokens), before))
                        offset, before, number = offset + len(record), before + len(tokens), number + 1
                yield _rows(rows, _INDEX_TYPES)
        finally:
            if sink is not None:
                sink.close()

    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, _INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return documents.sparkSession.read.parquet(f"{folder}/index")


_INDEX_TYPES = [("part", pa.int32()), ("file", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
                ("n_tokens", pa.int64()), ("before", pa.int64())]


def _rows(rows: list, types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])


def read_tokens(spark: SparkSession, folder: str, index: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids): the records that the index names, checksums verified.

    ``start`` counts the ids of all records before this one in the order of writing; ``ids`` holds them as unsigned
    4-byte little-endian integers.  Any selection of index rows can be read: reads are by offset.
    """
    stored = spark.read.parquet(f"{folder}/index")
    index = stored if index is None else index
    files = stored.groupBy("part", "file").agg(F.sum("n_tokens").alias("__tokens"), F.sum("length").alias("__bytes"))
    starts = files.select("file", (F.sum("__tokens").over(Window.orderBy("part")) - F.col("__tokens")).alias("__start"))
    wanted = index.join(starts, "file").withColumn("start", F.col("__start") + F.col("before"))
    total = files.agg(F.sum("__bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    block = F.floor(F.col("offset") / (READ_BYTES // 8))
    placed = wanted.select("file", "offset", "length", "start", "n_tokens", block.alias("block")).repartition(
        tasks, "file", "block").sortWithinPartitions("file", "offset")
    types = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]

    def run(batches):
        system, base = _file_system(folder)
        file, source = None, None
        for batch in batches:
            rows, size = [], 0
            for name, offset, length, start, count in zip(*[batch.column(c).to_pylist() for c in (
                    "file", "offset", "length", "start", "n_tokens")]):
                if name != file:
                    file, source = name, system.open_input_file(f"{base}/{name}")
                payload = payload_of(source.read_at(length, offset))
                identifier, null, width = struct.unpack_from("<qBB", payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=10)
                if len(ids) != count:
                    raise ValueError(f"{name} has {len(ids)} ids at {offset}, the index says {count}")
                rows.append((None if null else identifier, start, count, ids.astype("<u4").tobytes()))
                size += 4 * count
                if size > 4 << 20:
                    yield _rows(rows, types)
                    rows, size = [], 0
            yield _rows(rows, types)

    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
