import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm.packed_output import WordEncoder, frame as framed, new_folder, payload_of, read_tokens, write_tokens
from tests.llm.common import documents, empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_reads_what_was_written(spark):
    plain = Tokenizer.from_file(PATH)
    rows = documents() + [(1, "It's a, b. c,d", "en", "s"), (7, "ab <|endoftext|> cd<|startoftext|>, e <|ENDOFTEXT|>. <|endoftext |>", "en", "s"), (2, "Ünïcode ́ ΑΣ.\nx", "en", "s")]
    folder = new_folder(spark, "packed")
    index = write_tokens(frame(spark, rows), folder, PATH)
    got = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((i is not None, i or 0) for i, *_ in rows)
    start, seen = 0, []
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
        seen.append((str(r["doc_id"]), zlib.crc32(bytes(r["ids"]))))
    want = [(str(i), zlib.crc32(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, text, *_ in rows]
    assert sorted(seen) == sorted(want)
    some = read_tokens(spark, folder, index.where(F.col("number") % 3 == 1)).collect()
    assert {(r["doc_id"], r["start"]) for r in some} < {(r["doc_id"], r["start"]) for r in got} and some


def test_damaged_records_are_noticed():
    record = framed(b"payload")
    assert payload_of(record) == b"payload"
    for k in range(len(record)):
        with pytest.raises(ValueError):
            payload_of(record[:k] + bytes([record[k] ^ 1]) + record[k + 1:])


def test_empty_table(spark):
    folder = new_folder(spark, "packed")
    write_tokens(empty(spark), folder, PATH)
    assert read_tokens(spark, folder).count() == 0


def test_stretches_are_encoded_as_in_their_text():
    plain, draw = Tokenizer.from_file(PATH), random.Random(3)
    signs = "aZéÀßÿÖ×÷ªºµÑñİǅ'’.,;:-_19  \n\t\xa0\u0301\u093c\u0958<|>s"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += [" ".join("".join(draw.choice("abzÀÖØößøÿñÇ") for _ in range(draw.randrange(1, 12))) for _ in range(500)) for _ in range(30)]
    encoder = WordEncoder(PATH)
    got = [one for k in range(0, len(texts), 500) for one in encoder.encode(pa.array(texts[k:k + 500], pa.large_string())).to_pylist()]
    want = [np.array(one.ids, "<u4").tobytes() for one in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want
