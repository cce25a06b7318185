import hashlib
import random

import public_tokenizers
import tiktoken

from caseloom.llm.byte_bpe import decode, encode, read_ranks, round_trip
from tests.llm.common import documents, empty, frame, ordered

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
EXTRA = ["a  b", " a b ", "a\n b", "a \nb  ", "x\n\n y", "aaab" * 60 + " \n\n  x", "ñandú's 't 're x ", "<|endoftext|>", "x" * 900, "'s 're"]


def rows():
    return documents() + [(9000 + k, text, "en", "s") for k, text in enumerate(EXTRA)]


def test_ids_as_the_library_gives_them(spark):
    got = encode(frame(spark, rows()), PATH, PATTERN)
    assert ordered((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == ordered(
        (i, tuple(PLAIN.encode_ordinary(text or ""))) for i, text, *_ in rows())


def test_decoding_gives_the_bytes_back(spark):
    back = decode(encode(frame(spark, rows()), PATH, PATTERN), PATH, PATTERN)
    assert ordered((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == ordered((i, (text or "").encode()) for i, text, *_ in rows())


def test_spaces_within_other_white_space(spark):
    draw = random.Random(8)
    kinds = [*" \t\n\v\f\r\x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000", *" " * 8, "\x1c", "\u200b", "a", "b7", "é", "!", "'s", "日"]
    texts = ["a \xa0 \xa0 b", "Price \xa0 \xa0 \xa0 \xa0 10", " \xa0 \xa0", "a\n \nb", "\n \n", " \n", " a \t", "a b \xa0", "\xa0 a", "a  b c\n d", "a b "]
    texts += ["".join(draw.choice(kinds) for _ in range(draw.randrange(30))) for _ in range(3000)]
    given = frame(spark, [(k, text, "en", "s") for k, text in enumerate(texts)])
    want = [tuple(PLAIN.encode_ordinary(text)) for text in texts]
    assert [tuple(r["ids"]) for r in sorted(encode(given, PATH, PATTERN).collect(), key=lambda r: r["doc_id"])] == want
    got = sorted(round_trip(given, PATH, PATTERN).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got] == [
        (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        for ids, text in zip(want, texts)]


def test_digests(spark):
    want = []
    for i, text, *_ in rows():
        ids = PLAIN.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(round_trip(frame(spark, rows()), PATH, PATTERN).collect()) == ordered(want)
    assert round_trip(empty(spark), PATH, PATTERN).count() == 0
