import random
import re

from caseloom.llm.decontamination import find_contamination, without_hits
from tests.llm.common import LOWER, documents, empty, frame, ordered

BENCH = "item_id long, text string, doc_id int, words string"


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def plain(rows, bench, window=10):
    """Every window of every item against every place of every text."""
    out = []
    for i, text, *_ in rows:
        own, hit, items = plain_words(text), set(), set()
        for item, passage in bench:
            words = plain_words(passage)
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == words[k:k + size]:
                        hit |= set(range(at, at + size))
                        items |= {item}
        out.append((i, len(own), len(hit), sorted(str(x) for x in items if x is not None)))
    return out


def items(rows, seed=3):
    draw = random.Random(seed)
    found = []
    for k in range(12):
        words = (rows[draw.randrange(len(rows))][1] or "").split()
        start = draw.randrange(max(1, len(words) - 5))
        found.append((k, ", ".join(words[start:start + draw.choice([3, 9, 10, 11, 25])]).upper()))
    return found + [(100, None), (101, " !?"), (None, found[0][1]), (102, found[1][1]), (7, found[2][1]), (103, "naïve 日本語"), (104, "never there at all")]


def bench_frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "w") for i, t in rows], BENCH)


def result(found):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()]


def short(rows):
    return [r for r in rows if len(r[1] or "") < 5000]


def test_against_every_place(spark):
    rows = short(documents())
    bench = items(rows)
    for window in (10, 3):
        want = plain(rows, bench, window)
        assert sum(n > 0 for _, _, n, _ in want) > 5
        got = find_contamination(frame(spark, rows), bench_frame(spark, bench), window=window)
        assert ordered(map(repr, r) for r in result(got)) == ordered(map(repr, r) for r in want)


def test_several_automata_give_the_same(spark):
    rows = documents()
    bench = items(rows)
    one = find_contamination(frame(spark, rows), bench_frame(spark, bench)).collect()
    many = find_contamination(frame(spark, rows), bench_frame(spark, bench), automaton_bytes=900).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_spans_lie_in_the_original_text(spark):
    item = "Alpha beta, GAMMA délta epsilon zeta eta theta iota kappa lambda"
    text = "☃ é start!  alpha\tBETA gamma -- Délta délta epsilon; alpha beta gamma délta epsilon zeta eta (theta) iota kappa lambda mu"
    docs = frame(spark, [(1, text, "en", "s"), (2, "nothing here", "en", "s"), (3, None, None, None)])
    found = {r["doc_id"]: r for r in find_contamination(docs, bench_frame(spark, [(9, item)])).collect()}
    (span,) = found[1]["spans"]
    assert text[span["start"]:span["end"]] == "alpha beta gamma délta epsilon zeta eta (theta) iota kappa lambda"
    assert found[2]["spans"] == [] and found[3]["n_words"] == 0
    cut = {r["doc_id"]: r["text"] for r in without_hits(docs, bench_frame(spark, [(9, item)])).collect()}
    assert cut == {1: text[:span["start"]] + text[span["end"]:], 2: "nothing here", 3: None}


def test_a_text_of_megabytes_and_empty_tables(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    long = "filler words go on and on " * 200_000 + passage + " tail" * 100_000
    docs = frame(spark, [(1, long, "en", "s")])
    row = find_contamination(docs, bench_frame(spark, [(1, passage), (2, "tail tail")])).first()
    assert row["n_hit"] == 30 + 100_000 and row["items"] == ["1", "2"] and len(row["spans"]) == 2
    assert find_contamination(empty(spark), bench_frame(spark, [(1, passage)])).count() == 0
    assert find_contamination(docs, bench_frame(spark, [(1, passage)]).limit(0)).first()["n_hit"] == 0
