import hashlib
import math
import zlib

from caseloom.llm.target_resampling import cutoff, resample
from pyspark.sql import functions as F
from tests.llm.common import documents, empty, frame, ordered
from tests.llm.test_decontamination import bench_frame, plain_words


def features(text):
    words = plain_words(text)
    return words, [zlib.crc32(f) % 10000 for f in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def plain(rows, bench, percent=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    for _, text, *_ in rows:
        for b in features(text)[1]:
            s[b] += 1
    for _, text in bench:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text, *_ in rows:
        words, own = features(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[5] = rank
    return [tuple(r) for r in out]


def bench():
    return [(1, documents()[0][1]), (2, "lorem ipsum, Lorem IPSUM"), (3, None), (None, "ala bla cla dmi"), (4, "")]


def test_against_plain(spark):
    rows = documents()
    for percent, least in ((25, 20), (60, 1), (100, 20), (0, 20)):
        got = resample(frame(spark, rows), bench_frame(spark, bench()), percent=percent, least_words=least)
        assert ordered(got.collect()) == ordered(plain(rows, bench(), percent, least))


def test_ties_of_repeated_rows_are_cut_exactly(spark):
    """Copies under one identifier or none tie in everything; the draw still has the wanted size."""
    text = " ".join(f"w{k % 7}" for k in range(30))
    rows = [(None, text, "en", "s")] * 40 + [(5, text, "en", "s")] * 40 + [(k, text, "en", "s") for k in range(100, 120)]
    for percent in (10, 35, 50, 77, 99):
        got = resample(frame(spark, rows), bench_frame(spark, bench()), percent=percent).collect()
        assert len(got) == len(rows)
        ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
        assert ranks == list(range(1, percent + 1))
        drawn = [r for r in got if r["rank"] is not None]
        lowest = min(r["score"] for r in drawn)
        assert all(r["score"] <= lowest for r in got if r["rank"] is None)
        assert [r["score"] for r in sorted(drawn, key=lambda r: r["rank"])] == sorted((r["score"] for r in drawn), reverse=True)


def test_cutoff_by_bisection(spark):
    values = [5, 5, 5, -3, 8, 8, 100, 2**40, -(2**40)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in range(1, len(values) + 1):
        for tried in (1, 15):
            v, below = cutoff(rows, F.col("v"), wanted, tried)
            assert v == sorted(values)[wanted - 1] and below == sum(x < v for x in values)


def test_empty_tables_and_a_long_text(spark):
    docs = frame(spark, [(1, "alpha beta " * 300_000, "en", "s"), (2, "gamma", "en", "s")])
    assert ordered(resample(docs, bench_frame(spark, bench()).limit(0), percent=100).collect()) == ordered(
        plain([(1, "alpha beta " * 300_000), (2, "gamma")], [], 100))
    assert resample(empty(spark), bench_frame(spark, bench())).count() == 0
