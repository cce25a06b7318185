import collections

from caseloom.llm.mixing import mix, repeat_by_mix, source_targets
from tests.llm.common import documents, empty, frame, ordered, words


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Share by weight, stop at the limit, share again what is above, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def test_targets_by_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 3}, {"a": 0, "b": 9, "c": 100, "d": 100, "e": 1}, {"é": 5, "z": 90, "Z": 40}):
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r["source"]: round(r["target"], 9) for r in rows} == {s: round(t, 9) for s, t in want.items()}


def test_mix_of_all_cases(spark):
    rows = documents()
    for bucket in (4096, 3):
        got = mix(frame(spark), bucket_rows=bucket).collect()
        assert ordered((r["doc_id"], r["size"]) for r in got) == ordered((i, len(words(t))) for i, t, *_ in rows)
        sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
            assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        want = plain_targets(sizes)
        for source, size in sizes.items():
            assert abs(target[source] - want[source]) < 1e-6
            assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1
            copies = {r["copies"] for r in got if r["source"] == source and r["size"]}
            assert max(copies, default=0) - min(copies, default=0) <= 1


def test_reruns_and_buckets_agree(spark):
    one, two, three = (mix(frame(spark, parts=p), bucket_rows=b).collect() for p, b in ((5, 4096), (2, 4096), (3, 2)))
    assert ordered(one) == ordered(two) == ordered(three)


def test_repeated_rows_of_the_mix(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", f"s{i % 3}") for i in range(90)]
    docs = frame(spark, rows)
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mix(docs).collect() if r["copies"]})
    got = repeat_by_mix(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == want
    assert repeat_by_mix(frame(spark)).count() > 0
    assert mix(empty(spark)).count() == 0 and repeat_by_mix(empty(spark)).count() == 0
