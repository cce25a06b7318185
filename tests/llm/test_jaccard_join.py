import random

import numpy as np
import pytest

from caseloom.llm import jaccard_join
from caseloom.llm.jaccard_join import keep_one, shingle_components
from tests.llm.common import components, documents, empty, frame, ordered, thue_morse


@pytest.mark.parametrize("percent, length", [(90, 3), (80, 5), (100, 2)])
def test_against_plain(spark, percent, length):
    got = shingle_components(frame(spark), percent, length).collect()
    assert ordered(got) == ordered(components(documents(), percent, length))


@pytest.mark.parametrize("frequent", [2, 64])
def test_groups_of_variants(spark, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    draw = random.Random(9)
    rows = []
    for size, many in ((12, 5), (40, 60), (150, 90), (100, 1)):
        base = [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 4) for _ in range(size)]
        for _ in range(many):
            own = list(base)
            for _ in range(draw.randint(0, 6)):
                own[draw.randrange(size)] = f"x{draw.randint(0, 30)}"
            rows.append((5000 - len(rows), " ".join(own), "en", "s"))
    got = shingle_components(frame(spark, rows)).collect()
    assert ordered(got) == ordered(components(rows, 90, 3))


def test_every_order_lets_similar_sets_pass():
    draw, threshold = random.Random(5), jaccard_join.Threshold(90)
    passed = 0
    for _ in range(300):
        base = [draw.randrange(2**63) for _ in range(draw.randint(1, 200))]
        changed = [draw.randrange(2**63) if draw.random() < 0.03 else one for one in base]
        sets = [np.unique(np.array(own, np.uint64)) for own in (base, changed, [draw.randrange(2**63) for _ in range(200)])]
        prefixes = [b"".join(jaccard_join._prefix(threshold, own, seed).tobytes() for seed in jaccard_join.ORDERS) for own in sets]
        if threshold.holds(len(np.intersect1d(sets[0], sets[1])), len(sets[0]), len(sets[1])):
            assert jaccard_join._meet(prefixes[0], prefixes[1])
            passed += 1
        assert not jaccard_join._meet(prefixes[0], prefixes[2]) and not jaccard_join._meet(prefixes[0], b"")
    assert passed > 50


def test_one_row_of_each_component_stays(spark):
    rows = frame(spark)
    kept = keep_one(rows)
    assert kept.columns == rows.columns
    want = [i for i, _, c in components(documents(), 80, 5) if i == c]
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, want))


def test_empty_table(spark):
    assert shingle_components(empty(spark)).count() == 0


def test_words_that_polynomials_confuse_and_a_long_text(spark):
    one, two = thue_morse(11)
    long = " ".join(f"w{k}" for k in range(800_000))
    rows = [(1, f"{one} x y", "en", "s"), (2, f"{two} x y", "en", "s"), (3, long, "en", "s"), (4, long + " end", "en", "s")]
    assert ordered(shingle_components(frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 799_998, 3), (4, 799_999, 3)]
