import collections
import hashlib
import random

from caseloom.llm.exact_dedup import TextTrie, exact_duplicates, keep_one
from tests.llm.common import LOWER, documents, empty, frame, ordered


def plain(rows, pick=max):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").encode().translate(LOWER)].append(i)
    out, done = [], set()
    for i, text, *_ in rows:
        own = (text or "").encode().translate(LOWER)
        ids = [x for x in groups[own] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[own]), i == keep and (own, i) not in done, hashlib.sha256(own).hexdigest()))
        done.add((own, i))
    return out


def test_against_plain(spark):
    assert ordered(exact_duplicates(frame(spark)).collect()) == ordered(plain(documents()))
    assert ordered(exact_duplicates(frame(spark), keep="smallest").collect()) == ordered(plain(documents(), min))
    assert exact_duplicates(empty(spark)).count() == 0


def test_small_tries_give_the_same(spark):
    assert ordered(exact_duplicates(frame(spark), trie_bytes=3000).collect()) == ordered(plain(documents()))


def test_kept_rows_keep_their_columns(spark):
    rows = frame(spark)
    kept = keep_one(rows)
    assert kept.columns == rows.columns
    want = [r[0] for r in plain(documents()) if r[3]]
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, want))


def test_trie_spills_by_subtree():
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 14))).encode() for _ in range(4000)]
    texts += [b"a" * n for n in range(300)] * 2
    want = collections.Counter(texts)
    for budget in (5_000, 40_000, 1 << 30):
        trie = TextTrie(max, budget)
        for k, text in enumerate(texts):
            trie.insert(text, k, 1, text)
        found = list(trie.terminals())
        assert len(found) == len(want)
        assert {tag: n for _, n, tag in found} == want
        last = {text: k for k, text in enumerate(texts)}
        assert {tag: i for i, _, tag in found} == last
