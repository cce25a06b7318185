"""Small documents with every odd case, and plain versions of what the operators do."""

from __future__ import annotations

import collections
import random

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, id string, n int, score double, kept boolean, size int, mark int, key string"


def documents(seed: int = 4, count: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): groups of copies and near copies, shared passages, nulls, empty and long texts, repeats."""
    draw = random.Random(seed)
    words = [a + b for a in "abcdefghij" for b in ("la", "mi", "no", "r")]
    shared = " ".join(draw.choice(words) for _ in range(40))
    rows = []
    for i in range(count):
        text = " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 3, 8, 30, 60, 120])))
        if i % 5 == 0:
            text += " " + shared
        if i % 7 == 0:
            text += "\n" + text.upper()
        rows.append((1000 - i, text, draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None])))
    for i in range(0, count, 3):
        text = rows[i][1].split(" ")
        rows.append((2000 + i, " ".join(text), "en", "s1"))
        text[draw.randrange(len(text))] = "zz"
        rows.append((3000 + i, " ".join(text), "de", "s2"))
    odd = [None, "", " \t\n", "Wort", "été — naïve ☃ 日本語", "a\x00b \x1c c", "word " * 3000, "12345 67 !!", "x" * 600]
    rows += [(4000 + i, text, "en", "s1") for i, text in enumerate(odd)]
    rows += [(None, "no id here", "en", "s9"), (None, "no id here", "en", "s9"), (None, None, None, None)]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], "en", "s1")]
    return rows


def thue_morse(steps: int) -> tuple[str, str]:
    """A word of 2**steps letters and its complement; polynomials modulo a power of two cannot tell long ones apart."""
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def frame(spark, rows: list[tuple] | None = None, parts: int = 5):
    rows = documents() if rows is None else rows
    full = [(*r, "x", 1, 0.5, True, 7, 3, "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text, length: int) -> frozenset:
    own = (text or "").encode().translate(LOWER).split()
    if len(own) < length:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[k:k + length]) for k in range(len(own) - length + 1))


def components(rows: list[tuple], percent: int, length: int) -> list[tuple]:
    """(id, set size, component) by comparing all pairs that share a shingle."""
    sets = [shingles(text, length) for _, text, *_ in rows]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k, own in enumerate(sets):
        for one in own:
            holders[one].append(k)
    for k, own in enumerate(sets):
        common = collections.Counter(m for one in own for m in holders[one] if m > k)
        for m, n in common.items():
            if rows[k][0] is not None and rows[m][0] is not None and 100 * n >= percent * (len(own) + len(sets[m]) - n):
                a, b = find(rows[k][0]), find(rows[m][0])
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(r[0], len(own), None if r[0] is None else find(r[0])) for r, own in zip(rows, sets)]
