import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseloom.llm.conversation_repair import CODES, EMPTY, ASSISTANT, Lattice, repair, repair_damaged
from tests.llm.common import ordered

SCHEMA = "conv_id long, turn long, role string, text string, number long, seq int, conv string, code int"
SPACE = " \t\n\x0b\x0c\r"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA).repartition(parts)


def every_script(codes):
    """All scripts with up to two insertions at a place, as (cost, audit, roles): the wanted ones are of least cost."""
    found = []
    for letters in itertools.product("KRD", repeat=len(codes)):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            roles, cost, ok = "", 0, True
            audit = ""
            for k, code in enumerate([*codes, None]):
                for _ in range(gaps[k]):
                    roles += "?"
                    cost += 2
                    audit += "I"
                if code is None:
                    break
                kind, fault = "suao"[CODES.index(code) % 4], CODES.index(code) // 4
                audit += letters[k]
                if letters[k] == "D":
                    cost += 3
                    continue
                ok &= fault < 2
                cost += (2 if letters[k] == "R" else 0) + (fault == 1)
                roles += kind if letters[k] == "K" else "?"
            if not ok or not all(c in "sua?" for c in roles):
                continue
            at = 1 if roles[:1] == "s" else 0
            body = roles[at:]
            if len(body) % 2 or (at and not body) or any(c != "?" and c != "ua"[i % 2] for i, c in enumerate(body)):
                continue
            found.append((cost, audit))
    return min(found)


def test_searches_against_every_script():
    draw = random.Random(5)
    assert Lattice.of_turns("s", True).least(EMPTY, (EMPTY, ASSISTANT))[0] == 3
    for _ in range(150):
        codes = "".join(draw.choice(CODES) for _ in range(draw.randint(1, 4)))
        cost, letters, _ = Lattice.of_turns(codes, True).least(EMPTY, (EMPTY, ASSISTANT))
        assert (cost, "".join(letters)) == every_script(codes), codes


def plain_edits(turns):
    """(cost, audit, lines) by one pass over the turns that keeps the least (cost, audit) of every state."""
    follows = {0: "u", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for q, (cost, audit, lines) in list(best.items()):
                role = follows[q]
                new = (cost + 2, audit + "I", lines + [f"{names[role]}:"])
                if state_of[role] not in best or new[:2] < best[state_of[role]][:2]:
                    best[state_of[role]] = new
        return best

    best = {0: (0, "", [])}
    for role, text, fault in turns:
        after = {}
        for q, (cost, audit, lines) in inserted(best).items():
            ways = [(q, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                kind = follows[q]
                ways.append((state_of[kind], 2 + more, "R", [f"{names[kind]}:{text}"]))
                if role[:1] == kind or (role[:1] == "s" and q == 0):
                    ways.append((state_of[role[0]], more, "K", [f"{role}:{text}"]))
            for to, price, letter, line in ways:
                new = (cost + price, audit + letter, lines + line)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    return min((w for q, w in inserted(best).items() if q in (0, 3)), key=lambda w: w[:2])


def plain(rows, damaged=True):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, turns = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, lines = plain_edits(turns) if turns else (0, "", [])
        numbers = {t for t, *_ in own if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[sum(f == x for *_, f in turns) for x in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(seed=2, count=60, longest=9):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "open end", " ", "", None, "é☃.\n", "Really? \t", "line\nline", "a" * 300 + "."]
    rows = []
    for conv in range(count):
        turn = 0
        for _ in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "User", "sys", "agent"])
            text = draw.choice(texts) if draw.random() < 0.5 else f"{draw.random()}."
            rows.append((conv * 7 - 3, draw.choice([turn, turn, turn, None]), role, text))
            turn += draw.choice([1, 1, 1, 0, 3])
    rows += [(None, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(9)]
    return rows + rows[:4]


@pytest.mark.parametrize("bits", [10, 2, 1])
def test_report_against_plain(spark, bits):
    """Few bits cut conversations into blocks of four or two turns and, in turn, blocks of blocks."""
    rows = conversations()
    got = repair_damaged(rows_of(spark, rows), bits=bits)
    assert ordered(got.collect()) == ordered(plain(rows))


def test_one_long_conversation(spark):
    draw = random.Random(9)
    rows = [(1, k, draw.choice(["user", "assistant", "system"]), f"text {k}" + draw.choice([".", "", "!"])) for k in range(300)] + [(2, 0, "user", "x" * 3_000_000 + ".")]
    got = repair_damaged(rows_of(spark, rows), bits=3)
    assert ordered(got.collect()) == ordered(plain(rows))


def test_repaired_turns_follow_the_pattern(spark):
    rows = conversations(8)
    turns, report = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {}
    for r in turns.collect():
        found.setdefault(r["conv"], []).append((r["number"], r["seq"], r["role"], r["text"], r["edit"]))
    want = {("0" if r[0] is None else f"1{r[0]}"): r for r in plain(rows, damaged=False)}
    for conv, own in found.items():
        own.sort()
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, _, role, *_ in own))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text, _ in own).encode()).hexdigest() == want[conv][-1]
        assert "".join(e for *_, e in own) == want[conv][-2].replace("D", "")
    assert report.count() == len(want)


def test_lost_and_empty(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = repair_damaged(rows_of(spark, [(lost, 0, "user", "hi.")])).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_damaged(rows_of(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
