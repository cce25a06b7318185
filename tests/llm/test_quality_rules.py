import collections
import re

from pyspark.sql import functions as F

from caseloom.llm import quality_rules
from caseloom.llm.quality_rules import judge
from tests.llm.common import documents, empty, frame, ordered


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def rows():
    text = " ".join(f"w{k}" for k in range(80))
    more = [text, text + "\n" + text, text + " w1 w2 w3 w9 w1 w2 w3", "##| " * 70 + text, "A B C\nA B C\n \nA B C \n" + text, "a a a a", "a b a b a"]
    return documents() + [(8000 + k, t, "en", "s") for k, t in enumerate(more)]


def test_measures(spark):
    got = judge(frame(spark, rows())).collect()
    assert ordered((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                   for r in got) == ordered((i, *plain(text)) for i, text, *_ in rows())
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["posterior"] <= 1 for r in got)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_mark", lambda a, b, c: F.length(a).cast("bigint"))
    got = judge(frame(spark, rows())).collect()
    assert ordered((r["doc_id"], r["n_repeat_words"]) for r in got) == ordered((i, plain(text)[4]) for i, text, *_ in rows())


def test_capital_words(spark):
    texts = ["AB Ab xAB ABC\tÄÖ\u00a0AB 1AB \U00010400\U00010400 A B", "", "NASA\nESA", "É\u0301X aBC"]
    got = quality_rules.measured(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).select(
        "id", "n_capital_words", "n_words").collect()
    assert {r["id"]: r["n_capital_words"] for r in got} == {0: 4, 1: 0, 2: 2, 3: 0}


def test_plan_is_native(spark):
    plan = judge(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_table(spark):
    assert judge(empty(spark)).count() == 0


def test_symbols_weigh_against_a_text(spark):
    good = [(k, " ".join(f"word{k}x{j}" for j in range(90)) + ".", "en", "s") for k in range(60)]
    bad = [(100 + k, " ".join(f"word{k}x{j}***" for j in range(90)), "en", "s") for k in range(15)]
    kept = {r["doc_id"]: r["kept"] for r in judge(frame(spark, good + bad)).collect()}
    assert all(kept[k] for k in range(60)) and not any(kept[100 + k] for k in range(15))
