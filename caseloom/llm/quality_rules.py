"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs their votes.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A map side of the vote table has at most 3 ** rules rows, which bounds what is broadcast.
ROUNDS = 12

#: name: (votes good, votes bad) over the measures of a text; neither is an abstention.  All in whole numbers.
RULES = {
    "length": ("n_words >= 50 AND n_words <= 100000", "n_words < 20"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "symbols": ("20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "lines": ("n_dup_lines = 0", "5 * n_dup_lines > n_lines"),
    "repeats": ("20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "letters": ("10 * n_letter_words >= 8 * n_words", "10 * n_letter_words < 6 * n_words"),
    "capitals": ("10 * n_capital_words <= 2 * n_words", "10 * n_capital_words > 5 * n_words"),
}


def measures(text: Column) -> dict[str, Column]:
    """Columns of one text; every count reads it to its end."""
    pieces = F.split(F.translate(text, "\t\n\v\f\r", "     "), " ", -1)
    words = F.array_remove(pieces, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))
    return {"__words": words, "__lines": lines}


def _mark(*words: Column) -> Column:
    """A window's hash; windows that share one are compared by their words."""
    return F.xxhash64(*words)


def _window(words: Column, at: Column) -> list[Column]:
    return [F.element_at(words, at + k) for k in range(3)]


def _covered(starts: Column) -> Column:
    """Words in the windows that begin at these ascending positions."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, i: F.struct((s["n"] + i + 2 - F.greatest(s["upto"], i - 1)).alias("n"), (i + 2).alias("upto")))["n"]


def _ends(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.transform(hits, lambda p: p["i"]), F.transform(hits, lambda p: p["j"]))))


def _repeats_by_words(words: Column) -> Column:
    """Words in repeated windows, for a text with different windows of one hash: windows sorted by their words."""
    windows = F.size(words) - 2
    placed = F.array_sort(F.transform(F.sequence(F.lit(1), windows), lambda i: F.struct(F.array(*_window(words, i)).alias("words"), i.alias("i"))))
    pairs = F.zip_with(placed, F.slice(placed, 2, windows), lambda x, y: F.when(x["words"] == y["words"], F.struct(x["i"].alias("i"), y["i"].alias("j"))))
    return _covered(_ends(F.filter(pairs, lambda p: p.isNotNull())))


def _with_repeats(frame: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words of ``__words`` in a three-word window that occurs twice or more.

    Most texts repeat no window: there the distinct hashes are as many as the windows.  In the others, hashes are sorted
    with their positions and neighbours of one hash compared by their words.  Each step is a projection of its own,
    so nothing is computed twice.
    """
    others, words = frame.columns, F.col("__words")
    windows = F.size(words) - 2
    hashed = frame.select("*", F.when(windows >= 2, F.transform(
        F.sequence(F.lit(1), windows), lambda i: _mark(*_window(words, i)))).alias("__h"))
    placed = hashed.select(*others, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))).alias("__p"))

    def twin(x: Column, y: Column) -> Column:
        same = F.lit(True)
        for a, b in zip(_window(words, x["i"]), _window(words, y["i"])):
            same = same & (a == b)
        return F.when(x["h"] == y["h"], F.struct(x["i"].alias("i"), y["i"].alias("j"), same.alias("same")))

    pairs = F.filter(F.zip_with("__p", F.slice("__p", 2, F.size("__p")), twin), lambda p: p.isNotNull())
    met = placed.select(*others, pairs.alias("__pairs"))
    return met.select(*others, F.when(F.col("__pairs").isNull(), F.lit(0)).when(
        F.exists("__pairs", lambda p: ~p["same"]), _repeats_by_words(words)).otherwise(_covered(_ends(F.col("__pairs")))).alias("n_repeat_words"))


def measured(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measures): the counts that the rules look at."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = documents.select(F.col(id_column).alias("id"), text.alias("text"))
    split = _with_repeats(base.select("id", "text", *[c.alias(n) for n, c in measures(F.col("text")).items()]))
    words, lines = F.col("__words"), F.col("__lines")
    return split.select(
        "id", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"(?:^|[\x20\x09-\x0D])\p{L}")).cast("long").alias("n_letter_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}(?<![^\x20\x09-\x0D]\p{Lu})\p{Lu}")).cast("long").alias("n_capital_words"))


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


def label_model(votes: DataFrame, rules: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior): the probability that a text with these votes is good.

    Each rule has, for good and for bad texts, the probabilities that it votes good, votes bad or abstains: its accuracy
    on either kind.  The start takes texts with a vote against them as bad with 0.9, others as good with 0.9.  Maximisation
    counts each rule's votes weighted by the posteriors (one vote of each kind is added); expectation is Bayes' rule with
    independent votes, the share of good texts kept between 0.05 and 0.95.  Only the patterns of votes and their counts are
    needed, at most 3 ** rules rows, so all rounds are one expression on one row.
    """
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    table = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    numbers = range(len(rules))

    def total(state: Column, of) -> Column:
        return F.aggregate(state, F.lit(0.0), lambda s, x: s + of(x))

    def counted(k: int, vote: int, good: bool):
        return lambda x: F.when(x["votes"][k] == vote, x["n"] * (x["p"] if good else 1 - x["p"])).otherwise(F.lit(0.0))

    def step(state: Column, _) -> Column:
        sums = F.struct(
            total(state, lambda x: x["n"] * x["p"]).alias("good"), total(state, lambda x: x["n"] * (1 - x["p"])).alias("bad"),
            *[F.array(*[total(state, counted(k, vote, good)) for k in numbers]).alias(f"{name}{int(good)}")
              for name, vote in (("against", -1), ("for", 1)) for good in (True, False)])

        def weight(m: Column, vote: Column, k: int) -> Column:
            def ratio(one: Column, zero: Column) -> Column:
                return F.log((one + 1) / (m["good"] + 3)) - F.log((zero + 1) / (m["bad"] + 3))
            return (F.when(vote == -1, ratio(m["against1"][k], m["against0"][k])).when(vote == 1, ratio(m["for1"][k], m["for0"][k]))
                    .otherwise(ratio(m["good"] - m["against1"][k] - m["for1"][k], m["bad"] - m["against0"][k] - m["for0"][k])))

        def again(m: Column) -> Column:
            share = F.least(F.greatest(m["good"] / (m["good"] + m["bad"]), F.lit(0.05)), F.lit(0.95))
            return F.transform(state, lambda x: F.struct(
                x["votes"].alias("votes"), x["n"].alias("n"),
                (1 / (1 + F.exp(-(F.log(share / (1 - share)) + sum((weight(m, x["votes"][k], k) for k in numbers), F.lit(0.0)))))).alias("p")))

        return F.transform(F.array(sums), again)[0]

    first = F.transform("patterns", lambda x: F.struct(
        x["votes"].alias("votes"), x["n"].cast("double").alias("n"),
        F.when(F.array_contains(x["votes"], -1), F.lit(0.1)).otherwise(F.lit(0.9)).alias("p")))
    fitted = table.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)).alias("x"))
    return fitted.select(F.col("x.votes").alias("votes"), F.col("x.p").alias("posterior"))


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: dict = RULES,
          rounds: int = ROUNDS, least: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior).

    A text fails the base when it has fewer than 50 words or more than half of them lie in repeated windows of three.
    Others are kept when their posterior quality probability is at least ``least``.  A null or empty text has no words
    and fails; null identifiers and repeated rows are rows like any other; an empty table gives no rows; other columns
    are ignored.
    """
    measured_ = measured(documents, id_column, text_column)
    votes = F.array(*[_vote(*rule) for rule in rules.values()])
    held = cut_lineage(measured_.withColumn("votes", votes))
    model = label_model(held.select("votes"), list(rules), rounds)
    judged = held.join(F.broadcast(model), "votes", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= least)).alias("kept"), "posterior")
