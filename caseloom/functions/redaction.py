"""Ordered redaction of personal data, as one chain of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Pattern name, pattern, ignore case.  Order matters: each
# pattern works on the output of the one before it.
PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", True),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", False),
    ("PHONE_INTL", r"\b\+[0-9]{1,3}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}\b", False),
    ("IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", False),
    ("CC", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", False),
    ("SSN", r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b", False),
    ("URL_CREDS", r"https?://[^:]+:[^@]+@[^\s]+", False),
    ("API_KEY",
     r"\b(?:api[_-]?key|token|secret|password|auth)[=:]\s*[\"']?[A-Za-z0-9_-]{20,}[\"']?", True),
    ("LICENSE", r"\b[A-Z0-9]{4,5}[-\s][A-Z0-9]{4,5}[-\s][A-Z0-9]{4,5}[-\s][A-Z0-9]{4,5}\b", True),
    ("NAME_PREFIX", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", False),
]
STRICT_ONLY = {"NAME_PREFIX"}

#: What a text must hold for a pattern to match, told by a cheap look: any of some literals, or a plain pattern.
NEEDS = {
    "EMAIL": ["@"], "PHONE": "[0-9]{3}", "PHONE_INTL": ["+"], "IP": "[0-9][.][0-9]", "CC": "[0-9]{13}", "SSN": "[0-9]{3}",
    "URL_CREDS": ["://"], "API_KEY": ["=", ":"], "NAME_PREFIX": ["Mr.", "Mrs.", "Ms.", "Dr."],
}


def _active(strict: bool) -> list[tuple[str, Column, Column]]:
    # (?U) keeps word boundaries and white space Unicode-aware on every Java version.
    return [(name, F.lit(("(?iU)" if fold else "(?U)") + pattern), F.lit(f"[REDACTED_{name}]"))
            for name, pattern, fold in PATTERNS if strict or name not in STRICT_ONLY]


def _may_match(name: str, text: Column) -> Column:
    needs = NEEDS.get(name)
    if needs is None:
        return F.lit(True)
    if isinstance(needs, str):
        return F.rlike(text, F.lit(needs))
    held = text.contains(needs[0])
    for literal in needs[1:]:
        held = held | text.contains(literal)
    return held


def redact(text: Column, strict: bool = True) -> Column:
    for _, pattern, mark in _active(strict):
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_with_stats(frame: DataFrame, column: str, strict: bool = True,
                      text_name: str = "redacted_text", counts_name: str = "counts") -> DataFrame:
    """Add the redacted text and a map of hit counts, zero counts left out.

    Two projections per pattern, so a count and its replacement share the text of
    the step before, and only texts with a hit are rewritten; the optimizer does not
    inline them into each other.
    """
    keys, counters = [], []
    staged = frame.withColumn(text_name, F.col(column))
    for name, pattern, mark in _active(strict):
        counter = f"__{counts_name}_{name}"
        hits = F.when(_may_match(name, F.col(text_name)), F.regexp_count(text_name, pattern)).otherwise(F.lit(0))
        staged = staged.withColumn(counter, hits).withColumn(
            text_name, F.when(F.col(counter) > 0, F.regexp_replace(text_name, pattern, mark)).otherwise(F.col(text_name)))
        keys.append(F.lit(name))
        counters.append(counter)
    found = F.map_filter(F.map_from_arrays(F.array(*keys), F.array(*counters)), lambda _, n: n > 0)
    empty = F.from_json(F.lit("{}"), "map<string,int>")
    result = F.struct(F.col(text_name), F.coalesce(found, empty).alias(counts_name))
    kept = [c for c in frame.columns if c not in (text_name, counts_name)]
    # The one-element explode ends the chain: a later filter on the result is not copied back into every step.
    done = staged.select(*kept, F.explode(F.array(result)).alias("__done"))
    return done.select(*kept, f"__done.{text_name}", f"__done.{counts_name}")
