"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page's tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tasks import texts_of

#: Pages of the table that help to train, by their own semantic markup, and the most characters of one: the stated bound.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 40_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose text stays within the running text; every other tag ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr object param math semantics annotation annotation-xml mi mn mo ms mtext "
                    "mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
                    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction menclose".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements left out to their closing tag: without one, the first kind takes the rest of the page, the second is a normal element.
_RAW, _SKIPPED = frozenset("script style template".split()), frozenset("noscript svg iframe".split())
#: What else may stand in a head; anything more ends it, closed or not.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript title".split())
#: An opening tag that ends an open element of the same kind.
_ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())


def _raw_end(page: str, tag: str, at: int) -> int:
    stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return stop.end() if stop else len(page)


def _closings(page: str) -> dict[int, int]:
    """Where each closed element of ``_SKIPPED`` ends, by the end of its opening tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in _SKIPPED}
    at = 0
    while match := _TOKEN.search(page, at):
        at, tag = match.end(), (match[2] or "").lower()
        if match[1]:
            if opened.get(tag):
                ends[opened[tag].pop()] = at
        elif not (match[3] or "").endswith("/"):
            if tag in _RAW:
                at = _raw_end(page, tag, at)
            elif tag in _SKIPPED:
                opened[tag].append(at)
    return ends


@dataclass
class Block:
    """A run of text without a block-level tag inside: its words joined, its ancestors, and how much of it is links."""

    text: str
    path: tuple
    linked: float


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, empty ones left out."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []  # (tag, path with its features)
    parts: list[str] = []
    links = [0, 0]  # open links, characters in links
    at, path, block_path, end = 0, (), (), len(page)
    in_head, in_title, title_open, closings = False, False, False, None

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, block_path, min(1.0, links[1] / len(text))))
            parts.clear()
        links[1] = 0

    while at < end:
        match = _TOKEN.search(page, at)
        text = page[at:match.start() if match else end]
        if in_head and text:
            if in_title or not text.strip():
                text = ""
            else:
                in_head = False
        if text:
            if not parts:
                block_path = path
            parts.append(text)
            if links[0]:
                links[1] += len(text.strip())
        if not match:
            break
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        in_title = False
        if tag in _RAW and not match[1]:
            if not match[3].endswith("/"):
                at = _raw_end(page, tag, at)
            continue
        if tag in _SKIPPED and not match[1]:
            if match[3].endswith("/"):
                continue
            if closings is None:
                closings = _closings(page)
            if at in closings:
                at = closings[at]
                continue
        if tag == "head":
            close()
            in_head = not match[1]
            continue
        if in_head:
            if match[1]:
                continue
            if tag in _HEAD:
                if tag in ("title", "noframes"):
                    stop = None if title_open else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at, title_open = (stop.end(), False) if stop else (at, True)
                    in_title = stop is None
                continue
            in_head = False
        if tag == "br":
            parts.append(" ") if parts else None
            continue
        if tag not in _INLINE:
            close()
        if match[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    path = stack[-1][1] if stack else ()
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
            links[0] = sum(1 for one in stack if one[0] == "a")
            continue
        if tag in _VOID or match[3].endswith("/"):
            continue
        if tag not in _INLINE:
            while stack and stack[-1][0] in _INLINE:
                stack.pop()
            if tag in _ENDS_ITSELF and stack and stack[-1][0] == tag:
                stack.pop()
            path = stack[-1][1] if stack else ()
        if tag in ("a",):
            links[0] += 1
        if tag not in _INLINE:
            path = (*path, tag, *(f".{w}" for names in _NAMES.findall(match[3])
                                  for w in _WORDS.findall(_CAMEL.sub(" ", "".join(names)).lower())))
        stack.append((tag, path))
    close()
    return found


def _bucket(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def text_features(block: Block, before: int, count: int) -> tuple:
    words = block.text.count(" ") + 1
    stops = sum(block.text.count(c) for c in ".,;:")
    return (f"w{_bucket(words, (2, 4, 8, 15, 30, 60))}", f"l{_bucket(block.linked, (0.01, 0.3, 0.7))}",
            f"s{_bucket(stops / words, (0.01, 0.05, 0.1, 0.2))}", f"e{block.text[-1] in '.!?'}",
            "first" if before == 0 else "last" if before == count - 1 else "inner", f"c{block.text[:1] in '©®'}")


@dataclass
class ChainField:
    """Weights of the label "main" against "other" by feature, and of the four transitions and two starts."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def emissions(self, page: list[Block], paths: dict) -> np.ndarray:
        out = np.zeros((len(page), 2))
        weight = self.weights.get
        for k, block in enumerate(page):
            known = paths.get(block.path)
            if known is None:
                if len(paths) > 50_000:
                    paths.clear()
                known = paths[block.path] = sum(weight(f, 0.0) for f in path_features(block.path))
            out[k, 1] = known + sum(weight(f, 0.0) for f in text_features(block, k, len(page)))
        return out

    def viterbi(self, emissions: np.ndarray) -> list[int]:
        """The most probable labels; ties go to "main"."""
        if not len(emissions):
            return []
        (a, b), (c, d) = self.steps.tolist()
        rows = emissions.tolist()
        zero, one = rows[0][0] + float(self.starts[0]), rows[0][1] + float(self.starts[1])
        back = []
        for x, y in rows[1:]:
            from_zero, from_one = zero + a > one + c, zero + b > one + d
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = x + (zero + a if from_zero else one + c), y + (zero + b if from_one else one + d)
        label = 0 if zero > one else 1
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def path_features(path: tuple) -> set[str]:
    return {"bias", *path, f"leaf {next((t for t in reversed(path) if t[0] != '.'), '')}"}


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> ChainField:
    """Fit by stochastic gradient steps (AdaGrad) on the log-likelihood, with forward and backward sums per page."""
    model, draw = ChainField(), np.random.default_rng(seed)
    seen: dict[str, float] = {}
    seen_steps, seen_starts = np.full((2, 2), 1e-6), np.full(2, 1e-6)
    features = [[[*path_features(b.path), *text_features(b, k, len(page))] for k, b in enumerate(page)] for page, _ in pages]
    for _ in range(epochs):
        for number in draw.permutation(len(pages)):
            (page, labels), own = pages[number], features[number]
            if not page:
                continue
            weight = model.weights.get
            emit = np.zeros((len(page), 2))
            emit[:, 1] = [sum(weight(f, 0.0) for f in fs) for fs in own]
            ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
            ahead[0] = emit[0] + model.starts
            for k in range(1, len(page)):
                ahead[k] = emit[k] + np.logaddexp(ahead[k - 1][0] + model.steps[0], ahead[k - 1][1] + model.steps[1])
            for k in range(len(page) - 2, -1, -1):
                behind[k] = np.logaddexp(model.steps[:, 0] + emit[k + 1][0] + behind[k + 1][0], model.steps[:, 1] + emit[k + 1][1] + behind[k + 1][1])
            total = np.logaddexp(*ahead[-1])
            chance = np.exp(ahead + behind - total)
            slope_steps = np.zeros((2, 2))
            for k in range(1, len(page)):
                slope_steps -= np.exp(ahead[k - 1][:, None] + model.steps + emit[k] + behind[k] - total)
                slope_steps[labels[k - 1], labels[k]] += 1
            slope_starts = -chance[0]
            slope_starts[labels[0]] += 1
            seen_steps += slope_steps**2
            seen_starts += slope_starts**2
            model.steps += rate * slope_steps / np.sqrt(seen_steps)
            model.starts += rate * slope_starts / np.sqrt(seen_starts)
            for fs, label, p in zip(own, labels, chance[:, 1].tolist()):
                error = label - p
                if abs(error) < 1e-4:
                    continue
                for f in fs:
                    old = weight(f, 0.0)
                    slope = error - decay * old
                    seen[f] = seen.get(f, 1e-2) + slope * slope
                    model.weights[f] = old + rate * slope / seen[f] ** 0.5
    return model


_MAIN = frozenset(["article", "main"])
_NOT_MAIN = frozenset("nav footer header aside form .ad .ads .comments .comment .sidebar .notice .menu".split())


def by_markup(page: list[Block]) -> list[int] | None:
    """Labels of a page that has an article or main element: what is inside it and not in another part."""
    if not any(_MAIN & set(b.path) for b in page):
        return None
    return [int(bool(_MAIN & set(b.path)) and not _NOT_MAIN & set(b.path)) for b in page]


def fit(pages: DataFrame, html_column: str = "html", sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> ChainField:
    """Train on the labelled template pages and on a bounded sample of the table.

    Of the table's pages of up to ``chars`` characters, the ``sample`` first by a hash of their text are labelled by their
    semantic markup; pages without any are left out.
    """
    from caseloom.llm.labelled_pages import labelled_pages
    text = F.col(html_column).cast("string")
    short = pages.select(text.alias("html")).where(F.length("html") <= chars).withColumn("mark", F.xxhash64("html"))
    # The marks alone find the last page wanted, so no task sends more pages than are used.
    last = short.select("mark").distinct().orderBy("mark").limit(sample).agg(F.max("mark").alias("mark")).first()["mark"]
    wanted = short.where(F.col("mark") <= F.lit(last)).dropDuplicates(["mark"]) if last is not None else short.limit(0)
    rows = wanted.orderBy("mark").collect()
    training = list(labelled_pages())
    for row in rows:
        page = blocks(row["html"])
        labels = by_markup(page)
        if labels is not None:
            training.append((page, labels))
    return train(training)


def extract(pages: DataFrame, model: ChainField, html_column: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars): the main text of each page.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
    line break in page order.  A null or empty page, and a page without a main block, has the empty text; repeated rows
    are rows like any other; an empty table gives no rows; columns outside ``keep`` are ignored.
    """

    def run(batches):
        paths: dict = {}
        for batch in batches:
            texts = []
            for one in texts_of(batch.column("__html")):
                page = blocks(one.as_py())
                labels = model.viterbi(model.emissions(page, paths))
                texts.append("\n".join(b.text for b, label in zip(page, labels) if label))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, "text", "n_chars"])

    names = [f"__{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    rows = pages.select(*[F.col(c).alias(n) for n, c in zip(names, keep)], F.col(html_column).cast("string").alias("__html"))
    found = rows.mapInArrow(run, f"{schema}, text string, n_chars long")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "text", "n_chars")
