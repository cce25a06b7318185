"""Labelled pages for training: templates of page parts, filled with made-up words; every block's label is known."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas ul ve or in da pe shi gon ber tal nu es qua rin do".split()
#: Names under which pages file their parts.
_MAIN_BOXES = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry"), ("section", "story"),
               ("div", "article-text"), ("div", "main"), ("article", "post"), ("div", "page-content")]
_OTHER = {
    "menu": [("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navbar"), ("div", "breadcrumbs"), ("nav", "navigation")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "top-bar"), ("div", "site-header")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer"), ("div", "bottom")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("aside", "popular"), ("div", "tags"),
                ("div", "share"), ("div", "social"), ("div", "author-box"), ("div", "recommended")],
    "notice": [("div", "cookie"), ("div", "notice"), ("div", "banner"), ("div", "alert"), ("div", "consent"), ("div", "gdpr"),
               ("div", "popup"), ("div", "modal"), ("div", "message"), ("div", "disclaimer")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("aside", "promo"),
               ("div", "sponsor"), ("ins", "adsbygoogle")],
    "form": [("form", ""), ("div", "newsletter"), ("div", "subscribe"), ("form", "search"), ("div", "signup"), ("div", "login")],
    "comments": [("section", "comments"), ("div", "comment"), ("ol", "commentlist"), ("div", "replies"), ("div", "reply"),
                 ("div", "discussion"), ("section", "responses"), ("div", "disqus")],
}


class _Writer:
    def __init__(self, draw: random.Random):
        self.draw = draw

    def word(self) -> str:
        return "".join(self.draw.choice(_SYLLABLES) for _ in range(self.draw.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(low, high))).capitalize()

    def prose(self, low: int = 1, high: int = 7) -> str:
        sentences = []
        for _ in range(self.draw.randint(low, high)):
            words = self.words(2, 20).split()
            sentences.append(" ".join(w + ("," if self.draw.random() < 0.08 else "") for w in words) + ".")
        return " ".join(sentences)


def _main(w: _Writer) -> list[tuple[str, tuple, float]]:
    """(text, path below the box, share of links) of an article's blocks."""
    out = [(w.words(2, 14), ("h1",), 0.0)] if w.draw.random() < 0.8 else []
    for _ in range(w.draw.randint(1, 9)):
        kind = w.draw.random()
        if kind < 0.75:
            out.append((w.prose(1, w.draw.choice([1, 4, 9])), ("p",), 0.0 if w.draw.random() < 0.9 else 0.1))
        elif kind < 0.83:
            out.append((w.words(1, 8), (w.draw.choice(["h2", "h3"]),), 0.0))
        elif kind < 0.9:
            out += [(w.words(2, 14), ("ul", "li"), 0.0) for _ in range(w.draw.randint(1, 4))]
        elif kind < 0.94:
            out.append((w.prose(1, 3), ("blockquote",), 0.0))
        elif kind < 0.97:
            out.append((w.words(3, 12), ("pre",), 0.0))
        else:
            out += [(w.words(1, 4), ("table", "tr", "td"), 0.0) for _ in range(w.draw.randint(1, 4))]
    if w.draw.random() < 0.1:
        out.append((w.prose(1, 2), (), 0.0))
    return out


def _other(w: _Writer, kind: str) -> list[tuple[str, tuple, float]]:
    if kind == "menu":
        return [(w.words(1, 2), ("ul", "li"), 1.0) for _ in range(w.draw.randint(2, 8))]
    if kind == "header":
        return [(w.words(1, 5), (w.draw.choice(["div", "h1", "p", "a"]),), w.draw.choice([0.0, 1.0])) for _ in range(w.draw.randint(1, 3))]
    if kind == "footer":
        return [(w.draw.choice(["© ", ""]) + w.draw.choice([w.words(1, 6), w.prose(1, 3)]), w.draw.choice([(), ("p",)]), w.draw.choice([0.0, 0.0, 0.5]))
                for _ in range(w.draw.randint(1, 2))]
    if kind == "form":
        return [(w.draw.choice([w.words(1, 8), w.prose(1, 2)]), (w.draw.choice(["label", "p", "div"]),), 0.0) for _ in range(w.draw.randint(1, 3))]
    if kind == "sidebar":
        return [(w.words(1, 3), ("h3",), 0.0), *[(w.words(2, 9), w.draw.choice([("ul", "li"), ("p",), ("div",)]), w.draw.choice([0.0, 1.0]))
                                               for _ in range(w.draw.randint(1, 4))]]
    if kind == "comments":
        return [(w.words(1, 2), ("h3",), 0.0), *[(w.prose(1, 4), w.draw.choice([("p",), ("li",), ("div", ".comment", "p")]), 0.0)
                                               for _ in range(w.draw.randint(1, 5))]]
    return [(w.draw.choice([w.words(1, 12), w.prose(1, 4)]), w.draw.choice([(), ("p",), ("div",)]), w.draw.choice([0.0, 0.0, 0.5]))
            for _ in range(w.draw.randint(1, 2))]


def _box(draw: random.Random, boxes: list) -> tuple:
    tag, name = draw.choice(boxes)
    return (tag, *(f".{part}" for part in name.split("-") if part))


def labelled_pages(count: int = 500, seed: int = 17):
    """(blocks, labels) of pages; label 1 is main text.

    ``count`` pages have parts drawn at random, adverts, notices and asides within articles too.  Then every name of a part
    stands within an article eight times.
    """
    from caseloom.llm.html_extract import Block
    draw = random.Random(seed)
    w = _Writer(draw)
    for _ in range(count):
        outer = ("html", "body", *(("div", f".{draw.choice(['wrapper', 'container', 'page', 'layout'])}") if draw.random() < 0.4 else ()))
        page: list = []
        labels: list[int] = []

        def add(rows, path, label, page=page, labels=labels):
            page.extend(Block(text, (*path, *below), linked) for text, below, linked in rows)
            labels.extend([label] * len(rows))

        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if draw.random() < 0.45]
        draw.shuffle(before)
        for kind in before:
            add(_other(w, kind), (*outer, *_box(draw, _OTHER[kind])), 0)
        box = (*outer, *_box(draw, _MAIN_BOXES))
        rows = _main(w)
        cut = draw.randint(0, len(rows))
        add(rows[:cut], box, 1)
        for kind in ("advert", "sidebar", "notice", "form", "comments", "header", "footer", "menu"):
            if draw.random() < 0.4:
                add(_other(w, kind), (*box, *_box(draw, _OTHER[kind])), 0)
        add(rows[cut:], box, 1)
        if draw.random() < 0.15:
            add(_other(w, "comments"), (*box, *_box(draw, _OTHER["comments"])), 0)
        after = [k for k in ("comments", "sidebar", "advert", "form", "footer", "notice") if draw.random() < 0.45]
        for kind in after:
            add(_other(w, kind), (*outer, *_box(draw, _OTHER[kind])), 0)
        yield page, labels
    for kind, names in _OTHER.items():
        for tag, name in names * 8:
            box = ("html", "body", *_box(draw, _MAIN_BOXES))
            part = (*box, tag, *(f".{one}" for one in name.split("-") if one))
            inner = [(w.prose(1, 1), ("p",), 0.0)] if draw.random() < 0.6 else _other(w, kind)
            rows = [(r, box, 1) for r in _main(w)] + [(r, part, 0) for r in inner] + [(r, box, 1) for r in _main(w)]
            yield [Block(text, (*path, *below), linked) for (text, below, linked), path, _ in rows], [label for *_, label in rows]
