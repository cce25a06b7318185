import pytest

from caseloom.llm.html_extract import ChainField, blocks, extract, fit, train
from caseloom.llm.labelled_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body>
<header><a href="/">Home of things</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 text,   with&nbsp;space.<br>Same block.<p>Second one is unclosed, and goes on for a while.
<div class="ad"><p>Buy this now.</p></div><ul><li>Item one is listed.</li><li>Item two</li></ul>
<pre>x &lt; y</pre><!-- <p>hidden</p> --></article>
<section class="comments"><h3>Comments</h3><p>I liked it, thanks a lot.</p></section>
<aside class="sidebar"><p>Related things to read.</p></aside><form><label>Name</label><input></form>
<footer>&copy; me</footer>"""
MAIN = "A & B\nFirst bold text, with space. Same block.\nSecond one is unclosed, and goes on for a while.\nItem one is listed.\nItem two\nx < y"


@pytest.fixture(scope="module")
def model():
    return train(list(labelled_pages()))


def run(spark, model, pages):
    rows = spark.createDataFrame([(k, "u", page, "extra") for k, page in enumerate(pages)], "page_id long, url string, html string, text string")
    return [r["text"] for r in sorted(extract(rows, model).collect(), key=lambda r: r["page_id"])]


def test_whole_page(spark, model):
    assert run(spark, model, [PAGE]) == [MAIN]


def test_odd_pages(spark, model):
    long = "<html><body><article>" + "<p>Some words of an article, one after the other.</p>" * 5000 + "</article></body></html>"
    got = run(spark, model, [None, "", "<", "<<>><p", "<script>x", "<!-- open", "<article><p>Cut off in the mid", long])
    assert got[:2] == ["", ""] and got[4:6] == ["", ""]
    assert got[7].count("\n") == 4999
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(rows, model).count() == 0
    assert isinstance(fit(rows), ChainField)


def texts(page):
    return [b.text for b in blocks(page)]


def test_head_ends_where_the_body_starts():
    article = "<article><p>One.<p>Two.</article>"
    meta = '<meta charset="utf-8"><link href="a"><title>T <b> t</title><style>p{}</style><script>var a = "<p>no</p>";</script>'
    for page in (f"<html><head>{meta}{article}", f"<html><head>{meta}</head>{article}", f"<head>{meta}<body>{article}",
                 f"<head>{meta}</head><body>{article}</body>", f"<head><noscript><img></noscript>{meta}\n{article}", f"<head><title>T{article}"):
        assert texts(page) == ["One.", "Two."]
    assert texts("<head><title>T</title>Plain text.<p>One.") == ["Plain text.", "One."]


def test_unclosed_elements_keep_the_rest():
    for tag in ("noscript", "svg", "object", "iframe", "math"):
        assert texts(f"<p>One.</p><{tag}><p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
    for tag in ("noscript", "svg", "iframe"):
        assert texts(f"<p>One.</p><{tag}>no</{tag}><p>Two.</p><{tag}/><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert texts(f"<{tag}><p>One.</p><{tag}>no</{tag}><p>Two.</p>") == ["One.", "Two."]
    assert texts("<svg><svg>no</svg>no</svg><p>One.</p><script>no <p>no</p>") == ["One."]


def test_formulas_and_fallbacks_stay_in_their_paragraph():
    assert texts("<p>As <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds.</p>") == ["As x=2 holds."]
    assert texts('<p>See <object data="a"><param name="b">the picture</object> here.</p>') == ["See the picture here."]


def test_skipped_elements_do_not_cut_a_paragraph():
    for tag in ("script", "style", "template", "noscript", "svg", "iframe"):
        assert texts(f"<p>One <{tag}>no</{tag}>line.</p>") == ["One line."]


def test_labels_of_other_pages(model):
    wrong = total = 0
    for page, labels in labelled_pages(100, seed=99):
        found = model.viterbi(model.emissions(page, {}))
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        inside = row["html"].split("<article>")[1].split("</article>")[0]
        assert row["text"] == "\n".join(b.text for b in blocks("<article>" + inside + "</article>"))
        assert row["n_chars"] == len(row["text"])
