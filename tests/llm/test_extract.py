import html
import random
import re

import numpy as np
import pytest

from case_insights.llm.boosting import BoostedTrees
from case_insights.llm.entry import queries
from case_insights.llm.extract import Page, extract_text, fit_blocks, made_page, main_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_blocks(spark.read.parquet(f"{SF}/pages.parquet").select("html"))


def test_trees_learn_interactions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:1500], y[:1500], np.ones(1500))
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def article(source):
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_articles_of_the_table(spark):
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries()["op6_main_text"](spark, SF).collect()
    assert len(rows) == len(sources)
    for r in rows:
        assert r.text == article(sources[r.page_id]) and r.n_chars == len(r.text)


def test_unseen_layouts(model):
    rng = random.Random(77)
    lines = ["Some words, and others.", "One more line of the text, longer than that.", "Short"]
    right = wrong = 0
    for _ in range(200):
        page = Page(made_page(rng, lines))
        label, _ = page.labels()
        keep, own = page.decode(model.raw(page.features())), np.array(page.own)
        right += own[1:][label[1:] == keep[1:]].sum()
        wrong += own[1:][label[1:] != keep[1:]].sum()
    assert wrong / (right + wrong) < 0.03


def test_choices_are_closed_under_parents(model):
    rng = random.Random(5)
    for _ in range(50):
        page = Page(made_page(rng, ["a b c.", "d e f g h, i."]))
        keep = page.decode(np.random.default_rng(rng.randrange(99)).normal(size=len(page.tag)))
        assert all(keep[p] for p, k in zip(page.parent[1:], keep[1:]) if k)


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("<p", ""), ("plain text", "plain text"), ("<html><body></body></html>", ""),
        (
            "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One &lt;two&gt;\n "
            "<b>three</b><br>four &eacute;.</p><script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> -->"
            "<p>Five, six.<p>Seven<i>teen</i>.</article><footer>&copy; x</footer></body></html>",
            "A & B\nOne <two> three four é.\nFive, six.\nSeventeen.",
        ),
        (
            "<body><header><p>Site</p></header><main><h1>Title</h1><p>First, a line of text.</p><div class='ad'>Buy now.</div>"
            "<p>Second, a line of text.</p><section class='comments'><h3>Comments</h3><div><p>I like it, very much.</p></div>"
            "</section></main><aside><h3>Related</h3><ul><li><a href=y>Else</a></li></ul></aside>"
            "<form><p>Subscribe</p><input></form></body>",
            "Title\nFirst, a line of text.\nSecond, a line of text.",
        ),
        (
            "<body><div class='cookie-notice'><p>We use cookies, as all do.</p></div><div id='content'><h1>Title</h1>"
            "<p>First, a line of text, that is long enough.</p><p>Second one, that goes on and on.",
            "Title\nFirst, a line of text, that is long enough.\nSecond one, that goes on and on.",
        ),
    ],
)
def test_pages(model, source, text):
    assert extract_text(source, model) == text


LINES = ("First line of the article, which goes on for a while.", "Second, it ends here, after some more words, as lines do.")


@pytest.mark.parametrize(
    "source, text",
    [
        (f"<body><h1>Title</h1>{LINES[0]}<br><br>{LINES[1]}</body>", ["Title", *LINES]),
        (f"<body><a href=/>Home</a> | <a href=/n>News</a><hr><b>{LINES[0]}</b><br><br>{LINES[1]}<footer>&copy; x</footer>", LINES),
        (f"<article><p>{LINES[0]} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>{LINES[1]}</p></article>", [f"{LINES[0]} x=1", LINES[1]]),
        *(
            (f"<article><p>{LINES[0]} <{tag}><option>no</p><p>{LINES[1]}</p></article><footer>&copy; x</footer>", LINES)
            for tag in ("svg", "select", "object", "canvas", "iframe")
        ),
        (f"<article><svg><path d='M0'/><text>no</text><p>{LINES[0]}</p><p>{LINES[1]}</p></article>", LINES),
        (f"<article><p>{LINES[0]}</p><svg><text>no</text><foreignObject><p>no</p></foreignObject></svg><p>{LINES[1]}</p></article>", LINES),
        (f'<article><p class="x>{LINES[0]}</p><p>{LINES[1]}</p></article>', LINES),
        (f'<article><p class="x>{LINES[0]}</p><p class="y">{LINES[1]}</p></article>', LINES),
    ],
)
def test_broken_and_plain_pages(model, source, text):
    assert extract_text(source, model).split("\n") == list(text)


def test_odd_rows(spark):
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "t", 1), (None, "u", "", "t", 1), (2, "u", long, "t", 1), (2, "u", long, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = main_text(pages).collect()
    whole = "\n".join(["word, word."] * 20_000)
    assert sorted((r.n_chars, r.text) for r in found) == [(0, ""), (0, ""), (len(whole), whole), (len(whole), whole)]
    assert main_text(pages.limit(0)).collect() == []
