"""Main text of web pages: boosted trees judge the blocks of a page's tree, and a tree-wide decoding chooses.

A block is an element that starts a line of its own; what stands inline in it is part of it. Text right below the
page is a block of its own, up to the next block or empty line. The trees see its
tag, tokens of its class, id and role and of those of its ancestors, text and link density of its subtree,
depth, and how it compares with its siblings. Decoding maximises the sum of the blocks' scores, weighted by
their own text, under one rule: a block can only be kept if its parent is. So the choices of ancestors and
descendants never contradict each other.

Nobody labels blocks here, so the trees learn from a bounded sample of pages in two ways: from pages that mark
their article themselves, and from pages made by rule out of the sample's own lines, laid out in many other
ways with known roles (see ``made_page``).
"""

from __future__ import annotations

import html
import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm.boosting import BoostedTrees

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea head annotation annotation-xml".split())
HIDDEN = frozenset("noscript template svg iframe object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror "
    "mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form header button fieldset dialog menu".split())
LISTS = frozenset("ul ol dl li dt dd".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption".split())
# an open element of the first kind ends where one of the second kind starts
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
        "nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
# Tokens of classes, ids and roles that tell what a block is for.
GOOD_TOKENS = frozenset("article body content entry main post story text".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs byline comment comments contentinfo cookie cookies "
    "copyright disclaimer discussion footer form header hidden login masthead menu meta modal nav navbar navigation "
    "newsletter notice notification pagination popup promo recommended related replies reply search share sharing "
    "sidebar signup social sponsor sponsored subscribe tags toolbar warning widget".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # with a quote that nothing ends
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|data-keep)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SAMPLE_PAGES, SAMPLE_BYTES = 300, 50_000


class Page:
    """The blocks of a page, in page order; block 0 is the page. ``pieces``: (block, text) in page order; a piece of
    another block, or a mark of None, ends a line."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth = ["html"], [-1], [0]
        self.good, self.bad, self.keep = [0], [0], [None]
        self.own, self.linked, self.items = [0], [0], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self.run: int | None = None  # the open block of text right below the page
        self.breaks = 0  # line breaks since its last text
        self._parse(source)

    def _block(self, tag: str, parent: int, good: int = 0, bad: int = 0, keep: bool | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.good.append(good)
        self.bad.append(bad)
        self.keep.append(keep)
        for column in (self.own, self.linked, self.items):
            column.append(0)
        return len(self.tag) - 1

    def _ends_line(self, block: int) -> None:
        self.pieces.append((block, None))
        self.run = None

    def _parse(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("html", 0)]  # element and its block
        links, at, end = 0, 0, len(source)
        marked: list[bool] = []  # roles of open inline elements, in pages made for training
        while at < end:
            found = _TAG.search(source, at)
            if found is None:
                self._text(open_[-1][1], source[at:], links, marked)
                break
            if found.start() > at:
                self._text(open_[-1][1], source[at : found.start()], links, marked)
            at = found.end()
            closes, attributes = found[1] or found[4], found[3] or found[6] or ""
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if closes:
                if name == "span":
                    marked.clear()
                if name == "a":
                    links = 0
                if any(name == o for o, _ in open_[1:]):
                    while open_[-1][0] != name:
                        open_.pop()
                    open_.pop()
                    if name not in INLINE and open_[-1][1] >= 0:
                        self._ends_line(open_[-1][1])
                continue
            if open_[-1][1] < 0 and name in ENDED_BY["p"]:
                # a block can't stand in a drawing or a choice: what wasn't closed ends here
                first = next(i for i, (_, b) in enumerate(open_) if b < 0)
                if open_[first][0] in ("svg", "select") and all(o != "foreignobject" for o, _ in open_[first:]):
                    del open_[first:]
            if name in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    at = close.end() if close else (at if name == "head" else end)
                continue
            if name in VOID:
                block = open_[-1][1]
                if block < 0:
                    continue
                if name == "br" or name in INLINE:
                    self.breaks += name == "br"
                    if not block and self.breaks > 1:
                        self.run = None
                    self.pieces.append((self.run if self.run and not block else block, " " if name == "br" else ""))
                else:
                    self._ends_line(block)
                continue
            if name in ("html", "body"):
                continue
            if name in INLINE or name in HIDDEN or (open_[-1][1] < 0 and name not in ENDED_BY["p"]):
                links = 1 if name == "a" else links
                if "data-keep" in attributes:
                    marked[:] = ['"1"' in attributes]
                if not attributes.endswith("/"):
                    open_.append((name, -1 if name in HIDDEN else open_[-1][1]))
                continue
            # the nearest open block element may end here
            for i in range(len(open_) - 1, 0, -1):
                if name in ENDED_BY.get(open_[i][0], ()):
                    del open_[i:]
                    break
                if open_[i][0] not in INLINE and open_[i][0] not in ENDED_BY:
                    break
            links = 0
            parent = open_[-1][1]
            if parent < 0:
                if not attributes.endswith("/"):
                    open_.append((name, -1))
                continue
            good = bad = 0
            keep = None
            for attribute, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if attribute == "data-keep":
                    keep = value == "1"
                elif attribute.lower() == "hidden" or (attribute.lower() == "style" and "display:none" in value.replace(" ", "")):
                    bad += 1
                elif attribute.lower() != "style":
                    tokens = {t.lower() for t in _TOKEN.findall(value)}
                    good += len(tokens & GOOD_TOKENS)
                    bad += len(tokens & BAD_TOKENS)
            block = self._block(name, parent, good, bad, keep)
            self._ends_line(block)
            if not attributes.endswith("/"):
                open_.append((name, block))

    def _text(self, block: int, text: str, links: int, marked: list[bool]) -> None:
        if block < 0:
            return
        if "&" in text:
            text = html.unescape(text)
        if not block:
            if text.strip():
                if self.run is None:
                    self.run = self._block("text", 0, keep=marked[-1] if marked else None)
                self.breaks = 0
            block = self.run or 0
        self.pieces.append((block, text))
        size = len(text.strip())
        self.own[block] += size
        self.linked[block] += size * links
        self.items[block] += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, marks = (np.array(c, np.float64) for c in (self.own, self.linked, self.items))
        text, links, signs, blocks, height = own.copy(), linked.copy(), marks.copy(), np.ones(n), np.zeros(n)
        paragraphs = np.array([t == "p" for t in self.tag], np.float64)
        children, place = np.zeros(n), np.zeros(n)
        longest = np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            links[p] += links[i]
            signs[p] += signs[i]
            blocks[p] += blocks[i]
            paragraphs[p] += paragraphs[i]
            height[p] = max(height[p], height[i] + 1)
            longest[p] = max(longest[p], text[i])
        good, bad = np.array(self.good, np.float64), np.array(self.bad, np.float64)
        tag_good = np.array([t in CONTENT for t in self.tag], np.float64)
        tag_bad = np.array([t in BOILERPLATE for t in self.tag], np.float64)
        above_good, above_bad = np.zeros(n), np.zeros(n)
        parent = np.array(self.parent)
        for i in range(1, n):
            p = self.parent[i]
            place[i] = children[p]
            children[p] += 1
            above_good[i] = above_good[p] + good[p] + tag_good[p]
            above_bad[i] = above_bad[p] + bad[p] + tag_bad[p]
        up = np.maximum(parent, 0)
        total = max(text[0], 1.0)
        return np.stack([
            tag_good, tag_bad, good, bad, above_good, above_bad,
            [t == "p" for t in self.tag], [t in HEADING for t in self.tag], [t in LISTS for t in self.tag],
            [t in TABLES for t in self.tag], [t in ("div", "section") for t in self.tag], [t == "h1" for t in self.tag],
            np.array(self.depth), np.log1p(own), np.log1p(text), text / total, links / np.maximum(text, 1),
            linked / np.maximum(own, 1), signs / np.maximum(text, 1), np.log1p(text / blocks), np.log1p(blocks), height,
            np.log1p(paragraphs), np.log1p(children), np.log1p(children[up]), place / np.maximum(children[up], 1),
            text / np.maximum(longest[up], 1), [t == "text" for t in self.tag],
        ], 1).astype(np.float64)

    def decode(self, raw: np.ndarray) -> np.ndarray:
        """Which blocks to keep: the set that is closed under parents and has the largest sum of scores."""
        n = len(self.tag)
        best = np.tanh(raw / 2) * np.sqrt(np.array(self.own, np.float64) + 0.01)
        for i in range(n - 1, 0, -1):
            best[self.parent[i]] += max(0.0, best[i])
        keep = np.zeros(n, bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and best[i] > 0
        return keep

    def text(self, keep: np.ndarray) -> str:
        """Lines of the kept blocks."""
        lines, line, last = [], [], -1
        for block, piece in self.pieces:
            if block != last or piece is None:
                lines.append("".join(line))
                line, last = [], block
            if piece and block and keep[block]:
                line.append(piece)
        lines.append("".join(line))
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """For training: 1 for blocks of the article, and the weight of each block."""
        n = len(self.tag)
        label = np.zeros(n)
        marked = any(k is not None for k in self.keep)
        state = [False] * n
        for i in range(1, n):
            state[i] = state[self.parent[i]]
            if marked:
                state[i] = state[i] if self.keep[i] is None else self.keep[i]
            elif self.tag[i] in CONTENT:
                state[i] = True
            if not marked and (self.tag[i] in BOILERPLATE or self.bad[i]):
                state[i] = False
            label[i] = state[i]
        # a wrapper of kept blocks must be kept
        for i in range(n - 1, 0, -1):
            if label[i]:
                label[self.parent[i]] = 1
        return label, np.minimum(4.0, 1 + np.log1p(np.array(self.own)))


def made_page(rng: random.Random, lines: list[str]) -> str:
    """A page laid out by rule, with ``data-keep`` on blocks of known role."""

    def some(low: int, high: int) -> str:
        return html.escape(" ".join(rng.choice(lines) for _ in range(rng.randint(low, high))))

    def short() -> str:
        return html.escape(rng.choice(lines)[: rng.randint(4, 40)])

    def named(tag: str, names: str, inner: str, keep: int) -> str:
        name = rng.choice(names.split())
        attribute = rng.choice([f'class="{name}"', f'id="{name}"', f'class="x {name}-box"', f'id="{name}1"'])
        return f'<{tag} {attribute} data-keep="{keep}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(n)) + "</ul>"

    def boiler() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return rng.choice([f'<nav data-keep="0">{links(rng.randint(2, 8))}</nav>', named("div", "nav menu navbar breadcrumb", links(4), 0)])
        if kind == 1:
            return rng.choice([f'<aside data-keep="0"><h3>{short()}</h3>{links(4)}</aside>', named("div", "sidebar widget related recommended", f"<h3>{short()}</h3><p>{some(1, 3)}</p>", 0)])
        if kind == 2:
            return named("div", "ad ads advert sponsored promo banner", rng.choice([some(1, 3), f"<p>{some(1, 4)}</p>"]), 0)
        if kind == 3:
            return named("div", "cookie notice alert disclaimer notification warning", f"<p>{some(1, 3)}</p>", 0)
        if kind == 4:
            return f'<form data-keep="0"><label>{short()}</label><input name="q"><button>{short()}</button><p>{some(1, 2)}</p></form>'
        if kind == 5:
            posts = "".join(f"<div><p>{some(1, 3)}</p></div>" for _ in range(rng.randint(1, 5)))
            return rng.choice([named("section", "comments comment replies discussion", f"<h3>{short()}</h3>{posts}", 0), named("div", "comments comment replies discussion", posts, 0), named("ol", "comments comment", f"<li>{some(1, 3)}</li><li><p>{some(1, 3)}</p></li>", 0)])
        if kind == 6:
            return named("div", "share social subscribe newsletter tags", rng.choice([links(3), f"<p>{some(1, 2)}</p>"]), 0)
        if kind == 7:
            return rng.choice([f'<header data-keep="0"><p>{short()}</p>{links(2)}</header>', named("div", "header masthead toolbar login search", f"<p>{short()}</p>", 0)])
        return rng.choice([f'<footer data-keep="0"><p>{some(1, 2)}</p></footer>', f'<footer data-keep="0">{some(1, 3)}</footer>', named("div", "footer copyright", some(1, 2), 0)])

    def content() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            return f"<h2>{short()}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{some(1, 2)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{some(1, 3)}</p></blockquote>"
        if kind == 3:
            return f"<table><tr><td>{short()}</td><td>{short()}</td></tr><tr><td>{some(1, 2)}</td><td>{short()}</td></tr></table>"
        if kind == 4:
            return f'<p>{some(1, 3)} <a href="/x">{short()}</a> {some(1, 2)}</p>'
        if kind == 5:
            return f"<p>{short()}</p>"
        if kind == 6:
            return f"<p><b>{some(1, 3)}<br><p>{some(1, 3)}</p>"
        if kind == 7:
            return f"<pre>{some(1, 2)}</pre>"
        return f"<p>{some(1, 8)}</p>"

    def line(keep: int) -> str:
        if keep:
            text = rng.choice([some(1, 6), some(2, 8), f'{some(1, 3)} <a href="/x">{short()}</a> {some(1, 2)}', f"<b>{short()}</b>"])
        else:
            text = rng.choice([" | ".join(f'<a href="/{i}">{short()}</a>' for i in range(rng.randint(2, 7))), f"&copy; {short()}"])
        return f'<span data-keep="{keep}">{text}</span>' + rng.choice(["<br><br>", "<br>\n<br>", "<hr>"])

    if rng.random() < 0.15:  # lines right below the page
        inner = [f'<h1 data-keep="1">{short()}</h1>'] * (rng.random() < 0.6)
        for _ in range(rng.choice([1, 2, 4, 8])):
            inner.append(f'<p data-keep="1">{some(1, 6)}</p>' if rng.random() < 0.15 else line(1))
        before, after = ([rng.choice([boiler, lambda: line(0)])() for _ in range(rng.choice([0, 0, 1, 2]))] for _ in range(2))
        return f"<html><body>{''.join(before + inner + after)}</body></html>"

    inner = [f"<h1>{short()}</h1>"] * (rng.random() < 0.8)
    for _ in range(rng.choice([1, 2, 4, 8, 16])):
        inner.append(content())
        if rng.random() < 0.12:
            inner.append(boiler())
    inner += [boiler() for _ in range(rng.choice([0, 0, 1]))]
    text = "".join(inner)
    wrap = rng.randrange(6)
    if wrap < 2:
        text = f'<article data-keep="1">{text}</article>'
    elif wrap == 2:
        text = f'<main data-keep="1">{text}</main>'
    elif wrap == 3:
        text = named("div", "content article post entry story main", text, 1)
    elif wrap == 4:
        text = named("section", "content article post entry story main", f"<div>{text}</div>", 1)
    else:
        text = f'<div data-keep="1">{text}</div>'
    parts = [boiler() for _ in range(rng.randint(1, 4))] + [text] + [boiler() for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.3:
        parts = [f'<div class="{rng.choice(["page", "wrapper", "container", "x1"])}">', *parts, "</div>"]
    return f"<!DOCTYPE html><html><head><title>{short()}</title></head><body>{''.join(parts)}</body></html>"


def _trained(table: pa.Table) -> pa.Table:
    sources = sorted(table.column("html").to_pylist())
    rng = random.Random(13)
    pages = [Page(s) for s in sources]
    lines = [x for p in pages for x in p.text(np.ones(len(p.tag), bool)).split("\n") if x][:5000]
    # a line of a page may be its whole text; made pages need lines of usual length
    lines = [x[:400] for x in lines] or ["Some words, and others.", "One more line of text.", "Short", "A longer line of text, with a part."]
    pages = [p for p in pages if any(t in CONTENT for t in p.tag)]
    pages += [Page(made_page(rng, lines)) for _ in range(2 * SAMPLE_PAGES)]
    x = np.concatenate([p.features()[1:] for p in pages])
    label, weight = (np.concatenate(c) for c in zip(*((a[1:], b[1:]) for a, b in (p.labels() for p in pages))))
    model = BoostedTrees().fit(x, label, weight)
    return pa.table({"model": [json.dumps([model.base, model.depth, model.trees])]})


def fit_blocks(pages: DataFrame) -> BoostedTrees:
    """Fit on the ``SAMPLE_PAGES`` pages with the smallest hash, of those up to ``SAMPLE_BYTES`` long, in one task."""
    sample = (
        pages.filter(F.octet_length("html").between(1, SAMPLE_BYTES))
        .orderBy(F.xxhash64("html"), "html")
        .limit(SAMPLE_PAGES)
        .select("html")
    )
    none = pages.sparkSession.createDataFrame([("",)], "html string")  # made pages are enough to learn from
    found = sample.union(none).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_trained, "model string").first()
    base, depth, trees = json.loads(found.model)
    return BoostedTrees(base, depth, trees)


def extract_text(source: str | None, model: BoostedTrees) -> str:
    return _texts([source], model)[0]


def _texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    raw = model.raw(np.concatenate([p.features() for p in pages])) if pages else []
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        out.append(page.text(page.decode(raw[at : at + n])))
        at += n
    return out


def _extracted(model):
    def run(batches):
        for batch in batches:
            texts = []
            for i in range(0, batch.num_rows, 256):
                texts += _texts(batch.column("html").slice(i, 256).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html; other columns are ignored).

    text: the lines of the article, one for each block, in page order, joined by one newline; character
    references are decoded and white space within a line becomes one space. Text right below the body is judged like
    other blocks; an empty line, made of two line breaks, ends such a block. n_chars: its code points. A null or
    empty page, and one without an article, has an empty text. Unclosed tags end where their parent does, a drawing and a choice also where a block begins; unclosed scripts, styles,
    titles and text areas take the rest of the page, as in a browser. A tag whose quote nothing ends, ends at its first
    ``>``. A page
    that breaks off is read as far as it goes. Repeated rows and null ids keep their row; an empty table gives no
    rows. The sample bounds the training only; every page is read whole."""
    model = pages.sparkSession.sparkContext.broadcast(fit_blocks(pages.select("html")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extracted(model), "page_id long, url string, text string, n_chars long"
    )
