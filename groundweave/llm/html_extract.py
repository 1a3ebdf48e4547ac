"""Main text of web pages: a tree-structured graphical model over DOM blocks.

Each block-level element is a binary variable, content or not. Its features (tag, words
of class, id and role, size of its own text, share of it in links) give a node potential
by logistic weights; parent and child are joined by a potential that depends on the sort
of the parent. Sum-product message passing, children to parents and then back, gives
exact marginals on the tree; a block's text is kept when its marginal reaches 0.5.

Weights and pair potentials are learned from labelled pages which ``labelled_pages``
makes: page skeletons of many kinds, each element labelled by what put it there. On a part
of them the names say nothing, so that the shape of a page counts too: its sizes, links,
punctuation, tags and what share of the page's text an element holds. Node weights are
fitted by logistic regression, pair potentials from the labels' counts.

Blocks: character references are decoded, runs of white space (line breaks included) are
one space, ends trimmed; blocks follow page order, joined by a line end. Scripts, styles,
form controls and the like hold no text. What is left open loses no page: an element of
that sort without an end is passed over, and a control ends where a paragraph, heading,
list, table or section begins. Parsing and inference are linear in the page, however deep.

Null html counts as empty: empty text, 0 characters. Null ids and urls are carried along;
repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element sorts.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("script style template noscript title iframe object canvas audio video select textarea button label datalist".split())
CONTROL = set("title select textarea button label datalist".split())
ENDS_CONTROL = set("p h1 h2 h3 h4 h5 h6 article section main nav header footer aside ul ol dl table blockquote pre form hr".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"table", "td", "th"}}
ROOT_SORT, GROUP_SORT, LEAF_SORT = 0, 1, 2
GROUPS = set("div section article main center td tr tbody table form".split())
NAMED = set("nav footer header aside form menu address".split())  # their tag says more than their text
#: For a tag, the elements that its start closes, each unless one of its fence is nearer.
CLOSES = {tag: [c for c, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
_END = re.compile(r"</([a-zA-Z]+)")


class Page(HTMLParser):
    """Blocks of a page in order: parent, features' raw material, and runs of text with the block each belongs to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.words = ["html"], [-1], [()]
        self.size, self.linked, self.marks = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.labels: list[int] = [0]
        self.stack: list[tuple[str | None, int]] = []  # (tag or None where it has ended already, block or -1 for others)
        self.open: dict[str, list[int]] = {}  # places of open elements by tag
        self.blocks: list[int] = []  # places of open blocks
        self.ends: dict[str, int] = {}  # end tags that are still to come
        self.block, self.links, self.silent = 0, 0, 0
        self.buffer: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.runs.append((self.block, text))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append(" ")
            return
        for closed in CLOSES.get(tag, ()):
            self._close(closed, FENCE.get(closed, ()))
        if self.silent and tag in ENDS_CONTROL:
            for control in CONTROL:
                if self.open.get(control):
                    self._drop(self.open[control][-1])
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in SILENT and self.ends.get(tag, 0) <= len(self.open.get(tag, ())):
            return
        if tag == "a":
            self.links += 1
        if tag in SILENT:
            self.silent += 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.flush()
            named = dict(attrs)
            self.tags.append(tag)
            self.parents.append(self.block)
            self.words.append(tuple(_name_words(named)))
            self.size.append(0)
            self.linked.append(0)
            self.marks.append(0)
            self.labels.append(int(named.get("data-keep") == "1") if "data-keep" in named else -1)
            self.block = len(self.tags) - 1
            self.blocks.append(len(self.stack))
            self.stack.append((tag, self.block))
        else:
            self.stack.append((tag, -1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self.handle_endtag(tag)

    def _close(self, tag: str, fence) -> None:
        places = self.open.get(tag)
        if places and all(not self.open.get(f) or self.open[f][-1] < places[-1] for f in fence):
            self._pop_to(places[-1])

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, block = self.stack.pop()
            if block >= 0:
                self.flush()
                self.block = self.parents[block]
                self.blocks.pop()
            if tag:
                self.open[tag].pop()
                self._left(tag)

    def _drop(self, k: int) -> None:
        """Ends the element at place k, which no other of its tag follows, and no other."""
        tag = self.stack[k][0]
        if self.stack[k][1] >= 0:
            self._pop_to(k)
            return
        self.stack[k] = (None, -1)
        self.open[tag].pop()
        self._left(tag)

    def _left(self, tag: str) -> None:
        if tag == "a":
            self.links -= 1
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in self.ends:
            self.ends[tag] -= 1
        places = self.open.get(tag)
        if not places:
            return
        if tag in BLOCK or not self.blocks or self.blocks[-1] < places[-1]:
            self._pop_to(places[-1])
        else:  # an inline end inside another block ends nothing else
            self._drop(places[-1])

    def handle_data(self, data):
        if self.silent or not data:
            return
        self.buffer.append(data)
        n = len(data) - data.count(" ")
        self.size[self.block] += n
        if self.links:
            self.linked[self.block] += n
        self.marks[self.block] += data.count(".") + data.count(",") + data.count("。")

    def done(self) -> Page:
        self.close()
        self._pop_to(0)
        self.flush()
        return self


def parse(html: str) -> Page:
    page = Page()
    for tag in map(str.lower, _END.findall(html)):
        page.ends[tag] = page.ends.get(tag, 0) + 1
    page.feed(html)
    return page.done()


def _name_words(named: dict) -> set[str]:
    out = set()
    for key in ("class", "id", "role", "aria-label", "itemprop"):
        for word in re.findall(r"[A-Za-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named.get(key) or "")):
            out.add(word.lower())
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style") or ""):
        out.add("*hidden")
    return out


def _features(page: Page) -> list[list[str]]:
    """Of each block: its tag and its parent's, its own text and what it holds with all below it."""
    n = len(page.tags)
    text, linked = list(page.size), list(page.linked)
    for i in range(n - 1, 0, -1):
        text[page.parents[i]] += text[i]
        linked[page.parents[i]] += linked[i]
    plain = max(1, text[0] - linked[0])
    out = []
    for i in range(n):
        size = page.size[i]
        found = [f"tag={page.tags[i]}", f"under={page.tags[page.parents[i]] if i else ''}", f"size={min(6, int(math.log2(size + 1) / 1.6))}" if size else "size=none"]
        if size:
            found.append(f"links={int(4 * page.linked[i] / size)}")
            found.append(f"marks={min(3, page.marks[i])}")
        if text[i] and page.tags[i] not in NAMED:
            found.append(f"holds={min(4, int(5 * (text[i] - linked[i]) / plain))}")
            found.append(f"all links={int(4 * linked[i] / text[i])}")
        out.append(found + [f"word={w}" for w in page.words[i]])
    return out


def _sort(page: Page, i: int) -> int:
    return ROOT_SORT if page.tags[i] in ("html", "body") else GROUP_SORT if page.tags[i] in GROUPS else LEAF_SORT


def marginals(page: Page, weights: dict[str, float], pairs: np.ndarray) -> list[float]:
    """P(content) of each block, exactly, by one pass up and one down the tree."""
    n = len(page.tags)
    bias = weights.get("bias", 0.0)
    node = [bias + sum([weights.get(f, 0.0) for f in found]) for found in _features(page)]
    up = [[0.0, v] for v in node]  # log potentials of (not content, content) with the children's messages
    message = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        parent = page.parents[i]
        pair = pairs[_sort(page, parent)]
        message[i] = tuple(_log_sum(pair[p][0] + up[i][0], pair[p][1] + up[i][1]) for p in (0, 1))
        up[parent][0] += message[i][0]
        up[parent][1] += message[i][1]
    belief = [up[0]] + [[0.0, 0.0]] * (n - 1)
    for i in range(1, n):
        parent = page.parents[i]
        pair = pairs[_sort(page, parent)]
        rest = [belief[parent][p] - message[i][p] for p in (0, 1)]
        top = max(rest)
        rest = [rest[0] - top, rest[1] - top]
        belief[i] = [up[i][c] + _log_sum(rest[0] + pair[0][c], rest[1] + pair[1][c]) for c in (0, 1)]
    return [1 / (1 + math.exp(min(700.0, max(-700.0, b[0] - b[1])))) for b in belief]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


# Words that name the parts of a page in its markup.
_BOILER = "nav menu navbar header masthead topbar footer foot copyright sidebar rail widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert gdpr popup modal overlay comments comment reply respond disqus discussion feedback share social follow related recommended trending breadcrumb breadcrumbs pagination pager subscribe newsletter signup login search form tags toolbar skip disclaimer paywall".split()
_CONTENT = "article content post entry main story body text page document prose single".split()


def labelled_pages(count: int = 600, seed: int = 11, muted: float = 0.35) -> list[str]:
    """Pages whose elements carry data-keep: 1 on content, 0 on the rest."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstlnmdcpvbg") for _ in range(r.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", "!", ""])
    many = lambda a, b: " ".join(said(4, 16) for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{said(1, 3)}</a>'

    mute = False  # on such pages names say nothing

    def named(words, keep, tag="div"):
        attr = r.choice(["class", "class", "id"])
        return f'<{tag} {attr}="{word() if mute else r.choice(words)}{r.choice(["", "", "-" + word(), " " + word()])}" data-keep="{keep}">'

    def paragraph(keep, a=1, b=6):
        kind = r.random()
        body = many(a, b) if kind < 0.8 else said(1, 4)
        if kind > 0.9:
            body += " " + link() + " " + said(1, 8)
        return f'<p data-keep="{keep}">{body}</p>'

    def listing(keep, linked):
        items = "".join(f'<li data-keep="{keep}">{link() if linked else said(2, 14)}</li>' for _ in range(r.randint(2, 8)))
        return f'<ul data-keep="{keep}">{items}</ul>'

    def boiler():
        kind = r.randrange(9)
        if kind == 0:
            return f'<nav data-keep="0">{listing(0, True)}</nav>'
        if kind == 1:
            return f'<footer data-keep="0">{r.choice([said(2, 12), paragraph(0, 1, 1) + listing(0, True)])}</footer>'
        if kind == 2:
            return f'<header data-keep="0">{r.choice([link(), said(1, 5), "<h1 data-keep=0>" + said(1, 4) + "</h1>" + listing(0, True)])}</header>'
        if kind == 3:
            return f'<aside data-keep="0">{r.choice([paragraph(0), listing(0, True), "<h3 data-keep=0>" + said(1, 3) + "</h3>" + listing(0, True)])}</aside>'
        if kind == 4:
            return f'<form data-keep="0">{said(1, 6)} <input name="q"></form>'
        if kind == 5:
            bare = r.random() < 0.3
            one = lambda: paragraph(0, 1, 2) if bare else named(["comment", "reply", "comment-body"], 0) + paragraph(0, 1, 3) + "</div>"
            return named(["comments", "comment-list", "discussion", "respond"], 0, r.choice(["div", "section"])) + f'<h3 data-keep="0">{said(1, 3)}</h3>' + "".join(one() for _ in range(r.randint(1, 4))) + "</div>"
        inside = r.choice([said(1, 12), paragraph(0, 1, 3), listing(0, True), said(1, 4) + listing(0, False)])
        return named(_BOILER, 0, r.choice(["div", "div", "section", "ul", "p"]) if "<" not in inside else "div") + inside + "</div></section></p></ul>"

    def content():
        parts = [f'<h1 data-keep="1">{said(1, 10)}</h1>'] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 7, 9])):
            kind = r.random()
            if kind < 0.68:
                parts.append(paragraph(1))
            elif kind < 0.75:
                parts.append(f'<h2 data-keep="1">{said(1, 6)}</h2>')
            elif kind < 0.8:
                parts.append(listing(1, False))
            elif kind < 0.84:
                parts.append(f'<blockquote data-keep="1">{paragraph(1)}</blockquote>')
            elif kind < 0.87:
                parts.append(f'<table data-keep="1"><tr data-keep="1"><td data-keep="1">{said(1, 4)}</td><td data-keep="1">{said(1, 4)}</td></tr></table>')
            elif kind < 0.9:
                parts.append(f'<pre data-keep="1">{said(3, 20)}</pre>')
            else:
                parts.append(boiler())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.4:
            return f'<article data-keep="1">{inner}</article>'
        if kind < 0.55:
            return f'<main data-keep="1">{inner}</main>'
        if kind < 0.85:
            tag = r.choice(["div", "div", "section"])
            return named(_CONTENT, 1, tag) + inner + f"</{tag}>"
        if kind < 0.93:
            return f'<main data-keep="1"><article data-keep="1">{inner}</article></main>'
        return f'<div data-keep="1">{inner}</div>' if r.random() < 0.5 else inner

    out = []
    for _ in range(count):
        mute = r.random() < muted
        top = "".join(boiler() for _ in range(r.randint(0, 4)))
        bottom = "".join(boiler() for _ in range(r.randint(0, 4)))
        inner = top + content() + bottom
        if r.random() < 0.4:
            inner = f'<div class="{r.choice(["wrapper", "container", "site", "layout", "row"])}" data-keep="0">{inner}</div>'
        out.append(f'<html data-keep="0"><head><title>{said(1, 5)}</title></head><body data-keep="0">{inner}</body></html>')
    return out


def train(pages: list[str] | None = None, rounds: int = 8, least: int = 5, prior: float = 0.5) -> tuple[dict[str, float], np.ndarray]:
    """(node weights by feature, log pair potentials by parent sort, parent and child label).

    Features seen ``least`` times or more are weighted, by ``rounds`` Newton steps under a
    normal prior of this precision.
    """
    parsed = [parse(p) for p in pages or labelled_pages()]
    found: list[list[str]] = []
    labels = []
    counts = np.full((3, 2, 2), 1.0)
    for page in parsed:
        features = _features(page)
        for i, label in enumerate(page.labels):
            if label < 0:
                continue
            found.append(["bias", *features[i]])
            labels.append(label)
            parent = page.parents[i]
            if parent >= 0 and page.labels[parent] >= 0:
                counts[_sort(page, parent), page.labels[parent], label] += 1
    seen = Counter(f for row in found for f in row)
    names = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= least)}
    x = np.zeros((len(found), len(names)))
    for i, row in enumerate(found):
        x[i, [names[f] for f in row if f in names]] = 1
    y, w = np.array(labels, float), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior * np.eye(len(w)), x.T @ (p - y) + prior * w)
    # The pair potential is what the parent's label says beyond the child's base rate, which the bias holds.
    given = counts / counts.sum(axis=2, keepdims=True)
    base = counts.sum(axis=1, keepdims=True) / counts.sum(axis=(1, 2), keepdims=True)
    return {name: float(w[k]) for name, k in names.items()}, np.log(given / base)


def main_text(html: str | None, model: tuple[dict[str, float], np.ndarray]) -> str:
    if not html:
        return ""
    page = parse(html)
    if not page.runs:
        return ""
    keep = marginals(page, *model)
    return "\n".join(text for block, text in page.runs if keep[block] >= 0.5)


def extract(pages: DataFrame, *, model: tuple[dict[str, float], np.ndarray] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a few hundred weights

    def run(batches):
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
