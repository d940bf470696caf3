"""HTML main-text extraction with a tree-structured graphical model.

The block elements of a page (and inline ones with a class, id or role) are the nodes of a tree. A node's state is
structure (it holds content among other things), content or boilerplate. Node potentials are a softmax regression on
the node's own tag, name tokens, text length and link share; edge potentials are smoothed counts of (parent, child)
states. Both are trained from labelled pages (``labelled_pages``: generated with a state for every element). Sum-
product messages go from the leaves to the root and back, and give each node's exact marginals; text of nodes that are
content with the highest marginal is kept.

Output: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by one space in page order. Scripts, styles and comments never count; a script's or style's text ends at its own end
tag, whatever stands in it. Defined cases: null or empty html gives the empty
text; broken or cut-off markup is read as far as it goes, in time that grows with its length; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*>|<(?=/?[a-zA-Z!?])[^>]*\Z", re.S)
#: The end tag of each RAW element; of those, SUBTREE holds markup, the others text alone.
ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
SUBTREE = frozenset(["svg", "template"])
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b|display:\s*(none)""", re.I)
TOKEN = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")
STATES = ("structure", "content", "boilerplate")


class Page:
    """Nodes (parent, tag, name tokens, words, linked words) and text runs (node, block number, text) of one page."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.words, self.linked = [-1], ["#root"], [()], [0], [0]
        self.runs: list[tuple[int, int, str]] = []
        self.state: list[str] = [""]
        stack: list[tuple[str, int]] = [("#root", 0)]
        opened: Counter[str] = Counter()
        unclosed: set[str] = set()  # raw elements that no end tag follows any more
        block, links, at, skip = 0, 0, 0, None
        while m := MARKUP.search(source, at):
            if skip is None and m.start() > at:
                self._text(source[at : m.start()], stack[-1][1], block, links)
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if skip is not None:
                if m[1] and tag == skip:
                    skip = None
                elif not m[1] and tag in RAW - SUBTREE and tag not in unclosed:
                    end = ENDS[tag].search(source, at)
                    if end:
                        at = end.end()
                    else:
                        unclosed.add(tag)
                continue
            if m[1]:
                if opened[tag]:
                    while True:
                        t, _ = stack.pop()
                        opened[t] -= 1
                        links -= t == "a"
                        block += t not in INLINE
                        if t == tag:
                            break
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    if tag in SUBTREE:
                        skip = tag
                    else:
                        end = ENDS[tag].search(source, at)
                        at = end.end() if end else len(source)
                continue
            if tag in VOID:
                if tag in ("br", "hr", "wbr"):
                    block += tag == "hr"
                    if tag == "br":
                        self.runs.append((stack[-1][1], block, " "))
                continue
            closable = any(opened[t] for t, by in CLOSED_BY.items() if tag in by)
            for k in range(len(stack) - 1, 0, -1) if closable else ():
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    links -= sum(t == "a" for t, _ in stack[k:])
                    opened.subtract(t for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            inline = tag in INLINE
            names = ()
            if m[3]:
                names = tuple(sorted({x for a, b, c in NAMES.findall(m[3]) for x in TOKEN.findall((a or b or c).lower())}))
            block += not inline
            links += tag == "a"
            node = stack[-1][1]
            if not inline or names:
                node = len(self.parent)
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                self.names.append(names)
                self.words.append(0)
                self.linked.append(0)
                s = re.search(r'data-state="(\w+)"', m[3])
                self.state.append(s[1] if s else "")
            stack.append((tag, node))
            opened[tag] += 1
        if skip is None and at < len(source):
            self._text(source[at:], stack[-1][1], block, links)

    def _text(self, text, node, block, links):
        self.runs.append((node, block, text))
        n = len(text.split())
        self.words[node] += n
        if links:
            self.linked[node] += n

    def features(self, i: int) -> tuple:
        w = self.words[i]
        size = 0 if not w else min(5, 1 + int(math.log(w, 4)))
        link = 0 if not self.linked[i] else 1 + int(2 * self.linked[i] / w)
        return (self.tag[i], self.names[i], size, link)


def feature_names(f: tuple) -> list[str]:
    tag, names, size, link = f
    return [f"tag:{tag}", f"size:{size}", f"link:{link}", *(f"name:{n}" for n in names)]


def labelled_pages(n: int = 500, seed: int = 7):
    """Generated pages whose elements carry their state in data-state."""
    r = random.Random(seed)
    good = ["content", "main", "post", "entry", "story", "article", "body", "text"]
    bad = [("nav", ["menu", "nav", "navigation", "breadcrumb", "topnav", "navbar"]), ("header", ["header", "masthead", "site", "top", "logo"]), ("footer", ["footer", "bottom", "copyright", "legal"]), ("aside", ["sidebar", "aside", "related", "widget", "promo", "recommended"]), ("div", ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored"]), ("div", ["cookie", "notice", "consent", "popup", "modal", "alert", "gdpr", "overlay"]), ("form", ["form", "search", "login", "subscribe", "newsletter", "signup"]), ("section", ["comments", "comment", "discussion", "replies", "respond", "disqus"]), ("div", ["share", "social", "tags", "meta", "pagination", "toolbar"])]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(a, b):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def name(tokens, chance=0.7):
        return f' class="{r.choice(tokens)}"' if r.random() < chance else ""

    def junk():
        tag, tokens = r.choice(bad)
        named = name(tokens, 1.0 if tag in ("div", "section") else 0.5)
        tag = r.choice([tag, tag, tag, "div", "section"]) if named else tag
        kind = r.random()
        if kind < 0.35:
            inner = "<ul data-state=boilerplate>" + "".join(f'<li data-state="boilerplate"><a href="/">{words(1, 4)}</a></li>' for _ in range(r.randint(1, 8))) + "</ul>"
            inner = inner.replace("<ul data-state=boilerplate>", '<ul data-state="boilerplate">')
        elif kind < 0.7:
            inner = "".join(f'<{t} data-state="boilerplate">{words(2, 30)}</{t}>' for t in (r.choice(["p", "div", "h3", "li", "h2", "h1", "label"]) for _ in range(r.randint(1, 4))))
        else:
            inner = words(1, 25)
        return f'<{tag}{named} data-state="boilerplate">{inner}</{tag}>'

    def block():
        t = r.choices(["p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "figcaption", "section", "div", "dd"], [60, 5, 8, 5, 8, 4, 4, 2, 2, 3, 4, 1])[0]
        text = words(1, 120) if t == "p" else words(1, 25)
        if r.random() < 0.2:
            text += f' <a href="/x">{words(1, 3)}</a> ' + words(0, 8)
        own = f'<{t} data-state="content">{text}</{t}>'
        if t == "li":
            own = f'<ul data-state="content">{own}</ul>'
        if t == "td":
            own = f'<table data-state="content"><tr data-state="content">{own}</tr></table>'
        return own

    for _ in range(n):
        parts = [block() for _ in range(r.randint(1, 14))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(1, len(parts)), junk())
        root = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        named = name(good, 1.0 if root in ("div", "section") else 0.3)
        core = f'<{root}{named} data-state="content">{"".join(parts)}</{root}>'
        if r.random() < 0.5:
            wrap = r.choice(["div", "main", "section"])
            side = [junk() for _ in range(r.randint(0, 2))]
            core = f'<{wrap}{name(["wrapper", "container", "page", "layout", "main", "content"])} data-state="structure">{"".join(side[:1])}{core}{"".join(side[1:])}</{wrap}>'
        before, after = [junk() for _ in range(r.randint(0, 3))], [junk() for _ in range(r.randint(0, 3))]
        yield f'<html data-state="structure"><head data-state="boilerplate"><title data-state="boilerplate">{words(2, 8)}</title></head><body data-state="structure">{"".join(before)}{core}{"".join(after)}</body></html>'


class TreeModel:
    """Node and edge log potentials over STATES."""

    def __init__(self, weights: dict[str, list[float]], edges: list[list[float]]):
        self.weights, self.edges = weights, edges
        self.exp_edges = [[math.exp(x) for x in row] for row in edges]
        self.known: dict[tuple, tuple] = {}

    def node(self, f: tuple) -> tuple:
        got = self.known.get(f)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            z = [sum(x) for x in zip(*(self.weights.get(n, (0.0, 0.0, 0.0)) for n in ("bias", *feature_names(f))), strict=True)]
            top = max(z)
            got = self.known[f] = tuple(math.exp(x - top) for x in z)
        return got

    def marginals(self, page: Page) -> list[tuple]:
        """Upward then downward sum-product; parents precede children in page order."""
        n = len(page.parent)
        e = self.exp_edges
        phi = [(1.0, 1e-6, 1e-2), *(self.node(page.features(i)) for i in range(1, n))]
        belief = [list(p) for p in phi]
        up: list[tuple] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            m = tuple(r[0] * a + r[1] * b + r[2] * c for r in e)
            total = m[0] + m[1] + m[2]
            up[i] = m = (m[0] / total, m[1] / total, m[2] / total)
            p = belief[page.parent[i]]
            p[0] *= m[0]
            p[1] *= m[1]
            p[2] *= m[2]
            top = max(p)
            if top < 1e-100:
                p[0], p[1], p[2] = p[0] / top, p[1] / top, p[2] / top
        out: list[tuple] = [(0.0, 0.0, 0.0)] * n
        for i in range(n):
            b = belief[i]
            if i:
                q, m = out[page.parent[i]], up[i]
                x, y, z = q[0] / max(m[0], 1e-300), q[1] / max(m[1], 1e-300), q[2] / max(m[2], 1e-300)
                b = (b[0] * (x * e[0][0] + y * e[1][0] + z * e[2][0]), b[1] * (x * e[0][1] + y * e[1][1] + z * e[2][1]), b[2] * (x * e[0][2] + y * e[1][2] + z * e[2][2]))
            total = (b[0] + b[1] + b[2]) or 1e-300
            out[i] = (b[0] / total, b[1] / total, b[2] / total)
        return out

    def text(self, source: str) -> str:
        page = Page(source)
        content = [m[1] > m[0] and m[1] > m[2] for m in self.marginals(page)]
        blocks: list[str] = []
        last = None
        for node, block, text in page.runs:
            if content[node]:
                if block != last:
                    blocks.append("")
                    last = block
                blocks[-1] += text
        clean = (SPACE.sub(" ", html.unescape(b)).strip(" ") for b in blocks)
        return " ".join(b for b in clean if b)


def train(pages=None, rounds: int = 300, l2: float = 1e-4) -> TreeModel:
    """Fits node weights (softmax regression) and edge counts on labelled pages."""
    at = {s: k for k, s in enumerate(STATES)}
    names: dict[str, int] = {"bias": 0}
    rows, cols, y = [], [], []
    pairs = np.ones((3, 3))
    for source in pages if pages is not None else labelled_pages():
        p = Page(source)
        for i in range(1, len(p.parent)):
            s = at[p.state[i]]
            for n in ("bias", *feature_names(p.features(i))):
                rows.append(len(y))
                cols.append(names.setdefault(n, len(names)))
            y.append(s)
            if p.parent[i]:
                pairs[at[p.state[p.parent[i]]], s] += 1
    rows, cols, y = np.array(rows), np.array(cols), np.array(y)
    target = np.eye(3)[y]
    w, g2 = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-8)
    for _ in range(rounds):
        z = np.column_stack([np.bincount(rows, weights=w[cols, k], minlength=len(y)) for k in range(3)])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        err = (z / z.sum(axis=1, keepdims=True) - target) / len(y)
        g = np.column_stack([np.bincount(cols, weights=err[rows, k], minlength=len(names)) for k in range(3)]) + l2 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    edges = np.log(pairs / pairs.sum(axis=1, keepdims=True)) - np.log(pairs.sum(axis=0) / pairs.sum())
    return TreeModel({n: w[i].tolist() for n, i in names.items()}, edges.tolist())


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    fitted = model or train()
    weights, edges = fitted.weights, fitted.edges

    def run(batches):
        own = TreeModel(weights, edges)
        for batch in batches:
            text = [own.text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
