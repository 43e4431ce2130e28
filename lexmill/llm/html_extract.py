"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top down.

A page is read into a tree (void tags, implied ends and unclosed tags are allowed for; comments,
scripts and styles hold no text). Every element has features of its subtree (text, words, links,
tags, depth), of its own tag and attribute tokens, and of its siblings. Boosted regression trees
give the probability that an element belongs to the page's main part, that is, holds main text or
is an ancestor of some. Decoding picks the most likely labelling in which no dropped element has a
kept descendant: an element is kept with the best choice below it, or dropped with all of it.

No page here comes labelled, so the trees are fitted to pages from a generator that knows which
parts are main: mixed layouts, with and without semantic tags or telling attributes. The sample is
bounded (training_pages) and seeded, the fit takes seconds and the model has a fixed size.

The text: character references are decoded, white space in a block becomes one blank, blocks are
trimmed and joined by one line feed in page order; empty blocks vanish. A br is white space.

Defined results: null or empty html has the empty text, and so has a page without main part; an
empty table has no rows; repeated rows are repeated; other columns, whatever their names, are
ignored. Nesting may be of any depth (no recursion) and pages of any length are read whole, malformed
ones too: every step costs time in proportion to the page (a stray end tag looks up what is open). A
tag whose quotes run to the page's end makes the first ">" end tags from there on; one without any
">" after it is text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lexmill.llm.common import map_lists

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
SILENT = frozenset("head script style textarea title noscript template iframe svg math object canvas audio video select button option xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_P_BUT_P = ENDS_P - {"p"}

SKIPPED = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
TOKEN = re.compile(SKIPPED + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z|(?=["']))""", re.DOTALL)
#: Once a tag's quotes have run to the page's end: the first ">" ends a tag, whatever its quotes.
PLAIN = re.compile(SKIPPED + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)", re.DOTALL)
NUMBER = re.compile(r"&#(?=[0-9])0*+([0-9]*+)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Attribute tokens by what they tell; the trees learn what to make of each group.
TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "edge": "header masthead footer foot bottom topbar top copyright legal colophon contentinfo",
    "side": "sidebar side aside widget widgets rail related recommended more promo complementary secondary teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promoted doubleclick adsense adbox banner",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "reader": "comment comments commentlist disqus reply replies respond response responses discussion reviews feedback",
    "share": "share sharing social follow tools toolbar print meta tags tag byline author",
    "form": "form search login register input field contact",
    "hidden": "hidden none invisible collapse",
    "main": "main content article post entry body story text prose page document headline",
}
GROUP_OF = {t: i for i, (_, ts) in enumerate(TOKEN_GROUPS.items()) for t in ts.split()}
TAG_GROUPS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "select", "input", "fieldset"), ("article",), ("main",), ("section",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("div",), ("a",), tuple(sorted(SILENT)), tuple(sorted(INLINE - {"a"})), ("html", "body"), ("pre", "blockquote", "figure")]
#: Semantic tags tell what such tokens tell.
TAG_TELLS = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "article": "main", "main": "main", "dialog": "notice"}
TAG_OF = {t: i for i, ts in enumerate(TAG_GROUPS) for t in ts}


@dataclass(frozen=True)
class HtmlParams:
    training_pages: int = 700
    trees: int = 40
    depth: int = 4
    seed: int = 7


class Page:
    """Parallel lists of a page's elements, parents before children; texts hang between them in page order."""

    __slots__ = ("tags", "attrs", "parents", "order", "stack", "open", "blocks")

    def __init__(self, source: str):
        self.tags, self.attrs, self.parents = ["#root"], [""], [-1]
        self.order: list[tuple[int, str | None]] = []  # (element, text) or (element, None) where an element begins or ends
        self.stack, at, end = [0], 0, len(source)
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        self.blocks = [0]  # places in the stack of the open elements that are not inline
        stack, tags, order, token = self.stack, self.tags, self.order, TOKEN
        while at < end:
            m = token.search(source, at)
            if m and m[2] and m[4] != ">":  # no end of this tag
                if token is TOKEN:
                    token = PLAIN
                    continue
                m = None
            stop = m.start() if m else end
            if stop > at:
                order.append((stack[-1], source[at:stop]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    order.append((stack[-1], entities.escape(m[0][9:-3], quote=False)))
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in ENDS_P:
                self._drop({"p"}, ENDS_P_BUT_P)
            if tag in CLOSES:
                self._drop(CLOSES[tag], SCOPE[tag])
            number = len(tags)
            tags.append(tag)
            self.attrs.append(m[3])
            self.parents.append(stack[-1])
            order.append((number, None))
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(source, at)
                order.append((number, source[at : close.start()]))
                at = close.end()
                continue
            if m[3].endswith("/") and tag not in INLINE and tag not in ENDS_P:
                continue
            self.open.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                self.blocks.append(len(stack))
            stack.append(number)

    def _end(self, place: int) -> None:
        """End the open element at a place in the stack, and all that is open in it."""
        self.order.append((self.stack[place], None))
        for number in reversed(self.stack[place:]):
            self.open[self.tags[number]].pop()
        del self.stack[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def _innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _drop(self, wanted: set, stop: set) -> None:
        """End the innermost open element of wanted, unless one of stop is in between."""
        place = self._innermost(wanted)
        if place and place > self._innermost(stop):
            self._end(place)

    def _close(self, tag: str) -> None:
        place = self._innermost((tag,))
        if place and not (tag in INLINE and self.blocks[-1] > place):
            self._end(place)

    def text(self, kept: np.ndarray) -> str:
        """The blocks of the kept elements."""
        blocks, parts = [], []
        for number, piece in self.order:
            if piece is None:
                tag = self.tags[number]
                if tag == "br":
                    parts.append(" ")
                elif tag not in INLINE:
                    blocks.append("".join(parts))
                    parts = []
            elif kept[number]:
                parts.append(piece)
        blocks.append("".join(parts))
        clean = (SPACE.sub(" ", decoded(b)).strip() for b in blocks if b)
        return "\n".join(b for b in clean if b)


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, become U+FFFD."""
    if "&" not in text:
        return text
    return entities.unescape(NUMBER.sub(lambda m: f"&#{m[1] or 0}" if len(m[1]) < 8 else "&#1114112", text))


FEATURES = 14 + len(TAG_GROUPS) + 3 * len(TOKEN_GROUPS)


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tags)
    parent = page.parents
    x = np.zeros((n, FEATURES), np.float32)
    chars, words, linked, count, links, paras = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    own = [0] * n
    for number, piece in page.order:
        if piece is not None and page.tags[number] not in SILENT:
            size = len(piece)
            own[number] += size
            chars[number] += size
            words[number] += piece.count(" ") + 1
    depth, below, position, siblings = [0] * n, [0] * n, [0] * n, [0] * n
    seen = [0] * n
    groups = len(TAG_GROUPS)
    at = 14 + groups
    for i in range(1, n):
        p, tag = parent[i], page.tags[i]
        depth[i] = depth[p] + 1
        position[i] = seen[p]
        seen[p] += 1
        if tag in TAG_OF:
            x[i, 14 + TAG_OF[tag]] = 1
        if tag in TAG_TELLS:
            x[i, at + list(TOKEN_GROUPS).index(TAG_TELLS[tag])] = 1
        if page.attrs[i]:
            for name, value in ATTRIBUTE.findall(page.attrs[i]):
                name = name.lower()
                if name in ("class", "id", "role", "aria-label", "itemprop", "name"):
                    for token in re.split(r"[^a-z0-9]+", value.lower()):
                        if token in GROUP_OF:
                            x[i, at + GROUP_OF[token]] = 1
                elif name in ("hidden",) or name == "style" and "none" in value or name == "aria-hidden" and "true" in value:
                    x[i, at + GROUP_OF["hidden"]] = 1
    width = len(TOKEN_GROUPS)
    for i in range(1, n):  # what the ancestors' tokens tell
        p = parent[i]
        x[i, at + width : at + 2 * width] = np.maximum(x[p, at : at + width], x[p, at + width : at + 2 * width])
    for i in range(n - 1, 0, -1):
        p, tag = parent[i], page.tags[i]
        if tag == "a":
            linked[i], links[i] = chars[i], links[i] + 1
        paras[i] += tag == "p"
        for s in (chars, words, linked, count, links, paras):
            s[p] += s[i]
        below[p] = max(below[p], below[i] + 1)
        np.maximum(x[p, at + 2 * width :], np.maximum(x[i, at : at + width], x[i, at + 2 * width :]), out=x[p, at + 2 * width :])
    chars_ = np.array(chars, np.float32)
    up = np.array(parent)
    total = max(chars[0], 1)
    x[:, 0] = np.log1p(chars_)
    x[:, 1] = np.log1p(words)
    x[:, 2] = np.array(linked) / np.maximum(chars_, 1)
    x[:, 3] = chars_ / np.array(count)
    x[:, 4] = chars_ / total
    x[:, 5] = np.log1p(paras)
    x[:, 6] = depth
    x[:, 7] = below
    x[:, 8] = np.array(position) / np.maximum(np.array(seen)[up], 1)
    x[:, 9] = np.log1p(np.array(seen)[up])
    x[:, 10] = chars_ / np.maximum(chars_[up], 1)
    x[:, 11] = np.log1p(own)
    x[:, 12] = np.log1p(links)
    x[:, 13] = np.log1p(count)
    return x


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays: a node's test, and the leaves' values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(math.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (v.size - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, params: HtmlParams = HtmlParams(), rate: float = 0.3, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss over binned features, level by level."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    share = y.mean()
    base = math.log(share / (1 - share))
    score = np.full(len(x), base)
    feature, cut, leaf = [], [], []
    nodes = 2**params.depth - 1
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        fs, cs = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(params.depth):
            first, here = 2**level - 1, 2**level
            best, choice = np.full(here, 1e-6), [None] * here
            local = at - first
            gs, hs = np.bincount(local, g, here), np.bincount(local, h, here)
            for j, c in enumerate(cuts):
                k = len(c) + 1
                if k < 2:
                    continue
                cell = local * k + binned[:, j]
                gl = np.bincount(cell, g, here * k).reshape(here, k).cumsum(1)[:, :-1]
                hl = np.bincount(cell, h, here * k).reshape(here, k).cumsum(1)[:, :-1]
                gain = gl**2 / (hl + 1) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + 1) - (gs**2 / (hs + 1))[:, None]
                top = gain.argmax(1)
                for node in range(here):
                    if gain[node, top[node]] > best[node]:
                        best[node], choice[node] = gain[node, top[node]], (j, c[top[node]])
            for node, found in enumerate(choice):
                if found:
                    fs[first + node], cs[first + node] = found
            at = 2 * at + 1 + (x[np.arange(len(x)), fs[at]] > cs[at])
        local = at - nodes
        value = -rate * np.bincount(local, g, nodes + 1) / (np.bincount(local, h, nodes + 1) + 1)
        score = score + value[local]
        feature.append(fs), cut.append(cs), leaf.append(value)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaf))


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the labelling of the greatest likelihood in which nothing under a dropped element is kept."""
    n = len(page.tags)
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    for i, tag in enumerate(page.tags):
        if tag in SILENT:
            keep[i] = -1e9
    keep[0], drop[0] = 0.0, 0.0
    best_keep, all_drop = keep.tolist(), drop.tolist()
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        best_keep[p] += max(best_keep[i], all_drop[i])
        all_drop[p] += all_drop[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and best_keep[i] > all_drop[i]
    return kept


# --- training pages: what is main is marked by an attribute that the features do not read ---

MAIN_MARK = "data-main"


def _prose(rng: random.Random, n: int) -> str:
    shout = rng.random() < 0.05
    out = []
    for _ in range(max(1, n)):
        w = "".join(rng.choice("abcdefghilmnoprstuvéöñ") for _ in range(rng.randint(2, 9)))
        w = w.upper() if shout else w.capitalize() if rng.random() < 0.1 else w
        out.append(w + rng.choice(["", "", "", "", ".", ",", "!", "&amp;", "***"] if rng.random() < 0.2 else [""]))
    return " ".join(out)


def _some(rng: random.Random, usual: int) -> int:
    """A length around usual, now and then very short or very long."""
    return max(1, int(usual * math.exp(rng.gauss(0, 1))))


def _wrap(rng: random.Random, tag: str, groups: list[str], inside: str, bare: float = 0.2) -> str:
    """inside in its semantic tag or in a div or section, with telling attributes as a rule."""
    tokens = [rng.choice(TOKEN_GROUPS[g].split()) for g in groups]
    if rng.random() < 0.3:
        tokens.insert(rng.randint(0, len(tokens)), rng.choice(["col", "row", "clearfix", "box", "x1", "wrapper", "inner"]))
    name = rng.choice(["class", "class", "id"])
    semantic = tag != "div" and rng.random() < 0.6
    told = rng.random() >= bare or not semantic
    attr = f' {name}="{rng.choice([" ", "-"]).join(tokens)}"' if told and tokens and not (semantic and rng.random() < 0.5) else ""
    tag = tag if semantic else rng.choice(["div", "div", "section"])
    return f"<{tag}{attr}>{inside}</{tag}>"


def _links(rng: random.Random, n: int, words: int = 1) -> str:
    items = [f'<a href="/{i}">{_prose(rng, rng.randint(1, max(1, words)))}</a>' for i in range(max(1, n))]
    return f"<ul><li>{'</li><li>'.join(items)}</li></ul>" if rng.random() < 0.7 else rng.choice([" ", " | ", "<br>"]).join(items)


def _aside(rng: random.Random, kind: str) -> str:
    if kind == "menu":
        return _wrap(rng, "nav", ["menu"], _links(rng, _some(rng, 6)))
    if kind == "header":
        return _wrap(rng, "header", ["edge"], f"<a href='/'>{_prose(rng, 2)}</a>" + (f"<h1>{_prose(rng, 3)}</h1>" if rng.random() < 0.3 else "") + (_links(rng, 5) if rng.random() < 0.5 else f"<p>{_prose(rng, 6)}</p>"))
    if kind == "footer":
        return _wrap(rng, "footer", ["edge"], f"&copy; {_prose(rng, _some(rng, 8))}" + (f"<p>{_prose(rng, _some(rng, 15))}</p>" if rng.random() < 0.4 else "") + (_links(rng, 4) if rng.random() < 0.4 else ""))
    if kind == "sidebar":
        return _wrap(rng, "aside", ["side"], f"<h3>{_prose(rng, 2)}</h3>" + rng.choice([_links(rng, _some(rng, 6), 6), f"<p>{_prose(rng, _some(rng, 25))}</p>"]))
    if kind == "advert":
        body = _prose(rng, _some(rng, 12))
        return _wrap(rng, "div", ["advert"], rng.choice([body, f"<p>{body}</p>", f"<a href='/x'>{body}</a>"]), 0)
    if kind == "notice":
        body = _prose(rng, _some(rng, 18))
        return _wrap(rng, "div", ["notice"], f"<p>{body}</p>" if rng.random() < 0.6 else body + "<button>OK</button>", 0)
    if kind == "share":
        return _wrap(rng, "div", ["share"], _links(rng, 4), 0)
    if kind == "form":
        return f"<form action='/s'><label>{_prose(rng, 2)}</label><input name='q'>{f'<p>{_prose(rng, 8)}</p>' if rng.random() < 0.3 else ''}<button>{_prose(rng, 1)}</button></form>"
    one = lambda: rng.choice(["<li>{}</li>", "<div class='comment'>{}</div>", "<article class='comment'>{}</article>"]).format(f"<b>{_prose(rng, 2)}</b><p>{_prose(rng, _some(rng, 25))}</p>")
    return _wrap(rng, "div", ["reader"], f"<h3>{_prose(rng, 2)}</h3>" + "".join(one() for _ in range(_some(rng, 4))), 0)


def _block(rng: random.Random, k: str) -> str:
    """A block of the main part; k marks its elements."""
    body, kind = _prose(rng, _some(rng, 40)), rng.random()
    if kind < 0.58:
        return f"<p{k}>{body}</p>"
    if kind < 0.67:
        return f"<p{k}><b{k}>{body}.<br><p{k}>{_prose(rng, 20)}</p>"
    if kind < 0.73:
        return f"<{(h := rng.choice(['h2', 'h2', 'h3']))}{k}>{_prose(rng, 4)}</{h}>"
    if kind < 0.79:
        return f"<ul{k}>" + "".join(f"<li{k}>{_prose(rng, _some(rng, 8))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
    if kind < 0.83:
        return f"<blockquote{k}>{body}</blockquote>"
    if kind < 0.86:
        return f"<table{k}>" + "".join(f"<tr{k}><td{k}>{_prose(rng, 2)}</td><td{k}>{_prose(rng, 1)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>"
    if kind < 0.9:
        return f"<p{k}>{_prose(rng, 9)} <a{k} href='/y'>{_prose(rng, 2)}</a> {_prose(rng, 9)}</p>"
    if kind < 0.92:
        return f"<dl{k}>" + "".join(f"<dt{k}>{_prose(rng, 2)}</dt><dd{k}>{_prose(rng, _some(rng, 9))}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
    if kind < 0.94:
        return f"<pre{k}>{body}</pre>"
    if kind < 0.97:
        return f"<figure{k}><img src='/i.png'><figcaption{k}>{_prose(rng, _some(rng, 8))}</figcaption></figure>"
    return f"<div{k}>{body}</div>"


def _main(rng: random.Random) -> str:
    k = f" {MAIN_MARK}"
    parts = [f"<h1{k}>{_prose(rng, _some(rng, 7))}</h1>"] if rng.random() < 0.8 else []
    if parts and rng.random() < 0.2:
        more = f"<p{k}>{_prose(rng, _some(rng, 9))}</p>" if rng.random() < 0.4 else ""
        parts = [rng.choice([f"<header{k}>{parts[0]}{more}</header>", f"<header{k}>{parts[0]}</header>{more}", f"<div{k}>{parts[0]}{more}</div>"])]
    parts += [_block(rng, k) for _ in range(_some(rng, 5))]
    for kind in ("advert", "share", "form", "reader", "sidebar", "notice"):
        if rng.random() < 0.12:
            parts.insert(len(parts) if kind == "reader" else rng.randint(min(1, len(parts)), len(parts)), _aside(rng, kind))
    inside = "".join(parts)
    box = rng.random()
    if box < 0.45:
        return f"<article{k}>{inside}</article>"
    if box < 0.6:
        return f"<main{k}><article{k}>{inside}</article></main>"
    name = rng.choice(TOKEN_GROUPS["main"].split())
    if box < 0.85:
        return f"<div{k} {rng.choice(['class', 'id'])}='{name}'>{inside}</div>"
    return f"<div{k}>{inside}</div>" if box < 0.95 else inside


def training_page(rng: random.Random) -> str:
    before = [x for x in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
    after = [x for x in ("reader", "sidebar", "advert", "share", "menu", "form", "notice") if rng.random() < 0.3] + (["footer"] if rng.random() < 0.8 else [])
    rng.shuffle(before)
    middle = _main(rng) if rng.random() < 0.97 else ""
    body = "".join(_aside(rng, x) for x in before) + middle + "".join(_aside(rng, x) for x in after)
    if rng.random() < 0.25:
        body = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'site'])}'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{_prose(rng, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"


_MODEL: dict[HtmlParams, Trees] = {}


def model(params: HtmlParams = HtmlParams()) -> Trees:
    """The trees fitted to training_pages seeded pages; the same for the same parameters."""
    if params not in _MODEL:
        rng = random.Random(params.seed)
        xs, ys = [], []
        for _ in range(params.training_pages):
            page = Page(training_page(rng))
            main = np.array([MAIN_MARK in a for a in page.attrs])
            for i in range(len(main) - 1, 0, -1):
                main[page.parents[i]] |= main[i]
            told = np.array([t not in SILENT for t in page.tags])
            told[0] = False
            xs.append(features(page)[told]), ys.append(main[told])
        _MODEL[params] = boost(np.concatenate(xs), np.concatenate(ys).astype(float), params)
    return _MODEL[params]


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    rows = [features(p) for p in pages]
    odds = np.split(trees.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    return [p.text(decode(p, o)) for p, o in zip(pages, odds)]


def extract(pages: DataFrame, params: HtmlParams = HtmlParams(), rows: int = 64, most_chars: int = 4_000_000) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html). Up to `rows` pages and about most_chars characters are scored together."""
    sent = pages.sparkSession.sparkContext.broadcast(model(params))

    def run(batch: dict) -> dict:
        texts, part, size = [], [], 0
        for source in batch["html"]:
            if part and (len(part) == rows or size + len(source or "") > most_chars):
                texts += main_texts(part, sent.value)
                part, size = [], 0
            part.append(source)
            size += len(source or "")
        texts += main_texts(part, sent.value)
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_lists(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
