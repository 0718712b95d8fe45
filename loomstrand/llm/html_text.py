"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each page is parsed where it is read into its block elements (inline ones only where their attributes speak of adverts,
menus and the like). Every element gets a row of numbers: kind of tag, attribute tokens, depth, density of text, links and
punctuation in its subtree, its siblings, and what its ancestors are. Boosted trees turn the rows into log-odds of being
kept, and decoding chooses the subset of elements of largest sum in which no element is kept below a dropped one: a child
is only kept if that pays for it and all that hangs below. Text of the kept elements is returned in page order.

The trees are trained on at most `TRAIN_PAGES` pages (chosen by a hash of the id, none longer than `TRAIN_CHARS`) whose
article stands in an article or main element: as they are, and rebuilt around their paragraphs with menus, headers, sidebars,
notices, adverts, forms, comments and footers of many spellings, so that no one tag or name decides.

Null and empty pages give empty text. Pages without any markup are text. Scripts, styles, comments and form controls never
are: the first end at their end tag, whatever is in them, and controls, drawings and the like with the element around them at last. Without a page to train on, plain tags and attribute names decide. Repeated rows are treated alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

TRAIN_PAGES, TRAIN_CHARS, REBUILT, SEED = 200, 40_000, 4, 5
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed".split())
UNSHOWN = frozenset("noscript template svg select button object canvas math audio video".split())
LEFT_BY_BLOCKS = frozenset("svg math select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
BARRIER = frozenset("html body table td th ul ol dl article section main div aside nav footer header form blockquote".split())
KINDS = [
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset",
    "table thead tbody tfoot tr td th", "figure figcaption", "html body", "blockquote pre",
]
# What attribute names of a block tell, by group.
TOKENS = [
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager topnav toc",
    "header head masthead topbar top logo",
    "footer foot bottom copyright colophon legal",
    "side sidebar aside rail widget widgets",
    "comment comments commentlist reply replies respond discussion disqus",
    "notice cookie cookies consent alert popup modal overlay gdpr warning message toast",
    "form login signup subscribe newsletter search register",
    "share social related recommended recommendations more tags popular trending links",
    "content article post entry main body story text prose page-content",
    "meta byline author date info",
]

KIND = {t: i for i, names in enumerate(KINDS) for t in names.split()}
GROUP = {t: 1 << i for i, names in enumerate(TOKENS) for t in names.split()}
AWAY = {"nav": 1, "header": 2, "footer": 4, "aside": 8, "form": 16, "article": 32, "main": 32}
DROPPED_BITS = sum(1 << i for i in range(9))
INNER = len(KINDS)
#: In place of an element: what hangs below is never shown.
UNSEEN = -2

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_EVENT = re.compile("[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_MARK = re.compile(r"\by=([01])")
_POINTS = re.compile(r"[.,;:!?]")


@lru_cache(maxsize=20_000)
def _bits(attributes: str) -> int:
    found = 0
    for value in _NAMED.findall(attributes):
        for token in re.split(r"[^a-z]+", value.lower()):
            found |= GROUP.get(token, 0)
    return found


class Markup:
    """Finds the marks of a page from left to right. No stretch is searched twice, whatever is left open in it.

    A tag ends at the first `>` outside quotes, or at the first of all where a quote is never closed; without any, its `<` is text.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">")
        #: Where a tag ends of which a quote opens here, -1 for nowhere.
        self.known: dict[int, int] = {}

    def _end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose attributes start here, or -1."""
        passed = []
        while True:
            event = _EVENT.search(self.source, at)
            if not event:
                found = -1
                break
            place = event.start()
            if event[0] == ">":
                found = place
                break
            if (held := self.known.get(place)) is not None:
                found = held
                break
            passed.append(place)
            at = self.source.find(event[0], place + 1) + 1
            if not at:
                found = -1
                break
        self.known.update(dict.fromkeys(passed, found))
        return found

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the first mark from here on; comments and the like have no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(opening, start):
                    end = source.find(closing, start + len(opening))
                    return start, len(source) if end < 0 else end + len(closing), False, "", ""
            if start >= self.last:
                # Only a comment can still come.
                start = source.find("<!", start + 1)
                if start < 0:
                    return None
                at = start
                continue
            name = _NAME.match(source, start)
            if name:
                end = self._end(name.end())
                if end < 0:
                    end = source.find(">", name.end())
                return start, end + 1, bool(name[1]), name[2], source[name.end() : end]
            if source[start + 1] in "!?/":
                return start, source.find(">", start) + 1, False, "", ""
            at = start + 1
        return None


class Stack:
    """The open elements of a page as (name, node), and where those are that an end tag or a block may look for."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("", 0)]
        self.by_name: dict[str, list[int]] = {}
        self.blocks, self.barriers, self.left, self.seen = [-1], [-1], [-1], [0]

    @property
    def node(self) -> int:
        return self.open[-1][1]

    def _lists(self, name: str, node: int) -> list[list[int]]:
        lists = [self.by_name.setdefault(name, [-1])]
        if name in CLOSES_P:
            lists.append(self.blocks)
        if name in BARRIER:
            lists.append(self.barriers)
        if node != UNSEEN or name == "foreignobject":
            lists.append(self.seen)
        elif name in LEFT_BY_BLOCKS:
            lists.append(self.left)
        return lists

    def push(self, name: str, node: int) -> None:
        for places in self._lists(name, node):
            places.append(len(self.open))
        self.open.append((name, node))

    def _cut(self, place: int) -> None:
        while len(self.open) > place:
            for places in self._lists(*self.open.pop()):
                places.pop()

    def end(self, name: str) -> None:
        """An end tag closes the newest element of its name; an inline one doesn't reach across a block."""
        place = self.by_name.get(name, (-1,))[-1]
        if place > 0 and (name not in INLINE or self.blocks[-1] <= place):
            self._cut(place)

    def close(self, name: str) -> None:
        """The newest element of a name ends, unless a barrier stands in between."""
        place = self.by_name.get(name, (-1,))[-1]
        if place > 0 and self.barriers[-1] <= place:
            self._cut(place)

    def break_out(self) -> None:
        """Blocks end a drawing, formula or list of choices that was never closed."""
        if self.left[-1] > self.seen[-1]:
            self._cut(self.left[-1])


class Page:
    """The block elements of one page in document order, and its pieces of text."""

    def __init__(self, source: str) -> None:
        self.parent, self.kind, self.bits, self.away, self.chars, self.links, self.points, self.mark = [-1], [INNER - 2], [0], [0], [0], [0], [0], [1]
        self.pieces: list[tuple[int, str]] = []
        self._read(source)

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.kind.append(KIND.get(tag, INNER))
        self.bits.append(_bits(attributes) if attributes else 0)
        self.away.append(AWAY.get(tag, 0))
        self.chars.append(0)
        self.links.append(0)
        self.points.append(0)
        mark = _MARK.search(attributes) if attributes else None
        self.mark.append(int(mark[1]) if mark else self.mark[parent])
        return len(self.parent) - 1

    def _text(self, node: int, text: str, linked: bool) -> None:
        if node == UNSEEN:
            return
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, text))
        n = len(text)
        self.chars[node] += n
        if linked:
            self.links[node] += n
        self.points[node] += len(_POINTS.findall(text))

    def _read(self, source: str) -> None:
        stack, marks = Stack(), Markup(source)
        linked = 0
        at = 0
        add = self.pieces.append
        while m := marks.next(at):
            start, end, closes, tag, attributes = m
            if start > at:
                self._text(stack.node, source[at:start], linked > 0)
            at = end
            if not tag:
                continue
            tag = tag.lower()
            if closes:
                if tag == "a" and stack.node != UNSEEN:
                    linked = max(0, linked - 1)
                if tag in VOID:
                    continue
                stack.end(tag)
                if tag not in INLINE:
                    add((-1, " "))
                continue
            if tag in RAW:
                #: Nothing in it is markup: its end is looked for in the source itself.
                if not attributes.endswith("/"):
                    end = _RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
                add((-1, " "))
                continue
            if stack.node == UNSEEN and tag in CLOSES_P and tag not in VOID:
                stack.break_out()
            if (tag in UNSHOWN or stack.node == UNSEEN) and tag not in VOID:
                if not attributes.endswith("/"):
                    stack.push(tag, UNSEEN)
                add((-1, " "))
                continue
            if tag in VOID:
                if tag != "wbr":
                    add((-1, " "))
                if tag == "hr" and stack.node != UNSEEN:
                    stack.close("p")
                continue
            if tag in INLINE:
                if tag == "a":
                    linked += 1
                bits = _bits(attributes) if attributes else 0
                stack.push(tag, self._add(stack.node, tag, attributes) if bits & DROPPED_BITS else stack.node)
                continue
            add((-1, " "))
            if tag == "head":
                stack.push(tag, stack.node)
                continue
            if tag in CLOSES_P:
                stack.close("p")
                linked = 0
            for closed in CLOSES.get(tag, "").split():
                stack.close(closed)
            stack.push(tag, self._add(stack.node, tag, attributes))
        if at < len(source):
            self._text(stack.node, source[at:], linked > 0)

    def text(self, kept: list[bool]) -> str:
        """Text of the kept elements, blocks parted and white space turned into one space."""
        return " ".join("".join([t for node, t in self.pieces if node < 0 or kept[node]]).split())


class Forest:
    """The elements of many pages as columns, with sums over subtrees and paths."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages])
        self.first = np.cumsum(sizes) - sizes
        join = lambda name: np.array([x for p in pages for x in getattr(p, name)], dtype=np.int64)
        page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = join("parent")
        self.parent = np.where(self.parent < 0, -1, self.parent + self.first[page])
        self.mark = join("mark")
        kind, bits, away, chars, links, points = (join(n) for n in ("kind", "bits", "away", "chars", "links", "points"))
        n = len(self.parent)
        self.depth = np.zeros(n, dtype=np.int64)
        self.order: list[np.ndarray] = [self.first]
        by_parent = np.argsort(self.parent, kind="stable")
        starts = np.searchsorted(self.parent[by_parent], np.arange(n + 1))
        while True:
            above = self.order[-1]
            many = starts[above + 1] - starts[above]
            below = by_parent[np.repeat(starts[above] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            if not len(below):
                break
            self.depth[below] = len(self.order)
            self.order.append(below)
        sums = np.stack([chars, links, points, np.ones(n, dtype=np.int64), (kind == 0).astype(np.int64)], axis=1)
        for level in self.order[:0:-1]:
            np.add.at(sums, self.parent[level], sums[level])
        over_bits, over_away = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for level in self.order[1:]:
            up = self.parent[level]
            over_bits[level], over_away[level] = over_bits[up] | bits[up], over_away[up] | away[up]
        up = np.maximum(self.parent, 0)
        place = np.zeros(n, dtype=np.int64)
        place[by_parent] = np.arange(n) - starts[self.parent[by_parent]] if n else 0
        siblings = starts[up + 1] - starts[up]
        previous, following = np.zeros(n), np.zeros(n)
        same = np.flatnonzero(self.parent[by_parent][1:] == self.parent[by_parent][:-1])
        previous[by_parent[same + 1]], following[by_parent[same]] = sums[by_parent[same], 0], sums[by_parent[same + 1], 0]
        total = np.maximum(sums[self.first[page], 0], 1)
        text = np.maximum(sums[:, 0], 1)
        numbers = [
            self.depth, np.log1p(sums[:, 0]), sums[:, 1] / text, np.log1p(sums[:, 3]), sums[:, 0] / sums[:, 3], sums[:, 2] / text, place, siblings,
            sums[:, 0] / np.maximum(sums[up, 0], 1), sums[:, 0] / total, np.log1p(sums[:, 4]), (np.arange(n) - self.first[page]) / sums[self.first[page], 3],
            np.log1p(previous), np.log1p(following), chars / text, sums[up, 1] / np.maximum(sums[up, 0], 1),
        ]
        flags = [kind == k for k in range(INNER + 1)] + [bits >> k & 1 for k in range(len(TOKENS))] + [over_bits >> k & 1 for k in range(len(TOKENS))] + [over_away >> k & 1 for k in range(6)]
        self.rows = np.stack([*numbers, *flags], axis=1).astype(np.float32)
        self.plain = np.where((bits & DROPPED_BITS > 0) | (away & 31 > 0), -1.0, 1.0)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Which elements are kept: the subset of largest summed log-odds without one below a dropped one."""
        best = odds.copy()
        best[self.first] = np.maximum(best[self.first], 0)
        for level in self.order[:0:-1]:
            np.add.at(best, self.parent[level], np.maximum(best[level], 0))
        kept = np.zeros(len(odds), dtype=bool)
        kept[self.first] = True
        for level in self.order[1:]:
            kept[level] = kept[self.parent[level]] & (best[level] > 0)
        return kept


class BoostedTrees:
    """Binary classification by gradient-boosted trees of one depth over binned numbers."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T, strict=True)], axis=1)
        columns = rows.shape[1]
        cell = binned + np.arange(columns) * BINS
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.column = np.zeros((TREES, 2**DEPTH - 1), dtype=np.int64)
        self.edge = np.full((TREES, 2**DEPTH - 1), np.inf)
        self.value = np.zeros((TREES, 2**DEPTH))
        odds = np.full(len(rows), self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            slope, bend = labels - p, p * (1 - p)
            node = np.zeros(len(rows), dtype=np.int64)
            for level in range(DEPTH):
                wide = 2**level
                key = (node[:, None] * columns * BINS + cell).ravel()
                g, h = (np.bincount(key, np.repeat(v, columns), wide * columns * BINS).reshape(wide, columns, BINS).cumsum(axis=2) for v in (slope, bend))
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < 1) | (all_h - h < 1)] = 0
                for k, flat in enumerate(gain.reshape(wide, -1).argmax(axis=1)):
                    c, b = divmod(int(flat), BINS)
                    if gain[k, c, b] > 1e-6 and b < len(edges[c]):
                        self.column[t, wide - 1 + k], self.edge[t, wide - 1 + k] = c, edges[c][b]
                node = 2 * node + (rows[np.arange(len(rows)), self.column[t, wide - 1 + node]] > self.edge[t, wide - 1 + node])
            g, h = (np.bincount(node, v, 2**DEPTH) for v in (slope, bend))
            self.value[t] = RATE * g / (h + 1)
            odds += self.value[t, node]

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out, every = np.full(len(rows), self.base), np.arange(len(rows))
        for column, edge, value in zip(self.column, self.edge, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, column[node]] > edge[node])
            out += value[node - 2**DEPTH + 1]
        return out


def _paragraphs(page: Page) -> list[str]:
    """Texts of the elements that stand in an article or main element."""
    forest = Forest([page])
    inside = forest.rows[:, -1] > 0
    kept = [bool(i) and k == 0 for i, k in zip(inside, page.kind, strict=True)]
    texts: dict[int, list[str]] = {}
    for node, text in page.pieces:
        if node >= 0 and kept[node]:
            texts.setdefault(node, []).append(text)
    return [t for parts in texts.values() if (t := " ".join("".join(parts).split()))]


def rebuilt(paragraphs: list[str], draw: np.random.Generator) -> str:
    """A page around the paragraphs in which y=1 marks what is to be kept, and y=0 what isn't."""
    words = " ".join(paragraphs).split() or ["-"]
    esc = html.escape

    def say(low: int, high: int) -> str:
        begin = int(draw.integers(len(words)))
        return esc(" ".join(words[begin : begin + int(draw.integers(low, high))]) or words[0])

    def pick(*options: str) -> str:
        return options[int(draw.integers(len(options)))]

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{say(1, 4)}</a></li>' for _ in range(int(draw.integers(low, high)))) + "</ul>"

    def wrapped(inner: str, *openings: str) -> str:
        opening = pick(*openings)
        return f"<{opening} y=0>{inner}</{opening.split()[0]}>"

    named = lambda *names: [f'{t} {a}="{n}"' for n in names for t in ("div", "section") for a in ("class", "id")]
    parts = {
        "menu": lambda: wrapped(links(2, 9), "nav", "nav", *named("menu", "nav", "main-nav", "breadcrumbs")),
        "head": lambda: wrapped(pick(f"<p>{say(1, 8)}</p>", f"<h1>{say(1, 5)}</h1>", say(1, 8), f"<h2>{say(1, 5)}</h2><p>{say(3, 20)}</p>"), "header", "header", *named("header", "masthead", "site-header")),
        "notice": lambda: wrapped(pick(f"<p>{say(5, 40)}</p>", say(5, 40)), *named("notice", "cookie-notice", "cookie-banner", "consent", "alert")),
        "advert": lambda: wrapped(pick(f"<p>{say(4, 30)}</p>", say(4, 30), f'<a href="#">{say(2, 12)}</a>'), *named("ad", "ads", "advert", "ad-box", "sponsored", "promo")),
        "side": lambda: wrapped(pick(links(2, 8), f"<h3>{say(1, 4)}</h3><p>{say(5, 50)}</p>", f"<p>{say(5, 50)}</p>"), "aside", "aside", *named("sidebar", "side", "widget", "related")),
        "form": lambda: wrapped(pick(f"<label>{say(1, 4)}</label><input>", f"<p>{say(3, 20)}</p><input>"), "form", *named("newsletter", "login-form", "search", "subscribe")),
        "share": lambda: wrapped(pick(links(2, 6), say(2, 6)), *named("share", "social", "related", "tags")),
        "comments": lambda: wrapped("".join(f'<div class="comment"><p>{say(3, 60)}</p></div>' for _ in range(int(draw.integers(1, 5)))), *named("comments", "comments", "comment-list", "discussion", "respond")),
        "foot": lambda: wrapped(pick(f"&copy; {say(1, 12)}", f"<p>{say(3, 30)}</p>", links(2, 6)), "footer", "footer", *named("footer", "site-footer", "copyright")),
    }
    paragraphs = paragraphs[: int(draw.integers(1, 5))] if draw.random() < 0.3 else paragraphs
    inner = [f"<h1>{say(2, 9)}</h1>"] if draw.random() < 0.7 else []
    for p in paragraphs:
        roll = draw.random()
        inner.append(f"<blockquote>{esc(p)}</blockquote>" if roll < 0.04 else f"<ul><li>{esc(p[:60])}</li><li>{esc(p[60:])}</li></ul>" if roll < 0.1 else f"<h2>{say(1, 6)}</h2><p>{esc(p)}</p>" if roll < 0.2 else f"<div>{esc(p)}</div>" if roll < 0.25 else f"<p>{esc(p)}</p>")
        if draw.random() < 0.15:
            inner.append(parts[pick("advert", "share", "side", "side", "notice", "form", "menu")]())
    if draw.random() < 0.15:
        inner.append(parts["comments"]())
    body = "".join(inner)
    if draw.random() < 0.12:
        return pick("", "<html y=1><body>", "<html y=1><body><div>") + body
    for _ in range(int(draw.integers(1, 3))):
        opening = pick("article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'div class="entry"', "section", "div", 'div class="article-text"')
        body = f"<{opening} y=1>{body}</{opening.split()[0]}>"
    before = "".join(parts[name]() for name in ("head", "menu", "notice", "advert", "side", "form") if draw.random() < 0.45)
    after = "".join(parts[name]() for name in ("share", "side", "advert", "comments", "form", "notice", "menu", "foot") if draw.random() < 0.4)
    page = before + body + after
    if draw.random() < 0.5:
        opening = pick("div", 'div class="container"', 'div id="page"', 'div class="wrapper"')
        page = f"<{opening} y=1>{page}</div>"
    return f"<html y=1><body>{page}</body></html>"


def train(sources: list[str]) -> BoostedTrees | None:
    """Trees learned from pages; None if none of them has an article or main element."""
    draw = np.random.default_rng(SEED)
    pages: list[Page] = []
    for source in sources:
        page = Page(source)
        if not any(a & 32 for a in page.away):
            continue
        forest = Forest([page])
        holds = np.array([a & 32 > 0 for a in page.away])
        good = (forest.rows[:, -1] > 0) | holds
        for level in forest.order[:0:-1]:
            np.logical_or.at(good, forest.parent[level], good[level] & (holds[level] | (forest.rows[level, -1] == 0)))
        cut = (forest.plain < 0) & ~holds
        for level in forest.order[1:]:
            cut[level] |= cut[forest.parent[level]]
        page.mark = (good & ~cut).astype(int).tolist()
        pages.append(page)
        if paragraphs := _paragraphs(page):
            pages += [Page(rebuilt(paragraphs, draw)) for _ in range(REBUILT)]
    if not pages:
        return None
    forest = Forest(pages)
    return BoostedTrees(forest.rows, forest.mark.astype(np.float64))


def main_texts(sources: list[str], trees: BoostedTrees | None) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    kept = forest.decode(forest.plain if trees is None else trees.odds(forest.rows)).tolist()
    return [page.text(kept[first : first + len(page.parent)]) for page, first in zip(pages, forest.first.tolist(), strict=True)]


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html)."""
    short = pages.where((F.length("html") <= TRAIN_CHARS) & (F.length("html") > 0) & F.col("page_id").isNotNull())
    chosen = [r["page_id"] for r in short.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]
    sample = short.where(F.col("page_id").isin(chosen)).select("html").limit(train_pages) if chosen else short.select("html").limit(0)
    learned = pages.sparkSession.sparkContext.broadcast(train(sorted(r["html"] for r in sample.collect())))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html", 4 << 20):
            texts = main_texts([h or "" for h in batch.column("html").to_pylist()], learned.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(made, "page_id long, url string, text string, n_chars long")
