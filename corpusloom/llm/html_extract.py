"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block elements and the runs of text directly inside them. Each node gets
features: its tag, words of its class, id and role, depth, place among siblings, and its
subtree's text, density, links and punctuation. Boosted trees give each node a probability of
holding article text. Decoding is hierarchical: a node that is dropped drops all below it, and
of all choices that respect this the most probable one is taken, by a pass from the leaves up.

The trees are Spark ML's. They learn from two sources: pages made by a seeded generator, whose
truth is known, and a bounded sample of the given pages with an article element, marked by the
meaning of their elements. Pages are then parsed, scored and decoded where they are read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import hash_fraction, table

#: Pages that are learned from: made ones, and given ones at most (about; picked by a hash of the id).
MADE_PAGES, GIVEN_PAGES = 480, 240

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
#: The same where quotes don't pair up: a tag ends at the next ">".
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
#: Tags with a quote that stays open to the end of the page; after so many all tags of the page end at the next ">".
_LOOSE_TAGS = 8
_OPEN = re.compile(r"<!--|<!\[CDATA\[")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe object svg math canvas video audio select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key ends an open element of the value, up to the elements that shield it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_KEEPS_P = frozenset({"button", "label", "option"})
_SHIELDS_P = frozenset({"button", "td", "th", "table", "caption", "html"})

#: Words of class, id and role attributes by what they tell.
TOKENS = {
    "content": "article articlebody body content entry main post story text page prose copy blog paragraph".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs toc pager pagination sitemap skip".split(),
    "top": "header masthead banner top topbar hero logo brand".split(),
    "bottom": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside rail widget widgets complementary column right left secondary".split(),
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion commercial doubleclick".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay banner disclaimer privacy paywall".split(),
    "form": "form login signup signin subscribe newsletter search register input contact".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion reader responses feedback".split(),
    "social": "share sharing social follow like tweet related recommended recommendations more popular trending tags tag".split(),
    "hidden": "hidden invisible none offscreen".split(),
}
_TOKEN_KIND: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words:
        _TOKEN_KIND.setdefault(_w, []).append(_i)
N_KINDS = len(TOKENS)
TAG_GROUPS = [
    {"article"},
    {"main"},
    {"section"},
    {"div", "center"},
    {"p"},
    {"h1"},
    {"h2", "h3", "h4", "h5", "h6", "hgroup"},
    {"ul", "ol", "dl", "menu", "dir"},
    {"li", "dt", "dd"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"nav"},
    {"aside"},
    {"header"},
    {"footer"},
    {"form", "button", "label", "fieldset", "legend", "option", "search"},
    {"blockquote", "pre", "figure", "figcaption"},
    {"body", "html"},
    {"dialog", "details", "summary", "address"},
]
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
N_GROUPS = len(TAG_GROUPS)
#: Groups whose elements are no article text, whatever stands in them.
_NEGATIVE_GROUPS = frozenset({10, 11, 13, 14})


class Page:
    """Nodes in page order, parents first: elements, and leaves with a run of text."""

    def __init__(self, source: str | None):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.kinds: list[frozenset[int]] = []
        self.texts: list[str | None] = []
        self.link_chars: list[int] = []
        self._parse(source or "")

    def _node(self, tag: str, parent: int, kinds: frozenset[int], text: str | None = None, link_chars: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.kinds.append(kinds)
        self.texts.append(text)
        self.link_chars.append(link_chars)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        none = frozenset()
        root = self._node("html", -1, none)
        stack: list[tuple[str, int]] = [("html", root)]  # blocks with their node, inline elements with -1
        where: dict[str, list[int]] = {"html": [0]}  # by name the places in the stack
        owners = [(0, root)]  # places and nodes of blocks
        walls = [0]  # places of blocks that end tags of inline elements don't reach beyond
        run: list[str] = []
        links = linked = 0
        block = root

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self._node("#", block, none, text, min(linked, len(text)))
                run, linked = [], 0

        def push(tag: str, node: int) -> None:
            nonlocal links
            where.setdefault(tag, []).append(len(stack))
            if node >= 0:
                owners.append((len(stack), node))
                if tag != "p":
                    walls.append(len(stack))
            links += node < 0 and tag == "a"
            stack.append((tag, node))

        def pop_to(place: int) -> None:
            """Ends the elements from this place on; each is looked at once in all."""
            nonlocal links, block
            if owners[-1][0] >= place:
                flush()
            while len(stack) > place:
                tag, node = stack.pop()
                where[tag].pop()
                links -= node < 0 and tag == "a"
            for open_ in (owners, walls):
                while (open_[-1][0] if open_ is owners else open_[-1]) >= place:
                    open_.pop()
            block = owners[-1][1]

        def last(names: frozenset[str] | set[str]) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=-1)

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                text = html.unescape(piece) if "&" in piece else piece
                run.append(text)
                if links:
                    linked += len(text)

        at = loose = 0
        end = source.rfind(">") + 1  # what is open there is no tag
        search = _TAG.search
        while m := search(source, at, end):
            add(source[at : m.start()])
            at = m.end()
            if search == _TAG.search:
                closing, name, attributes = m[1] or m[4], m[2] or m[5], m[3] or m[6] or ""
                loose += m[5] is not None
                search = _PLAIN_TAG.search if loose >= _LOOSE_TAGS else search
            else:
                closing, name, attributes = m[1], m[2], m[3] or ""
            if not name:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:] + source[at:])
                    at = at if m[0].endswith("]]>") else len(source)
                elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                continue
            tag = name.lower()
            if closing:
                if tag == "br":
                    run.append(" ")
                place = last({tag})
                if place > (0 if tag in BLOCK else walls[-1]):
                    pop_to(place)
                continue
            if tag in VOID:
                if tag == "br":
                    run.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    closed = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at, end)
                    at = closed.end() if closed else len(source)
                continue
            if tag not in BLOCK:
                if tag != "head":
                    push(tag, -1)
                continue
            if tag == "html" or (tag == "body" and where.get("body")):
                continue
            flush()
            if tag not in _KEEPS_P and last({"p"}) > last(_SHIELDS_P):
                pop_to(last({"p"}))
            if tag in ENDS:
                closed, shields = ENDS[tag]
                while last(closed) > max(0, last(shields)):
                    pop_to(last(closed))
                    if tag not in ("tr", "tbody"):
                        break
            block = self._node(tag, block, _kinds(attributes))
            push(tag, block)
        rest = source[at:]
        if opened := _OPEN.search(rest):
            rest = rest[: opened.start()] + (rest[opened.end() :] if opened[0] != "<!--" else "")
        add(rest)
        flush()


def _kinds(attributes: str) -> frozenset[int]:
    if not attributes:
        return frozenset()
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            for w in _WORDS.findall(_CAMEL.sub(" ", value).lower()):
                out.update(_TOKEN_KIND.get(w, ()))
        elif (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
            out.add(N_KINDS - 1)
    if re.search(r"\shidden(?:\s|$)", attributes):
        out.add(N_KINDS - 1)
    return frozenset(out)


_PUNCTUATION = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"\d")
N_FEATURES = N_GROUPS + 2 * N_KINDS + 22


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parents = page.parents
    chars, marks, blocks, linked, elements, paras, heads, digits = ([0] * n for _ in range(8))
    for i in range(n - 1, -1, -1):
        text = page.texts[i]
        if text is not None:
            chars[i], marks[i], blocks[i], linked[i] = len(text), len(_PUNCTUATION.findall(text)), 1, page.link_chars[i]
            digits[i] = len(_DIGIT.findall(text))
        else:
            elements[i] += 1
            paras[i] += page.tags[i] == "p"
            heads[i] += _GROUP.get(page.tags[i], -1) in (5, 6)
        p = parents[i]
        if p >= 0:
            for s in (chars, marks, blocks, linked, elements, paras, heads, digits):
                s[p] += s[i]
    total = max(1, chars[0])
    children = [0] * n
    order = [0] * n
    depth = [0] * n
    for i in range(1, n):
        p = parents[i]
        order[i] = children[p]
        children[p] += 1
        depth[i] = depth[p] + 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    above_kinds: list[frozenset[int]] = [frozenset()] * n
    above_groups: list[frozenset[int]] = [frozenset()] * n
    before = 0
    log = math.log1p
    for i in range(n):
        p = parents[i]
        leaf = page.texts[i] is not None
        owner = p if leaf else i
        if p >= 0:
            above_kinds[i] = above_kinds[p] | page.kinds[p] if page.kinds[p] else above_kinds[p]
            g = _GROUP.get(page.tags[p], 3)
            above_groups[i] = above_groups[p] if g in above_groups[p] else above_groups[p] | {g}
        row = out[i]
        row[_GROUP.get(page.tags[owner], 3)] = 1
        for k in page.kinds[owner]:
            row[N_GROUPS + k] = 1
        for k in above_kinds[owner]:
            row[N_GROUPS + N_KINDS + k] = 1
        at = N_GROUPS + 2 * N_KINDS
        up = above_groups[owner]
        siblings = children[p] if p >= 0 else 1
        c = chars[i]
        row[at : at + 22] = (
            leaf,
            depth[i],
            order[i],
            order[i] / siblings,
            siblings,
            log(c),
            c / total,
            c / max(1, chars[p]) if p >= 0 else 1,
            linked[i] / max(1, c),
            marks[i] / max(1, c),
            digits[i] / max(1, c),
            log(c / max(1, blocks[i])),
            log(c / (elements[i] + 1)),
            elements[i],
            paras[i],
            heads[i],
            before / total,
            0 in up or 1 in up,
            10 in up or 11 in up,
            12 in up,
            13 in up,
            14 in up,
        )
        if leaf:
            before += c
    return out


class Trees:
    """Boosted trees as flat arrays; a leaf points to itself."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]):
        self.trees = [(w, *(np.array(column) for column in zip(*nodes, strict=True))) for w, nodes in trees]

    @classmethod
    def of(cls, model) -> Trees:
        out = []
        for weight, tree in zip(model.treeWeights, model.trees, strict=True):
            nodes: list = []

            def walk(node, nodes=nodes) -> int:
                me = len(nodes)
                nodes.append((0, 0.0, me, me, float(node.prediction())))
                if node.subtreeDepth() > 0:
                    split = node.split()
                    feature, threshold = int(split.featureIndex()), float(split.threshold())
                    left, right = walk(node.leftChild()), walk(node.rightChild())
                    nodes[me] = (feature, threshold, left, right, 0.0)
                return me

            walk(tree._call_java("rootNode"))
            out.append((float(weight), nodes))
        return cls(out)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                to = np.where(rows[every, feature[at]] <= threshold[at], left[at], right[at])
                if (to == at).all():
                    break
                at = to
            total += weight * value[at]
        return 2 * total


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes to keep: the most probable choice in which a dropped node drops all below it."""
    n = len(page.tags)
    odds = np.clip(log_odds, -30, 30)
    keep = (-np.logaddexp(0, -odds)).tolist()
    drop = (-np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, 0, -1):  # drop[i]: of all below too; keep[i]: with the best choice below
        p = page.parents[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [False] * n
    kept[0] = keep[0] >= drop[0]
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and keep[i] >= drop[i]
    return kept


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The article text of each page, its blocks in page order, one a line."""
    pages = [Page(s) for s in sources]
    out = []
    step = 256
    for i in range(0, len(pages), step):
        some = pages[i : i + step]
        rows = [features(p) for p in some]
        odds = trees.log_odds(np.concatenate(rows))
        at = 0
        for page, r in zip(some, rows, strict=True):
            kept = decode(page, odds[at : at + len(r)])
            at += len(r)
            out.append("\n".join(t for t, k in zip(page.texts, kept, strict=True) if k and t is not None))
    return out


# Learning


def _marks_by_meaning(page: Page) -> list[bool] | None:
    """Nodes of a page with an article or main element that hold article text; None without one."""
    n = len(page.tags)
    inside, bad, good = [False] * n, [False] * n, [False] * n
    for i in range(n):
        p = page.parents[i]
        g = _GROUP.get(page.tags[i], 3)
        inside[i] = (p >= 0 and inside[p]) or g in (0, 1)
        bad[i] = (p >= 0 and bad[p]) or g in _NEGATIVE_GROUPS or (g == 12 and not inside[i]) or bool(page.kinds[i] - {0, 2})
        good[i] = page.texts[i] is not None and inside[i] and not bad[i]
    if not any(inside):
        return None
    for i in range(n - 1, 0, -1):
        good[page.parents[i]] |= good[i]
    return good


_SYLLABLES = "an ber chi do en fa gor hel in ka li mo na or pa qui re sa tion un ver wo ze".split()


def make_page(seed: int) -> tuple[str, set[str]]:
    """A made page and the texts of its article's blocks; every text on it is different."""
    r = random.Random(seed)
    truth: set[str] = set()
    number = iter(range(10**6))
    named = r.random()  # how often elements carry telling names

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))

    def prose(low: int, high: int, article: bool, dots: bool = True) -> str:
        words = [word() + ("," if dots and r.random() < 0.08 else "." if dots and r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
        text = " ".join([*words, f"{word()}{next(number)}"]).capitalize() + ("." if dots else "")
        if article:
            truth.add(text)
        return text

    def attrs(*kinds: str, always: bool = False) -> str:
        if not always and r.random() > 0.4 + named * 0.6:
            return "" if r.random() < 0.5 else f' class="{word()}{r.randint(1, 99)}"'
        name = r.choice(TOKENS[r.choice(kinds)])
        name = r.choice([name, f"{name}-{word()}", f"site-{name}", f"{word()}_{name}", f"{name} {word()}", f"js-{name}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{prose(0, 2, False, False)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def box(tag: str, kinds: tuple[str, ...], inner: str) -> str:
        tag = tag if r.random() < 0.5 or tag in ("form", "nav") else r.choice(["div", "section", "div"])
        telling = tag not in ("nav", "aside", "footer", "header", "form")
        return f"<{tag}{attrs(*kinds, always=telling)}>{inner}</{tag}>"

    def junk() -> str:
        kind = r.randrange(8)
        p = lambda low, high: r.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>"]).format(prose(low, high, False))
        if kind == 0:
            return box("div", ("advert",), p(2, 30) + (p(2, 15) if r.random() < 0.4 else ""))
        if kind == 1:
            return box("div", ("notice",), p(4, 40) + (f"<button>{prose(0, 2, False, False)}</button>" if r.random() < 0.5 else ""))
        if kind == 2:
            return box("form", ("form",), f"<label>{prose(0, 4, False, False)}</label><input>{p(2, 20)}<button>{prose(0, 1, False, False)}</button>")
        if kind == 3:
            return box("div", ("social",), links(r.randint(2, 6)))
        if kind == 4:
            return box("aside", ("side",), (f"<h3>{prose(0, 3, False, False)}</h3>" if r.random() < 0.6 else "") + (links(r.randint(2, 8)) if r.random() < 0.6 else "".join(f"<p>{prose(3, 40, False)}</p>" for _ in range(r.randint(1, 3)))))
        if kind == 5:
            return box("nav", ("menu",), links(r.randint(2, 8)))
        if kind == 6:
            return box("aside", ("social",), f"<h4>{prose(0, 3, False, False)}</h4>" + links(r.randint(2, 6)))
        return comments()

    def comments() -> str:
        one = lambda: f"<{c}{attrs('comment', always=True)}>" + (f"<b>{prose(0, 1, False, False)}</b>" if r.random() < 0.5 else "") + "".join(f"<p>{prose(3, 60, False)}</p>" for _ in range(r.randint(1, 2))) + f"</{c}>"
        c = r.choice(["div", "li", "article", "p"])
        head = f"<h3>{prose(0, 3, False, False)}</h3>" if r.random() < 0.7 else ""
        form = f"<form><label>{prose(0, 3, False, False)}</label></form>" if r.random() < 0.3 else ""
        return f"<{r.choice(['section', 'div', 'div', 'ol'])}{attrs('comment', always=True)}>{head}{''.join(one() for _ in range(r.randint(1, 5)))}{form}</div>"

    def article() -> str:
        parts = [f"<h1>{prose(2, 10, True, False)}</h1>"] if r.random() < 0.85 else []
        close = "</p>" if r.random() < 0.9 else ""
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = r.random()
            if kind < 0.78:
                low, high = r.choice([(0, 3), (3, 15), (10, 60), (30, 120)])
                text = prose(low, high, True)
                if r.random() < 0.1 and text.count(" ") > 4:
                    a, b = text.split(" ", 1)
                    parts.append(f'<p>{a} <a href="/{word()}">{b}</a>{close}' if r.random() < 0.3 else f"<p><b>{a}</b> {b}{close}")
                else:
                    parts.append(f"<p>{text}{close}")
            elif kind < 0.84:
                parts.append(f"<{(h := r.choice(['h2', 'h3']))}>{prose(1, 6, True, False)}</{h}>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{prose(2, 20, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(prose(5, 40, True))}</blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{prose(0, 4, True, False)}</td><td>{prose(0, 4, True, False)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.98:
                parts.append(f"<pre>{prose(5, 30, True)}</pre>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{prose(2, 12, True)}</figcaption></figure>")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            parts.insert(r.randint(min(1, len(parts)), len(parts)), junk())
        if r.random() < 0.15:
            parts.insert(0, f"<header>{parts.pop(0)}</header>" if parts and parts[0].startswith("<h1") else "")
        inner = "".join(parts)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner = f"<div{attrs('content')}>{inner}</div>"
        tag = r.choice(["article", "article", "main", "section", "div", "div"])
        return f"<{tag}{attrs('content', always=tag == 'section')}>{inner}</{tag}>" if tag not in ("article", "main") else f"<{tag}{attrs('content') if r.random() < 0.4 else ''}>{inner}</{tag}>"

    top = [box("header", ("top",), (f"<h2>{prose(0, 4, False, False)}</h2>" if r.random() < 0.5 else prose(0, 6, False)) + (links(r.randint(2, 6)) if r.random() < 0.4 else ""))] if r.random() < 0.6 else []
    top += [box("nav", ("menu",), links(r.randint(2, 10)))] if r.random() < 0.8 else []
    top += [junk() for _ in range(r.choice([0, 0, 1, 1, 2]))]
    bottom = [junk() for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
    bottom += [comments()] if r.random() < 0.35 else []
    foot = [box("footer", ("bottom",), r.choice(["<p>{}</p>", "{}"]).format("&copy; " + prose(2, 25, False)) + (links(r.randint(2, 6)) if r.random() < 0.4 else ""))] if r.random() < 0.85 else []
    middle = top + [article()] + bottom
    if r.random() < 0.4:
        cut = r.randint(0, len(top))
        middle = [*top[:cut], f"<div{attrs('content') if r.random() < 0.3 else ''}>{''.join([*top[cut:], middle[len(top)], *bottom])}</div>"]
    head = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    return head + "".join([*middle, *foot]) + ("</body></html>" if r.random() < 0.9 else ""), truth


def _learn_made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seed in batch.column("id").to_pylist():
            source, truth = make_page(seed)
            page = Page(source)
            good = [t in truth if t is not None else False for t in page.texts]
            for i in range(len(good) - 1, 0, -1):
                good[page.parents[i]] |= good[i]
            yield _rows(page, good)


def _learn_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source in batch.column("html").to_pylist():
            page = Page(source)
            good = _marks_by_meaning(page)
            if good:
                yield _rows(page, good)


def _rows(page: Page, good: list[bool]) -> pa.RecordBatch:
    rows = features(page).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array([float(g) for g in good])], names=["row", "label"])


def train(pages: DataFrame, made: int = MADE_PAGES, given: int = GIVEN_PAGES) -> Trees:
    """Boosted trees from ``made`` generated pages and about ``given`` of ``pages`` at most."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    schema = "row array<double>, label double"
    rows = pages.select("page_id", "html").filter("html is not null")
    n = rows.count()
    picked = rows.filter(hash_fraction("page_id", 3) < min(1.0, given / max(1, n))).select("html")
    learn = spark.range(made, numPartitions=4).mapInArrow(_learn_made, schema).unionByName(picked.mapInArrow(_learn_given, schema)).coalesce(6)
    data = learn.select(array_to_vector("row").alias("features"), "label").persist()
    model = GBTClassifier(maxIter=20, maxDepth=5, maxBins=32, stepSize=0.3, seed=1).fit(data)
    data.unpersist()
    return Trees.of(model)


def extract(spark: SparkSession, source: Column, trees: Trees) -> Column:
    """The main text of HTML; empty for null, empty and text-free pages."""
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("string")
    def run(sources: pa.Array) -> pa.Array:
        return pa.array(main_texts(sources.to_pylist(), shared.value), pa.string())

    return run(source)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``; repeated rows each give a row."""
    done = pages.select("page_id", "url", extract(pages.sparkSession, F.col("html"), train(pages)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
