"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of elements (tolerant of missing end tags and broken markup, in time linear in the page). Each
element gets features of itself, its subtree and its siblings, and the summed log-odds of its attribute tokens, which are
learnt from the training pages; boosted regression trees, trained here on made-up pages whose parts are known,
give the log-odds that its text belongs to the article. Decoding is hierarchical: an element is around the
article, in it, or cut from it, and down from the root these only follow each other in this order, so that nothing is in
below what was cut and nothing is around below what is in. Of all such labellings the one with the most evidence wins,
summed over elements by text length, less a price for each change. Blocks of what is in are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import pick, read, released

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text. Of math, svg and object only the parts that are not shown are among them.
SILENT = frozenset("script style noscript template iframe annotation annotation-xml metadata desc head title textarea select option button canvas audio video".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names, up to the nearest of the stops.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ENDS_P = BLOCK - frozenset("body caption html legend summary tbody td tfoot th thead tr dd dt li figcaption".split()) | {"li", "dd", "dt"}
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z))", re.S)
_HINT = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
#: What may hide an element, before its attributes are told apart.
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SPACE = re.compile(r"\s+")
#: Names that the made-up training pages give to elements; what each tells is learnt.
BAD_WORDS = "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus foot footer footnote form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related recommended replies reply rss search share sharing shop sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
GOOD_WORDS = "article articlebody body content entry hentry main maincontent post story text".split()
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {n: re.compile(rf"</{n}\s*[^>]*>|\Z", re.I) for n in RAW}


def is_hidden(attrs: str) -> bool:
    """Whether an attribute `hidden`, display:none in `style` or aria-hidden=true is among attributes; of equal names the first counts."""
    if not _MAY_HIDE.search(attrs):
        return False
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), value.strip("\"'"))
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(html.unescape(found.get("style", ""))) is not None


class Node:
    __slots__ = ("attrs", "children", "depth", "hidden", "name", "parent", "tokens")

    def __init__(self, name: str, parent: Node | None, attrs: str = "") -> None:
        self.name, self.parent, self.attrs = name, parent, attrs
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.tokens, self.hidden = tokens(attrs) if attrs else (), bool(attrs) and is_hidden(attrs)


@lru_cache(4096)
def tokens(attrs: str) -> tuple[str, ...]:
    """Words of the attributes that name an element or its part, in lower case, camel case apart."""
    hints = " ".join(m.strip("\"'") for m in _HINT.findall(attrs))
    return tuple(_WORD.findall(_CAMEL.sub(" ", hints).lower())) if hints else ()


class _Open:
    """The open elements of a page, the innermost last, with those of each name, so that any question takes no walk."""

    def __init__(self, root: Node) -> None:
        self.path, self.by = [root], {}

    def add(self, node: Node) -> None:
        self.path.append(node)
        self.by.setdefault(node.name, []).append(node)

    def depth(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of these names; 0 if there is none."""
        return max((found[-1].depth for n in names if (found := self.by.get(n))), default=0)

    def close(self, depth: int) -> None:
        """Ends the open element of this depth and all inside it."""
        while self.path[-1].depth >= depth > 0:
            self.by[self.path.pop().name].pop()


_CELLS = ("td", "th", "table")
#: What may stand in a head; anything else ends one that is still open.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_IN_TABLE = frozenset("td th tr tbody thead tfoot table body html".split())
#: A paragraph is not ended across these.
_AROUND_P = ("td", "th", "li", "div", "article", "section", "body", "button", "table", "blockquote")


def _end_head(open_: _Open, other: object) -> None:
    """Ends an open head before what does not belong in one; a template inside it may hold anything."""
    if other and open_.by.get("head") and not open_.by.get("template") and open_.path[-1].name not in SILENT - {"head"}:
        open_.close(open_.depth(("head",)))


def parse(page: str | None) -> Node:
    """The element tree of a page; whatever the markup, no text outside SILENT elements is lost. An end tag without its element, or with a table between, is passed over."""
    root = Node("#root", None)
    at = pos = 0
    page, open_ = page or "", _Open(root)
    while True:
        m = _TAG.search(page, pos)
        if m is None:
            break
        if m.start() > at:
            _end_head(open_, page[at : m.start()].strip())
            open_.path[-1].children.append(page[at : m.start()])
        at = pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            own = open_.depth((name,))
            if own and (name in _IN_TABLE or own > open_.depth(_CELLS)):
                open_.close(own)
            continue
        _end_head(open_, name not in _IN_HEAD)
        if name in ENDS_P and (p := open_.depth(("p",))) > open_.depth(_AROUND_P):
            open_.close(p)
        if name in CLOSES:
            ended, stops = CLOSES[name]
            if (own := open_.depth(ended)) > open_.depth(stops):
                open_.close(own)
        new = Node(name, open_.path[-1], m[3])
        open_.path[-1].children.append(new)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = pos = end.end()
        elif name not in VOID and not m[3].endswith("/") or name not in VOID and name in BLOCK:
            open_.add(new)
    if at < len(page):
        _end_head(open_, page[at:].strip())
        open_.path[-1].children.append(page[at:])
    return root


FEATURES = (
    "depth text_share log_text log_words link_share links_a_word tags_a_word p_share punct_a_word mean_word n_children same_siblings sibling_text index_share token_odds token_low token_odds_above inside_main is_p is_head is_list is_nav is_aside is_article is_foot_head is_form is_div is_table has_h1 list_share short_blocks digits before_article".split()
)
_GROUPS = {
    "is_p": {"p", "blockquote", "pre", "figcaption"},
    "is_head": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "is_list": {"ul", "ol", "li", "dl", "menu", "dt", "dd"},
    "is_nav": {"nav", "menu"},
    "is_aside": {"aside", "dialog"},
    "is_article": {"article", "main"},
    "is_foot_head": {"footer", "header"},
    "is_form": {"form", "fieldset", "label", "legend", "input"},
    "is_div": {"div", "section", "span"},
    "is_table": {"table", "tr", "td", "th", "tbody", "thead"},
}
_GROUP_ORDER = [k for k in FEATURES if k in _GROUPS]
_PUNCT, _DIGITS = re.compile(r"[.,;:!?]"), re.compile(r"\d")


@dataclass
class Page:
    """Elements in page order (parents first), with their features and own text lengths."""

    nodes: list[Node]
    parent: np.ndarray
    own: np.ndarray
    x: np.ndarray


def describe(page: str | None, odds: dict[str, float]) -> Page:
    """odds: what attribute tokens tell; of others nothing is known."""
    root = parse(page)
    nodes, parent = [root], [-1]
    index = {id(root): 0}
    stack = [c for c in reversed(root.children) if not isinstance(c, str)]
    while stack:
        n = stack.pop()
        if n.name in SILENT or n.hidden:
            continue
        index[id(n)] = len(nodes)
        parent.append(index[id(n.parent)])
        nodes.append(n)
        stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    k = len(nodes)
    par = np.array(parent)
    own = np.zeros((k, 9))  # chars, words, link chars, links, tags, p chars, punctuation, digits, h1
    for i, n in enumerate(nodes):
        t = " ".join([c for c in n.children if isinstance(c, str)])
        t = _SPACE.sub(" ", t).strip()
        own[i, 0], own[i, 1] = len(t), t.count(" ") + 1 if t else 0
        own[i, 4], own[i, 3], own[i, 8] = 1, n.name == "a", n.name == "h1"
        own[i, 6] = len(_PUNCT.findall(t))
        own[i, 7] = len(_DIGITS.findall(t))
    link = np.zeros(k, bool)
    para = np.zeros(k, bool)
    listed = np.zeros(k, bool)
    said = np.array([[sum(x), min(x, default=0.0)] for x in ([odds.get(w, 0.0) for w in n.tokens] for n in nodes)])
    above = np.zeros(k)
    main = np.zeros(k)
    for i, n in enumerate(nodes):
        p = par[i]
        link[i] = n.name == "a" or (p >= 0 and link[p])
        para[i] = n.name in ("p", "pre", "blockquote") or (p >= 0 and para[p])
        listed[i] = n.name in ("ul", "ol", "table", "select", "dl") or (p >= 0 and listed[p])
        above[i] = said[i, 0] + (above[p] if p >= 0 else 0)
        main[i] = (n.name in ("article", "main")) + (main[p] if p >= 0 else 0)
    own[:, 2] = own[:, 0] * link
    own[:, 5] = own[:, 0] * para
    sub = np.concatenate([own, (own[:, 0] * listed)[:, None], ((own[:, 0] < 60) * own[:, 0])[:, None]], axis=1)
    for i in range(k - 1, 0, -1):
        sub[par[i]] += sub[i]
    kids = np.bincount(par[1:], minlength=k) if k > 1 else np.zeros(k)
    names = np.array([hash_name(n.name) for n in nodes])
    same = np.zeros(k)
    order = np.zeros(k)
    count: dict[tuple[int, int], int] = {}
    at: dict[int, int] = {}
    for i in range(1, k):
        key = (int(par[i]), int(names[i]))
        count[key] = count.get(key, 0) + 1
        order[i] = at[int(par[i])] = at.get(int(par[i]), -1) + 1
    for i in range(1, k):
        same[i] = count[int(par[i]), int(names[i])]
    words, chars = np.maximum(sub[:, 1], 1), np.maximum(sub[:, 0], 1)
    up = np.maximum(par, 0)
    articles = np.cumsum([n.name in ("article", "main") for n in nodes])
    cols = {
        "depth": [n.depth for n in nodes],
        "text_share": sub[:, 0] / max(1.0, sub[0, 0]),
        "log_text": np.log1p(sub[:, 0]),
        "log_words": np.log1p(sub[:, 1]),
        "link_share": sub[:, 2] / chars,
        "links_a_word": sub[:, 3] / words,
        "tags_a_word": sub[:, 4] / words,
        "p_share": sub[:, 5] / chars,
        "punct_a_word": sub[:, 6] / words,
        "mean_word": chars / words,
        "n_children": np.log1p(kids),
        "same_siblings": np.log1p(same),
        "sibling_text": np.log1p(sub[up, 0] - sub[:, 0]),
        "index_share": order / np.maximum(kids[up], 1),
        "token_odds": said[:, 0],
        "token_low": said[:, 1],
        "token_odds_above": above,
        "inside_main": main,
        "has_h1": sub[:, 8],
        "list_share": sub[:, 9] / chars,
        "short_blocks": sub[:, 10] / chars,
        "digits": sub[:, 7] / chars,
        "before_article": (articles == 0) & bool(articles[-1]),
    }
    for g in _GROUP_ORDER:
        cols[g] = [n.name in _GROUPS[g] for n in nodes]
    return Page(nodes, par, own[:, 0], np.stack([np.asarray(cols[f], np.float64) for f in FEATURES], axis=1))


@lru_cache(4096)
def hash_name(name: str) -> int:
    return int.from_bytes(name.encode()[:7].ljust(7, b"\0"), "big") * 31 + len(name)


# --- boosted trees ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Binary trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    tokens: dict[str, float] = field(default_factory=dict)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        trees = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            f = self.feature[trees, at]
            at = 2 * at + 1 + (x[rows, f] > self.cut[trees, at])
        return self.base + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Forest:
    """Gradient boosting of the logistic loss with histogram splits (second order)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = float((w * y).sum() / w.sum())
    base = float(np.log(p / (1 - p)))
    score, inner = np.full(len(y), base), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = w * (y - q), w * q * (1 - q)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            i = np.flatnonzero(at == node)
            best = (1e-6, 0, -1)
            if len(i) > 8:
                gi, hi = g[i], h[i]
                whole = gi.sum() ** 2 / (hi.sum() + 1)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    n = len(edges[f]) + 1
                    gl, hl = np.cumsum(np.bincount(code[i, f], gi, n))[:-1], np.cumsum(np.bincount(code[i, f], hi, n))[:-1]
                    gain = gl**2 / (hl + 1) + (gi.sum() - gl) ** 2 / (hi.sum() - hl + 1) - whole
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            _, f, k = best
            if k >= 0:
                feature[t, node], cut[t, node] = f, edges[f][k]
            at[i] = 2 * node + 1 + (code[i, f] > k if k >= 0 else 0)
        for n in range(inner + 1):
            i = at == inner + n
            leaf[t, n] = rate * g[i].sum() / (h[i].sum() + 1)
        score += leaf[t, at - inner]
    return Forest(feature, cut, leaf, base)


# --- training pages --------------------------------------------------------------------------------


def _made_page(rng: np.random.Generator) -> str:
    """A page whose main elements carry the mark data-k="1"."""
    syll = ["an", "ter", "il", "o", "ra", "sche", "mi", "ent", "qu", "la", "de", "tion", "ver", "ñe", "é", "ing", "st", "ou"]
    word = lambda: "".join(rng.choice(syll, rng.integers(1, 4)))

    def sent(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.integers(lo, hi))).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    para = lambda: " ".join(sent(1, 22) for _ in range(rng.integers(1, 7)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    maybe = lambda p: rng.random() < p

    def named(words: list[str]) -> str:
        """An attribute of an element that is no part of the article; now and then with any of the names that say so."""
        words = words if maybe(0.7) else BAD_WORDS
        return rng.choice([f' class="{rng.choice(words)}"', f' id="{rng.choice(words)}"', f' class="{word()} {rng.choice(words)}-{word()}"', f' class="{word()}"'], p=[0.4, 0.25, 0.25, 0.1])

    out = []
    if maybe(0.4):
        out.append(rng.choice([f"<header><h1>{sent(1, 4)}</h1><p>{sent(2, 8)}</p></header>", f"<div{named(['header', 'masthead', 'topbar'])}>{word()} <a href='/'>{word()}</a></div>", f"<header{named(['header'])}><a href='/'>{word()}</a><span>{sent(2, 6)}</span></header>"]))
    if maybe(0.8):
        tag = rng.choice(["nav", "nav", "div", "ul"])
        body = links(rng.integers(2, 9))
        out.append(f"<{tag}{named(['nav', 'menu', 'navbar', 'breadcrumb']) if tag != 'nav' or maybe(0.3) else ''}>{body if tag == 'ul' else '<ul>' + body + '</ul>'}</{tag}>")
    for p, names in ((0.6, ["ad", "ads", "banner", "sponsored", "promo"]), (0.3, ["cookie", "notice", "consent", "newsletter", "subscribe"])):
        if maybe(p):
            tag = rng.choice(["div", "div", "aside", "section"])
            inner = rng.choice([sent(2, 14), f"<p>{sent(3, 16)}</p>", f"<p>{para()}</p><a href='/x'>{word()}</a>", f"{sent(2, 9)} <button>{word()}</button>"])
            out.append(f"<{tag}{named(names)}>{inner}</{tag}>")
    side = f"<{(t := rng.choice(['aside', 'div', 'aside']))}{named(['sidebar', 'widget', 'related']) if t == 'div' or maybe(0.5) else ''}><h3>{sent(1, 4)}</h3>{rng.choice(['<ul>' + links(4) + '</ul>', f'<p>{para()}</p>'])}</{t}>"
    if maybe(0.25):
        out.append(side)
    body = []
    if maybe(0.9):
        h = rng.choice(["h1", "h1", "h2"])
        body.append(f'<{h} data-k="1">{sent(2, 12)}</{h}>')
    if maybe(0.3):
        body.append(f'<p data-k="0" class="{rng.choice(["share", "social", "share-buttons"])}"><a href="/t">{word()}</a> <a href="/f">{word()}</a></p>')
    n = int(rng.choice([1, 2, 3, 5, 8, 15, 30], p=[0.15, 0.15, 0.2, 0.2, 0.15, 0.1, 0.05]))
    for _ in range(n):
        kind = rng.random()
        if kind < 0.62:
            body.append(f'<p data-k="1">{para()}</p>')
        elif kind < 0.74:
            body.append(f'<p data-k="1"><b data-k="1">{para()}<br><p data-k="1">{para()}</p>')
        elif kind < 0.8:
            body.append(f'<h2 data-k="1">{sent(2, 7)}</h2>')
        elif kind < 0.86:
            body.append('<ul data-k="1">' + "".join(f'<li data-k="1">{sent(2, 12)}</li>' for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.9:
            body.append(f'<blockquote data-k="1"><p data-k="1">{para()}</p></blockquote>')
        elif kind < 0.94:
            body.append(f'<p data-k="1">{sent(2, 9)} <a href="/{word()}" data-k="1">{word()} {word()}</a> {sent(2, 9)}</p>')
        elif kind < 0.97:
            body.append(f'<table data-k="1"><tr data-k="1"><td data-k="1">{word()}</td><td data-k="1">{sent(1, 5)}</td></tr></table>')
        else:
            body.append(f"<div{named(['ad', 'promo', 'related', 'newsletter'])}>{rng.choice([sent(2, 12), '<ul>' + links(3) + '</ul>'])}</div>")
    style = rng.random()
    inner = "".join(body)
    if style < 0.6:
        main = f'<article data-k="1">{inner}</article>'
    elif style < 0.75:
        main = f'<main data-k="1">{inner}</main>'
    elif style < 0.92:
        main = f'<div data-k="1" class="{rng.choice(["content", "post", "entry", "article", "main", "story", "text"] if maybe(0.7) else GOOD_WORDS)}">{inner}</div>'
    else:
        main = f'<div data-k="1">{inner}</div>'
    out.append(f'<div class="{rng.choice(["wrap", "page", "container", "row"])}">{main}{side if maybe(0.3) else ""}</div>' if maybe(0.25) else main)
    if maybe(0.3):
        c = rng.choice(["comments", "comment-list", "replies", "disqus"])
        items = "".join(rng.choice([f'<div class="comment"><p>{para()}</p></div>', f"<li><b>{word()}</b><p>{para()}</p></li>"]) for _ in range(rng.integers(1, 6)))
        out.append(f'<{(t := rng.choice(["section", "div", "ol"]))} {rng.choice(["class", "id"])}="{c}"><h3>{sent(1, 3)}</h3>{items}</{t}>')
    if maybe(0.25):
        out.append(f"<form action='/s'{named(['search', 'login', 'signup', 'form'])}><label>{sent(1, 4)}</label><input><button>{word()}</button><p>{sent(3, 12)}</p></form>")
    if maybe(0.2):
        out.append(side)
    if maybe(0.85):
        t = rng.choice(["footer", "footer", "div"])
        out.append(f"<{t}{named(['footer', 'foot', 'copyright']) if t == 'div' or maybe(0.3) else ''}>&copy; {word()} &middot; {rng.choice([sent(2, 14), para(), '<ul>' + links(4) + '</ul>'])}</{t}>")
    return "<html><body>" + "".join(out) + ("</body></html>" if maybe(0.8) else "")


def _shares(nodes: list[Node], parent: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each element's subtree, and the share of it that is marked."""
    text, good = own.copy(), own * np.array(['data-k="1"' in n.attrs for n in nodes], float)
    for i in range(len(text) - 1, 0, -1):
        text[parent[i]] += text[i]
        good[parent[i]] += good[i]
    return text, good / np.maximum(text, 1)


def token_odds(pages: list[Page]) -> dict[str, float]:
    """For each attribute token the log-odds that an element with it is main, against those without tokens' share, from clear elements; smoothed by one."""
    inside, outside = Counter(), Counter()
    for d in pages:
        text, share = _shares(d.nodes, d.parent, d.own)
        for n, t, x in zip(d.nodes, text, share, strict=True):
            if t > 0:
                (inside if x > 0.5 else outside).update(set(n.tokens))
    total = math.log((sum(inside.values()) + 1) / (sum(outside.values()) + 1))
    return {w: math.log((inside[w] + 1) / (outside[w] + 1)) - total for w in inside | outside if inside[w] + outside[w] >= 5}


def train(pages: int = 600, seed: int = 5) -> Forest:
    """On made-up pages (documented bound: `pages`); token odds from a third of them, trees from the others, so that the trees see odds as they are for new pages."""
    rng = np.random.default_rng(seed)
    made = [_made_page(rng) for _ in range(pages)]
    odds = token_odds([describe(p, {}) for p in made[: pages // 3]])
    xs, ys = [], []
    for p in made[pages // 3 :]:
        d = describe(p, odds)
        text, share = _shares(d.nodes, d.parent, d.own)
        clear = (text > 0) & ((share > 0.95) | (share < 0.05))
        xs.append(d.x[clear])
        ys.append((share > 0.5)[clear])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    forest = boost(x, y, np.ones(len(y)))
    forest.tokens = odds
    return forest


@lru_cache(1)
def default_forest() -> Forest:
    return train()


#: What a change of state between an element and its child costs, in log-odds times log(1 + characters).
CHANGE = 6.0


def decode(d: Page, odds: np.ndarray) -> np.ndarray:
    """Whether each element is in the article.

    Every element is around the article (0), in it (1) or cut from it (2); a child's state is that of its parent or a
    later one, a change costs CHANGE, and only elements that are in give their evidence. The best labelling by dynamic
    programming over the tree: of equal ones that with the earlier state.
    """
    k = len(d.nodes)
    wins = np.zeros((k, 2))  # around, in; what is cut gains nothing
    wins[:, 1] = np.clip(odds, -6, 6) * np.log1p(d.own)  # of own text only: an element without it has no say of its own
    for i in range(k - 1, 0, -1):
        around, inside = wins[i]
        p = d.parent[i]
        wins[p, 0] += max(around, inside - CHANGE)
        wins[p, 1] += max(inside, -CHANGE)
    state = np.zeros(k, np.int8)
    state[0] = wins[0, 1] - CHANGE > wins[0, 0]
    for i in range(1, k):
        s = state[d.parent[i]]
        if s == 0:
            state[i] = wins[i, 1] - CHANGE > wins[i, 0]
        else:
            state[i] = 2 if s == 2 or -CHANGE > wins[i, 1] else 1
    return state == 1


def blocks(d: Page, state: np.ndarray) -> str:
    """Text of the elements that are in: one line a block."""
    lines: list[str] = []
    part: list[str] = []
    index = {id(n): i for i, n in enumerate(d.nodes)}

    def flush() -> None:
        if part:
            line = _SPACE.sub(" ", html.unescape("".join(part))).strip()
            if line:
                lines.append(line)
            part.clear()

    stack: list[tuple[Node, int]] = [(d.nodes[0], 0)]
    while stack:
        n, at = stack.pop()
        i = index[id(n)]
        while at < len(n.children):
            c = n.children[at]
            at += 1
            if isinstance(c, str):
                if state[i]:
                    part.append(c)
            elif id(c) in index:
                if c.name in BLOCK:
                    flush()
                elif c.name == "br":
                    part.append(" ")
                stack.append((n, at))
                n, at = c, 0
                i = index[id(n)]
        if n.name in BLOCK:
            flush()
    flush()
    return "\n".join(lines)


def extract(page: str | None, forest: Forest | None = None) -> str:
    """The main text of one page; empty for a null or empty page and for one without an article."""
    forest = forest or default_forest()
    d = describe(page, forest.tokens)
    return blocks(d, decode(d, forest.log_odds(d.x)))


def main_text(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text of each row; null ids and urls stay null, null and empty pages have an empty text. Equal and repeated rows are handled one by one."""
    sent = pages.sparkSession.sparkContext.broadcast(forest or default_forest())  # trees of fixed number and depth

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([extract(h, forest) for h in c.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    p = pick(pages, "page_id", "url", "html")
    return p.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
