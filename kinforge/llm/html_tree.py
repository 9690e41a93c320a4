"""Operator 7: main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of its block elements.  Every node is content or
boilerplate; its tag, class names, own text and link share give its state
potentials, and each edge of the tree a potential between parent and child
(by kind of the child).  Sum-product message passing upward and downward gives
the exact marginals; the texts of nodes that are content with probability over
one half are the main text.

The model is learned by its exact likelihood (the same messages give the
expectations) from labelled pages.  These pages are made by `labelled_pages`
from a fixed set of layouts, so nothing has to be read or stored for it.

Extraction is one pass without a shuffle, in time linear in a page's length
whatever its markup.  Defined cases: a null, empty or text-free page has the
empty text; unclosed and stray tags are repaired as browsers do for blocks, a
tag without its end takes the rest of the page; blocks nested deeper than
`MAX_DEPTH` are siblings there, as in browsers, and keep their text; scripts,
styles, comments and form fields have no text; null ids and urls stay null;
repeated rows get a row each; a page of any length is read whole; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import cut

# Fixed values of the HTML language.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe svg object canvas audio video textarea head title".split())
#: Of these, what has no end tag is an element without text of its own: the page goes on behind its tag.
_OPEN = frozenset("head title svg object canvas audio video template".split())
#: Nested blocks beyond this depth become siblings.
MAX_DEPTH = 512
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
_CLOSES_P = BLOCKS - {"button", "body", "html", "option", "select", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

#: Possessive: once a tag has begun nothing is read twice.  A quote that never ends is a sign like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Parts of class and id names, by what they tell (a name may tell several things).
NAMES = {
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc toolbar",
    "top": "header masthead topbar logo branding hero",
    "foot": "footer foot copyright legal colophon",
    "side": "side sidebar aside widget rail related recommended more popular trending",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall",
    "social": "social share sharing follow twitter facebook",
    "comment": "comment comments reply replies discussion disqus respond responses thread",
    "form": "form login search contact input",
    "meta": "meta byline author date tags category",
    "main": "article content post entry main story text body prose page",
}
_TELLS = {word: kind for kind, words in NAMES.items() for word in words.split()}
TAGS = ["other", *"article aside blockquote body button dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 header li main menu nav ol p pre section select table td th tr ul".split()]
_TAG = {t: i for i, t in enumerate(TAGS)}
_KINDS = list(NAMES)
_N_LENGTH, _N_LINK, _N_MARK, _N_DEPTH = 10, 5, 4, 6


@dataclass
class Tree:
    """Block elements in page order; parents come before their children."""

    parent: list[int]
    tag: list[str]
    kinds: list[frozenset[str]]
    own: list[int]  # characters of own text
    linked: list[int]  # of these, inside links
    marks: list[int]  # sentence marks in own text
    blocks: list[tuple[int, str]]  # (node, text) in page order
    label: list[int]  # where known (learning): 1 content


def _told(attributes: str) -> frozenset[str]:
    kinds = set()
    for m in _ATTRIBUTE.finditer(attributes):
        kinds |= {_TELLS[w] for x in _NAME.findall(m[2] or m[3] or m[4] or "") if (w := x.lower()) in _TELLS}
    return frozenset(kinds)


def parse(page: str) -> Tree:
    """The tree of a page; node 0 is the page itself."""
    tree = Tree([-1], ["body"], [frozenset()], [0], [0], [0], [], [-1])
    stack, names = [0], ["body"]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    held: list[str] = []
    link = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                node = stack[-1]
                tree.blocks.append((node, text))
                tree.own[node] += len(text)
                tree.marks[node] += sum(map(text.count, ".,;:!?"))

    def close(k: int) -> None:
        nonlocal link
        flush()
        link = 0
        for name in names[k:]:
            places[name].pop()
        del stack[k:], names[k:]

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else 0

    at, raw_end, unclosed = 0, {}, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text = page[at : m.start()]
            held.append(text)
            if link:
                tree.linked[stack[-1]] += len(text.strip())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link = 0
            elif name in BLOCKS and last(name):
                close(last(name))
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                if name not in raw_end:
                    raw_end[name] = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I)
                end = None if name in unclosed else raw_end[name].search(page, at)
                if end:
                    at = end.end()
                else:  # none will be found further on either
                    unclosed.add(name)
                    at = at if name in _OPEN else len(page)
            continue
        if name == "a":
            link = 1
        elif name == "br" or name == "hr":
            held.append(" ") if name == "br" else flush()
        elif name in BLOCKS and name not in ("html", "body"):
            flush()
            if name in _CLOSES_P and last("p") and last("p") >= max(map(last, ("td", "th", "li", "blockquote", "div", "button"))):
                close(last("p"))
            for other in CLOSES.get(name, "").split():
                if names[-1] == other and len(names) > 1:
                    close(len(names) - 1)
            if len(stack) >= MAX_DEPTH:
                close(len(stack) - 1)
            tree.parent.append(stack[-1])
            tree.tag.append(name)
            tree.kinds.append(_told(m[3]) if m[3] else frozenset())
            for column in (tree.own, tree.linked, tree.marks):
                column.append(0)
            tree.label.append(1 if m[3] and "data-content" in m[3] else 0)
            places.setdefault(name, []).append(len(stack))
            stack.append(len(tree.tag) - 1)
            names.append(name)
            link = 0
    held.append(page[at:])
    flush()
    return tree


@dataclass
class Forest:
    """Trees of many pages side by side: features and levels for message passing."""

    parent: np.ndarray
    level: list[np.ndarray]  # nodes by depth
    features: np.ndarray  # (node, column): place in the weights, -1 for none
    edge: np.ndarray  # kind of the edge to the parent
    begin: np.ndarray  # first node of each page


def _features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(tree.tag)
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        depth[i] = depth[tree.parent[i]] + 1
    tag = np.array([_TAG.get(t, 0) for t in tree.tag])
    told = np.array([[k in kinds for k in _KINDS] for kinds in tree.kinds])
    own = np.array(tree.own)
    length = np.minimum(np.ceil(np.log2(own + 1)), _N_LENGTH - 1).astype(np.int64)
    link = np.minimum(np.array(tree.linked) * (_N_LINK - 1) // np.maximum(own, 1), _N_LINK - 1)
    mark = np.minimum(np.array(tree.marks), _N_MARK - 1)
    base = np.cumsum([0, len(TAGS), len(_KINDS), _N_LENGTH, _N_LINK, _N_MARK, _N_DEPTH])
    columns = [
        base[0] + tag,
        *(np.where(told[:, k], base[1] + k, -1) for k in range(len(_KINDS))),
        base[2] + length,
        base[3] + link,
        base[4] + mark,
        base[5] + np.minimum(depth, _N_DEPTH - 1),
    ]
    return np.stack(columns, axis=1), tag, depth


N_FEATURES = len(TAGS) + len(_KINDS) + _N_LENGTH + _N_LINK + _N_MARK + _N_DEPTH


def forest(trees: list[Tree]) -> Forest:
    begin = np.cumsum([0, *(len(t.tag) for t in trees)])
    made = [_features(t) for t in trees]
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + b) for t, b in zip(trees, begin, strict=False)])
    depth = np.concatenate([d for *_, d in made])
    level = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    return Forest(parent, level, np.concatenate([f for f, *_ in made]), np.concatenate([t for _, t, _ in made]), begin)


@dataclass
class Model:
    node: np.ndarray  # (N_FEATURES, 2)
    edge: np.ndarray  # (len(TAGS), 2, 2): [kind, parent's state, child's state]

    def marginals(self, f: Forest, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Sum-product: probability of each state of each node (and of each edge's pair)."""
        padded = np.vstack([self.node, np.zeros((1, 2))])  # place -1: nothing
        own = padded[f.features].sum(axis=1)
        up = own.copy()  # own potential and all messages from below
        message = np.zeros_like(own)  # to the parent
        for nodes in reversed(f.level[1:]):
            m = np.logaddexp.reduce(self.edge[f.edge[nodes]] + up[nodes][:, None, :], axis=2)
            message[nodes] = m - m.max(axis=1, keepdims=True)
            np.add.at(up, f.parent[nodes], message[nodes])
        belief = up.copy()
        pair = np.zeros((len(own), 2, 2)) if pairs else None
        for nodes in f.level[1:]:
            rest = belief[f.parent[nodes]] - message[nodes]  # the parent without this child
            joint = self.edge[f.edge[nodes]] + rest[:, :, None]
            down = np.logaddexp.reduce(joint, axis=1)
            belief[nodes] = up[nodes] + down - down.max(axis=1, keepdims=True)
            if pairs:
                both = joint + up[nodes][:, None, :]
                both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                pair[nodes] = both / both.sum(axis=(1, 2), keepdims=True)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), pair


def fit(trees: list[Tree], epochs: int = 80, rate: float = 0.1, ridge: float = 2e-3) -> Model:
    """Maximum likelihood by Adam over all labelled trees at once."""
    f = forest(trees)
    y = np.concatenate([t.label for t in trees])
    y[f.level[0]] = 1
    model = Model(np.zeros((N_FEATURES, 2)), np.zeros((len(TAGS), 2, 2)))
    parts = (model.node, model.edge)
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    inner = np.concatenate(f.level[1:])
    weight = 20.0 / len(y)
    for tick in range(1, epochs + 1):
        p, pair = model.marginals(f, pairs=True)
        p[np.arange(len(y)), y] -= 1
        pair[inner, y[f.parent[inner]], y[inner]] -= 1
        grads = [np.zeros((N_FEATURES + 1, 2)), np.zeros_like(model.edge)]
        for k in range(f.features.shape[1]):
            np.add.at(grads[0], f.features[:, k], p)
        np.add.at(grads[1], f.edge[inner], pair[inner])
        for part, grad, m, s in zip(parts, (grads[0][:-1], grads[1]), mean, square, strict=True):
            grad = weight * grad + ridge * part
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            part -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.99**tick)) + 1e-8)
    return model


def labelled_pages(n: int = 400, seed: int = 1) -> list[str]:
    """Pages of many layouts whose content elements carry data-content."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwy"

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return (words(1, 18) + rng.choice([".", ".", ".", "?", "!", ","])).capitalize()

    def prose() -> str:
        kind = rng.random()
        if kind < 0.15:  # noisy text is content too
            return " ".join(w + rng.choice(["***", "###", "&amp;&amp;&amp;", "$$$", "|", "!!"]) for w in words(1, 60).split())
        if kind < 0.25:
            return words(1, 6)
        return " ".join(sentence() for _ in range(rng.randint(1, 6)))

    def pick(kind: str) -> str:
        return rng.choice(NAMES[kind].split())

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(a, b)))

    def menu() -> str:
        body = f"<ul>{links(2, 9)}</ul>"
        return rng.choice([f"<nav>{body}</nav>", f'<div class="{pick("menu")}">{body}</div>', f'<nav class="{pick("menu")}">{body}</nav>'])

    def fixed(kind: str, tag: str, a: int = 2, b: int = 14) -> str:
        inner = rng.choice([words(a, b), f"<p>{sentence()}</p>", f"<p>{words(a, b)}</p><a href='/x'>{words(1, 3)}</a>", f"<ul>{links(1, 5)}</ul>", sentence()])
        chosen = rng.choice([tag, "div", "section"])
        named = "" if chosen in ("header", "footer", "aside", "nav", "form") and rng.random() < 0.4 else f' {rng.choice(["class", "id"])}="{pick(kind)}"'
        return f"<{chosen}{named}>{inner}</{chosen}>"

    def comments() -> str:
        items = "".join(f'<{t}><b>{words(1, 2)}</b> <p>{prose()}</p></{t}>' for t in [rng.choice(["li", "div", "article"])] * rng.randint(1, 5))
        name = pick("comment")
        return rng.choice([f'<section class="{name}"><h3>{words(1, 2)}</h3>{items}</section>', f'<div id="{name}">{items}</div>', f'<ol class="{name}-list">{items}</ol>'])

    def article() -> str:
        parts = [f"<h1 data-content>{words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.15:
            parts.append(f'<div class="{pick("meta")}">{words(1, 5)}</div>')
        many = rng.random() < 0.15  # verse, dialogue, lists of lines
        for _ in range(rng.randint(30, 150) if many else rng.randint(1, 12)):
            if many:
                parts.append(f"<p data-content>{rng.choice([words(1, 4), sentence(), prose()])}</p>")
                continue
            kind = rng.random()
            if kind < 0.72:
                tail = rng.choice(["</p>", "</p>", "</p>", "<br></p>", "<br>", "</b></p>"])
                parts.append(f"<p data-content>{rng.choice(['', '', '<b>'])}{prose()}{tail}")
            elif kind < 0.78:
                parts.append(f"<h2 data-content>{words(1, 6)}</h2>")
            elif kind < 0.84:
                kind = rng.choice(["ul", "ol"])
                parts.append(f"<{kind} data-content>" + "".join(f"<li data-content>{prose()}</li>" for _ in range(rng.randint(1, 5))) + f"</{kind}>")
            elif kind < 0.88:
                parts.append(f"<blockquote data-content><p data-content>{prose()}</p></blockquote>")
            elif kind < 0.91:
                cells = "".join(f"<td data-content>{words(1, 3)}</td>" for _ in range(3))
                parts.append(f"<table data-content><tr data-content>{cells}</tr></table>")
            elif kind < 0.94:
                parts.append(f"<div data-content>{prose()}</div>")
            elif kind < 0.96:
                parts.append(f"<pre data-content>{words(2, 20)}</pre>")
            else:
                parts.append(fixed(rng.choice(["advert", "social", "side", "notice"]), "aside"))
        if rng.random() < 0.2:
            parts.append(comments())
        body = "".join(parts)
        shell = rng.random()
        if shell < 0.5:
            return f"<article data-content>{body}</article>"
        if shell < 0.65:
            return f"<main data-content>{body}</main>"
        if shell < 0.9:
            return f'<div class="{pick("main")}" data-content>{body}</div>'
        return f"<div data-content>{body}</div>"

    pages = []
    for _ in range(n):
        before = [menu()] if rng.random() < 0.8 else []
        after = [fixed("foot", "footer", 2, 30)] if rng.random() < 0.85 else []
        for kind, tag, likely in (("top", "header", 0.4), ("advert", "div", 0.5), ("notice", "div", 0.3), ("form", "form", 0.25), ("side", "aside", 0.4), ("social", "div", 0.25)):
            if rng.random() < likely:
                (before if rng.random() < 0.5 else after).insert(0, fixed(kind, tag))
        if rng.random() < 0.3:
            after.insert(0, comments())
        rng.shuffle(before)
        body = "".join(before) + article() + "".join(after)
        if rng.random() < 0.3:
            body = f"<div data-content>{body}</div>"
        pages.append(f"<html><head><title>x</title></head><body>{body}</body></html>")
    return pages


@functools.lru_cache(maxsize=2)
def trained(n_pages: int = 400) -> Model:
    """The model of the built-in labelled pages; the same on every machine."""
    return fit([parse(p) for p in labelled_pages(n_pages)])


TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    f = forest(trees)
    p, _ = model.marginals(f)
    content = p[:, 1] > 0.5
    return ["\n".join(text for node, text in t.blocks if content[b + node]) for t, b in zip(trees, f.begin, strict=False)]


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    model = model or trained()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for big in cut(batch.select(["page_id", "html", "url"])):
                for a in range(0, big.num_rows, 200):
                    part = big.slice(a, 200)
                    texts = main_texts(part.column(1).to_pylist(), model)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.string())], names=TEXTS.names)

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(rows, TEXTS)
