"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks of text at block-level tags. Each block gets a signed cost in log-odds: positive costs are
capacities from the source (content), negative ones capacities to the sink (boilerplate). Neighbouring blocks are joined
by smoothness edges, stronger the closer they are in the DOM, and blocks of one parent are joined along it. The maximum
flow from source to sink leaves the labelling of least total cost; what cannot reach the sink any more is content.

The cost is that of a logistic classifier of the block's own text and tag (length, punctuation, share of links, kind of
tag, ...) and of its place. It is fitted on weak labels: in pages that mark an article (or main part), blocks within it are content, others
and those of menus, footers and the like are not. Where pages mark too little, the weights stay at ``DEFAULTS``, to which
the fit of the own features is drawn; it sees no marks. The place in a marked page is a feature too, whose weights are learned from
nothing beside what the own features may say at most (``CLIP``); only the weight of excluding words is drawn to its default.

Scripts, styles, comments in the markup, forms and hidden parts have no blocks. Menus, footers, sidebars and notices known by
tag or role have a sink capacity no neighbour can outweigh. Words of a class or id (adverts, reader comments and the like) are
a strong but finite cost to all blocks below; those behind has-, no-, with- and without- say what a part lays out and do not
count. Where every article (main part, if there is one) lies below such a word, the words above it are no cost to it; in pages
without either, the words of a part that holds nine tenths of the text are none.

Scale: fitting takes a bounded sample, at most ``SAMPLE`` pages of up to ``SAMPLE_CHARS`` characters, the first in the order of a
seeded hash of id and url, and ``SAMPLE_BLOCKS`` blocks of each, evenly spread. Extraction is one narrow pass over whole pages;
each page is a graph of its own, with as many edges as blocks times three, so memory follows the longest page. Augmenting
paths are searched from one block at a time and stop at the nearest sink; blocks that can reach none are never searched again.

Defined results: null html is empty; a page without content has the empty text and 0 characters; repeated rows are
extracted alike; markup cut off at the end of a page is dropped; other columns are ignored; empty tables are allowed.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|canvas|object|textarea|select)\b[^>]*>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTES = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts that are never the article, by tag and by role, and hardly ever, by words of class or id; words that only name a layout.
NEVER_TAGS = frozenset("head title nav footer aside form fieldset menu dialog button label legend".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay share sharing social comment comments commentlist disqus respond replies related recommended pagination pager toolbar widget widgets hidden".split()
)
LAYOUT_WORDS = frozenset("has no with without".split())
LIKELY_WORDS = frozenset("article content entry main post story text body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.!?;:,…。！？]")

#: Features of the block classifier and their weights where nothing is learned, in log-odds of content.
DEFAULTS = {
    "bias": -1.0,
    "long": 1.5,
    "sentences": 0.0,
    "words": 0.0,
    "punctuation": 1.0,
    "links": -4.0,
    "all_links": 0.0,
    "paragraph": 1.0,
    "heading": 0.5,
    "item": 0.0,
    "cell": 0.0,
    "likely": 1.0,
    "header": -2.0,
    "rights": -2.0,
    "inside": 8.0,
    "beside": -0.5,
    "outside": -4.5,
    "word": -12.0,
}
#: The last of them tell the place: in the article (or in the main part of a page without one), in the main part beside its
#: article, elsewhere in a marked page; and in any page, below a word of class or id. What a mark says is learned from nothing.
OWN = len(DEFAULTS) - 4
START = DEFAULTS | {"inside": 0.0, "beside": 0.0, "outside": 0.0}
#: How much the block's own features may say: less than two neighbours of one kind can outweigh.
CLIP = 2.0
NEVER = 10_000.0
#: Smoothness between neighbours, halved for each step between them in the DOM, and along a parent.
SMOOTH, DECAY, SIBLING = 6.0, 0.5, 1.0
SAMPLE, SAMPLE_CHARS, SAMPLE_BLOCKS, SEED = 500, 200_000, 100, 9
#: How strongly weights are drawn to their defaults: like so many blocks of either kind.
PRIOR, PLACE_PRIOR = 5.0, 1.0


class Node:
    __slots__ = ("parent", "tag", "depth", "never", "article", "main", "header", "likely", "worded", "inner", "last", "own", "chars")

    def __init__(self, parent: Node | None, tag: str, attributes: str):
        self.parent, self.tag, self.last, self.chars = parent, tag, -1, 0
        self.depth = parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or tag == "article"
        self.main = bool(parent and parent.main) or tag == "main"
        self.header = bool(parent and parent.header) or tag == "header"
        self.never = bool(parent and parent.never) or tag in NEVER_TAGS
        self.likely = bool(parent and parent.likely)
        hit = False
        if attributes and not self.never:
            for m in _ATTRIBUTES.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    found = {w.lower() for w in _WORDS.findall(value)}
                    hit = hit or any(never_word(name) for name in value.split())
                    self.likely = self.likely or bool(found & LIKELY_WORDS)
                elif name == "role":
                    self.never = self.never or value.lower() in NEVER_ROLES
                    self.article, self.main = self.article or value.lower() == "article", self.main or value.lower() == "main"
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.never = True
        above = bool(parent and parent.worded)
        own = hit and tag not in ("html", "body", "article", "main")
        self.own, self.worded = own, above or own
        if (self.article or self.main) and not (parent and (parent.article or parent.main)):
            self.inner = above and hit  # a comment among comments may be an article too
        else:
            self.inner = bool(parent and parent.inner) or own


def never_word(name: str) -> bool:
    """Whether one class or id names a part that is no article, in words before any of layout."""
    for w in _WORDS.findall(name):
        if w.lower() in LAYOUT_WORDS:
            return False
        if w.lower() in NEVER_WORDS:
            return True
    return False


class Block:
    __slots__ = ("node", "parts", "text", "linked")

    def __init__(self, node: Node):
        self.node, self.parts, self.text, self.linked = node, [], "", 0


def blocks_of(html: str) -> list[Block]:
    """The text blocks in page order, without empty ones."""
    root = Node(None, "", "")
    stack, open_tags, links = [root], Counter(), 0
    out: list[Block] = []
    current: Block | None = None

    def pop_to(tag: str) -> None:
        while True:
            gone = stack.pop().tag
            open_tags[gone] -= 1
            if gone == tag:
                return

    for m in _TOKENS.finditer(html):
        text = m["text"]
        if text is not None:
            if current is None or current.node is not stack[-1]:
                current = Block(stack[-1])
                out.append(current)
            text = unescape(text)
            current.parts.append(text)
            if links > 0:
                current.linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK_TAGS:
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag == "a":
                links = 0 if m["end"] else 1
            elif tag in NEVER_TAGS:  # inline parts of forms
                if m["end"]:
                    if open_tags[tag]:
                        pop_to(tag)
                else:
                    stack.append(Node(stack[-1], tag, m["rest"]))
                    open_tags[tag] += 1
                current = None
            continue
        current, links = None, 0
        if m["end"]:
            if open_tags[tag]:
                pop_to(tag)
            continue
        if open_tags["p"]:
            pop_to("p")
        if tag in ("li", "dd", "dt", "tr", "td", "th") and stack[-1].tag == tag:
            pop_to(tag)
        if tag in VOID_TAGS:
            continue
        stack.append(Node(stack[-1], tag, m["rest"]))
        open_tags[tag] += 1
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return kept


def features(block: Block) -> list[float]:
    """The block by itself: the first ``OWN`` of ``DEFAULTS``, in their order."""
    n, text = block.node, block.text
    size = len(text)
    marks = len(_PUNCTUATION.findall(text))
    linked = min(1.0, block.linked / max(1, size))
    return [
        1.0,
        min(size, 200) / 200,
        min(marks, 10) / 10,
        min(text.count(" "), 20) / 20,
        float(marks > 0),
        linked,
        float(linked > 0.9),
        float(n.tag in ("p", "blockquote", "pre")),
        float(n.tag in HEADINGS),
        float(n.tag in ("li", "dd", "dt")),
        float(n.tag in ("td", "th")),
        float(n.likely),
        float(n.header and not n.article),
        float("©" in text and size < 300),
    ]


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, offset: np.ndarray, prior: float) -> np.ndarray:
    """Logistic weights beside a fixed ``offset``, both kinds of block weighing alike, drawn to ``start``."""
    weight = np.where(y > 0, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        slope = x.T @ (weight * (p - y)) + prior * (w - start)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + prior * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, prior: float = PRIOR) -> list[float]:
    """All weights: those of the blocks' own features as if no page had marks, then those of the place beside what the own
    features may say. The latter know nothing of marks but what the blocks show, and start from none."""
    if not len(y) or y.min() == y.max():
        return list(DEFAULTS.values())
    own, start = np.array(list(DEFAULTS.values()))[:OWN], np.array(list(START.values()))[OWN:]
    own = _newton(x[:, :OWN], y, own, np.zeros(len(y)), prior)
    return [*own.tolist(), *_newton(x[:, OWN:], y, start, np.clip(x[:, :OWN] @ own, -CLIP, CLIP), PLACE_PRIOR).tolist()]


def labelled(html: str | None, most: int = SAMPLE_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Features and weak labels of up to ``most`` blocks of a page; none where the page marks neither article nor main part."""
    blocks = [b for b in blocks_of(html or "") if b.node.tag not in ("head", "title")]
    if not any(b.node.article or b.node.main for b in blocks):
        return np.zeros((0, len(DEFAULTS))), np.zeros(0)
    marks_article = any(b.node.article for b in blocks)
    where = places(blocks)
    chosen = [i * len(blocks) // min(most, len(blocks)) for i in range(min(most, len(blocks)))]
    nodes = [blocks[i].node for i in chosen]
    y = [float((n.article if marks_article else n.main) and not n.never and not n.worded) for n in nodes]
    return np.array([features(blocks[i]) + where[i] for i in chosen]), np.array(y)


def _words_of_wholes(blocks: list[Block]) -> None:
    """Take back the words of parts that hold nine tenths of the text that no tag or role rules out."""
    total = 0
    for b in blocks:
        if not b.node.never:
            total += len(b.text)
            n = b.node
            while n:
                n.chars += len(b.text)
                n = n.parent
    for b in blocks:
        n, worded = b.node, False
        while n:
            worded = worded or (n.own and n.chars < 0.9 * total)
            n = n.parent
        b.node.worded = worded


def places(blocks: list[Block]) -> list[list[float]]:
    """What the page says of each block's place: the last of ``DEFAULTS``, in their order."""
    has_article, has_main = any(b.node.article for b in blocks), any(b.node.main for b in blocks)
    marked = has_article or has_main
    inner = marked and not any((b.node.main if has_main else b.node.article) and not b.node.worded and not b.node.never for b in blocks)
    if not marked and any(b.node.worded for b in blocks):
        _words_of_wholes(blocks)
    out = []
    for b in blocks:
        n = b.node
        inside = n.article if has_article else n.main
        beside = has_article and n.main and not inside
        out.append([float(inside), float(beside), float(marked and not inside and not beside), float(n.inner if inner else n.worded)])
    return out


def costs(blocks: list[Block], weights: list[float]) -> list[float]:
    """Log-odds of content of each block, by the learned weights of its own features, bounded, and of its place."""
    out = []
    for b, where in zip(blocks, places(blocks), strict=True):
        if b.node.never:
            out.append(-NEVER)
            continue
        z = sum(w * v for w, v in zip(weights, features(b), strict=False) if v)
        out.append(max(-CLIP, min(CLIP, z)) + sum(w * v for w, v in zip(weights[OWN:], where, strict=True)))
    return out


def _apart(a: Node, b: Node) -> int:
    """Steps between two nodes in the DOM, counted up to 12."""
    steps = 0
    while a is not b and steps < 12:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in the page and between neighbours under one parent."""
    out = []
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, SMOOTH * DECAY ** _apart(blocks[i - 1].node, b.node)))
        parent = b.node.parent or b.node
        if 0 <= parent.last < i - 1:
            out.append((parent.last, i, SIBLING))
        parent.last = i
    return out


def minimum_cut(costs: list[float], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side (the larger side at ties) of the least cut."""
    n = len(costs)
    excess, room = [max(c, 0.0) for c in costs], [max(-c, 0.0) for c in costs]
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    capacity: list[float] = []
    for a, b, c in smooth:
        if c > 0:
            head[a].append(len(to))
            head[b].append(len(to) + 1)
            to += [b, a]
            capacity += [c, c]
    dead = [False] * n
    for s in range(n):
        while excess[s] > 1e-9 and not dead[s]:
            came, queue, end = {s: -1}, deque([s]), -1
            while queue:
                u = queue.popleft()
                if room[u] > 1e-9:
                    end = u
                    break
                for e in head[u]:
                    v = to[e]
                    if capacity[e] > 1e-9 and v not in came and not dead[v]:
                        came[v] = e
                        queue.append(v)
            if end < 0:
                for u in came:
                    dead[u] = True
                break
            push, u = min(excess[s], room[end]), end
            while came[u] >= 0:
                push, u = min(push, capacity[came[u]]), to[came[u] ^ 1]
            excess[s] -= push
            room[end] -= push
            u = end
            while came[u] >= 0:
                e = came[u]
                capacity[e] -= push
                capacity[e ^ 1] += push
                u = to[e ^ 1]
    # what can still reach the sink is boilerplate
    sink = deque(i for i in range(n) if room[i] > 1e-9)
    out = [True] * n
    for i in sink:
        out[i] = False
    while sink:
        v = sink.popleft()
        for e in head[v]:
            u = to[e]
            if out[u] and capacity[e ^ 1] > 1e-9:
                out[u] = False
                sink.append(u)
    return out


def main_text(html: str | None, weights: list[float] | None = None) -> str:
    blocks = blocks_of(html or "")
    content = minimum_cut(costs(blocks, weights or list(DEFAULTS.values())), edges(blocks))
    return "\n".join(b.text for b, c in zip(blocks, content, strict=True) if c)


def train(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, seed: int = SEED) -> list[float]:
    """Weights of the block classifier, learned from what a bounded sample of the pages marks as its article."""
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.lit(seed), id_col, url_col).alias("order")).filter(F.length("html") <= SAMPLE_CHARS)
    last = rows.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    if last is None:
        return list(DEFAULTS.values())
    chosen = rows.filter(F.col("order") <= last).select("html").limit(sample)  # of rows that agree in id and url, some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                x, y = labelled(html)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    found = sorted((bytes(r["x"]), bytes(r["y"])) for r in chosen.mapInArrow(run, "x binary, y binary").collect())  # at most `sample` pages of SAMPLE_BLOCKS blocks
    x = np.concatenate([np.zeros((0, len(DEFAULTS))), *(np.frombuffer(a).reshape(-1, len(DEFAULTS)) for a, _ in found)])
    return fit(x, np.concatenate([np.zeros(0), *(np.frombuffer(b) for _, b in found)]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: list[float] | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``; with default weights unless ``train`` has made some."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op9_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, weights=train(pages))
