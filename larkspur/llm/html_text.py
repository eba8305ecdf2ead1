"""Main text of web pages: boosted trees over DOM nodes and a decision that respects the tree.

A page is parsed into block elements and text blocks.  Boosted trees score every
node by its tag, attribute words, subtree density, depth and siblings.  The
decoding then keeps, drops or divides each subtree as a whole, so nothing inside
a dropped element is kept and nothing inside a kept one is dropped.

The trees are fitted on a bounded sample of pages.  Pages that mark their article
with ``article`` or ``main`` label themselves; their texts are also set into
pages of many other layouts, where the label of every block is known, so that
the trees do not lean on one template.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import boosting
from larkspur.llm.arrow import text_slices, texts_of
from larkspur.llm.sampling import distinct_texts

SAMPLE_PAGES = 300  # pages that the trees are fitted on, at most
LAYOUTS = 600  # pages of other layouts that their texts are set into
MIXED_COST = 0.5  # log-odds that dividing a subtree costs
_MOST = 6.0  # largest log-odds of one node

# fixed values: what tags and attribute words stand for
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe xmp".split())  # text up to their end tag, or the page's end
ASIDE_TAGS = frozenset("noscript template svg annotation annotation-xml".split())  # left out from tag to end tag
NEVER_TEXT = frozenset("head button select option label legend".split())
CLOSES = {  # an opening tag ends these open elements, up to the barrier
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot copyright legal sidebar aside "
    "widget ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice "
    "alert popup modal overlay newsletter subscribe signup social share sharing related recommended more comment "
    "comments respond responses discussion reply replies login search form pagination pager tags toolbar skip gdpr "
    "disclaimer warning toast".split()
)
INSIDE_WORDS = frozenset("article content main post entry story body text prose copy paragraph".split())
GROUPS = [
    {"#text"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "menu", "dl", "dt", "dd"},
    {"div", "section"}, {"table", "tr", "td", "th", "tbody", "thead", "tfoot"}, {"article", "main"}, {"nav", "menu"},
    {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "button", "select", "option", "legend"},
]
_OUTSIDE_TAGS = frozenset("nav header footer aside form".split())
_TOKEN = re.compile(
    r"<!--(.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS}
_ASIDE = {tag: re.compile(rf"<(/?){tag}(?![\w-])[^>]*+>", re.I) for tag in ASIDE_TAGS}
_POINTS = re.compile(r"[.,;:!?]")
KEEP_FROM, KEEP_TO = "keep", "/keep"  # comments that mark the article in pages made for training


class Node:
    """A block element, or a text block (tag ``#text``)."""

    __slots__ = ("tag", "parent", "words", "text", "links", "tags", "label", "index")

    def __init__(self, tag: str, parent: int, words: tuple[str, ...], index: int, label: bool):
        self.tag, self.parent, self.words, self.index, self.label = tag, parent, words, index, label
        self.text, self.links, self.tags = "", 0, 0


def aside_ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of ``tag`` that is closed ends, by the end of its opening tag."""
    ends, stack = {}, []
    for token in _ASIDE[tag].finditer(page):
        if token[1]:
            if stack:
                ends[stack.pop()] = token.end()
        elif not token[0].endswith("/>"):
            stack.append(token.end())
    return ends


def _crosses(page: str, start: int, end: int, tag: str) -> bool:
    """Whether more elements of ``tag`` are closed than opened in this part."""
    depth = 0
    for token in re.finditer(rf"<(/?){re.escape(tag)}(?![\w-])", page[start:end], re.I):
        depth += -1 if token[1] else 1
        if depth < 0:
            return True
    return False


def parse(page: str) -> list[Node]:
    """Nodes in page order; a parent stands before its children, node 0 is the page.

    Scripts, styles, drawings and the like are left out up to their end tag.  A
    drawing, template or noscript that is never closed, or only after the block
    it stands in, is no element: what follows it is text of the page.
    """
    nodes = [Node("#page", -1, (), 0, False)]
    children = [0]  # children of each node so far
    stack = [0]
    pieces: list[str] = []
    state = {"links": 0, "tags": 0, "in_link": 0, "label": False}
    asides: dict[str, dict[int, int]] = {}

    def add(tag: str, words: tuple[str, ...] = ()) -> Node:
        parent = stack[-1]
        node = Node(tag, parent, words, children[parent], state["label"])
        children[parent] += 1
        children.append(0)
        nodes.append(node)
        return node

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and nodes[stack[-1]].tag not in NEVER_TEXT:
                node = add("#text")
                node.text, node.links, node.tags = text, state["links"], state["tags"]
            pieces.clear()
        state["links"] = state["tags"] = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]
        if state["in_link"] > len(stack):
            state["in_link"] = 0

    def write(text: str) -> None:
        if text:
            pieces.append(text)
            if state["in_link"]:
                state["links"] += len(text)

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            write(page[at:])
            break
        write(page[at:token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            mark = (token[1] or "").strip()
            if mark in (KEEP_FROM, KEEP_TO):
                flush()
                state["label"] = mark == KEEP_FROM
            continue
        tag, ends = tag.lower(), bool(token[2])
        state["tags"] += 1
        if tag in RAW_TAGS and not ends:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in ("textarea", "title"):
                flush()
        elif tag in ASIDE_TAGS:
            if not ends:
                if tag not in asides:
                    asides[tag] = aside_ends(page, tag)
                end = asides[tag].get(at)
                if end and not _crosses(page, at, end, nodes[stack[-1]].tag):
                    at = end
        elif tag == "br":
            pieces.append(" ")
        elif tag == "hr":
            flush()
        elif tag in EMPTY_TAGS:
            continue
        elif tag == "a":
            state["in_link"] = 0 if ends else len(stack)
        elif tag in BLOCK_TAGS:
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close(depth)
                        break
                else:
                    flush()
                continue
            if tag in CLOSES:
                closed, barrier = CLOSES[tag]
                lowest = None
                for depth in range(len(stack) - 1, max(0, len(stack) - 64), -1):
                    own = nodes[stack[depth]].tag
                    if own in barrier:
                        break
                    if own in closed:
                        lowest = depth
                if lowest:
                    close(lowest)
            if nodes[stack[-1]].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (
                nodes[stack[-1]].tag == "head" and tag == "body"
            ):
                close(len(stack) - 1)
            flush()
            words = ()
            if token[4]:
                words = tuple(
                    w.lower() for m in _ATTRIBUTE.finditer(token[4]) for w in _WORD.findall(m[1] or m[2] or m[3] or "")
                )
            add(tag, words)
            stack.append(len(nodes) - 1)
    close(1)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    parent = np.array([node.parent for node in nodes])
    sums = np.zeros((n, 5))  # characters, link characters, points, blocks, tags
    for i, node in enumerate(nodes):
        if node.text:
            sums[i] = len(node.text), min(node.links, len(node.text)), len(_POINTS.findall(node.text)), 1, node.tags
        else:
            sums[i, 4] = 1
    begin = np.cumsum(sums[:, 0]) - sums[:, 0]
    path = np.zeros((n, 5))  # depth, outside words, inside words, outside tags, article above
    outside, inside = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        outside[i] = sum(w in OUTSIDE_WORDS for w in node.words)
        inside[i] = sum(w in INSIDE_WORDS for w in node.words)
        own = (1, outside[i], inside[i], node.tag in _OUTSIDE_TAGS, node.tag in ("article", "main"))
        path[i] = own if i == 0 else path[node.parent] + own
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    chars, links, points, blocks, tags = sums.T
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up]
    index = np.array([node.index for node in nodes])
    at = {(node.parent, node.index): i for i, node in enumerate(nodes)}
    before = np.array([chars[at[key]] if (key := (node.parent, node.index - 1)) in at else 0 for node in nodes])
    after = np.array([chars[at[key]] if (key := (node.parent, node.index + 1)) in at else 0 for node in nodes])
    kinds: dict[tuple[int, str], int] = {}
    for node in nodes:
        kinds[node.parent, node.tag] = kinds.get((node.parent, node.tag), 0) + 1
    alike = np.array([kinds[node.parent, node.tag] for node in nodes])
    one = np.maximum(chars, 1)
    columns = [[node.tag in group for node in nodes] for group in GROUPS]
    columns += [
        outside, inside, *path.T, np.log1p(chars), links / one, 100 * points / one, chars / max(chars[0], 1),
        np.log1p(blocks), 100 * tags / one, np.log1p(siblings), alike / np.maximum(siblings, 1),
        index / np.maximum(siblings, 1), chars / np.maximum(chars[up], 1), np.log1p(before), np.log1p(after),
        begin / max(chars[0], 1), np.log1p(chars / np.maximum(blocks, 1)),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[str]:
    """Texts of kept blocks: each subtree is kept, dropped or divided, whichever sums up best."""
    score = np.clip(log_odds, -_MOST, _MOST).tolist()
    n = len(nodes)
    keep, drop, best = score, [-s for s in score], [0.0] * n
    divided = [0.0] * n
    choice = [0] * n  # 1 keep, -1 drop, 0 divide
    for i in range(n - 1, -1, -1):
        if nodes[i].text:
            best[i] = max(keep[i], drop[i])
            choice[i] = 1 if keep[i] >= drop[i] else -1
        else:
            best[i], choice[i] = max((keep[i], 1), (drop[i], -1), (divided[i] - MIXED_COST, 0))
        up = nodes[i].parent
        if up >= 0:
            keep[up] += keep[i]
            drop[up] += drop[i]
            divided[up] += best[i]
    texts = []
    for i, node in enumerate(nodes):
        if i and choice[node.parent]:
            choice[i] = choice[node.parent]  # decided above
        if node.text and choice[i] == 1:
            texts.append(node.text)
    return texts


def main_text(pages: list[str], model: boosting.Boosted) -> list[str]:
    """Main texts of a slice of pages; their nodes are scored together."""
    parsed = [parse(page) for page in pages]
    if not parsed:
        return []
    scores = model.log_odds(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append("\n\n".join(decode(nodes, scores[at:at + len(nodes)])))
        at += len(nodes)
    return out


# ---------------------------------------------------------------- training


class Texts(NamedTuple):
    article: list[str]
    other: list[str]


def self_labelled(nodes: list[Node]) -> list[bool] | None:
    """Labels of a page with exactly one article; None for other pages."""
    marked = [i for i, node in enumerate(nodes) if node.tag in ("article", "main")]
    if len(marked) != 1:
        return None
    labels = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside = i == marked[0] or (node.parent >= 0 and labels[node.parent])
        labels[i] = inside and node.tag not in _OUTSIDE_TAGS and not set(node.words) & OUTSIDE_WORDS
    return labels


def _node_rows(nodes: list[Node], block_labels: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes whose blocks all have one label."""
    kept, total = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text:
            kept[i], total[i] = block_labels[i], 1
        if nodes[i].parent >= 0:
            kept[nodes[i].parent] += kept[i]
            total[nodes[i].parent] += total[i]
    pure = (total > 0) & ((kept == 0) | (kept == total))
    return features(nodes)[pure], (kept == total)[pure].astype(np.float64)


def made_page(texts: Texts, rand: random.Random) -> str:
    """A page of some layout, its article between two marking comments."""

    def some(pool: list[str], low: int, high: int) -> list[str]:
        return [html.escape(rand.choice(pool)) for _ in range(rand.randint(low, high))]

    def short(words: int = 4) -> str:
        return html.escape(" ".join(rand.choice(texts.other + texts.article).split()[:rand.randint(1, words)]) or "x")

    def box(tags: str, names: str, inner: str) -> str:
        tag = rand.choice(tags.split())
        name = rand.choice([*names.split(), ""]) if tag in BLOCK_TAGS - {"div", "section", "ul"} else rand.choice(names.split())
        attribute = f' {rand.choice(("class", "id"))}="{name}{rand.choice(("", "", "-box", " row"))}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{rand.random()}">{short()}</a>' for _ in range(rand.randint(low, high))]
        if rand.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
        return rand.choice((" | ", " ", "<br>")).join(items)

    def paragraphs(pool: list[str], low: int, high: int) -> str:
        return "".join(f"<p>{text}</p>" for text in some(pool, low, high))

    def article() -> str:
        parts = [f"<h1>{short(10)}</h1>"] if rand.random() < 0.8 else []
        for text in some(texts.article, 1, 9):
            kind = rand.random()
            if kind < 0.08:
                parts.append(f"<h2>{short(8)}</h2>")
            elif kind < 0.14:
                parts.append("<ul>" + "".join(f"<li>{short(12)}</li>" for _ in range(rand.randint(2, 5))) + "</ul>")
            elif kind < 0.18:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.22:
                parts.append(f"<table><tr><td>{short()}</td><td>{short()}</td></tr></table>")
            elif kind < 0.3:
                parts.append(f'<p>{text} <a href="/x">{short()}</a> {short(12)}</p>')
            elif kind < 0.36:
                parts.append(f"<p><b>{text}<br>")
                continue
            elif kind < 0.42:
                parts.append(f"<div>{text}</div>")
                continue
            parts.append(f"<p>{text}</p>")
        inner = "".join(parts)
        if rand.random() < 0.25:
            inner = f"<!--keep-->{inner}<!--/keep-->" + rand.choice((comments, related, share))()
        else:
            inner = f"<!--keep-->{inner}<!--/keep-->"
        return box("article main div div section", "content post entry story article-body main text", inner)

    def header() -> str:
        return box("header div", "header masthead topbar site-header", f"<a href='/'>{short()}</a><p>{short(8)}</p>")

    def menu() -> str:
        return box("nav div ul", "nav menu navbar breadcrumbs navigation", links(3, 10))

    def notice() -> str:
        return box("div section", "cookie-notice notice alert banner consent popup newsletter", paragraphs(texts.other + texts.article, 1, 2) + "<button>OK</button>")

    def advert() -> str:
        inner = rand.choice((texts.other, texts.article))
        return box("div aside", "ad ads advert sponsored promo ad-slot", rand.choice(some(inner, 1, 1)))

    def form() -> str:
        return f"<form action='/s'><label>{short()}</label><input name=q><p>{short(8)}</p><button>Go</button></form>"

    def sidebar() -> str:
        return box("aside div", "sidebar widget aside right-sidebar", f"<h3>{short()}</h3>" + rand.choice((links(2, 8), paragraphs(texts.article, 1, 3))))

    def related() -> str:
        return box("div section", "related recommended more-stories", f"<h3>{short()}</h3>" + links(2, 6))

    def share() -> str:
        return box("div ul", "share social", links(2, 4))

    def comments() -> str:
        each = "".join(f'<div class="comment"><b>{short(2)}</b>{paragraphs(texts.article, 1, 2)}</div>' for _ in range(rand.randint(1, 5)))
        return box("section div", "comments responses discussion", f"<h3>{short()}</h3>{each}")

    def footer() -> str:
        inner = rand.choice((f"&copy; {short()} &middot; {short(12)}", links(2, 6), f"<p>{short(15)}</p>"))
        return box("footer div", "footer site-footer copyright legal", inner)

    above = [part() for part in (header, menu, notice, advert, form) if rand.random() < 0.5]
    below = [part() for part in (sidebar, related, comments, advert, form, notice, share) if rand.random() < 0.35]
    body = "".join([*above, article(), *below, *([footer()] if rand.random() < 0.9 else [])])
    if rand.random() < 0.4:
        body = f'<div class="{rand.choice(("wrapper", "page", "container", "site"))}">{body}</div>'
    return f"<html><head><title>{short()}</title></head><body>{body}</body></html>"


def fit_model(sample: list[str], layouts: int = LAYOUTS) -> boosting.Boosted:
    """Trees from self-labelled pages of the sample and pages of other layouts with their texts."""
    rows, article, other = [], [], []
    for page in sample:
        nodes = parse(page)
        labels = self_labelled(nodes)
        if labels is None:
            continue
        rows.append(_node_rows(nodes, labels))
        for node, label in zip(nodes, labels):
            if node.text:
                (article if label else other).append(node.text)
    rand = random.Random(11)
    if not article:  # nothing labels itself: invented words
        syllables = ["ta", "lo", "mi", "ner", "vi", "so", "ka", "ren"]
        article = [
            " ".join("".join(rand.choices(syllables, k=rand.randint(1, 4))) for _ in range(rand.randint(5, 90))) + "."
            for _ in range(200)
        ]
    if not other:
        other = [" ".join(text.split()[:8]) for text in article]
    texts = Texts(article, other)
    for _layout in range(layouts):
        nodes = parse(made_page(texts, rand))
        rows.append(_node_rows(nodes, [node.label for node in nodes]))
    return boosting.fit(np.concatenate([x for x, _y in rows]), np.concatenate([y for _x, y in rows]))


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> boosting.Boosted:
    """Fit on at most ``sample_pages`` different pages, those with the smallest hashes."""
    return fit_model([row[html_col] for row in distinct_texts(pages, html_col, sample_pages).collect()])


def extract(
    pages: DataFrame, model: boosting.Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every page.

    NULL and empty pages have an empty text.  Repeated rows and NULL keys come
    out as often as they went in; other columns are not read.
    """
    id_name, url_name = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = main_text(texts_of(batch, "html"), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["id", "url", "text", "n_chars"],
            )

    return (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
        .mapInArrow(extracted, f"id {id_name}, url {url_name}, text string, n_chars long")
        .withColumnsRenamed({"id": id_col, "url": url_col})
    )
