"""Main text of web pages by a tree-structured graphical model over the DOM (operator 7).

A page becomes a tree of block elements; each run of inline content directly in
a block is a leaf.  Every node has a hidden state, content or not.  A node's
features (tag, words of its class, id and role, length, links, place) give its
own potential; each edge has a potential over the two states, by the kind of the
child.  Messages are passed from the leaves to the root and back (sum-product),
and a leaf whose marginal is at least CUT is part of the text.  Weights are
fitted by the gradient of the exact log-likelihood on PAGES pages made by
`labelled_pages`, whose parts carry their labels; no page of the input is used.

Scripts, styles, comments in markup, form controls, heads and other parts that
are never shown as text are left out in parsing.  Character references are
decoded, white space inside a block becomes one space, blocks are joined by \\n.
An element that is never shown and never closed hides what stands before the next
block.  Null or empty html gives an empty text.  A page cut off in a tag ends before that
tag.  A marginal of exactly CUT counts as content.  Rows are independent: repeated rows
give repeated results, null ids and urls are kept.  Other columns are ignored.  A page of
any length is one row: its task holds its tree, some 500 bytes for each block.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CUT, PAGES, ROUNDS, RATE, PENALTY = 0.5, 240, 60, 0.1, 1e-3
#: Fixed values of HTML: elements by how they lay out or hide their content.
HIDDEN = frozenset("script style template noscript head iframe svg select option button textarea title canvas datalist dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var video maction math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element of the key ends an open one of its values, up to the nearest of the stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
STOPS = frozenset("ul ol dl table body html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[=\"'])*)(>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
WORDS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("tag", "names", "parent", "children", "text", "links", "depth")

    def __init__(self, tag: str, names: frozenset, parent: Block | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Block] = []
        self.text, self.links = "", 0
        self.depth = parent.depth + 1 if parent else 0


def _past_hidden(page: str, tag: str, at: int) -> int:
    """Where a hidden element ends that was opened before `at`."""
    if tag in RAW:
        end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
        return end.end() if end else len(page)
    depth = 1
    for m in re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>", re.I).finditer(page, at):
        if m.group(1) or not m.group().endswith("/>"):
            depth += -1 if m.group(1) else 1
        if not depth:
            return m.end()
    for m in TOKEN.finditer(page, at):  # never closed
        if m.group(2) and m.group(2).lower() not in INLINE:
            return m.start()
    return len(page)


def parse(page: str) -> Block:
    """The tree of block elements with leaves (tag '#') of inline text."""
    root = Block("html", frozenset(), None)
    here, inline, parts, in_link, links = root, [], [], 0, 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                leaf = Block("#", frozenset(), here)
                leaf.text, leaf.links = text, links
                here.children.append(leaf)
        parts, links = [], 0

    at, n = 0, len(page)
    while m := TOKEN.search(page, at):
        start = m.start()
        if start > at:
            parts.append(page[at:start])
            if in_link:
                links += start - at
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        if not m.group(4):  # cut off inside a tag
            at = n
            break
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                if tag == "a" and in_link:
                    in_link = 0
                continue
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                flush()
                here = up.parent
                in_link = 0
            elif tag in ("p", "br"):
                parts.append(" ")
            continue
        if tag in HIDDEN:
            if not m.group(3).endswith("/") or tag in RAW:
                at = _past_hidden(page, tag, at)
            parts.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "hr", "input"):
                if tag == "hr":
                    flush()
                parts.append("" if tag == "wbr" else " ")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        if m.group(3).endswith("/"):
            continue
        flush()
        if tag in CLOSES_P and here.tag == "p":
            here = here.parent
        if tag in ENDS:
            up = here
            while up.parent is not None and up.tag not in STOPS:
                if up.tag in ENDS[tag]:
                    here = up.parent
                up = up.parent
        if tag == "html":
            continue
        names = frozenset()
        if "=" in m.group(3):
            names = frozenset(w for _, v in NAMES.findall(m.group(3)) for w in WORDS.findall(v.lower()))
        b = Block(tag, names, here)
        here.children.append(b)
        if b.depth > 200:  # markup that never closes: deeper elements stay at this depth
            b.depth = 200
        here = b
    if at < n:
        parts.append(page[at:])
        if in_link:
            links += n - at
    flush()
    return root


#: Words in class, id and role that name a part of a page, in groups.
HINTS = {
    "ads": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted outbrain taboola",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc skip sitemap",
    "side": "sidebar aside side widget widgets rail complementary related recommended recommendations popular trending more",
    "frame": "header footer masthead topbar head foot copyright colophon banner contentinfo legal",
    "talk": "comment comments reply replies respond disqus discussion reviews review",
    "note": "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup gdpr privacy message warning",
    "form": "form login search share social sharing buttons button tools toolbar",
    "main": "article content contents main post entry story text body page prose",
}
HINT_OF: dict[str, list[str]] = {}
for _group, _words in HINTS.items():
    for _w in _words.split():
        HINT_OF.setdefault(_w, []).append(_group)
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form body html address".split()
FEATURES = {n: i for i, n in enumerate(["bias", "leaf", *(f"tag:{t}" for t in TAGS), "tag:other", *(f"in:{t}" for t in TAGS), *(f"hint:{g}" for g in HINTS), "len<20", "len<60", "len<150", "len>=150", "links", "all links", "stop", "copyright", "first"])}
#: Kinds of edge, by the child.
KINDS = {n: i for i, n in enumerate(["leaf", "text", "part", "frame"])}
TEXT_TAGS, FRAME_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td tr th table figure figcaption".split()), frozenset("nav header footer aside form".split())


def nodes_of(root: Block) -> list[Block]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        b = stack.pop()
        out.append(b)
        stack.extend(reversed(b.children))
    return out


def features_of(b: Block) -> list[int]:
    f = [0]
    if b.tag == "#":
        n = len(b.text)
        f.append(FEATURES["leaf"])
        f.append(FEATURES.get(f"in:{b.parent.tag}", 0) or FEATURES["in:div"])
        f.append(FEATURES["len<20" if n < 20 else "len<60" if n < 60 else "len<150" if n < 150 else "len>=150"])
        if b.links:
            f.append(FEATURES["all links" if b.links >= 0.8 * n else "links"])
        if b.text[-1] in ".!?\"'”»)":
            f.append(FEATURES["stop"])
        if "©" in b.text:
            f.append(FEATURES["copyright"])
    else:
        f.append(FEATURES.get(f"tag:{b.tag}", FEATURES["tag:other"]))
        f.extend(FEATURES[f"hint:{g}"] for g in {g for w in b.names for g in HINT_OF.get(w, ())})
    if b.parent is not None and b.parent.children[0] is b:
        f.append(FEATURES["first"])
    return f


def kind_of(b: Block) -> int:
    return 0 if b.tag == "#" else 1 if b.tag in TEXT_TAGS else 3 if b.tag in FRAME_TAGS else 2


class Graph:
    """Arrays of one page: features, edges to parents, kinds."""

    def __init__(self, page: str) -> None:
        self.nodes = nodes_of(parse(page))
        number = {id(b): i for i, b in enumerate(self.nodes)}
        self.features = [features_of(b) for b in self.nodes]
        self.parent = [number[id(b.parent)] if b.parent is not None else -1 for b in self.nodes]
        self.kind = [kind_of(b) for b in self.nodes]


def marginals(g: Graph, weights: list[float], pair: list[list[list[float]]]) -> tuple[list[float], list[tuple]]:
    """P(content) of each node, and for each edge the joint (p00, p01, p10, p11) of parent and child."""
    n = len(g.nodes)
    own = [sum(weights[k] for k in f) for f in g.features]  # log-odds of content from the node alone
    up0, up1 = [0.0] * n, [0.0] * n  # products of messages from below, in logs, at the node in state 0 and 1
    to0, to1 = [0.0] * n, [0.0] * n  # message to the parent in state 0 and 1
    exp, log = math.exp, math.log

    def add(a: float, b: float) -> float:
        return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))

    for i in range(n - 1, 0, -1):
        t = pair[g.kind[i]]
        a, b = up0[i], up1[i] + own[i]
        to0[i], to1[i] = add(a + t[0][0], b + t[0][1]), add(a + t[1][0], b + t[1][1])
        p = g.parent[i]
        up0[p] += to0[i]
        up1[p] += to1[i]
    down0, down1 = [0.0] * n, [0.0] * n
    out, edges = [0.0] * n, []
    for i in range(n):
        if i:
            p, t = g.parent[i], pair[g.kind[i]]
            rest0 = down0[p] + up0[p] - to0[i]
            rest1 = down1[p] + up1[p] + own[p] - to1[i]
            down0[i], down1[i] = add(rest0 + t[0][0], rest1 + t[1][0]), add(rest0 + t[0][1], rest1 + t[1][1])
            a, b = up0[i], up1[i] + own[i]
            j = (rest0 + t[0][0] + a, rest0 + t[0][1] + b, rest1 + t[1][0] + a, rest1 + t[1][1] + b)
            top = max(j)
            j = [exp(x - top) for x in j]
            s = sum(j)
            edges.append(tuple(x / s for x in j))
        d = down1[i] + up1[i] + own[i] - down0[i] - up0[i]
        out[i] = 1 / (1 + exp(-d)) if d > -700 else 0.0
    return out, edges


def fit(pages: list[tuple[str, set[str]]]) -> tuple[list[float], list]:
    """Weights from (page, texts of its content leaves); a block is content if all its leaves are, or half its text is."""
    graphs = []
    for page, content in pages:
        g = Graph(page)
        good, size = [0] * len(g.nodes), [0] * len(g.nodes)
        for i in range(len(g.nodes) - 1, -1, -1):
            b = g.nodes[i]
            if b.tag == "#":
                size[i], good[i] = len(b.text), len(b.text) if b.text in content else 0
            if g.parent[i] >= 0:
                size[g.parent[i]] += size[i]
                good[g.parent[i]] += good[i]
        graphs.append((g, [int(2 * a > s) for a, s in zip(good, size, strict=True)]))
    w, t = np.zeros(len(FEATURES)), np.zeros((len(KINDS), 2, 2))
    hw, ht = np.zeros_like(w), np.zeros_like(t)
    for _ in range(ROUNDS):
        dw, dt = -PENALTY * len(graphs) * w, -PENALTY * len(graphs) * t
        wl, tl = w.tolist(), t.tolist()
        for g, y in graphs:
            q, edges = marginals(g, wl, tl)
            for f, a, b in zip(g.features, y, q, strict=True):
                for k in f:
                    dw[k] += a - b
            for i, e in enumerate(edges, 1):
                d = dt[g.kind[i]]
                d[y[g.parent[i]], y[i]] += 1
                d -= np.array(e).reshape(2, 2)
        hw, ht = hw + dw**2, ht + dt**2
        w, t = w + RATE * 4 * dw / (np.sqrt(hw) + 1e-6), t + RATE * 4 * dt / (np.sqrt(ht) + 1e-6)
    return w.tolist(), t.tolist()


def labelled_pages(n: int = PAGES, seed: int = 9) -> list[tuple[str, set[str]]]:
    """Pages of made-up words in common layouts, with the texts of their content leaves."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 3, hi: int = 25) -> str:
        return words(lo, hi).capitalize() + r.choice("...!?")

    def list_of_links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def named(group: str) -> str:
        return f'{r.choice(["class", "class", "id"])}="{r.choice(HINTS[group].split())}"'

    out = []
    for _ in range(n):
        content: set[str] = set()

        def say(text: str, content: set = content) -> str:
            content.add(text)
            return text

        def paragraph(say=say) -> str:
            text = " ".join(sentence() for _ in range(r.randint(1, 6)))
            kind = r.random()
            if kind < 0.1:
                head, _, tail = text.partition(" ")
                say(text)
                return f"<p>{head} <a href='/x'>{tail}</a></p>" if len(tail) < 40 else f"<p><b>{head}</b> {tail}</p>"
            say(text)
            return f"<p>{text}</p>" if kind < 0.85 else f"<p><b>{text}<br>" if kind < 0.93 else f"<div>{text}</div>"

        def piece(paragraph=paragraph, say=say) -> str:
            kind = r.random()
            if kind < 0.72:
                return paragraph()
            if kind < 0.82:
                return f"<h{(k := r.randint(2, 4))}>{say(words(1, 8).capitalize())}</h{k}>"
            if kind < 0.9:
                return "<ul>" + "".join(f"<li>{say(sentence(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if kind < 0.95:
                return f"<blockquote><p>{say(sentence(5, 20))}</p></blockquote>"
            return "<table>" + "".join(f"<tr><td>{say(words(1, 3))}</td><td>{say(words(1, 6))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"

        def junk(group: str) -> str:
            tag = {"menu": r.choice(["nav", "div", "ul"]), "side": r.choice(["aside", "div", "section"]), "talk": r.choice(["section", "div", "ol"]), "form": r.choice(["form", "div"]), "frame": "div"}.get(group, "div")
            plain = tag in ("nav", "aside", "form") and r.random() < 0.5
            attr = "" if plain else " " + named(group)
            if group == "menu":
                return f"<{tag}{attr}>{list_of_links(r.randint(3, 8))}</{tag}>"
            if group == "talk":
                body = "".join(f"<div class='{r.choice(['comment', 'reply', 'author'])}'><p>{sentence()} {sentence(1, 30)}</p></div>" for _ in range(r.randint(1, 5)))
                return f"<{tag}{attr}><h3>{words(1, 3)}</h3>{body}</{tag}>"
            if group == "side":
                return f"<{tag}{attr}><h3>{words(1, 3)}</h3>{r.choice([list_of_links(4), f'<p>{sentence(4, 30)}</p>'])}</{tag}>"
            if group == "form":
                return f"<{tag}{attr}><label>{words(1, 2)}</label><input name='q'><p>{sentence(2, 12)}</p></{tag}>"
            text = " ".join(sentence(2, 20) for _ in range(r.randint(1, 3)))
            return f"<{tag}{attr}>" + (text if r.random() < 0.6 else f"<p>{text}</p>") + f"</{tag}>"

        title = words(2, 9).capitalize()
        middle = [piece() for _ in range(r.randint(1, 9))]
        for g in r.sample(["ads", "side", "form", "note"], r.randint(0, 2)):
            middle.insert(r.randint(0, len(middle)), junk(g))
        if r.random() < 0.1:  # many short lines
            middle += [f"<p>{say(sentence(1, 3))}</p>" for _ in range(r.randint(20, 120))]
        if r.random() < 0.15:
            middle.append(f"<footer>{words(2, 8)}</footer>")
        if r.random() < 0.8:
            middle.insert(0, f"<h1>{say(title)}</h1>")
        inner = "".join(middle)
        holder = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f"<div {named('main')}>{{}}</div>", f"<section {named('main')}>{{}}</section>", "<div>{}</div>"])
        before = [junk(g) for g in r.sample(["menu", "ads", "note", "form"], r.randint(0, 3))]
        after = [junk(g) for g in r.sample(["talk", "side", "ads", "menu", "note"], r.randint(0, 3))]
        if r.random() < 0.5:
            before.insert(0, f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>")
        if r.random() < 0.7:
            after.append(f"<footer>{r.choice(['&copy; ', ''])}{words(1, 3)} &middot; {sentence(2, 15)}</footer>" if r.random() < 0.8 else f"<div class='footer'><p>&copy; {words(2, 8)}</p></div>")
        page = f"<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{holder.format(inner) if r.random() < 0.97 else inner}{''.join(after)}</body></html>"
        out.append((page, content))
    return out


def extract(page: str | None, weights: list[float], pair: list) -> str:
    if not page:
        return ""
    g = Graph(page)
    q, _ = marginals(g, weights, pair)
    return "\n".join(b.text for b, p in zip(g.nodes, q, strict=True) if b.tag == "#" and p >= CUT)


def _extract(weights: list[float], pair: list):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = [extract(h, weights, pair) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    weights, pair = fit(labelled_pages())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(weights, pair), "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
