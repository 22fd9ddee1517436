"""Main-text extraction with a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table

#: Hashed features of a node, and labelled pages that the built-in model is trained on.
BUCKETS = 1 << 14
TRAINING_PAGES = 1500
#: Share of the parent-child potentials that counts: the features of a node already say a part of it.
DAMPING = 0.5

_SILENT = {"script", "style", "template", "noscript", "head", "title", "textarea", "select", "option", "button", "iframe", "object", "svg", "math", "canvas", "audio", "video", "datalist"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"} | _HEADINGS
#: Start tags that end an open element of the same kind, unless one of the kind's containers was opened in between.
_SCOPES = (("p", {"p"}, {"table", "td", "th", "button", "caption"}), ("li", {"li"}, {"ul", "ol", "menu"}), ("dd", {"dt", "dd"}, {"dl"}), ("cell", {"td", "th"}, {"tr", "table"}), ("row", {"tr"}, {"table"}))
_ENDS = {"li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4} | dict.fromkeys(_CLOSES_P, 0)
#: Deeper elements are laid beside each other, as browsers do.
_MAX_DEPTH = 512
# A quote opens a string only where a value starts; elsewhere it is a character of a name or of an unquoted value.
_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+|=)*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+))?+)?+""")
_NAME = re.compile(r"[A-Z]?[a-zß-öø-ÿ]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…。！？](?=\s|\Z)")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in _SILENT}
_NESTED = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*?(/?)(?:>|\Z)", re.IGNORECASE) for name in _SILENT - _RAW}
#: Elements whose direct text becomes a node of its own, so that it can be content where they are not.
_OUTER = {"#page", "html", "body"}
#: Elements that end with their start tag if that says so.
_FOREIGN = {"svg", "math"}


@dataclass
class Page:
    """Block elements in document order; node 0 is the page. blocks: (node, text) in page order. gold: labels of training pages."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    gold: list[int] = field(default_factory=lambda: [0])
    own: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    sentences: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _silent_end(name: str, source: str, at: int) -> int | None:
    """The place after the end of a silent element whose content starts at `at`; elements of its name inside it end before it."""
    if name in _RAW:
        close = _CLOSING[name].search(source, at)
        return close.end() if close else None
    inside = 1
    for m in _NESTED[name].finditer(source, at):
        if m.group(1):
            inside -= 1
        elif not (m.group(2) and name in _FOREIGN):
            inside += 1
        if not inside:
            return m.end()
    close = _CLOSING[name].search(source, at)  # one of them lacks its end: as if they weren't nested
    return close.end() if close else None


def parse(source: str, bare: int = 0) -> Page:
    """DOM of a page, as far as its blocks need it, in time linear in its length. End tags that are missing, stray or cut off are handled
    as browsers mostly do. bare: label of text that stands outside of all elements but html and body, in training pages."""
    page = Page()
    depth = [0]
    # open elements: name, block node they belong to, place of the nearest block, places of the elements that a start tag may end
    stack: list[tuple[str, int, int, tuple[int, ...]]] = [("#page", 0, 0, (0,) * len(_SCOPES))]
    places: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    pieces: list[str] = []
    in_links = 0

    def add(above: int, tag: str, names: list[str], gold: int) -> int:
        depth.append(depth[above] + 1)
        for column, value in ((page.parent, above), (page.tag, tag), (page.names, names), (page.gold, gold), (page.own, 0), (page.linked, 0), (page.sentences, 0)):
            column.append(value)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal in_links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = stack[-1][1]
                if page.tag[node] in _OUTER:
                    node = add(node, "#text", [], bare)
                page.blocks.append((node, text))
                page.own[node] += len(text)
                page.linked[node] += in_links
                page.sentences[node] += len(_SENTENCE.findall(text))
            pieces.clear()
        in_links = 0

    def pop_to(i: int) -> None:
        if stack[-1][2] >= i:  # a block among them
            flush()
        for name, *_ in stack[i:]:
            places[name].pop()
        del stack[i:]

    def push(name: str, node: int, block: int, scope: tuple[int, ...]) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node, block, scope))

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            pieces.append(html.unescape(text))  # a reference doesn't reach over a tag
            if places.get("a"):
                in_links += len(text.strip())
        if not m:
            break
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            name = end.lower()
            if name == "br":
                pieces.append(" ")
            if places.get(name) and (name not in _INLINE or places[name][-1] > stack[-1][2]):
                pop_to(places[name][-1])
        elif start and m.group(0).endswith(">"):
            name = start.lower()
            if name in _SILENT:
                if name != "button":
                    flush()
                if not m.group(3).endswith("/") and name not in unclosed:
                    close = _silent_end(name, source, at)
                    if close is None:
                        unclosed.add(name)
                    at = close or (n if name in _RAW else at)
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                if name == "br":
                    pieces.append(" ")
                continue
            if name in _INLINE:
                push(name, stack[-1][1], stack[-1][2], stack[-1][3])
                continue
            if name in {"html", "body"} and places.get(name):
                continue
            flush()
            if name in _ENDS and (i := stack[-1][3][_ENDS[name]]):
                pop_to(i)
            if name in {"td", "th", "tr"} and (i := stack[-1][3][0]):  # a cell ends a paragraph of the cell before
                pop_to(i)
            attributes = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTRIBUTE.finditer(m.group(3))} if m.group(3) else {}
            above = stack[-1][1]
            above = page.parent[above] if depth[above] >= _MAX_DEPTH else above
            names = [w.lower() for k in ("class", "id", "role", "itemprop", "aria-label") if k in attributes for w in _NAME.findall(attributes[k])]
            node = add(above, name, names, int(attributes.get("data-gold", "0") == "1"))
            here = len(stack)
            push(name, node, here, tuple(here if name in ends else 0 if name in stops else before for (_, ends, stops), before in zip(_SCOPES, stack[-1][3], strict=True)))
        elif start:  # the page ends inside a tag
            break
    flush()
    return page


def _bucket(*parts: object) -> int:
    h = 2166136261
    for c in "\x1f".join(map(str, parts)).encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


_remembered: dict[tuple, list[int]] = {}


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(feature, node) pairs: tag, words of class, id and role and their first letters, of the node and its nearest ancestors, paragraphs
    beside it, length, link share and sentences of the own text, blocks of the page."""
    f, node = [], []
    beside = [0] * len(page.tag)
    for i, tag in enumerate(page.tag):
        if tag == "p":
            beside[page.parent[i]] += 1
    for i, tag in enumerate(page.tag):
        own = page.own[i]
        up = page.parent[i]
        above = []
        while up > 0 and len(above) < 3:
            above.append((page.tag[up], tuple(page.names[up])))
            up = page.parent[up]
        key = (tag, *page.names[i], 0, tuple(above), min(6, beside[max(page.parent[i], 0)]), min(8, int(np.log2(own + 1))) if own else -1, min(4, int(4 * page.linked[i] / own)) if own else -1, min(2, page.sentences[i]), min(4, len(page.blocks)))
        got = _remembered.get(key)
        if got is None:
            got = [0, _bucket("tag", tag), _bucket("size", key[-4]), _bucket("links", key[-3]), _bucket("beside", tag, key[-5]), _bucket("sentences", tag, key[-2]), _bucket("page", tag, key[-1]), *(_bucket("up", k, t) for k, (t, _) in enumerate(above)), *(_bucket("tag up", tag, t) for t, _ in above[:1]), *(_bucket("name up", w) for _, names in above for w in names), *(_bucket("stem up", w[:4]) for _, names in above for w in names), *(b for w in page.names[i] for b in (_bucket("name", w), _bucket("stem", w[:4])))]
            if len(_remembered) < 100_000:
                _remembered[key] = got
        f += got
        node += [i] * len(got)
    return np.array(f), np.array(node)


@dataclass
class TreeModel:
    """Log-odds of content by feature, and log potentials of (parent label, child label), a table for each kind of child tag."""

    weights: np.ndarray
    pair: np.ndarray


def marginals(model: TreeModel, pages: list[Page]) -> list[np.ndarray]:
    """P(content) of every node by sum-product: messages go up from the leaves and down from the root, a depth at a time over all pages."""
    sizes = [len(p.parent) for p in pages]
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = int(base[-1])
    parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, b, 0) for p, b in zip(pages, base[:-1], strict=True)])
    got = [features(p) for p in pages]
    logit = np.bincount(np.concatenate([node + b for (_, node), b in zip(got, base[:-1], strict=True)]), model.weights[np.concatenate([f for f, _ in got])], minlength=n)
    unary = np.stack([np.zeros(n), logit], axis=1)
    above, deep = parent.tolist(), [0] * n
    for i, p in enumerate(above):
        if p >= 0:
            deep[i] = deep[p] + 1
    depth = np.array(deep, dtype=int)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    pair = model.pair[np.array([_TAG_KIND.get(t, 0) for p in pages for t in p.tag])]
    up, belief = np.zeros((n, 2)), unary.copy()
    for level in levels[:0:-1]:
        up[level] = np.logaddexp(pair[level, :, 0] + belief[level, None, 0], pair[level, :, 1] + belief[level, None, 1])
        np.add.at(belief, parent[level], up[level])
    full = belief.copy()
    for level in levels[1:]:
        rest = full[parent[level]] - up[level]
        down = np.logaddexp(pair[level, 0] + rest[:, 0:1], pair[level, 1] + rest[:, 1:2])
        full[level] = belief[level] + down
    p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60)))
    return [p[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


#: Kinds of child for which parent-child potentials are learned apart.
_TAG_KIND = {t: k for k, ts in enumerate((("#text", "p", "blockquote", "pre", "figure", "figcaption", *sorted(_HEADINGS)), ("nav", "footer", "aside", "header", "form", "menu", "fieldset"), ("article", "main", "section"), ("li", "ul", "ol", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th")), 1) for t in ts}


def train(pages: list[Page], rounds: int = 300, rate: float = 0.3, ridge: float = 1e-5) -> TreeModel:
    """Fit on labelled pages: logistic log-odds of the features, and parent-child potentials from label counts beyond what each side says alone."""
    kinds = max(_TAG_KIND.values()) + 1
    counts = np.full((kinds, 2, 2), 1.0)
    f, node, y, start = [], [], [], 0
    for p in pages:
        pf, pn = features(p)
        f.append(pf)
        node.append(pn + start)
        y += p.gold
        start += len(p.gold)
        for i in range(1, len(p.parent)):
            counts[_TAG_KIND.get(p.tag[i], 0), p.gold[p.parent[i]], p.gold[i]] += 1
    f_all, node_all, labels = np.concatenate(f), np.concatenate(node), np.array(y, dtype=float)
    w = np.zeros(BUCKETS)
    m, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(node_all, w[f_all], minlength=len(labels))))
        g = np.bincount(f_all, (p - labels)[node_all], minlength=BUCKETS) / len(labels) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    total = counts.sum(axis=(1, 2), keepdims=True)
    pair = DAMPING * np.log(counts * total / (counts.sum(axis=2, keepdims=True) * counts.sum(axis=1, keepdims=True)))
    return TreeModel(w, pair)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[Page]:
    """Labelled pages of many layouts; data-gold marks the content nodes and is no feature."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(600)]

    def words(a: int, b: int) -> str:
        return " ".join(r.choices(vocabulary, k=r.randint(a, b))).capitalize() + r.choice([".", ".", "", "!", "?"])

    def links(a: int, b: int) -> str:
        inner = "".join(f"<li><a href='/{r.choice(vocabulary)}'>{words(1, 3)}</a></li>" for _ in range(r.randint(a, b)))
        return r.choice([f"<ul>{inner}</ul>", f"<ol>{inner}</ol>", inner.replace("<li>", "<div>").replace("</li>", "</div>"), re.sub("</?li>", " ", inner)])

    def hashed() -> str:
        return r.choice(["css-", "sc-", "c", "_", "x"]) + "".join(r.choices("abcdefghijkmnpqrstuvwxyz0123456789", k=r.randint(4, 8)))

    def named(names: list[str], tag: str = "div") -> str:
        name = r.choice(names)
        name = r.choice([name, f"{name}-{r.choice(['box', 'area', 'wrap', 'block', 'top', 'main', 'item'])}", f"site-{name}", f"{name} {r.choice(vocabulary)}"])
        return f"<{tag} {r.choice(['class', 'class', 'id', 'role'])}='{name}'"

    def junk() -> str:
        text = r.choice([lambda: words(1, 6), lambda: words(4, 40), lambda: f"<p>{words(3, 40)}</p>", lambda: f"<h3>{words(1, 3)}</h3>{links(2, 5)}", lambda: links(2, 7), lambda: f"<h2>{words(1, 3)}</h2><p>{words(3, 25)}</p>", lambda: f"<p>{words(3, 25)}</p><p>{words(3, 25)}</p>"])()
        kind = r.randrange(9)
        if kind == 0:
            return f"<nav>{links(3, 8)}</nav>" if r.random() < 0.7 else (named(["menu", "nav", "navbar", "breadcrumb", "navigation", "pagination", "navi", "menue", "menuprincipal"]) if r.random() < 0.7 else r.choice(["<div", f"<div class='{hashed()}'"])) + f">{links(3, 8)}</div>"
        if kind == 1:
            return r.choice(["<aside>", "<aside class='sidebar'>"]) + text + "</aside>" if r.random() < 0.5 else named(["sidebar", "related", "widget", "recommended", "promo", "trending", "popular", "seitenleiste", "barra", "verwandt"]) + f">{text}</div>"
        if kind in (2, 3):
            return named(["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "werbung", "anzeige", "publicidad", "publicite"], r.choice(["div", "div", "section", "p"])).replace("<p", "<p") + f">{words(2, 30)}</div>"
        if kind == 4:
            return named(["notice", "cookie", "consent", "alert", "popup", "modal", "gdpr", "disclaimer", "newsletter", "subscribe", "paywall"], r.choice(["div", "section"])) + f">{text}</div>"
        if kind == 5:
            return f"<form action='/s'>{r.choice(['<label>' + words(1, 3) + '</label>', '<p>' + words(2, 9) + '</p>', '<fieldset>' + words(1, 4) + '</fieldset>', words(1, 5)])}<input name='q'><button>{words(1, 1)}</button></form>"
        if kind == 6:
            each = "".join(r.choice([f"<div class='comment'><b>{words(1, 2)}</b><p>{words(3, 60)}</p></div>", f"<li class='comment'>{words(3, 50)}</li>", f"<li><p>{words(3, 30)}</p></li>", f"<li>{words(2, 30)}</li>", f"<article class='comment'><p>{words(3, 50)}</p></article>"]) for _ in range(r.randint(1, 4)))
            return named(["comments", "comment", "commentlist", "commentslist", "replies", "discussion", "responses", "disqus", "kommentare", "comentarios", "commentaires"], r.choice(["div", "section", "ul", "ol"])) + f">{r.choice(['<h2>', '<h3>', '<h4>', '<p>'])}{words(1, 3)}</h3>{each}</div>"
        if kind == 7:
            return named(["share", "social", "tags", "meta", "byline", "toolbar", "author"]) + f">{text}</div>"
        if r.random() < 0.5:
            return f"<header>{r.choice(['', f'<h1>{words(1, 4)}</h1>', f'<div>{words(1, 4)}</div>'])}{r.choice([text, ''])}{links(1, 4)}</header>"
        return f"<header>{text}{links(1, 4)}</header>" if r.random() < 0.2 else f"<footer>{r.choice(['&copy; ', '', 'Copyright '])}{text}</footer>"

    def gold(tag: str, inner: str, attributes: str = "") -> str:
        return f"<{tag} data-gold='1'{attributes}>{inner}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>")

    def content(k: int) -> str:
        out = [gold("h1", words(2, 9))] if r.random() < 0.8 else []
        for _ in range(k):
            kind = r.randrange(12)
            inline = f"{words(3, 60)} <b>{words(1, 4)}</b> <a href='/x'>{words(1, 4)}</a> {words(0, 30)}" if r.random() < 0.4 else words(1, 120)
            if r.random() < 0.1:
                inline = f"<b>{words(1, 40)}<br>"
            if kind == 0:
                out.append(gold(r.choice(["h2", "h3", "h4"]), words(1, 6)))
            elif kind == 1:
                tag = r.choice(["ul", "ol"])
                out.append(gold(tag, "".join(gold("li", words(1, 25)) for _ in range(r.randint(2, 6)))))
            elif kind == 2:
                out.append(gold("blockquote", gold("p", words(4, 50)) if r.random() < 0.5 else words(4, 50)))
            elif kind == 3:
                out.append(gold("table", "".join(gold("tr", "".join(gold("td", words(1, 4)) for _ in range(3))) for _ in range(r.randint(1, 3)))))
            elif kind == 4:
                out.append(gold("pre", words(3, 30)))
            elif kind == 5:
                out.append(gold("div", inline))
            elif kind == 6:
                out.append(gold("figure", gold("figcaption", words(2, 12))))
            elif kind == 7:
                out.append(junk())
            elif kind == 8:
                out.append(gold("section", gold("h2", words(1, 5)) + gold("p", inline)))
            else:
                out.append(gold("p", inline))
        return "".join(out)

    def cells(inner: str) -> str:
        """A page laid out by a table, its menu or sidebar in a cell of its own."""
        side = named(["menu", "nav", "sidebar", "navigation", "left", "links"], "td") + f">{r.choice([links(3, 8), f'<p>{words(2, 12)}</p>{links(2, 6)}'])}</td>"
        middle = gold("td", inner, r.choice(["", " class='content'", f" class='{hashed()}'"])).replace("</td></td>", "</td>")
        return f"<table><tr>{side}{middle}</tr></table>" if r.random() < 0.7 else f"<table><tr>{middle}{side}</tr></table>"

    pages = []
    for _ in range(n):
        shell = r.choice(["article", "article", "main", "named", "both", "section", "none", "plain", "cells"])
        inner = content(r.choice([0, 1, 2, 4, 8, 16]))
        name = r.choice(["content", "article", "post", "entry", "story", "main", "text", "body", "entry-content", "post-body", "article-body", "inhalt", "beitrag", "artikel", "contenido", "articulo", "texto", "contenu", "corps", "tekst", hashed()])
        if shell == "named":
            inner = gold("div", inner, f" {r.choice(['class', 'id'])}='{name}'")
        elif shell == "cells":
            inner = cells(inner)
        elif shell == "plain":
            inner = gold("div", inner)
        elif shell == "both":
            inner = gold("main", gold("article", inner if r.random() < 0.5 else gold("div", inner, f" class='{name}'")) + "".join(junk() for _ in range(r.randint(0, 2))))
        elif shell != "none":
            inner = gold(shell, inner, f" class='{name}'" if r.random() < 0.3 or shell == "section" else "")
        bare = shell == "none" and r.random() < 0.5  # nothing but the text
        if bare and r.random() < 0.4:
            inner = gold("p", words(2, 8))
        before, after = ("".join(junk() for _ in range(0 if bare else r.randint(0, 4))) for _ in range(2))
        if r.random() < 0.4:
            before, after = f"<header>{before}", f"</header>{inner}{after}"
            inner = ""
        body = before + inner + after
        if r.random() < 0.4:
            body = f"<div class='{r.choice(['wrap', 'page', 'container', 'row', 'layout'])}'>{body}</div>"
        whole = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>"
        pages.append(parse(body if bare and r.random() < 0.5 else whole))
    r.seed(seed + 1)
    for _ in range(n // 10):  # text outside of all elements, alone or between paragraphs and junk
        text = lambda: r.choice([words(1, 90), f"<b>{words(1, 9)}</b> {words(3, 60)}", f"{words(2, 40)} <a href='/x'>{words(1, 3)}</a> {words(1, 9)}", f"{words(2, 40)}<br><br>{words(2, 40)}"])
        parts = [text() if r.random() < 0.6 else content(r.choice([1, 2, 4])) for _ in range(r.choice([1, 1, 2, 4, 8]))]
        if len(parts) > 1 and r.random() < 0.5:
            parts = [junk(), *parts, junk()]
        inner = "<hr>".join(parts)
        pages.append(parse(r.choice(["{}", "<body>{}</body>", "<html><body>{}", "<html><head><title>x</title></head><body>{}</body></html>"]).format(inner), bare=1))
    for _ in range(n // 10):  # and scraps of it that are none
        scraps = [r.choice([f"<a href='/'>{words(1, 2)}</a> | <a href='/x'>{words(1, 2)}</a>", f"&copy; <a href='/'>{words(1, 3)}</a>"]) for _ in range(2)]
        inner = content(r.choice([2, 4, 8]))
        inner = inner if r.random() < 0.5 else gold(r.choice(["article", "main", "div"]), inner)
        pages.append(parse(f"<html><body>{scraps[0]}{inner}{scraps[1]}</body></html>"))
    return pages


_model: list[TreeModel] = []


def default_model() -> TreeModel:
    if not _model:
        _model.append(train(labelled_pages()))
    return _model[0]


def text_of(page: Page, p: np.ndarray, threshold: float = 0.5) -> str:
    return "\n".join(text for node, text in page.blocks if p[node] >= threshold)


def extract(pages: DataFrame, model: TreeModel | None = None, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.5) -> DataFrame:
    """Main text of each whole page, with the `keep` columns: text string (blocks in page order, joined by a newline; empty if none) and n_chars long.

    Null and empty pages give empty text. Repeated rows stay repeated; other columns are dropped. The model is trained on the driver from
    labelled pages (the built-in set unless one is given) and travels with the task.
    """
    bound_batches(pages.sparkSession)
    chosen = model or default_model()
    rows = pages.select(*keep, pages[source].alias("__html"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            texts = [text_of(page, p, threshold) for page, p in zip(parsed, marginals(chosen, parsed), strict=True)] if parsed else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, kept + "text string, n_chars bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, from its whole html: page_id, url, text, n_chars. Null and empty pages give an empty text."""
    return extract(table(spark, sf_dir, "pages"))
