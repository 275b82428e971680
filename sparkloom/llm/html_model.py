"""Labelled pages and training for operator 5.

The pages are layouts of our own, some written by hand and many drawn at random (:mod:`sparkloom.llm.html_layouts`); ``data-main`` marks what belongs to the main text ("1") and what inside it does not
("0"); an element without a mark takes its parent's. ``{p}`` stands for a paragraph, ``{s}`` for a short sentence,
``{w}`` for a word or two; each layout is filled several times with texts of different lengths. More labelled pages
(with ``data-main`` marks) can be passed to :func:`train`, up to ``max_pages`` of them.
"""

from __future__ import annotations

import math
import random

import numpy as np

from sparkloom.llm.html_layouts import layout
from sparkloom.llm.html_pages import PAIRS, Extractor, Node, PageTree, features, pair_kinds

LAYOUTS = (
    """<body><nav><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li><li><a href="/c">{w}</a></li></ul></nav><div class="ad">{s}</div>
    <article data-main="1"><h1>{s}</h1><p>{p}</p><p>{s}</p><p>{p}</p><p>{w}</p></article><footer>&copy; {w} &middot; {s}</footer></body>""",
    """<body><header><a href="/">{w}</a><form action="/q"><input><button>{w}</button></form></header><main data-main="1"><h1>{w}</h1><p>{p}</p><ul><li>{s}</li><li>{s}</li><li>{w}</li></ul>
    <h2>{w}</h2><p>{p}</p><aside data-main="0"><h3>{w}</h3><p>{s}</p></aside><blockquote>{p}</blockquote></main><footer><p>{s}</p><ul><li><a href="/x">{w}</a></li></ul></footer></body>""",
    """<body><div id="header"><div class="logo"><a href="/">{w}</a></div><div class="menu"><a href="/1">{w}</a> <a href="/2">{w}</a></div></div><div class="cookie-notice"><p>{s}</p><button>{w}</button></div>
    <div id="content" data-main="1"><h1>{w}</h1><div class="post-body"><p>{p}</p><p>{p}</p><div class="ad" data-main="0">{s}</div><p>{s}</p></div></div>
    <div id="sidebar"><h3>{w}</h3><ul><li><a href="/3">{s}</a></li><li><a href="/4">{s}</a></li></ul><p>{p}</p></div><div id="footer">{s}</div></body>""",
    """<body><div><div><a href="/">{w}</a> <a href="/z">{w}</a></div></div><div data-main="1"><h2>{w}</h2><p>{p}</p><p>{p}</p><p>{s}</p><table><tr><th>{w}</th><td>{s}</td></tr></table></div>
    <div class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p><div class="reply"><p>{p}</p></div></div></div></body>""",
    """<body><section class="hero banner"><h2>{w}</h2><p>{s}</p></section><section class="article" data-main="1"><h1>{s}</h1><p>{w}</p><p>{p}</p><pre>{p}</pre><p>{p}</p></section>
    <section id="comments"><h2>{w}</h2><article class="comment"><p>{p}</p></article><article class="comment"><p>{s}</p></article><form><label>{w}</label><textarea></textarea><button>{w}</button></form></section>
    <section class="related"><h3>{w}</h3><ul><li><a href="/5">{s}</a></li><li><a href="/6">{s}</a></li></ul></section></body>""",
    """<body><nav>{w}<a href="/7">{w}</a></nav><article data-main="1">{p}<h2>{w}</h2>{p}<figure><figcaption>{s}</figcaption></figure><p>{p}<div class="share" data-main="0"><a href="/8">{w}</a> <a href="/9">{w}</a></div>
    <p>{s}<div class="newsletter" data-main="0"><p>{s}</p><form><button>{w}</button></form></div></article><div class="popup">{s}</div><aside><p>{p}</p></aside></body>""",
    """<body><article data-main="1"><h1>{w}</h1><p><b>{s}<br><p>{p}</p><p>{s}</p></article><section class="comments"><h2>{w}</h2><p>{p}</p><p>{p}</p></section><footer>{p}</footer></body>""",
    """<body><div class="breadcrumb"><a href="/">{w}</a> / <a href="/k">{w}</a></div><div class="notice">{p}</div><div class="entry" data-main="1"><p>{p}</p><ol><li>{p}</li><li>{s}</li></ol><dl><dt>{w}</dt><dd>{s}</dd></dl></div>
    <div class="widget"><h4>{w}</h4><p>{s}</p></div><div class="pagination"><a href="/p1">{w}</a><a href="/p2">{w}</a></div></body>""",
    """<body><header><h1>{w}</h1><p>{s}</p></header><p data-main="1">{p}</p><p data-main="1">{p}</p><h2 data-main="1">{w}</h2><p data-main="1">{s}</p><footer><div>{s}</div></footer></body>""",
    """<body><div class="advert"><p>{p}</p></div><main data-main="1"><article><h1>{s}</h1><div><p>{p}</p><div><p>{p}</p></div></div></article></main><aside class="sidebar"><div><h3>{w}</h3><p>{p}</p></div></aside></body>""",
    """<body><nav><a href="/m">{w}</a></nav><div class="cookie-banner">{s}</div><article data-main="1"><h1>{w}</h1><p>{s}</p><aside data-main="0">{s}</aside><p>{s}<form data-main="0"><label>{w}</label><input></form></article>
    <div id="comments"><p>{p}</p></div><footer>{w}</footer></body>""",
    """<body><article data-main="1"><p>{p}</p></article></body>""",
    """<body><div class="top-nav"><ul><li>{w}</li><li>{w}</li></ul></div><article data-main="1"><header><h1>{s}</h1></header><p>{w}</p><p>{p}</p><div class="ads" data-main="0"><p>{s}</p></div><p>{p}</p><section class="comments" data-main="0"><h3>{w}</h3><div><p>{p}</p></div></section></article><div class="site-footer"><p>{p}</p></div></body>""",
    """<body data-main="1">{p}<br>{p}<p>{p}</p></body>""",
    """<body><p data-main="1">{p}</p><p data-main="1">{s}</p><p data-main="1">{p}</p></body>""",
    """<body><div><div><div data-main="1"><div>{p}</div><div>{p}</div><div>{s}</div></div></div></div></body>""",
    """<body><div data-main="1"><div>{p}</div><div><div>{s}</div><div>{p}</div></div></div></body>""",
    """<body><div data-main="1"><p>{p}</p><p>{p}</p><p>{s}</p><div class="ad" data-main="0">{s}</div><div class="ad" data-main="0">{s}</div><div class="ad" data-main="0">{s}</div><p>{p}</p></div></body>""",
    """<body><div data-main="1"><p>{p}</p><div class="advert" data-main="0"><p>{s}</p></div><p>{p}</p><div class="promo" data-main="0"><p>{p}</p></div><p>{s}</p><div class="share" data-main="0"><a href="/t">{w}</a></div><p>{p}</p></div></body>""",
    """<body><div data-main="1"><p>{p}</p><p>{s}</p><div class="ad" data-main="0">{s}</div><div class="ad" data-main="0">{s}</div><div class="ad" data-main="0">{s}</div><div class="ad" data-main="0">{s}</div><p>{p}</p></div></body>""",
    """<body><nav><a href="/o">{w}</a></nav><article data-main="1"><h1>{w}</h1><div class="social-history"><p>{p}</p></div><div class="form-and-style">{p}</div><p>{s}</p><section class="related-work"><h2>{w}</h2><p>{p}</p></section></article><footer>{s}</footer></body>""",
    """<body><main data-main="1"><div class="comment-culture"><p>{p}</p></div><div class="legal-text"><p>{p}</p><p>{s}</p></div><div class="sponsored" data-main="0"><p>{p}</p></div></main><div class="comments-list"><p>{p}</p></div><div class="share-bar">{w}</div></body>""",
    """<body><noscript><p>{s}</p></noscript><article data-main="1"><p>{p}</p><noscript data-main="0">{s}</noscript><p>{s}</p></article><noscript>{s}</noscript></body>""",
    """<body><div class="page"><div class="top"><a href="/v">{w}</a> <a href="/u">{w}</a></div><div data-main="1"><div><b>{w}</b></div><div>{p}</div><div>{p}</div></div><div class="bottom footer">{s}</div></div></body>""",
    """<body><div class="wrapper"><div class="header"><p>{s}</p></div><div class="main" data-main="1"><h1>{w}</h1><p>{w}</p><p>{p}</p><p>{s}</p></div><div class="comments"><ul><li><p>{p}</p></li><li><p>{s}</p></li></ul></div></div></body>""",
)
WORDS = "the river of light and stone moves over a quiet field where small birds keep their long hours in autumn while people walk home under new rain".split()
VARIANTS = 12
#: Random layouts that are drawn.
DRAWN = 800
STRENGTH = 0.002


def filled(layout: str, seed: int) -> str:
    """The layout with texts of random length."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.08 else "") for _ in range(n)).capitalize()

    parts, out = layout.split("{"), []
    out.append(parts[0])
    for part in parts[1:]:
        kind, rest = part[0], part[2:]
        n = {"p": round(math.exp(rng.uniform(math.log(4), math.log(200)))), "s": rng.randint(4, 14), "w": rng.randint(1, 3)}[kind]
        out += [words(n), "." if kind != "w" or rng.random() < 0.3 else "", rest]
    return "".join(out)


def labels(nodes: list[Node]) -> list[int]:
    out: list[int] = []
    for node in nodes:
        out.append(int(node.label == "1") if node.label else (out[node.parent] if node.parent >= 0 else 0))
    return out


class Forest:
    """All trees at once: messages run level by level, as in ``html_pages.sum_product``, and give exact gradients."""

    def __init__(self, pages: list[str]):
        rows, known, parent, depth, kind = [], [], [], [], []
        for html in pages:
            nodes, start = PageTree().read(html).nodes, len(rows)
            for i, node in enumerate(nodes):
                rows.append(features(node))
                parent.append(start + node.parent if i else -1)
                depth.append(depth[start + node.parent] + 1 if i else 0)
            kind += pair_kinds(nodes)
            known += labels(nodes)
        self.x, self.s = np.array(rows), 2.0 * np.array(known) - 1
        self.parent, self.kind, depths = np.array(parent), np.array(kind), np.array(depth)
        self.levels = [np.flatnonzero(depths == d) for d in range(1, depths.max() + 1)]
        self.child = np.flatnonzero(self.parent >= 0)

    def expected(self, w: np.ndarray, coupling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's probability of content, and the expected product of the labels (-1, 1) of each child and its
        parent. Messages are log ratios."""
        belief, c = self.x @ w, coupling[self.kind]
        up = np.zeros(len(belief))
        for level in reversed(self.levels):
            b = belief[level]
            up[level] = np.logaddexp(c[level] + b, -c[level]) - np.logaddexp(-c[level] + b, c[level])
            np.add.at(belief, self.parent[level], up[level])
        below, rest = belief.copy(), np.zeros(len(belief))
        for level in self.levels:
            rest[level] = belief[self.parent[level]] - up[level]
            belief[level] += np.logaddexp(c[level] + rest[level], -c[level]) - np.logaddexp(-c[level] + rest[level], c[level])
        k = self.child
        same = np.logaddexp(0, below[k] + rest[k]) + c[k]
        other = np.logaddexp(below[k], rest[k]) - c[k]
        return 1 / (1 + np.exp(-belief)), np.tanh((same - other) / 2)


def pages(layouts: tuple[str, ...] = LAYOUTS, drawn: int = DRAWN, seed: int = 0) -> list[str]:
    """Labelled pages: each of ``layouts`` VARIANTS times, and ``drawn`` random ones, filled."""
    return [filled(text, 1000 * i + v) for i, text in enumerate(layouts) for v in range(VARIANTS)] + [filled(layout(seed + i), seed + i) for i in range(drawn)]


def train(more: list[str] = (), max_pages: int = 1000, rounds: int = 900, layouts: tuple[str, ...] = LAYOUTS, drawn: int = DRAWN) -> Extractor:
    """Weights and couplings of largest penalised likelihood, by gradient steps of adaptive length (Adam)."""
    forest = Forest(pages(layouts, drawn) + list(more)[:max_pages])
    n = forest.x.shape[1]
    w, first, second = np.zeros(n + PAIRS), np.zeros(n + PAIRS), np.zeros(n + PAIRS)
    y, k = (forest.s + 1) / 2, forest.child
    products = forest.s[k] * forest.s[forest.parent[k]]
    for step in range(1, rounds + 1):
        p, both = forest.expected(w[:n], w[n:])
        slope = np.concatenate([forest.x.T @ (y - p), np.bincount(forest.kind[k], products - both, minlength=PAIRS)]) - STRENGTH * len(y) / 100 * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Extractor([float(v) for v in w[:n]], [float(v) for v in w[n:]])
