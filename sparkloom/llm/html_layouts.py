"""Random page layouts for operator 5, with labels.

:func:`layout` writes a page from a seed: nested wrappers with and without names, site headers, menus, notices, an article with
its parts in some order and nesting, surroundings inside and around it. ``data-main`` marks what belongs to the main text
("1") and what inside it does not ("0"); an element without a mark takes its parent's. ``{p}`` stands for a paragraph,
``{s}`` for a short sentence, ``{w}`` for a word or two.
"""

from __future__ import annotations

import random

#: Names of the parts of a page, as sites give them.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner", "notice": "cookie cookies consent gdpr notice alert popup modal overlay", "share": "share sharing social",
    "news": "newsletter subscribe subscription signup feedback survey form", "side": "sidebar side widget complementary popular trending", "nav": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager skip toolbar",
    "comments": "comments comments comment replies reply discussion disqus respond", "related": "related recommended", "foot": "footer copyright legal contentinfo", "head": "header masthead login search", "meta": "meta byline author tags rating",
    "main": "article main content post entry body text story prose page", "wrap": "wrapper container site layout row grid inner outer page hfeed",
}
NAMES = {kind: words.split() for kind, words in NAMES.items()}
EXTRA = "area box wrap list block section inner col unit slot item top bar card one 2 3 12".split()
#: Names of sections that an article itself may have: a word against content, outnumbered by others or not alone.
OWN_NAMES = "social history,related work,comment culture,legal theory,form style,header study,search method,rating study,author life,notice period,popular culture,survey design".split(",")


class _Writer:
    def __init__(self, rng: random.Random, plain: float):
        self.rng, self.plain = rng, plain

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def name(self, kind: str) -> str:
        """A class or id of a part."""
        words = [self.rng.choice(NAMES[kind])] + ([self.rng.choice(EXTRA)] if self.chance(0.45) else [])
        if self.chance(0.15):
            words.reverse()
        if self.chance(0.15):
            words.insert(0, self.rng.choice(["site", "page", "js", "x"]) if kind != "main" else "x")
        text = self.rng.choice(["-", "_", " ", "-"]).join(words)
        return f' {self.rng.choice(["class", "class", "id"])}="{text}"' + (f' role="{self.rng.choice(NAMES[kind])}"' if self.chance(0.05) else "")

    def some(self, low: int, high: int, make) -> str:
        return "".join(make() for _ in range(self.rng.randint(low, high)))

    def link(self, inner: str = "{w}") -> str:
        return f'<a href="/{self.rng.randint(1, 99)}">{inner}</a>'

    def menu(self) -> str:
        items = self.rng.choice([lambda: f"<li>{self.link()}</li>", lambda: f"{self.link()} ", lambda: f"<div>{self.link()}</div>", lambda: f"<li>{self.link()}<ul><li>{self.link()}</li></ul></li>"])
        inner = self.some(2, 7, items)
        inner = f"<ul>{inner}</ul>" if "<li>" in inner else inner
        return f"<nav>{inner}</nav>" if self.chance(0.5) else f"<div{self.name('nav')}>{inner}</div>"

    def form(self) -> str:
        return f'<form action="/q">{"<label>{w}</label>" if self.chance(0.5) else ""}<input>{"<select><option>{w}</option><option>{w}</option></select>" if self.chance(0.2) else ""}<button>{{w}}</button></form>'

    def wrapped(self, inner: str, kinds: tuple[str, ...], high: int, mark: str = "") -> str:
        """Inside wrappers with names of these kinds or none."""
        for _ in range(self.rng.randint(0, high)):
            kind, tag = self.rng.choice(kinds), self.rng.choice(["div", "div", "div", "section"])
            inner = f"<{tag}{self.name(kind) if kind else ''}{mark}>{inner}</{tag}>"
        return inner

    def head(self) -> str:
        inner = self.rng.choice(["", "<p>{s}</p>", "<h1>{w}</h1>", "<div>{w}</div>", "<h1>{w}</h1><p>{s}</p>"]) + (self.link() if self.chance(0.6) else "") + (self.form() if self.chance(0.2) else "") + (self.menu() if self.chance(0.5) else "")
        return f"<header{self.name('head') if self.chance(0.4) else ''}>{inner}</header>" if self.chance(0.55) else f"<div{self.name('head')}>{inner}</div>"

    def foot(self) -> str:
        inner = self.some(1, 3, lambda: self.rng.choice(["<p>{s}</p>", "<div>{s}</div>", "&copy; {w} {s} ", self.link() + " ", f"<ul><li>{self.link()}</li><li>{self.link()}</li></ul>", "<p>{p}</p>" if self.chance(0.3) else "{w} "]))
        return f"<footer{self.name('foot') if self.chance(0.4) else ''}>{inner}</footer>" if self.chance(0.6) else f"<div{self.name('foot')}>{inner}</div>"

    def notice(self) -> str:
        return f"<div{self.name('notice')}>{self.rng.choice(['{s}', '<p>{s}</p>', '<p>{s}</p><button>{w}</button>', '<p>{p}</p><a href=\"/c\">{w}</a>'])}</div>"

    def ad(self, mark: str = "") -> str:
        tag = "aside" if self.chance(0.1) else "div"
        return f"<{tag}{self.name('ad')}{mark}>{self.rng.choice(['{s}', '<p>{s}</p>', '<p>{p}</p>', self.link('{s}'), '{w}'])}</{tag}>"

    def share(self, mark: str = "") -> str:
        return f"<div{self.name('share')}{mark}>{self.some(1, 4, lambda: self.link() + ' ')}</div>" if self.chance(0.7) else f"<ul{self.name('share')}{mark}>{self.some(1, 4, lambda: f'<li>{self.link()}</li>')}</ul>"

    def news(self, mark: str = "") -> str:
        return f"<div{self.name('news')}{mark}>{self.rng.choice(['<p>{s}</p>', '<h3>{w}</h3><p>{s}</p>', ''])}{self.form()}</div>" if self.chance(0.7) else self.form().replace("<form", f"<form{mark}")

    def related(self, mark: str = "") -> str:
        inner = self.rng.choice(["<h3>{w}</h3>", "<h2>{w}</h2>", "<h4>{w}</h4>"]) + self.rng.choice([f"<ul>{self.some(1, 5, lambda: f'<li>{self.link(chr(123) + self.rng.choice(chr(115) + chr(119)) + chr(125))}</li>')}</ul>", self.some(1, 4, lambda: f"<p>{self.link('{s}')}</p>"), self.some(1, 3, lambda: f"<div>{self.link('{s}')}<p>{{s}}</p></div>")])
        tag = self.rng.choice(["aside", "section", "div"])
        return f"<{tag}{self.name('related')}{mark}>{inner}</{tag}>"

    def comments(self, mark: str = "") -> str:
        one = self.rng.choice(["<p>{p}</p>", "<p>{s}</p>", "<div>{p}</div>", "<p>{w}</p><p>{p}</p>"])
        tag = self.rng.choice(["div", "li", "article", "div"])
        name = "" if self.chance(0.3) else f' class="{self.rng.choice(["comment", "comment-body", "reply", "comment depth-1"])}"'
        if tag == "article" and not name:
            tag = "div"
        items = self.some(1, 5, lambda: f"<{tag}{name}>{one}{f'<div class=reply><p>{chr(123)}s{chr(125)}</p></div>' if self.chance(0.2) else ''}</{tag}>")
        items = f"<ul>{items}</ul>" if tag == "li" else items
        title = self.rng.choice(["<h2>{w}</h2>", "<h3>{w}</h3>", ""])
        tag = self.rng.choice(["div", "section", "section", "div"])
        return f"<{tag}{self.name('comments')}{mark}>{title}{items}{self.form() if self.chance(0.4) else ''}</{tag}>"

    def meta(self, mark: str) -> str:
        tag = self.rng.choice(["div", "p"])
        return f"<{tag}{self.name('meta')}{mark}>{self.rng.choice(['{w}', '{s}', self.link(), '{w} ' + self.link()])}</{tag}>"

    def side(self) -> str:
        widget = lambda: self.rng.choice(["<h3>{w}</h3>", "<h4>{w}</h4>", ""]) + self.rng.choice([f"<ul>{self.some(1, 5, lambda: f'<li>{self.link()}</li>')}</ul>", "<p>{s}</p>", "<p>{p}</p>", self.form(), f"<ul>{self.some(1, 4, lambda: f'<li>{self.link(chr(123) + chr(115) + chr(125))}</li>')}</ul>"])
        inner = self.some(1, 3, lambda: f"<div{self.name('side')}>{widget()}</div>" if self.chance(0.4) else f"<div>{widget()}</div>" if self.chance(0.5) else widget())
        tag = "aside" if self.chance(0.5) else "div"
        return f"<{tag}{self.name('side') if tag == 'div' or self.chance(0.4) else ''}>{inner}</{tag}>"

    def block(self, bare: bool) -> str:
        """A piece of an article."""
        r = self.rng.random()
        if bare or r < 0.5:
            return f"<p>{self.rng.choice(['{p}', '{p}', '{p}', '{s}', '{s}', '{w}'] if not bare else ['{p}', '{p}', '{s}'])}</p>"
        kinds = [
            "<h2>{w}</h2>", "<h3>{s}</h3>", "<h2>{s}</h2><p>{p}</p>", "<blockquote>{p}</blockquote>", "<blockquote><p>{p}</p></blockquote>", "<pre>{p}</pre>", "<div>{p}</div>", "{p}", "<p>{p}", f"<p>{self.link('{p}')}</p>", f"<p>{self.link('{s}')}</p>", f"<p>{{s}} {self.link()} {{s}}</p>",
            f"<ul>{self.some(1, 6, lambda: self.rng.choice(['<li>{w}</li>', '<li>{s}</li>', '<li><p>{s}</p></li>', '<li>{p}</li>']))}</ul>", f"<ol>{self.some(1, 4, lambda: '<li>{s}</li>')}</ol>", f"<ul>{self.some(1, 5, lambda: f'<li>{self.link(chr(123) + chr(115) + chr(125))}</li>')}</ul>",
            f"<ul>{self.some(1, 5, lambda: f'<li>{self.link()}</li>')}</ul>", "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table>", "<table><tbody><tr><td>{p}</td></tr></tbody></table>", "<figure><img><figcaption>{s}</figcaption></figure>", "<figure><figcaption>{w}</figcaption></figure>",
            "<dl><dt>{w}</dt><dd>{s}</dd></dl>", "<label>{w}</label>", "<details><summary>{w}</summary><p>{p}</p></details>", "{s}<br>{s}", "<div><div><p>{p}</p></div></div>", "<section><h2>{w}</h2><p>{p}</p><p>{s}</p></section>", "<address>{s}</address>", "<p><b>{w}</b></p>",
        ]
        if r > 0.95:
            words = self.rng.choice(OWN_NAMES).replace(" ", self.rng.choice(["-", " ", "_"]))
            tag = self.rng.choice(["div", "section"])
            return f'<{tag} class="{words}">{self.rng.choice(["<p>{p}</p>", "{p}", "<h2>{w}</h2><p>{p}</p>"])}</{tag}>'
        return self.rng.choice(kinds)

    def article(self, named: bool) -> str:
        """An article, with a name or without."""
        off = ' data-main="0"'
        junk = [self.ad, self.share, self.news, self.related, self.meta, lambda m: f"<aside{m}>{self.rng.choice(['{s}', '<p>{s}</p>', '<h3>{w}</h3><p>{s}</p>'])}</aside>"]
        title = self.rng.choice(["", "<h1>{w}</h1>", "<h1>{s}</h1>", "<h1>{w}</h1>", "<h2>{s}</h2>"])
        if named and title and self.chance(0.35):
            tag = "header" if self.chance(0.7) else "hgroup"
            title = f"<{tag}{self.rng.choice(['', ' class=\"entry-header\"', ' class=\"post-header\"', ' class=\"article-header\"']) if tag == 'header' else ''}>{title}{self.meta(off) if self.chance(0.5) else ''}</{tag}>"
        elif title and self.chance(0.2):
            title += self.meta(off)
        bare = not named
        inside = self.some(2 if bare else 1, self.rng.choice([3, 6, 14]), lambda: self.block(bare) + (self.rng.choice(junk)(off) if self.chance(0.09 if named else 0.05) else ""))
        if bare:
            inside = "<p>{p}</p><p>{p}</p>" + inside
        if self.chance(0.4):
            inside = self.wrapped(inside, ("main", "") if named else ("",), 2)
        end = "".join(self.rng.choice(junk)(off) for _ in range(self.rng.choice([0, 0, 0, 1, 1, 2]))) if named else ""
        if named and self.chance(0.15):
            end += self.comments(off)
        if named and self.chance(0.1):
            end += f"<footer{off}>{self.rng.choice(['<p>{s}</p>', '{w}', self.link()])}</footer>"
        on = ' data-main="1"'
        if named and self.chance(0.65):
            return f"<article{self.name('main') if self.chance(0.35) else ''}{on}>{title}{inside}{end}</article>"
        return f"<div{self.name('main') if named else ''}{on}>{title}{inside}{end}</div>"


def layout(seed: int) -> str:
    """A page's markup with marks, for texts of any length."""
    rng = random.Random(seed)
    w = _Writer(rng, 0.2)
    named = w.chance(0.7)  # the other pages give nothing of the article a name
    parts = [w.article(named)]
    if w.chance(0.3):
        parts.append(w.comments())
    if w.chance(0.15):
        parts.append(w.related())
    if w.chance(0.1):
        parts.insert(0, w.ad())
    inner = "".join(parts)
    if named and w.chance(0.4):
        inner = f"<main{w.name('main') if w.chance(0.3) else ''}>{inner}</main>" if w.chance(0.6) else f"<div{w.name('main')}>{inner}</div>"
    side = w.side() if named and w.chance(0.5) else ""
    if not named and w.chance(0.5):  # a grid whose cells have no telling names: the aside is short
        side = f'<div class="col-md-4">{w.rng.choice(["<h3>{w}</h3>", ""])}{w.rng.choice([f"<ul><li>{w.link()}</li><li>{w.link()}</li></ul>", "<p>{s}</p>", f"<p>{w.link()}</p><p>{w.link()}</p>"])}</div>'
        inner = f'<div class="col-md-8">{inner}</div>'
    if side:
        inner = side + inner if w.chance(0.25) else inner + side
        if w.chance(0.5):
            inner = f'<div{w.rng.choice(["", w.name("wrap"), " class=\"row\""])}>{inner}</div>'
    top = "".join(make() for make, p in ((w.head, 0.6), (w.menu, 0.6), (w.notice, 0.25), (w.ad, 0.15)) if w.chance(p))
    end = "".join(make() for make, p in ((w.related, 0.15), (w.comments, 0.1), (w.news, 0.15), (w.foot, 0.75), (w.notice, 0.1)) if w.chance(p))
    if w.chance(0.1):
        top += "<noscript>{s}</noscript>"
    body = top + inner + end if w.chance(0.5) else top + w.wrapped(inner, ("wrap", ""), 3) + end
    return f"<body>{w.wrapped(body, ('wrap', ''), 2)}</body>"
