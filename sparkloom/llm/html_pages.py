"""Operator 5: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each element has a score from its own features, and each parent-child pair
a potential that depends on what the two are; sum-product messages go up from the leaves and down from the root, as log
ratios, and give every element's marginal probability of being content. The text of the elements above one half is the
page's main text: character references decoded, white space inside a block turned into one blank, blocks joined in page
order by a newline. Scripts, styles, templates, comments in the markup and the head are never text; the text of formulas,
drawings and embedded objects belongs to the block around them. Nothing is cut or capped.

Null or empty pages give an empty text. Broken markup is repaired as far as blocks go: unclosed elements end with their
parents, a paragraph ends where the next block begins. Repeated rows are handled one by one. An empty table gives an
empty one.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title".split())
#: Elements that form a node of the tree; all others are part of the text around them.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav aside header footer form fieldset "
    "button select option textarea address details summary hgroup dialog menu center noscript".split()
)
#: Where one of these starts, an open one of the named ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th button article main section nav aside header footer form div ul ol dl blockquote".split())
GROUPS = {
    "main": "article main", "chrome": "nav footer aside menu dialog noscript", "header": "header", "form": "form fieldset button select option textarea",
    "paragraph": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption",
    "outer": "html body",
}
GROUP_OF = {tag: group for group, tags in GROUPS.items() for tag in tags.split()}
#: Words in class, id and role names that speak against content wherever they stand, those that do so unless other words
#: outnumber them (``related-work`` names a section of an article), and those that speak for content.
STRONG = (
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription signup share sharing sidebar widget menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comments replies disqus respond recommended trending popup modal overlay pagination pager toolbar complementary contentinfo hidden"
).split()
WEAK = "alert notice social side comment reply discussion related popular login search copyright legal tags meta byline author form feedback survey skip rating".split()
FAVOUR = "article main content post entry body text story prose page".split()
#: Words that say how a part is laid out, or what it is of, and leave open what it is.
LAYOUT = frozenset("area box wrap wrapper container list block section inner outer col row grid unit slot item top bottom bar card one two site js layout left right md sm lg x header".split()) | frozenset(FAVOUR)
STRONG_WORDS, AGAINST, IN_FAVOUR = frozenset(STRONG), frozenset(STRONG + WEAK), frozenset(FAVOUR)
WORD = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?。、]")
PLAIN_FEATURES = [
    "bias", *GROUPS, "other", "against", "all_against", "favour", "named_main", "named_against", "inside_main", "inside_against", "own", "all", "links", "links_inside_main", "marks", "short", "short_inside_main",
    "share", "largest", "most_links", "few_words_many_links", "outweighed", "outweighed_box", "outweighed_box_without_name", "unnamed_page",
    "leads", "heading_leads", "heading_leads_in_unnamed_page",
]
#: Every hint word has a weight of its own.
HINTS = {word: len(PLAIN_FEATURES) + i for i, word in enumerate([*STRONG, *WEAK, *FAVOUR, "header"])}
FEATURES = [*PLAIN_FEATURES, *HINTS]
#: What a parent and a child are to each other; each pair of kinds has a coupling of its own. A plain element counts by the
#: nearest of its ancestors that names itself.
KINDS = ("outer", "main", "plain", "plain in main", "plain in against", "against")
PAIRS = len(KINDS) * len(KINDS)


def known(word: str) -> str:
    """The hint word that a longer word begins with (``sharedaddy``: share), from five letters on; else the word itself."""
    return next((word[:n] for n in range(len(word), 4, -1) if word[:n] in HINTS), word)


class Node:
    __slots__ = ("tag", "parent", "hints", "own", "linked", "marks", "total", "total_linked", "label", "named", "inside", "share", "largest", "least", "unnamed", "leads")

    def __init__(self, tag: str, parent: int, hints: list[str], label: str | None):
        self.tag, self.parent, self.hints, self.label = tag, parent, hints, label
        self.named = self.inside = ""
        self.share, self.least, self.largest, self.unnamed, self.leads = 0.0, 0.0, False, False, False
        self.own = self.linked = self.marks = self.total = self.total_linked = 0


class PageTree(HTMLParser):
    """Nodes of a page in order (parents first) and its text segments (node, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, [], None)]
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.hidden: list[str] = []
        self.links = 0
        self.pieces: list[str] = []
        self.segments: list[tuple[int, str]] = []

    def read(self, html: str) -> PageTree:
        self.feed(html)
        if not self.rawdata.startswith("<"):  # a tag cut off by the end of the page is no text
            self.close()
        self._flush()
        for node in reversed(self.nodes):
            node.total += node.own
            node.total_linked += node.linked
            if node.parent >= 0:
                self.nodes[node.parent].total += node.total
                self.nodes[node.parent].total_linked += node.total_linked
        self._placed()
        return self

    def _placed(self) -> None:
        """What each node names itself as, what the nearest ancestor with such a name does, and its share of the text without
        links: of the page's, whether no sibling has more, how far it stays behind the sibling that has
        most, and whether the next sibling is a text."""
        most = [0] * len(self.nodes)
        for node in self.nodes[1:]:
            most[node.parent] = max(most[node.parent], node.total - node.total_linked)
        whole = max(1, self.nodes[0].total - self.nodes[0].total_linked)
        for node in self.nodes:
            node.named = named(node)
            if node.parent >= 0:
                above = self.nodes[node.parent]
                node.inside = above.named or above.inside
                node.largest = node.total - node.total_linked >= max(1, most[node.parent])
                node.least = 1 - (node.total - node.total_linked) / max(1, most[node.parent])
            node.share = (node.total - node.total_linked) / whole
        last: dict[int, Node] = {}
        for node in self.nodes[1:]:
            if node.parent in last:
                last[node.parent].leads = node.total - node.total_linked >= 60 and node.named != "against"
            last[node.parent] = node
        unnamed = not any(node.named == "main" for node in self.nodes)
        for node in self.nodes:
            node.unnamed = unnamed

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            self.segments.append((self.stack[-1][1], text))

    def _pop(self, tags: tuple[str, ...]) -> None:
        """End the nearest open one of ``tags``, unless a scope lies between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self._flush()
                del self.stack[i:]
                self.links = 0
                return
            if self.stack[i][0] in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag == self.hidden[-1] and tag not in ("script", "style"):
                self.hidden.append(tag)
            elif tag == "body":
                self.hidden.clear()
            if self.hidden:
                return
        if tag in HIDDEN:
            self.hidden.append(tag)
            return
        if tag == "br":
            self.pieces.append(" ")
        if tag == "a":
            self.links += 1
        if tag in VOID or tag not in BLOCKS:
            if tag == "hr":
                self._pop(("p",))
                self._flush()
            return
        if tag in ENDS:
            self._pop(ENDS[tag])
        self._pop(("p",))
        self._flush()
        self.links = 0
        said = {k: (v or "") for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-label", "data-main")}
        hints = [known(h) for h in WORD.findall(" ".join(v for k, v in said.items() if k in ("class", "id", "role", "aria-label")).lower())]
        if "hidden" in said or "display:none" in said.get("style", "").replace(" ", ""):
            hints.append("hidden")
        if tag in ("html", "body"):
            self.nodes[0].hints += hints
            self.nodes[0].label = said.get("data-main") or self.nodes[0].label
            return
        self.nodes.append(Node(tag, self.stack[-1][1], hints, said.get("data-main")))
        self.stack.append((tag, len(self.nodes) - 1))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCKS:
            if tag not in HIDDEN:
                self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "br":
            self.pieces.append(" ")
        elif tag in BLOCKS and tag not in ("html", "body"):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._flush()
                    del self.stack[i:]
                    self.links = 0
                    return
                if tag == "p" and self.stack[i][0] in SCOPES:
                    return

    def handle_data(self, data):
        if self.hidden or not data:
            return
        self.pieces.append(data)
        node, size = self.nodes[self.stack[-1][1]], len(data)
        node.own += size
        node.marks += len(MARKS.findall(data))
        if self.links:
            node.linked += size

    def unknown_decl(self, data):
        pass


def named(node: Node) -> str:
    """What an element names itself as by its tag or its hint words: ``main``, ``against``, or nothing."""
    if node.parent < 0:
        return ""
    group, hints = GROUP_OF.get(node.tag, "other"), node.hints
    telling = [h for h in hints if h not in LAYOUT]
    if group in ("chrome", "form") or any(h in STRONG_WORDS for h in hints) or 2 * sum(h in AGAINST for h in telling) > len(telling):
        return "against"
    return "main" if group == "main" or any(h in IN_FAVOUR for h in hints) else ""


def plain_features(node: Node) -> list[float]:
    group = GROUP_OF.get(node.tag, "other")
    links, short, in_main = (node.total_linked / node.total if node.total else 0.0), float(node.total < 25), float(node.inside == "main")
    return [
        1.0,
        *[float(group == g) for g in GROUPS],
        float(group == "other"),
        sum(h in AGAINST for h in node.hints) / max(1, len(node.hints)),
        float(bool(node.hints) and all(h in AGAINST for h in node.hints)),
        float(any(h in IN_FAVOUR for h in node.hints)),
        float(node.named == "main"),
        float(node.named == "against"),
        in_main,
        float(node.inside == "against"),
        math.log1p(node.own) / 5,
        math.log1p(node.total) / 8,
        links,
        links * in_main,
        min(1.0, 10 * node.marks / node.own) if node.own else 0.0,
        short,
        short * in_main,
        node.share,
        float(node.largest),
        float(links > 0.5),
        float(links > 0.3 and node.total < 150),
        node.least,
        node.least * (group == "other"),
        node.least * (group == "other" and not node.named and not node.inside),
        float(node.unnamed),
        float(node.leads),
        float(node.leads and group == "heading"),
        float(node.leads and group == "heading" and node.unnamed and not node.inside),
    ]


def features(node: Node) -> list[float]:
    """The plain features, then whether each hint word is among the node's."""
    out = plain_features(node) + [0.0] * len(HINTS)
    for h in node.hints:
        if h in HINTS:
            out[HINTS[h]] = 1.0
    return out


def own_score(node: Node, weights: list[float]) -> float:
    """The weighted sum of the node's features."""
    return sum(w * x for w, x in zip(weights, plain_features(node), strict=False)) + sum(weights[HINTS[h]] for h in set(node.hints) if h in HINTS)


def kind(node: Node) -> int:
    """The place in KINDS of an element."""
    if node.parent < 0:
        return 0
    return {"main": 1, "against": 5}.get(node.named) or {"": 2, "main": 3, "against": 4}[node.inside]


def pair_kinds(nodes: list[Node]) -> list[int]:
    """For each node, which coupling holds between it and its parent (0 for the root, which has none)."""
    kinds = [kind(node) for node in nodes]
    return [kinds[node.parent] * len(KINDS) + kinds[i] if i else 0 for i, node in enumerate(nodes)]


class Extractor:
    """A trained model, ready for pages."""

    def __init__(self, weights: list[float], coupling: list[float]):
        self.weights, self.coupling = weights, coupling

    def content(self, nodes: list[Node]) -> list[float]:
        return sum_product(nodes, self.weights, self.coupling)

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        tree = PageTree().read(html)
        p = self.content(tree.nodes)
        found = [text for node, text in tree.segments if p[node] > 0.5]
        # a page with an article that has words has a text: the likeliest elements of what calls itself the article, else
        # of what doesn't call itself anything
        for kind in ("main", "") if not found else ():
            own = [(p[node], text) for node, text in tree.segments if (tree.nodes[node].named or tree.nodes[node].inside) == kind and (kind or tree.nodes[node].own - tree.nodes[node].linked >= 25)]
            found = found or [text for q, text in own if q >= max(own)[0] / 2]
        return "\n".join(found)


def sum_product(nodes: list[Node], weights: list[float], coupling: list[float]) -> list[float]:
    """The probability of content of each node. A parent and a child of one label have the potential exp(c), of two
    labels exp(-c), with the c of their kinds. Nodes come parents first, so one backward pass carries all messages up and
    one forward pass all down. Messages are log ratios, which add up without loss however many children there are."""
    belief = [own_score(node, weights) for node in nodes]
    c = [coupling[k] for k in pair_kinds(nodes)]
    up = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        up[i] = _message(c[i], belief[i])
        belief[nodes[i].parent] += up[i]
    for i in range(1, len(nodes)):
        belief[i] += _message(c[i], belief[nodes[i].parent] - up[i])  # what the parent knows without this child
    return [1 / (1 + math.exp(-b)) if b > -700 else 0.0 for b in belief]


def _message(c: float, b: float) -> float:
    """The log ratio that a neighbour of log ratio b gives over a coupling c."""
    return _log_sum(c + b, -c) - _log_sum(b - c, c)


def _log_sum(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def extracted(pages: DataFrame, model: Extractor, html_col: str = "html") -> DataFrame:
    """The rows with ``text`` in place of their markup (a column of this name is replaced)."""
    base = pages.drop(*[c for c in ("text",) if c != html_col])
    kept = [f for f in base.schema if f.name != html_col]
    at, places = base.columns.index(html_col), [base.columns.index(f.name) for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])

    def run(batches):
        for batch in batches:
            texts = pa.array([model.text(h.as_py()) for h in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + [texts], [f.name for f in kept] + ["text"])

    return base.mapInArrow(run, schema)
