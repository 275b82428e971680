"""Operators 5 and 6: round trips, held-out accuracy and edge cases."""

import hashlib
import html
import itertools
import math
import random
import re

import pytest

from sparkloom.llm import chat, html_layouts, html_model, html_pages, queries


@pytest.fixture(scope="module")
def model():
    return html_model.train()


# 5


def test_pages_equal_their_articles(spark, tables):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    out = queries.op5_html_extraction(spark, tables).collect()
    assert len(out) == len(pages)
    for r in out:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", body))
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def segments_right(model, layouts):
    """Segments of text of some layouts, and how many the model tells right."""
    right = total = 0
    for i, layout in layouts:
        for v in range(3):
            tree = html_pages.PageTree().read(html_model.filled(layout, 77_000 + 100 * i + v))
            known, p = html_model.labels(tree.nodes), model.content(tree.nodes)
            total += len(tree.segments)
            right += sum((p[n] > 0.5) == known[n] for n, _ in tree.segments)
    return right, total


def test_layouts_filled_with_unseen_texts(model):
    right, total = segments_right(model, enumerate(html_model.LAYOUTS))
    assert right > 0.97 * total


def test_unseen_layouts():
    right = total = 0
    for fold in range(5):
        seen = tuple(layout for i, layout in enumerate(html_model.LAYOUTS) if i % 5 != fold)
        r, t = segments_right(html_model.train(layouts=seen, rounds=600), [(i, layout) for i, layout in enumerate(html_model.LAYOUTS) if i % 5 == fold])
        right, total = right + r, total + t
    assert right > 0.85 * total


def whole_pages_right(model, pages):
    """The share of pages whose text is right as a whole."""
    right = 0
    for page in pages:
        tree = html_pages.PageTree().read(page)
        known = html_model.labels(tree.nodes)
        right += model.text(page) == "\n".join(text for node, text in tree.segments if known[node])
    return right / len(pages)


def test_whole_texts_of_unseen_random_layouts(model):
    pages = [html_model.filled(html_layouts.layout(500_000 + i), 900_000 + i) for i in range(400)]
    assert whole_pages_right(model, pages) >= 0.9


def test_whole_texts_of_layouts_by_hand_after_training_on_random_ones_alone():
    pages = [html_model.filled(layout, 77_000 + 100 * i + v) for i, layout in enumerate(html_model.LAYOUTS) for v in range(3)]
    assert whole_pages_right(html_model.train(layouts=()), pages) >= 0.75


S = "This is a sentence of the article, which has sixteen words or so, to be kept whole."
ORDINARY = [
    (f'<body><div id="page"><header id="masthead"><a href="/">Site</a></header><main><article><header class="entry-header"><h1>Head</h1><div class="entry-meta">By me</div></header><div class="entry-content"><p>{S}</p><p>{S}</p><div class="sharedaddy"><a href="/t">Tweet</a></div></div></article><div id="comments"><p>{S}</p></div></main></div><aside class="widget-area"><h3>x</h3><ul><li><a href="/">y</a></li></ul></aside></body>', f"Head\n{S}\n{S}"),
    (f'<body><div id="page"><main><article><header class="entry-header"><h1>Head</h1></header><div class="entry-content">{f"<p>{S}</p>" * 12}<div class="sharedaddy"><a href="/t">Tweet</a></div></div></article></main></div></body>', "\n".join(["Head"] + [S] * 12)),
    (f'<div class="container"><div class="row"><div class="col-md-8"><h1>H</h1><p>{S}</p><p>{S}</p></div><div class="col-md-4"><h3>Links</h3><ul><li><a href="/">a</a></li></ul></div></div></div>', f"H\n{S}\n{S}"),
    (f"<article><p>{S}</p><p><a>{S}</a></p><ul><li><a>First study, of rivers and lakes.</a></li></ul></article>", f"{S}\n{S}\nFirst study, of rivers and lakes."),
    (f'<article><p>{S}</p><ul><li><a>one</a></li><li><a>two</a></li></ul><label>Figure 1</label><div id="ad-slot-3"><p>Buy now, it is cheap.</p></div></article>', f"{S}\none\ntwo\nFigure 1"),
]


@pytest.mark.parametrize("page", range(len(ORDINARY)))
def test_ordinary_pages(model, page):
    markup, text = ORDINARY[page]
    assert model.text(markup) == text


def test_an_article_with_words_has_a_text(model):
    rng = random.Random(2)
    for _ in range(100):
        inner = "".join(rng.choice(["<p>a</p>", "<a>b</a>", "c ", "<ul><li><a>d</a></li></ul>", "<div class='x'><a>e</a></div>"]) for _ in range(rng.randint(1, 4)))
        assert model.text(f"<body><nav><a>n</a></nav><article>{inner}</article><div class='comments'><p>{S}</p></div></body>")
    assert model.text("<body><nav><ul><li><a href='/'>only a menu</a></li></ul></nav></body>") == ""


def enumerated(nodes, model):
    """The marginals as sums over all labellings."""
    n, total = len(nodes), 0.0
    marginal, pairs = [0.0] * n, html_pages.pair_kinds(nodes)
    own = [sum(w * x for w, x in zip(model.weights, html_pages.features(node), strict=True)) for node in nodes]
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(y * b for y, b in zip(labels, own, strict=True))
        score += sum(model.coupling[pairs[i]] * (1 if labels[i] == labels[nodes[i].parent] else -1) for i in range(1, n))
        p = math.exp(score)
        total += p
        marginal = [m + p * y for m, y in zip(marginal, labels, strict=True)]
    return [m / total for m in marginal]


AD, PARAGRAPH = '<div class="ad">Buy now</div>', "<p>One two three, four five six seven eight nine ten.</p>"


@pytest.mark.parametrize("page", ["<div><p>one two three.</p><aside>x</aside><section><p>y</p><ul><li>z</li></ul></section></div>", f"<div>{PARAGRAPH * 7}{AD * 7}</div>", f"<div>{AD * 7}{PARAGRAPH * 7}</div>", f"<div>{AD * 8}{PARAGRAPH * 5}</div>"])
def test_sum_product_equals_enumeration(model, page):
    nodes = html_pages.PageTree().read(page).nodes
    assert all(abs(m - q) < 1e-6 for m, q in zip(enumerated(nodes, model), model.content(nodes), strict=True))


def test_marginals_do_not_depend_on_the_order_of_many_children(model):
    one, other = (model.content(html_pages.PageTree().read(f"<body><div>{x}</div>").nodes) for x in (PARAGRAPH * 40 + AD * 40, AD * 40 + PARAGRAPH * 40))
    assert all(abs(a - b) < 1e-9 for a, b in zip(one[2:42] + one[42:], other[42:] + other[2:42], strict=True))


def test_articles_without_names_and_mixed_containers(model):
    long = "This is a sentence of the article, and it goes on for a while until it ends."
    assert model.text(f"<body><div><div><div>{long}</div><div>{long}</div></div></div></body>") == f"{long}\n{long}"
    mixed = model.text(f"<body><div>{f'<p>{long}</p>' * 8}{AD * 8}</div></body>")
    assert mixed == "\n".join([long] * 8) and model.text(f"<body><div>{AD * 8}{f'<p>{long}</p>' * 8}</div></body>") == mixed
    inside = f'<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><div class="social-history"><p>{long}</p></div><p>{long}</p></article></body>'
    assert model.text(inside) == f"Title\n{long}\n{long}"
    assert model.text("<article><p>Let <math><mi>x</mi></math> be a number, and so on.</p><p>An <object>old <b>film</b></object> and a <svg><text>map</text></svg>.</p></article>") == "Let x be a number, and so on.\nAn old film and a map."


PAGES = [
    (1, None), (2, ""), (3, "<article><p>A &amp; B &lt;c&gt; &eacute; &#228;<p>d  e\n f<br>g</article>"), (4, "<article><script>var x='</p>';</script><style>p{}</style><p>text<!-- no --> here</p></article>"), (5, "<article><p>cut off <b>he"),
    (6, "<article><p>same</p></article>"), (6, "<article><p>same</p></article>"), (7, "<article>" + "<p>word word, word.</p>" * 20_000 + "</article>"), (8, "<div>" * 3000 + "deep"), (9, "<p>x</p></p></div></article>< <a <>"), (10, "\x00<article>\x00nul</article>"),
]


def test_page_edges(spark, model):
    df = spark.createDataFrame([(i, h, "old", "u") for i, h in PAGES], "page_id int, html string, text string, url string")
    out = {r.page_id: r.text for r in html_pages.extracted(df, model).collect()}
    assert html_pages.extracted(df, model).columns == ["page_id", "url", "text"] and html_pages.extracted(df, model).count() == len(PAGES)
    assert out[1] == out[2] == "" and out[3] == "A & B <c> é ä\nd e f g" and out[4] == "text here" and out[5] == "cut off he" and out[6] == "same"
    assert out[7].count("\n") == 19_999 and out[9] is not None
    assert html_pages.extracted(df.limit(0), model).count() == 0


def test_page_with_everything_around_the_article(model):
    page = """<header><h2>Site</h2></header><nav><a href=x>Home</a></nav><div class="cookie-banner">We use cookies</div><article><h1>T</h1><p>Hello &amp; bye.<aside>Look here</aside>
    <p>Second block of words<form><label>Mail</label><input></form></article><div id="comments"><p>I liked this very much, thank you for it.</p></div><footer>c</footer>"""
    assert model.text(page) == "T\nHello & bye.\nSecond block of words"


# 6


def test_chat_round_trip_of_any_text():
    rng = random.Random(5)
    alphabet = ["\\", "#", "<", "/", ">", ":", " ", "\n", "### ", "</turn>", "a", "é", "\U0001f600", "&"]
    for _ in range(500):
        turns = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3))) if rng.random() < 0.3 else rng.choice(("user", "assistant")), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.formatted(turns)
        assert chat.parsed(text) == turns
        assert [chat.plain(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.CONTROL_STRINGS), (-7, 1, "assistant", queries.CONTROL_STRINGS)]
    want = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        learned = "".join(t for role, t in turns if role == "assistant")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), learned)]
        want[conv] = (len(turns), digests[0], len(learned), digests[1])
    out = queries.op6_chat_formatting(spark, tables).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want and len(out) == len(want)
    assert queries.CONTROL_STRINGS == "\\### Assistant: </turn> ok"


TREES = [
    ("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "yes", 0.2), ("a", 3, 1, "assistant", "no", 0.9), ("a", 4, 2, "user", "ok", 0.9), ("a", 4, 2, "user", "ok", 0.9),  # a repeated row
    ("b", 1, 99, None, None, None),  # its parent is missing
    ("c", 1, 2, "user", "loop", 1.0), ("c", 2, 1, "user", "loop", 1.0),  # a circle
    ("d", 1, None, "user", "x", 0.0), ("d", 2, 1, "assistant", "p", 0.5), ("d", 3, 1, "assistant", "q", 0.5),  # a tie
    (None, 1, None, "user", "lost", 0.0), ("a", None, None, "user", "no node", 0.0), ("f", 1, None, "user", "b", 0.0), ("f", 1, None, "user", "a", 0.0), *[("e", i, i - 1 or None, "user", f"t{i}", 0.0) for i in range(1, 301)],
]


def test_reply_trees(spark):
    trees = spark.createDataFrame([(*t, "extra") for t in TREES], "conv string, node long, parent long, role string, text string, score double, leaf string")
    out = {r.conv: chat.parsed(r.formatted) for r in chat.conversations_of(trees).collect()}
    assert out["a"] == [("user", "hi"), ("assistant", "no")] and out["b"] == [("", "")] and "c" not in out and out[None] == [("user", "lost")]
    assert out["f"] == [("user", "a")] and out["d"] == [("user", "x"), ("assistant", "p")] and out["e"] == [("user", f"t{i}") for i in range(1, 301)]
    both = sorted((r.conv, r["rank"], len(chat.parsed(r.formatted))) for r in chat.conversations_of(trees, 2).where("conv in ('a', 'd')").collect())
    assert both == [("a", 1, 2), ("a", 2, 3), ("d", 1, 2), ("d", 2, 2)]
    assert chat.conversations_of(trees.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    assert chat.parsed(chat.conversations_of(chat.linear(repeated)).first().formatted) == [("user", "a"), ("user", "a"), ("user", "b")]


TURNS = [
    *[(1, 3, "user", x) for x in ("d", "b", "a", "c", "b", None, "")], (1, 3, "assistant", "z"), (1, None, "user", "first"), (1, 4, None, "none"), (1, 4, "", "empty"), (2, 0, "user", None),
    (None, 2, "user", "lost"), (None, 1, "assistant", "too"), *[(3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(100)],
]


def test_conversations_in_order(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id int, turn int, role string, text string, leaf string").repartition(5)
    want = {}
    for conv, turn, role, text in TURNS:
        want.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    want = {conv: [t[1:] for t in sorted(rows)] for conv, rows in want.items()}
    out = chat.conversations_in_order(turns).collect()
    assert {r.conv: chat.parsed(r.formatted) for r in out} == want and len(out) == len(want)
    trees = chat.linear(turns.where("role is not null and text is not null"))
    assert {r.conv: r.formatted for r in chat.conversations_of(trees).collect()} == {r.conv: r.formatted for r in chat.conversations_in_order(turns.where("role is not null and text is not null")).collect()}
    assert chat.conversations_in_order(turns.limit(0)).count() == 0
