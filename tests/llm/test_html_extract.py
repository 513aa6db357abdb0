import itertools
import random
import re

import numpy as np

from changelens.llm.html_extract import CLIP, DEFAULTS, OWN, blocks_of, costs, edges, extract, fit, main_text, minimum_cut, op9_min_cut_extraction, train

PAGE = """<html><head><title>T</title></head><body class="home"><header><h1>Site</h1><p>Our slogan is long and has a point.</p></header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<div id="cookie-notice">We use cookies, friends.</div><main><article><header><h1>Headline</h1></header><p>First para with <a href="/">a link</a>, and text &lt;b&gt; &amp; more&nbsp;stuff.<p>Second   para<br>goes on.<ul><li>Item one</li><li>Item two</li></ul>
<div class="advert">Buy now!</div><section id="comments"><h2>Comments</h2><p>I really liked this article, it was great.</p></section></article><aside>Related stuff</aside></main>
<form><label>Name</label><input><p>Sign up for our list today.</p></form><footer>&copy; 2020</footer><script>var a="<p>no</p>";</script></body></html><p unfinished"""


def test_cut_is_least():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 7)
        costs = [rng.choice([0, 1, -1, 2.5, -3]) for _ in range(n)]
        smooth = [(a, b, rng.choice([0, 0.5, 1, 2])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        value = lambda l: sum(max(c, 0) for c, k in zip(costs, l, strict=True) if not k) + sum(max(-c, 0) for c, k in zip(costs, l, strict=True) if k) + sum(w for a, b, w in smooth if l[a] != l[b])  # noqa: E731, E741, B023
        assert abs(value(minimum_cut(costs, smooth)) - min(map(value, itertools.product([0, 1], repeat=n)))) < 1e-9


def test_page():
    assert main_text(PAGE) == "Headline\nFirst para with a link, and text <b> & more stuff.\nSecond para goes on.\nItem one\nItem two"
    plain = '<body><div class="menu"><a>a</a> <a>b</a></div><div id="content"><h2>Title here</h2><p>A paragraph of text that is reasonably long, with punctuation and so on.</p><p>Short.</p></div><div class="footer">All rights reserved</div></body>'
    assert main_text(plain) == "Title here\nA paragraph of text that is reasonably long, with punctuation and so on.\nShort."


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>Deep text, far down in the page, is still the text.</p>" + "</div>" * 3000
    wide = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(3000)) + "</article>"
    html = [PAGE, None, "", "<", "<p", "no markup at all, just a line of text that goes on for a while.", "<!-- never closed", '<p title="a>b">x', deep, wide, "<script>", PAGE]
    rows = [(k, "u", h, "t", 1) for k, h in enumerate(html)] + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[2].text == got[4].text == got[6].text == got[10].text == ""
    assert got[8].text.startswith("Deep text") and got[9].text.count("\n") == 2999
    assert got[0].text == got[11].text
    assert extract(pages.limit(0)).count() == 0


TEXT = "A paragraph of text that is reasonably long, with punctuation and so on."
BOTH = f"<h2>Title here</h2><p>{TEXT}</p><p>Short.</p>"
GOT = f"Title here\n{TEXT}\nShort."


def test_layout_classes_do_not_lose_the_article():
    for name in ("layout has-sidebar", "no-ads", "post with-comments", "hasSidebar", "without_widgets"):
        assert main_text(f'<body><div class="{name}"><div class="menu"><a>a</a></div><div id="content">{BOTH}</div></div></body>') == GOT
    for tag in ("article", "main", "div role=main"):
        page = f'<body><div class="page sidebar"><p>Aside of some length, with a point.</p><{tag}>{BOTH}<div class="comments"><p>{TEXT * 3}</p></div></{tag.split()[0]}></div></body>'
        assert main_text(page) == GOT
    assert main_text(f"<article>{BOTH}</article><div class='related-posts'><article><h3>Other news</h3><p>{TEXT * 3}</p></article></div>") == GOT
    comment = f'<li class="comment"><article class="comment-body"><p>{TEXT * 3}</p></article></li>'
    assert main_text(f'<main><article>{BOTH}</article><ol class="comment-list">{comment * 3}</ol></main>') == GOT
    assert main_text(f'<article class="post no-sidebar">{BOTH}<div class="ad-with-image">{TEXT * 3}</div></article>') == GOT


def test_self_closed_raw_tags_are_empty():
    for mark in ('<svg class="icon" />', "<svg/>", '<iframe src="x"/>', "<svg><path/>hidden</svg>", '<script src="x" />'):
        assert main_text(f"<article>{mark}{BOTH}<svg>drawn</svg></article>") == GOT


def noisy(html, rng):
    """A page without its marks: article, menu and footer are plain divs; short and linked blocks in the article, a list beside it."""
    sentences = re.findall(r"[^.<>]{20,80}\.", re.sub(r"<[^>]+>", " ", html)) or ["Some other text here."]
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = []
    for p in re.split(r"(?=<p>)", article):
        parts.append(p)
        if rng.random() < 0.3:
            parts.append(f"<p>{rng.choice(['Yes', 'No so', 'Hm', 'And', 'One two'])}</p>")
        if rng.random() < 0.15:
            parts.append(f'<div><a href="x">{rng.choice(sentences)[:25]}</a></div>')
    links = [f'<li><a href="y">{rng.choice(sentences)[:30]}</a></li>' for _ in range(7)]
    beside = "<div><ul>" + "".join([*links[:4], f"<li>{rng.choice(sentences)}</li>", *links[4:]]) + "</ul></div>"
    out = html.replace(f"<article>{article}</article>", f"<div>{''.join(parts)}</div>").replace(' class="ad"', "")
    for tag in ("nav", "footer"):
        out = out.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return out.replace("<body>", "<body>" + beside, 1) if rng.random() < 0.5 else out.replace("</body>", beside + "</body>")


def test_the_cut_mends_what_the_classifier_alone_gets_wrong(spark):
    """Weights are learned from the marked pages of one half; the other half is read with its marks taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id")
    weights = train(pages.filter("page_id % 2 = 0"))
    assert train(pages.filter("page_id % 2 = 0").repartition(5)) == weights and weights != list(DEFAULTS.values())
    rng, hits = random.Random(1), {"alone": [0, 0, 0], "cut": [0, 0, 0]}
    changed = 0
    for r in pages.filter("page_id % 2 = 1").collect():
        assert main_text(r.html, weights) == main_text(r.html)  # a marked page is read by its marks
        blocks = blocks_of(noisy(r.html, rng))
        home = next(b.node.parent for b in blocks if b.node.tag == "h1")
        real = []
        for b in blocks:
            n = b.node
            while n and n is not home:
                n = n.parent
            real.append(n is home)
        z = costs(blocks, weights)
        told = {"alone": [x > 0 for x in z], "cut": minimum_cut(z, edges(blocks))}
        changed += sum(a != b for a, b in zip(told["alone"], told["cut"], strict=True))
        for name, labels in told.items():
            for k, (a, b) in enumerate(((True, True), (True, False), (False, True))):
                hits[name][k] += sum(x is a and y is b for x, y in zip(labels, real, strict=True))
    f1 = {name: 2 * t / (2 * t + p + m) for name, (t, p, m) in hits.items()}
    assert changed > 100 and f1["cut"] > 0.985 and f1["cut"] > f1["alone"] + 0.03, (f1, changed)


def test_place_is_learned_and_marks_are_not_the_only_input(spark):
    """The whole query against the marks of every given page; then with the marks of article, menu and footer taken away."""
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    got = {r.page_id: r for r in op9_min_cut_extraction(spark, d).collect()}
    weights = dict(zip(DEFAULTS, train(pages), strict=True))
    assert weights["inside"] > CLIP and weights["outside"] < -CLIP and weights["inside"] != DEFAULTS["inside"]
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = "\n".join(b.text for b in blocks_of(article) if not b.node.worded)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", r.html)
        assert main_text(bare, list(weights.values())) == want


def test_place_without_any_marks_to_learn_from():
    x = np.array([[1.0] * OWN + [0.0] * 4] * 4 + [[0.0] * OWN + [0.0] * 4] * 4)
    weights = fit(x, np.array([1.0] * 4 + [0.0] * 4))
    assert weights[OWN:] == [0.0, 0.0, 0.0, DEFAULTS["word"]]
    assert fit(x[:0], np.zeros(0)) == fit(x, np.ones(8)) == list(DEFAULTS.values())


def test_training_on_odd_pages(spark):
    schema = "page_id long, url string, html string, x string, y double, text string"
    assert train(spark.createDataFrame([], schema)) == list(DEFAULTS.values())
    rows = [(k, None, h, "x", 0.0, "t") for k, h in enumerate(["", None, "<p>no article", "<article>", PAGE])] + [(None, None, PAGE, "x", 0.0, "t")] * 30
    pages = spark.createDataFrame(rows, schema)
    weights = train(pages, sample=10)
    assert len(weights) == len(DEFAULTS) and all(abs(w) < 50 for w in weights)
    got = {r.page_id: r for r in extract(pages, weights=weights).collect()}
    assert got[4].text == main_text(PAGE) and got[0].text == got[1].text == ""


def test_a_wrapper_of_the_whole_page_is_no_sidebar():
    assert main_text(f'<body><div class="sidebar">{BOTH * 3}</div></body>') == "\n".join([GOT] * 3)
    assert main_text(f'<body><div class="x">{BOTH}</div><div class="comments"><p>{TEXT}</p></div></body>') == GOT
