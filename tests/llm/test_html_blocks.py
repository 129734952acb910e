import re

import pytest

from tidemark.llm import html_blocks
from tidemark.llm.html_blocks import extract

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work for you and your friends, and so on and on.</p></div>
<article><h1>A &amp; B</h1><p><b>First  text<br>here.<p>Second &eacute;.</p><div class="ad">Buy now.</div></article>
<div class="comments"><p>I think that this is a great article, thank you so much for all of it!</p></div>
<form><p>Enter your address here to get our letter every week.</p></form><footer>&copy; me"""
PLAIN = """<div id="content"><h1>Title</h1><p>This is a long paragraph of main text with many words so that it counts, indeed it does.</p>
<p>Short one.</p><p>Another long paragraph of main text with many words so that it counts, indeed it does.</p></div>
<div class="sidebar"><p>Some sidebar text is here that is fairly long as well and it may be confused with text.</p></div>"""


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, PLAIN), (3, "u", None), (4, "u", ""), (5, "u", "<nav>x"), (None, "u", PAGE), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS n_chars", "1 AS words")
    out = extract(df)
    assert out.columns == ["page_id", "url", "words", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in out.collect()))
    main = "A & B\n\nFirst text here.\n\nSecond é."
    assert [g for g in got if g[0] in (0, 1)] == [(0, main, len(main)), (1, main, len(main)), (1, main, len(main))]
    assert [g[1] for g in got if g[0] > 2] == ["", "", ""]
    plain = next(g[1] for g in got if g[0] == 2)
    assert plain.startswith("Title\n\nThis is") and "sidebar" not in plain and plain.count("\n\n") == 3
    assert extract(df.limit(0)).count() == 0


def test_missing_ends_and_names_of_wrappers_keep_the_article(spark):
    body = "<article><h1>Title</h1><p>This is a long paragraph of main text with many words so that it counts, indeed it does.</p></article>"
    pages = [
        "<html><head><title>T</title><body>" + body, "<body><svg viewBox='0'/>" + body, "<body><div><button>Go</div>" + body, "<body><select><option>One<option>Two</select>" + body,
        "<body><button>Go" + body, "<body class='has sidebar'>" + body, "<main class='content with-sidebar'>" + body + "</main>", "<div class='with-sidebar'>" + body + "</div>",
    ]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()}
    for i in range(len(pages)):
        assert got[i].startswith("Title\n\nThis is a long") and "Go" not in got[i] and "One" not in got[i], (i, got[i])


LONG = "This is a long paragraph of main text with many words so that it counts, indeed it does."
#: Pages by what is asked of their main text: a text that it begins with or holds, and one that it doesn't hold.
CASES = [
    (f"<body class='single has-sidebar'><article><h1>Title</h1><p>{LONG}</p></article><aside class='sidebar'><p>Beside.</p></aside>", "Title", "Beside"),
    (f"<body><form id='aspnetForm'><div id='page'><main><h1>Title</h1><p>{LONG}</p></main></div></form>", LONG, "\\0"),
    (f"<body><form><article><p>{LONG}</p></article><p>Sign up here.</p></form>", LONG, "\\0"),
    (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", "Title", "\\0"),
    (f"<article><h1>T</h1><p>{LONG}</p><p>See <a href=x>this longer guide</a></p><p>{LONG}</p></article>", "See this longer guide", "\\0"),
    (f"<article><p>{LONG}</p><p>The very end.</p><div><a href=x>Next page</a></div></article>", "The very end.", "Next page"),
    (f"<article><h1>T</h1><p>{LONG} <a href=x>open</p><p>{LONG} Second.</p><p>{LONG} Third.</p></article>", "Third.", "\\0"),
    (f"<div class='site-header'><h1>Logo</h1></div><article><p>{LONG}</p></article>", LONG, "Logo"),
    (f"<header class='masthead'><h1>Logo</h1><nav><a href=x>Home</a></nav></header><main><p>{LONG}</p></main><footer><p>Footer words.</p></footer>", LONG, "Footer"),
    (f"<article><p>{LONG}</p></article><section class='comments'><article class='comment'><p>Great read, I liked every bit of it, thank you so much!</p></article></section>", LONG, "Great read"),
    (f"<article><p>{LONG}</p></article><div id='comments'><h3>3 comments</h3><p>I was there and it was a very long day for all of us.</p></div>", LONG, "very long day"),
    (f"<div class='cookie-banner'><p>We use cookies to make this site work for you and your friends.</p></div><article><p>{LONG}</p></article>", LONG, "cookies"),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", "Title", "\\0"),
    (f"<article><p>{LONG}</p><form><p>Enter your address to get our letter every week.</p></form></article>", LONG, "Enter your"),
    (f"<main><p>{LONG}</p><ul class='share-links'><li><a href=x>Tweet</a><li><a href=x>Mail</a></ul></main>", LONG, "Tweet"),
    (f"<main><p>{LONG}</p><noscript><p>Turn on scripts.</p></noscript></main>", LONG, "Turn on"),
    (f"<article><p>{LONG}</p><blockquote><p>A quoted line of text.</p></blockquote><p>{LONG}</p></article>", "A quoted line", "\\0"),
    (f"<article><p>{LONG}</p><ul><li>First point to make here<li>Second point to make here</ul><p>{LONG}</p></article>", "Second point", "\\0"),
    (f"<article><h2>Part</h2><p>{LONG}</p><pre>x = 1</pre><p>{LONG}</p></article>", "x = 1", "\\0"),
    (f"<article><p>{LONG}</p><div class='related-posts'><h3>More</h3><p>Another story that you may want to read some day.</p></div></article>", LONG, "Another story"),
    (f"<body><div id='wrapper' class='search-page'><main><p>{LONG}</p></main></div>", LONG, "\\0"),
    (f"<article><p>{LONG}</p><style>p{{color:red}}</style><script>var p='<p>no</p>';</script><p>After.</p></article>", "After.", "color"),
    (f"<article><p>Caf&eacute; &lt;b&gt; &#8212; {LONG}</p></article>", "Café <b> —", "&eacute;"),
    ("<nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>", "", "Home"),
    ("<footer><p>All rights reserved by the owner of this page and its makers.</p></footer>", "", "rights"),
    (f"<table><tr><td><div class='content'><h1>Old</h1><p>{LONG}</p></div></td></tr></table>", LONG, "\\0"),
    (f"<div class='post'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='widget-area'><p>Widget text of some length is here for you.</p></div>", "Title", "Widget"),
    (f"<article><p>{LONG}</p><!-- <p>hidden</p> --><p>{LONG}</p></article>", LONG, "hidden"),
    (f"<article><p>{LONG}</p><p>{LONG}</p><p><a href=a>Previous</a> <a href=b>Next</a></p></article>", LONG, "Previous"),
    (f"<section class='promo-header'><article><h1>Title</h1><p>{LONG}</p></article></section>", "Title", "\\0"),
]


def test_labelled_pages(spark):
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id int, html string")).collect()}
    wrong = [(i, got[i]) for i, (_, has, lacks) in enumerate(CASES) if has not in got[i] or lacks in got[i] or not has and got[i]]
    assert not wrong


def test_a_very_long_page(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert extract(spark.createDataFrame([(1, page)], "page_id int, html string")).first().n_chars == 20_000 * (len(LONG) + 2) - 2


TITLE, FIRST, SECOND = "On rivers", "Rivers carry water from the hills down to the sea, and they have done so for a very long time.", "Along the way they turn wheels and move boats."
WRAPPERS = [
    '<div class="page-with-sidebar">', '<div class="search-page">', '<div class="menu-page">', '<div class="social-feed">', '<div class="share-wrap">', '<div class="alert-content">', '<div id="share">', '<div class="header-image-layout header">',
    '<form id="aspnetForm">', "<div>", '<div class="page-with-sidebar"><div id="c">', '<section class="widget-area">', '<form><div class="nav-wrap">',
]
BESIDE = [
    "", '<div class="sidebar"><p>Elsewhere a storm has come and gone without any harm done.</p></div>', '<div class="comments"><p>I liked this piece a lot, thank you for it.</p></div>', "<footer><p>Copyright 2024 by the people of the river and others.</p></footer>",
    '<div class="menu"><a href="a">One</a> <a href="b">Two</a></div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("beside", BESIDE)
def test_wrappers_with_telling_names_hold_the_page(wrapper, beside):
    """Pages without article or main: what holds most of the words and the title is the page, whatever it is called; what stands beside it, or in it, isn't."""
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))
    main = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
    for page in (f"<body><nav><a href=x>Home</a></nav>{wrapper}{main}{ends}{beside}</body>", f"<body>{beside}{wrapper}{main}{ends}</body>", f"<body>{wrapper}{main}{beside}{ends}</body>"):
        texts, x = html_blocks.blocks(page)
        keep = html_blocks.decide(html_blocks.trained(), x)
        assert [t for t, k in zip(texts, keep, strict=True) if k] == [TITLE, FIRST, SECOND], page
