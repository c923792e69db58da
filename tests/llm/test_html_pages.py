"""Pages written by hand, and markup that must not take more than linear time."""

import time

import pytest

from tidycell.llm import html_text

#: Pages with their article, as a reader sees it.
BY_HAND = [
    ("""<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Harbour reopens</title></head><body>
<div id="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>
<nav><ul><li><a href="/">Home</a><li><a href="/news">News</a><li><a href="/sport">Sport</a></ul></nav>
<main><article><h1>Harbour reopens after repairs</h1>
<p>The old harbour was opened again on Monday, after two years of repairs to its walls &amp; gates.
<p>Boats may enter from six in the morning. "It is a good day," said the harbour master.</p>
<aside class="ad"><p>Advertisement: buy a boat</p></aside>
<p>The repairs cost less than was planned, and the walls should last for fifty years.</p></article></main>
<section class="comments"><h3>Comments</h3><ul><li><p>Great news for the town!</p></li></ul></section>
<footer><p>&copy; 2024 The Town Paper</p><a href="/imprint">Imprint</a></footer></body></html>""",
     "Harbour reopens after repairs The old harbour was opened again on Monday, after two years of repairs to its walls & gates. "
     "Boats may enter from six in the morning. \"It is a good day,\" said the harbour master. "
     "The repairs cost less than was planned, and the walls should last for fifty years."),
    ("""<body><header class="site-header"><a href="/">A walker's log</a></header>
<article class="box hidden md:block" title="the hidden valley"><h1>The hidden valley</h1><p>We set out before the sun was up, and the path was wet from the night.</p>
<p>At noon we came to a valley that is on no map of the region. There we ate our bread.</p>
<script>document.write("<p>not text</p>")</script></article>
<aside class="sidebar"><h3>More walks</h3><ul><li><a href="/1">The ridge</a></li><li><a href="/2">The lake</a></li></ul></aside>
<footer>© A walker</footer>""",
     "The hidden valley We set out before the sun was up, and the path was wet from the night. At noon we came to a valley that is on no map of the region. There we ate our bread."),
]


@pytest.fixture(scope="module")
def field(spark, sf):
    return html_text.train(spark.read.parquet(f"{sf}/pages.parquet"))


@pytest.mark.parametrize("page,article", BY_HAND)
def test_article_of_pages_written_by_hand(field, page, article):
    assert html_text.text_of(page, field) == article


def test_hidden_is_told_by_attribute_names_and_drops_nothing():
    for page, said in [
        ('<article title="the hidden city"><p>one</p></article>', False), ('<article class="box hidden md:block"><p>one</p></article>', False),
        ("<p data-x='a hidden b'>one", False), ("<p hidden>one", True), ('<div hidden="until-found"><p>one</p></div>', True),
        ('<p style="color:red; display : none">one', True), ('<p aria-hidden="true">one', True), ('<p aria-hidden="false">one', False),
    ]:
        (text, path, _), = html_text.blocks(page)
        assert text == "one" and ("hidden" in path) == said


@pytest.mark.parametrize("page", [
    "<a " * 330_000, "<a '>'" * 170_000, '<a "' * 250_000, "<div>x" * 170_000, "<b>x<br>" * 125_000, "<i>" * 80_000 + "<b>" * 80_000 + "</i>x<br>" * 80_000,
    "<div>" * 90_000 + "</p>x" * 90_000, "<p " + "a" * 1_000_000 + ">x", "<button>x" * 100_000, "<" * 1_000_000, "<table><tr><td>x" * 60_000,
    "".join(f'<div class="{"".join(chr(97 + int(c)) for c in str(i))}">x' for i in range(40_000)),
], ids=lambda p: p[:8])
def test_a_megabyte_of_any_markup_takes_seconds(field, page):
    start = time.process_time()
    html_text.text_of(page, field)
    assert time.process_time() - start < 30  # some two seconds; hours where time grows with the square


def test_tags_that_quotation_marks_leave_open():
    texts = lambda page: [b[0] for b in html_text.blocks(page)]
    assert texts('<p title="a > b">one</p>two') == ["one", "two"]
    assert texts("<p title='a>one</p>two") == ["one", "two"]  # never closed
    assert texts("<p class='x'>one<a href='y'>two</a> <a") == ["onetwo"]
    assert texts("<p x='>' y='>' ") == ["' y='>'"]  # closed quotations hold every >


def test_paths_of_elements_that_end_out_of_order():
    found = [(t, sorted(p)) for t, p, _ in html_text.blocks('<nav><b class="x"><i>one</b></i><p>two</nav>three<div class=x><div class=x>four</div>five</div>six')]
    assert found == [("one", ["tag:nav"]), ("two", ["tag:nav", "tag:p"]), ("three", []), ("four", ["name:x"]), ("five", ["name:x"]), ("six", [])]
