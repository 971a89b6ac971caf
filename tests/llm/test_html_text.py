import html
import re

import pytest

from convoy.llm import html_text
from convoy.llm.queries import op3_html_text

LONG = "The river runs to the sea and it is the longest of the rivers that we have in the north of the land. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><br>", ""),
        ("just text", "just text"),
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three</article><footer>f</footer>", "A & B one two three"),
        ("<nav><ul><li><a href='/x'>menu</a></nav><article>x<b>y</b>z</article>", "xyz"),
        ("<article><p>a</p><div class='share-buttons'>tweet</div><p>b</p><section id=comments><p>hi</section></article>", "a b"),
        ("<article>a<script>if (x < 1) { '</p>' }</script>b<!-- <p>no -->c<style>p{}</style></article>", "abc"),
        ("<article>open <p>never closed", "open never closed"),
        ("<article>a &lt;b&gt; &#233; &nbsp; c</article>", "a <b> é c"),
        ("<article><p title='a > b'>x</p> 1 < 2</article>", "x 1 < 2"),
        ("<article><form>name<input></form>t<aside>s</aside></article><div>outside</div>", "t"),
        ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x</p></main>", "T x"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_page_without_article():
    text = LONG.strip()
    page = (
        f"<body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><h2>On rivers</h2><p>{LONG}</p><p>A short line.</p>"
        f"<p>{LONG}</p><p>Copyright 2020 by them, all rights reserved.</p><ul><li><a href=/>Top</a></ul></body>"
    )
    assert html_text.main_text(page) == f"On rivers {text} A short line. {text}"


TEXT = LONG.strip()
NAV = "<ul><li><a href=/>Home</a><li><a href=/n>News</a></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout with-sidebar'><article><p>{LONG}</p></article><div class=sidebar>{LONG}</div></div>",
        f"<article class='post comments-open'><p>{LONG}</p></article>",
        f"<main class='no-sidebar'><p>{LONG}</p></main><footer>{LONG}</footer>",
        f"<form id=aspnetForm><div class=nav>x</div><article><p>{LONG}</p></article></form>",
        f"<form><main><div class='post social'><p>{LONG}</p></div><form>Your name<input></form></main></form>",
        f"<div class='search page'>{NAV}<p>{LONG}</p><div class=comments><p>I like the rivers.</p></div></div>",
        f"<div class=pageHasBanner>{NAV}<p>{LONG}</p></div>",
        f"<article><p>{LONG}</p></article><section class=comments><article class=comment>{LONG * 3}</article></section>",
        f"<article><p>{LONG}</p><article class=comment><p>{LONG * 3}</p></article></article>",
        f"{NAV}<p>{LONG}</p><div class=comments><p>{LONG * 3}</p></div>",
        f"{NAV}<p>{LONG}</p><div class=cookie-notice><p>We and others use the cookies that you have to accept on this "
        "page, and it is for the good of all.</p></div>",
    ],
)
def test_names_of_layouts_do_not_drop_the_page(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize(
    "line",
    ["Copyright law protects the work of authors in most of the states that have signed it.",
     "See <a href=/r>rivers</a> for what they are.", "(c) The third of the points that we make.",
     "The copyright was sold."],
)
def test_short_paragraphs_with_a_link_or_the_word_copyright(line):
    want = re.sub("<[^>]+>", "", line)
    assert html_text.main_text(f"{NAV}<p>{LONG}</p><p>{line}</p><p>{LONG}</p>{NAV}") == f"{TEXT} {want} {TEXT}"


@pytest.mark.parametrize("line", ["© 2020 Them", "Copyright (c) 2019 by them", "(c) 2011 Us", "Them. All rights reserved."])
def test_copyright_lines(line):
    assert html_text.main_text(f"{NAV}<p>{LONG}</p><p>{line}</p>") == TEXT


def test_second_pass():
    t, f, n = True, False, None
    assert html_text.inherited([n, t, n, n, f, n], [False] * 6) == [t, t, t, f, f, f]
    assert html_text.inherited([f, n, n, t], [False, False, False, False]) == [f, f, t, t]
    assert html_text.inherited([f, n, t], [False, True, False]) == [f, t, t]
    assert html_text.inherited([n, n], [False, False]) == [t, t]
    assert html_text.inherited([t, n, n, n, t], [False] * 5) == [t] * 5


def test_very_long_page():
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>")) == 50_000 * 10 - 1
    assert html_text.main_text("<" * 50_000 + "<article>x</article>").endswith("x")


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>x</p>", "old")], "page_id long, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "html", "text"]
    assert [(r.page_id, r.text) for r in got.orderBy("page_id").collect()] == [(1, ""), (2, "x")]
    assert html_text.extract(df.where("false")).count() == 0


def test_query(spark, sf):
    """The made-up pages mark their article; all of its text and nothing else is wanted."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op3_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert r.n_chars == len(r.text)


def test_empty_comments_and_self_closed_elements_hide_nothing_after_them():
    page = "<article><p>one <svg/> two</p><!--><p>three</p><svg class='i'/><p>four</p><!---><p>five</p><!-- a --!><p>six</p></article>"
    assert html_text.main_text(page) == "one two three four five six"
    # A script does not close itself, whatever its tag says.
    assert html_text.main_text("<article><p>a</p><script/>var x</script><p>b</p></article>") == "a b"


def test_links_in_a_marked_article():
    page = (
        "<article><p>Short start.</p><p><a href='/x'>All of this paragraph is one link</a></p><p>" + "the word of it and " * 12
        + "</p><ul><li><a href='/1'>First other page</a></li><li><a href='/2'>Second other page</a></li></ul><p>End.</p></article>"
    )
    text = html_text.main_text(page)
    assert text.startswith("Short start. All of this paragraph is one link the word") and text.endswith("End.")
    assert "other page" not in text


def test_pages_without_their_mark(spark):
    """Density and neighbours alone find the article that the mark tells, but for bare legal lines in it."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) == 250
    decided = 0
    for r in rows:
        known = html_text.main_text(r.html)
        blocks, marked = html_text.blocks_of(re.sub(r"(?i)(</?)(article|main)\b", r"\1div", r.html))
        assert not marked
        decided += sum(html_text.judged(b, False) is None for b in blocks if not b.boiler)
        found = html_text.main_text(re.sub(r"(?i)(</?)(article|main)\b", r"\1div", r.html))
        assert found == known or "All rights reserved." in known, r.page_id
    # The second pass has had much to decide.
    assert decided > 500
