import html
import re

import pytest

from tidemark.llm.main_text import PIECE, content, extracted, op2_text_ratio
from tests.conftest import SF

LONG = "word " * 60


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\n only &lt;b&gt;", "plain text only <b>"),
        ("<p>One<p>Two <b>bold<br>x", "One\nTwo bold x"),
        ("<article><p>Good &amp; text<div class='cookie-notice'>x</div><p>more</article><p>tail", "Good & text\nmore"),
        ("<article><header><h1>T</h1></header><p>a b\n c</p><ul><li>i1<li>i2</ul><section id='comments'><p>c</p></section></article>", "T\na b c\ni1\ni2"),
        ("<article><p>cut off in the midd &am", "cut off in the midd &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<script>if (a<b) document.write('<p>x</p>')</script><p>y", "y"),
        ("<article><p>AT&T &copy 2020 &#233; &#x2603; &amp;lt;", "AT&T © 2020 é ☃ &lt;"),
        ("<nav>Menu</nav><form><p>Name</p></form><main><p>Body</p></main><aside>Side</aside><footer>F</footer>", "Body"),
        ("<article><p hidden>h</p><p style='display: none'>n</p><p>shown</p><div class='userComments'>no</div></article>", "shown"),
        (f"<div id=menu><a href=x>Home</a></div><div><h1>Title</h1><p>{LONG}</p><p>short.</p><p>{LONG}</p></div><div class=footer>(c)</div>", f"Title\n{LONG.strip()}\nshort.\n{LONG.strip()}"),
        (f"<ul>{'<li><a href=x>link text</a>' * 9}</ul><p>{LONG}</p>", LONG.strip()),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("</p></div>stray<//>", "stray"),
        ("<!-- c --><![CDATA[x]]><?php y ?>z", "z"),
    ],
)
def test_pages(page, text):
    assert content(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>Teaser</p></article><div><h2>Title</h2><p>{LONG}</p><p>short.</p><p>{LONG}</p></div>", f"Teaser\nTitle\n{LONG.strip()}\nshort.\n{LONG.strip()}"),
        (f"<div>{LONG}</div><article>A card.</article><ul>{'<li>x</li>' * 9}</ul>", f"{LONG.strip()}\nA card."),
        (f"<p>Site</p><main><p>{LONG}</p><p>Of.</p></main><p>tail</p>", f"{LONG.strip()}\nOf."),
        (f"<h1>Site</h1><main><p>{LONG}</p></main>", LONG.strip()),
    ],
)
def test_ratio_chooses_outside_the_mark(page, text):
    assert content(page) == text


def page_of(wrapper, more=""):
    return f"<body><{wrapper}><article><h1>T</h1><p>{LONG}</p><p>Of.</p></article></div>{more}<div class='ad'>x</div></body>"


@pytest.mark.parametrize(
    "page",
    [
        *(page_of(f"div class='{c}'") for c in ("layout with-sidebar", "no-sidebar", "overflow-hidden", "post share-enabled", "hasSidebar", "header-story")),
        page_of("div class='header-story'", f"<div id=comments>{f'<p>{LONG}' * 9}</div>"),
        page_of("div class='page'", f"<div id=comments>{f'<article class=comment>{LONG}</article>' * 9}</div>"),
        page_of("div class='page'", f"<div class=sidebar>{f'<p>{LONG}' * 3}</div>"),
        page_of("div class='page'", f"<article class='related card'>{LONG}</article>"),
        page_of("div class='side menu'><div class='popup'"),
        f"<article class='post share-button'><h1>T</h1><p>{LONG}</p><p>Of.</p></article>",
    ],
)
def test_names_are_weighed(page):
    assert content(page) == f"T\n{LONG.strip()}\nOf."


def test_links_inside_an_article_stay():
    refs = "<ul><li><a href=x>One paper</a><li><a href=y>Another</a></ul><p><a href=z>all linked</a></p>"
    assert content(f"<ul><li><a href=x>Home</a></ul><article><p>{LONG}</p>{refs}</article>") == f"{LONG.strip()}\nOne paper\nAnother\nall linked"


def test_pages_of_readers_only_and_names_inside_a_line():
    assert content(f"<div id=comments><article class=comment>{LONG}</article><article class=comment>other</article></div>") == f"{LONG.strip()}\nother"
    assert content("<article><p>one <span class=share>Share</span>two</p><div class=related><p>r</p></div></article>") == "one two"


def test_very_long_block_is_whole():
    body = "long text & " * (PIECE // 4)
    assert content(f"<article><p>{body}</p></article>") == body.strip()


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in op2_text_ratio(spark, SF).collect()}
    for page in pages:
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_nulls_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, None, "a"), (None, "<p>x", None), (None, "<p>x", None)], "page_id long, html string, main_text string")
    assert sorted(map(tuple, extracted(pages).select("html", "main_text").collect()), key=repr) == [("<p>x", "x"), ("<p>x", "x"), (None, "")]
    assert extracted(pages.limit(0)).count() == 0
