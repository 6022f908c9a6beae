import pytest

from almanac.llm import html_text
from almanac.llm.html_text import main_text

P1 = "The first paragraph of the article is long enough to be told from a menu, and it goes on for a while."
P2 = "A second one says more about the same matter; it too is longer than any line of the frame around it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2><p>Motto</p></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Other</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div><!-- <p>commented</p> -->
@@
<aside><p>Sidebar with quite a lot of text that is not part of the article at all, but long enough to look like it.</p></aside>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2026 Site</footer></body></html>"""


def test_article_and_frame():
    body = f"<article><h1>Head &amp; line</h1><p>{P1}</p><div class='ad'>Buy this now, it is cheap</div><p>Short.</p><ul><li>one <b>bold</b>\n  item<li>two</ul><p>{P2}<br>After a break</p><section id='comments'><h3>Comments</h3><p>I like this article very much, said a reader at some length.</p></section></article>"
    assert main_text(PAGE.replace("@@", body)) == "\n".join(["Head & line", P1, "Short.", "one bold item", "two", P2 + " After a break"])


def test_without_article_element():
    body = f"<div id=content><h1>Title</h1><p>{P1}</p><p>Short.</p><p>{P2}</p></div><div><a href=/a>Link one</a> <a href=/b>Link two</a></div>"
    assert main_text(PAGE.replace("@@", body)) == "\n".join(["Title", P1, "Short.", P2])


def test_references_cut_pages_and_nothing():
    assert main_text("<article><p>a &lt;b&gt; &#233; &eacute; &nbsp;x</p><p>cut &am") == "a <b> é é x\ncut &am"
    assert main_text("<article><p>whole</p><p>cut <a hre") == "whole\ncut"
    assert main_text("<article><p>Some <button>Share</button>text <script>x()</script>here</p></article>") == "Some text here"
    assert main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    for nothing in (None, "", "   ", "<html></html>", "<nav><a href=/>x</a></nav>", "<script>x</script>", "<!-- only -->"):
        assert main_text(nothing) == ""
    assert main_text("plain words without any tag") == "plain words without any tag"
    long = "<article>" + "".join(f"<p>paragraph {i} of many, all kept</p>" for i in range(20_000)) + "</article>"
    assert main_text(long).count("\n") == 19_999


def test_smoothing_and_threshold():
    assert all(abs(x - 3) < 1e-9 for x in html_text.smoothed([3.0] * 5))
    assert 2 < html_text.threshold([1, 1.5, 9, 10]) < 9 and html_text.threshold([4, 4]) == 0


def test_pages(spark):
    rows = [(1, "u", "<article><p>text</p></article>"), (1, "u", "<article><p>text</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<p>\U0001f389 ok</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = sorted(html_text.extract_pages(pages).collect(), key=str)
    assert len(out) == 5 and {(r.page_id, r.text, r.n_chars) for r in out} == {(1, "text", 4), (2, "", 0), (None, "", 0), (3, "\U0001f389 ok", 4)}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


STORY = "<h1>Heading of it</h1><p>A first paragraph, long enough to be read as text.</p><p>Short one.</p><p>And a last paragraph that has some more words in it.</p>"
TOLD = "Heading of it\nA first paragraph, long enough to be read as text.\nShort one.\nAnd a last paragraph that has some more words in it."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Contact us</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout with-sidebar"><article>{s}</article><div class="sidebar">{m}</div></div>',
        '<div class="elementor-widget-container">{s}</div><div class="widget">{m}</div>',
        '<form id="aspnetForm"><div>{m}</div><div>{s}</div></form>',
        "<nav>{m}<article>{s}</article>",
        "<nav>{m}</nav><button>Menu<article>{s}</article>",
        "<article><button>Share{s}</article>",
        "<nav>{m}</nav><main><section>{s}</section><section class=comments><article><p>A reader says something about this.</p></article></section></main>",
        '<div>{m}</div><div class="page no-sidebar post-share"><div>{s}</div></div><footer><p>Imprint</p></footer>',
    ],
)
def test_marks_of_wrappers_and_unclosed_elements_do_not_empty_a_page(page):
    assert main_text("<html><body>" + page.replace("{s}", STORY).replace("{m}", MENU) + "</body></html>") == TOLD
