"""Main texts of pages with known articles, in several shapes, and odd markup."""

import html as entities
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pagewright.llm import html

PARTS = {
    "nav": '<nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></ul></nav>',
    "header": '<header id="top"><div class="logo">Site name</div><form action="/s"><input name=q><button>Go</button></form></header>',
    "side": '<aside><h3>Popular</h3><p>Other story</p></aside><div class="sidebar-2"><p>More side text here</p></div>',
    "ad": '<div class="ad banner"><p>Buy now</p></div><div id="ad-17">Cheap</div><ins class="adsbygoogle">x</ins>',
    "notice": '<div role="alert">Please accept</div><div class="cookie-notice"><p>We use cookies</p></div>',
    "comments": '<section id="comments"><h2>2 comments</h2><div class="comment"><p>First! I liked this very much indeed.</p></div></section>',
    "footer": '<footer>&copy; 2024 <p>Imprint</p></footer>', "script": '<script>if (a < b) { x("</p>"); }</script><style>p > a {}</style>',
}
BODY = ["A title &amp; more", "First para\n with  <b>bold <i>and</i></b> a <a href='#'>link</a>.", "Line one<br>line two&nbsp;end", "x &lt; y &#233; &#x1F642;"]
WANT = "A title & more\n\nFirst para with bold and a link.\n\nLine one line two end\n\nx < y é 🙂"


def page(start, end, close=True):
    p = "".join(f"<p>{b}" + ("</p>" if close else "") for b in BODY[1:])
    q = PARTS
    return (f"<!doctype html><html><head><title>T</title>{q['script']}</head><body>{q['header']}{q['nav']}{q['notice']}<!-- <p>no</p> -->"
            f"{start}<h1>{BODY[0]}</h1>{p}{q['ad']}{end}{q['side']}{q['comments']}{q['footer']}</body></html>")


@pytest.mark.parametrize("start,end", [
    ("<article>", "</article>"), ("<main><article class='post-12'>", "</article></main>"), ('<div class="content">', "</div>"),
    ('<div id="wrap"><div class="entry e7">', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("", "")])
@pytest.mark.parametrize("close", [True, False])
def test_shapes(start, end, close):
    assert html.extract(page(start, end, close), None) == WANT


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "layout-with-sidebar", "page-with-nav",
                                  "search-results", "ad-free", "alert-story"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_wrappers_named_after_what_stands_beside(name, inner):
    assert html.extract(page(f"<div class='{name}'><{inner}>", f"</{inner}></div>"), None) == WANT


LONG_PART = "<p>" + "A sentence of the long part. " * 20 + "</p>"


@pytest.mark.parametrize("source", [
    f"<div class='post'><h1>Title</h1><p>Intro.</p><blockquote>{LONG_PART}</blockquote><p>The end.</p></div>",
    f"<main><h1>Title</h1><p>Intro.</p><section>{LONG_PART}</section><p>The end.</p></main>",
    f"<div class='post'><h1>Title</h1><div><p>Intro.</p></div><p>Intro.</p><div>{LONG_PART}</div><p>The end.</p></div>"])
def test_text_beside_a_heavy_part_stays(source):
    got = html.extract(f"<body><nav><a href='/'>Menu</a></nav>{source}</body>", None)
    assert got.startswith("Title\n\nIntro.") and got.endswith("The end.") and "long part" in got


def test_most_pages_of_a_host_outweigh_a_page(spark):
    text = "<p>" + "A long sentence of the article itself. " * 8 + "</p>"
    usual = "<html><body><div class='story'>{}</div><div class='teasers'><p>{}</p></div></body></html>"
    rows = [(i, "http://one.example/" + str(i), usual.format(text, "Short teaser.")) for i in range(5)]
    rows.append((99, "http://one.example/x", usual.format("<p>Brief story.</p>", "Teaser text. " * 40)))
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got}[99] == "Brief story."


def test_comments_that_are_articles_stay_out():
    comments = "<section id='comments'>" + "<article class='comment'><p>I liked it.</p></article>" * 3 + "</section>"
    story = "<p>" + "A sentence of the story itself. " * 9 + "</p>"
    for start, end in (("<article>", "</article>"), ("<div class='story'>", "</div>")):
        assert "liked" not in html.extract(f"<body>{start}{story}{end}{comments}</body>", None)


def test_header_of_an_article_keeps_its_heading():
    source = "<body><header><h2>Site</h2></header><article><header><h1>Title</h1><p>By me</p></header><p>Text of it.</p></article></body>"
    assert html.extract(source, None) == "Title\n\nText of it."


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("   ", ""), ("just text &amp; no tags", "just text & no tags"), ("<p>cut <b", "cut"),
    ("a < b and c > d", "a < b and c > d"), ("<p>one<p>two<div>three", "one\n\ntwo\n\nthree"), ("</p></div>after", "after"),
    ("<script>never closed <p>x", ""), ('<p title="a > b">q</p>', "q"), ('<p title="open>q</p><p>r</p>', None), ("<!-- open", "")])
def test_odd_markup(source, want):
    got = html.extract(source, None)
    assert want is None or got == want


def test_long_and_deep_pages():
    assert html.extract("<article>" + "<p>word</p>" * 50_000 + "</article>", None) == "\n\n".join(["word"] * 50_000)
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    assert html.extract(deep, None) == "deep"
    assert "q" in html.extract("<p>q</p>" + '<a href="' * 3000, None)


def test_memory_and_time_grow_with_elements_not_with_depth():
    for tag in ("div", "ul><li", "section class='a1 b'"):
        name = re.split(r"[ >]", tag)[0]
        deep = f"<{tag}>" * 100_000 + "<p>deep</p>" + f"</{name}>" * 100_000
        tracemalloc.start()
        assert html.extract(deep, None) == "deep"
        assert tracemalloc.get_traced_memory()[1] < 400 << 20
        tracemalloc.stop()


def test_written_paths_are_found_again():
    page = html.Page("<body><div class='a>b c7'><p>x</p></div><div><section id=s>y</section></div></body>")
    for e in range(1, len(page.tag)):
        assert page.find(page.path_text(e)) == page.path[e]
    assert page.find(">body>div>p") is None and page.path_text(2) == ">body>div.a>b.c#"


@pytest.mark.parametrize("source,want", [
    ("<p>Speed <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is known</p>", "Speed E=m is known"),
    ("<p>So <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> holds</p>", "So x holds"),
    ("<p>A <svg><text>drawn</text></svg>picture <object>old</object>here</p>", "A picture here")])
def test_formulas_and_drawings(source, want):
    assert html.extract(source, None) == want


def test_hosts_agree_on_a_path(spark):
    text = "<p>" + "A long sentence of the article itself. " * 8 + "</p>"
    usual = "<html><body><div class='story'>{}</div><div class='teasers'><p>{}</p></div></body></html>"
    rows = [(i, "http://one.example/" + str(i), usual.format(text, "Short teaser.")) for i in range(30)]
    # Here the teasers are longer than the story; the host's other pages tell which is which.
    rows.append((99, "http://ONE.example/x", usual.format("<p>Brief story.</p>", "Teaser text. " * 40)))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(table).collect()}
    assert got[99] == "Brief story." and got[0].startswith("A long sentence")


@pytest.mark.parametrize("bound", [html.SMALL_SIDE, 0])
def test_given_pages(spark, folder, monkeypatch, bound):
    monkeypatch.setattr(html, "SMALL_SIDE", bound)
    table = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r for r in html.main_text(table.withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "::::", None), (2, "http://x", "")]
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
