import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions import web


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


class Reader(HTMLParser):
    """Brute-force text view by parser events."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in tx.HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in tx.LINE_ENDERS.split("|"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", html.unescape(data)).strip())


def brute(source):
    reader = Reader()
    reader.feed(source)
    lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(reader.out).splitlines()]
    return [x for x in lines if x]


PIECES = ["<p>", "</p>", "<br>", "<br/>", "</br>", "<div class='a>b'>", "</div>", "<b>", "</b>", "<li>x", "</li>",
          "a b", " c  d ", " ", "&amp;lt;", "&copy;", "&#233;", "&#x4e2d;", "&#150;", "&eacute;", "&nbsp;", "&hearts;",
          "<!-- n <p> -->", "<script>var a='</p>';</script>", "<style>p{}</style>", "<h1>T</h1>", "\n", "&unknown;", "&copy 5",
          "<noscript>no</noscript>", "é", "<td>1</td>", "<tr>", "</tr>", "5 > 3"]


def test_text_view_against_parser(spark):
    rng = random.Random(7)
    sources = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, html string")
    got = {r.i: list(r.x) for r in rows.select("i", tx.text_lines(F.col("html")).alias("x")).collect()}
    wrong = [(s, got[i], brute(s)) for i, s in enumerate(sources) if got[i] != brute(s)]
    assert not wrong, (len(wrong), wrong[:3])


def test_long_tag_runs_do_not_overflow(spark):
    source = "<p>" + "<br><i></i>" * 50_000 + "end " + "x " * 50_000 + "</p>"
    assert value(spark, F.size(tx.text_lines(F.lit(source)))) == 1


def test_title_and_headings(spark):
    page = ("<title>A &amp;amp; B</title><h1>One</h1><h2><span>no</span></h2><h3>Three<br>lost</h3>"
            "<h1>x<!-- c -->y</h1>")
    assert value(spark, tx.page_title(F.lit(page))) == "A & B"
    assert value(spark, tx.page_headings(F.lit(page))) == ["One", "Three", "x", "y"]


@pytest.mark.parametrize("given, wanted", [
    ("2026年6月8日", "2026-06-08"), (" 2026 / 6 / 18 起", "2026-06-18"), ("发布于20260612。", "2026-06-12"),
    ("2026.13.01", "2026.13.01"), ("2026-00-01 20260612", "2026-00-01 20260612"), ("no  date", "no date"),
    ("2026-02-31", "2026-02-31"), ("", "")])
def test_dates(spark, given, wanted):
    assert value(spark, tx.normalize_date(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("Publish-Date 1", "publish_date_1"), ("价格price", "price"), ("2nd!", "field_2nd"), ("__a--b__", "a_b"), ("价格", None)])
def test_identifiers(spark, given, wanted):
    assert value(spark, tx.field_identifier(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("HTTP://user:pw@Ex.COM:8080/a/b?x=1#f", "http://ex.com:8080/a/b"), ("https://[::1]:9/x", "https://[::1]:9/x"),
    ("https://a.b", "https://a.b"), ("/just/path?q", "/just/path"), ("http://a:99999/", "[invalid-url]"),
    ("http://a:x1/", "[invalid-url]"), ("http://[::1/", "[invalid-url]")])
def test_safe_url(spark, given, wanted):
    assert value(spark, web.safe_url(F.lit(given))) == wanted


def test_redaction_reaches_nested_values(spark):
    tree = F.create_map(F.lit("u"), F.lit("http://me:pw@h/ KEY"))
    assert value(spark, web.redact_map(tree, ["KEY"])) == {"u": "http://[redacted]@h/ [redacted]"}
    assert value(spark, web.redact_list(F.array(F.lit("KEY" * 600)), ["none"])) == [("KEY" * 600)[:1000]]


def test_labels_and_snippets(spark):
    assert value(spark, tx.label_list(F.array(*[F.lit(x) for x in (" a ", "b", "a", " ")]))) == ["a", "b"]
    text = "x" * 100 + "HIT" + "y" * 100
    assert value(spark, tx.snippet(F.lit(text), F.lit(100), F.lit(103))) == "x" * 60 + "HIT" + "y" * 60
    assert value(spark, tx.locate(F.lit("abc"), F.lit("z"))) is None and value(spark, tx.locate(F.lit("abc"), F.lit(""))) == 0
