import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.operators import body, dom, intent, noise, quality, selectors, signature, specs, views
from pagewright.plans import all_oracles, all_queries


def trees(spark, *sources):
    return dom.page_trees(spark.createDataFrame(list(enumerate(sources)), "page_id bigint, html string"))


def nodes(spark, source):
    return dom.node_table(trees(spark, source)).orderBy("id").collect()


def select(spark, source, strategy, selector, attribute=None):
    found = selectors.matches(F.col("nodes"), F.col("tokens"), selectors.parse_selector(F.lit(strategy), F.lit(selector)),
                              F.lit(attribute).cast("string"))
    row = trees(spark, source).select(found.alias("m"), selectors.outcome(found).alias("o")).first()
    return row.o, None if row.m is None else [x["value"] for x in row.m]


def test_tag_soup_recovery(spark):
    tags = [(n.tag, n.parent, n.text) for n in nodes(spark, "<p><b>Title.<br><p>One<ul><li>a<li>b</ul>tail")]
    assert [t[0] for t in tags] == ["html", "body", "p", "b", "br", "p", "ul", "li", "li"]
    assert tags[3][2] == "Title." and tags[5][2] == "One" and [t[2] for t in tags[7:]] == ["a", "b"]
    assert tags[1][2] == "Title. One a b tail"


def test_hidden_elements_go_and_their_tails_stay(spark):
    rows = nodes(spark, "<div>a<script>var x='</p>'</script>b<!-- c -->d<style>p{}</style></div>")
    assert [n.tag for n in rows] == ["html", "body", "div"] and rows[2].text == "ab d"


def test_tables_and_misnested_ends(spark):
    rows = nodes(spark, "<table><tr><td>1<td>2</div><tr><td>3</table></p>x")
    assert [n.tag for n in rows] == ["html", "body", "table", "tr", "td", "td", "tr", "td"]
    assert [n.text for n in rows if n.tag == "td"] == ["1", "2", "3"]


def test_intervals_are_nested(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    trees = dom.page_trees(pages)
    table = trees.select("page_id", F.explode(F.transform("nodes", lambda n: F.struct(
        n["id"], n["last"], dom.chain_of(n, F.col("nodes")).alias("chain")))).alias("n")).select("page_id", "n.*")
    bad = table.alias("a").join(table.alias("b"), "page_id").filter(
        "b.id > a.id and b.id <= a.last and (b.last > a.last or not array_contains(b.chain, a.id))")
    assert bad.count() == 0


@pytest.mark.parametrize("strategy, selector, attribute, outcome, values", [
    ("css", "h1", None, "success", ["Title"]), ("css", "p", None, "ambiguous_matches", ["A", "B"]),
    ("css", ".absent", None, "no_matches", []), ("css", "h2", None, "empty_value", [""]),
    ("xpath", "count(//h1)", None, "invalid_selector", None), ("css", "p < x", None, "invalid_selector", None),
    ("css", "div.a > p:nth-of-type(2)", None, "success", ["B"]), ("css", "*[class*='a'] h1", None, "success", ["Title"]),
    ("css", "#x", "data-k", "success", ["v"]), ("css", "h1, h2", None, "ambiguous_matches", ["Title", ""]),
    ("xpath", "//div[@class='a']/p[1]", None, "success", ["A"]), ("xpath", "//p[contains(@class,'q')]/@class", None, "success", ["q r"]),
    ("xpath", "//head/title/text()", None, "success", ["Site"]), ("xpath", "//*[@id or @data-k]", None, "success", ["Title"]),
    ("css", "p.q.r", None, "success", ["B"]), ("css", "body p[class~='r']", None, "success", ["B"]),
    ("xpath", "//body//h1|//h1", None, "success", ["Title"]), ("css", "[id]", None, "success", ["Title"])])
def test_selectors(spark, strategy, selector, attribute, outcome, values):
    page = ("<html><head><title>Site</title></head><body><div class='a'><h1 id='x' data-k='v'>Title</h1><h2></h2>"
            "<p>A</p><p class='q r'>B</p></div></body></html>")
    assert select(spark, page, strategy, selector, attribute) == (outcome, values)


def test_child_and_descendant_mix_needs_backtracking(spark):
    page = "<div class='x'><section><div class='x'><i><b>hit</b></i></div></section></div><div class='x'><b>no</b></div>"
    assert select(spark, page, "css", ".x > section b")[1] == ["hit"]
    assert select(spark, page, "css", "body > .x i > b")[1] == ["hit"]


def test_blocks_select_themselves(spark):
    page = "<ul><li>a<br>b</li><li><p>c</p></li></ul><table><tr><th>h</th><td><p>d</p></td></tr></table><p> </p>"
    t = trees(spark, page)
    blocks = views.text_blocks(F.col("nodes"), F.col("tokens"))
    got = t.select(F.inline(blocks)).collect()
    assert [(b.tag, b.text) for b in got] == [("li", "a b"), ("li", "c"), ("th", "h"), ("td", "d")]
    again = F.transform(blocks, lambda b: F.struct(
        selectors.matches(F.col("nodes"), F.col("tokens"), selectors.css_selector(b["selector"]), F.lit(None).cast("string"))["value"],
        selectors.matches(F.col("nodes"), F.col("tokens"), selectors.xpath_selector(b["xpath"]), F.lit(None).cast("string"))["value"],
        b["text"]))
    for css, xpath, text in t.select(again.alias("x")).first().x:
        assert css == [text] and xpath == [text]
    assert t.select(F.size(views.text_blocks(F.col("nodes"), F.col("tokens"), 2))).first()[0] == 2
    assert trees(spark, "").select(F.size(blocks)).first()[0] == 0


RESOURCE = ("<html><body><nav><a>x</a></nav><main><h1>Name</h1><div class='meta'><span class='author'>me</span><time>now</time></div>"
            "<article><p>First long paragraph here.</p><p>Second long paragraph.</p></article></main><aside><p>side</p></aside></body></html>")
HOME = "<main><h1>Home</h1><ul><li>one item</li><li>two item</li><li>three item</li></ul></main>"
LISTING = "<main><h1>List</h1>" + "<section class='card'>Some card text</section>" * 3 + "</main>"


def test_intents(spark):
    rows = [r.intent for r in intent.assess_intent(trees(spark, RESOURCE, HOME, LISTING, "<p>x</p>"), "single_resource")
            .orderBy("page_id").select("intent").collect()]
    assert rows[0].intent == "article" and rows[0].confidence > 0.5 and "unique_primary_heading" in rows[0].signals
    assert "detail_metadata" in rows[0].signals and rows[0].gate_passed
    assert rows[1].intent in ("home", "list") and rows[2].intent == "list"
    assert not rows[2].gate_passed and rows[2].reasons == ["page_intent_mismatch"]
    assert rows[3].intent == "unknown" and rows[3].reasons == ["page_intent_low_confidence"]
    # Nested text counts at every level here, once there.
    assert rows[3].visible_text_chars == 5 and rows[3].distinct_text_chars == 1


def pick(spark, page):
    return body.select_body(trees(spark, page)).select("body.*").first()


def test_body_prefers_the_article_over_a_summary(spark):
    got = pick(spark, "<div class='summary'>Short teaser.</div><article class='content'>" + "<p>Long body text number one.</p>" * 3 + "</article>")
    assert got.accepted and got.visible_text_coverage > 0.5 and got.rejected_reasons == []
    assert got.candidates[0].selector == "article.content" and "teaser" not in got.text


def test_body_merges_neighbouring_regions_in_order(spark):
    got = pick(spark, "<body><nav>menu</nav><main><div class='content'><p>Alpha region text that is long.</p></div>"
               "<div class='content'><p>Beta region text that is long.</p></div></main><aside>sidebar words</aside><footer>f</footer></body>")
    assert got.accepted and got.merged_candidate_count == 2 and got.noise_ratio < 0.35
    assert got.text.index("Alpha") < got.text.index("Beta") and "sidebar" not in got.text


def test_body_drops_noise_inside_the_article(spark):
    got = pick(spark, "<article class='content'><p>Real article text that stays in place.</p><div class='notice'>warn</div>"
               "<table class='infobox'><tr><td>facts</td></tr></table><div class='toc'>toc words</div></article>")
    assert got.accepted and got.text == "Real article text that stays in place." and got.noise_ratio > 0


def test_body_falls_back_to_the_page_or_rejects(spark):
    assert pick(spark, "<body><p>Only a plain paragraph.</p></body>").candidates[0].selector == "body"
    assert pick(spark, "<body><nav>menu</nav></body>").rejected_reasons == ["no_body_candidates"]
    assert pick(spark, "<article><p>tiny</p></article>").rejected_reasons == ["body_text_too_short"]


def test_body_wrapper_replaces_a_small_leaf(spark):
    leaf = "<div class='entry'><p>" + "leaf words " * 3 + "</p></div>"
    got = pick(spark, "<article>" + "<p>outer text</p>" * 40 + leaf + "</article>")
    assert [c.selector for c in got.candidates] == ["article"] and got.candidate_count == 2


BASE = dict(signature_version="1", page_intent="single_resource", title_shape=["h1"], content_shape=["main", "article"],
            heading_count=3, text_block_count=12, repeated_item_ratio=0.05, selector_match_counts={"title": 1, "body": 1},
            body_visible_text_coverage=0.86, body_continuity_score=0.9, body_noise_ratio=0.08)


@pytest.mark.parametrize("change, strict, status, reasons", [
    ({}, False, "compatible", []),
    (dict(page_intent="list", title_shape=["h2"], repeated_item_ratio=0.9), False, "incompatible",
     ["page_intent_mismatch", "title_shape_mismatch", "repeated_item_ratio_out_of_range"]),
    (dict(body_visible_text_coverage=None), False, "unknown", ["missing_body_coverage"]),
    (dict(selector_match_counts={"title": 1}), False, "compatible", []),
    (dict(selector_match_counts={"title": 1}), True, "incompatible", ["missing_selector_match:body"]),
    (dict(selector_match_counts={"title": 2, "body": 1}), False, "incompatible", ["selector_match_mismatch:title"])])
def test_signature_comparison(spark, change, strict, status, reasons):
    rows = spark.createDataFrame([(BASE, {**BASE, **change})], f"e {signature.SIGNATURE_TYPE}, a {signature.SIGNATURE_TYPE}")
    got = rows.select(signature.compare(F.col("e"), F.col("a"), strict).alias("c")).first().c
    assert (got.status, got.reasons) == (status, reasons)


def test_rule_validation_cases(spark):
    page = ("<html><head><title>Site</title></head><body class='content'><h1>Title</h1><h2></h2><p>A</p><p>B</p>"
            "<time datetime='2026-10-09'>Today</time></body></html>")
    cases = [("css", "html > body.content", None), ("xpath", "//head/title/text()", None), ("xpath", "//body[@class='content']/@class", None),
             ("xpath", "count(//h1)", None), ("css", ".absent", None), ("css", "h2", None), ("css", "p", None), ("css", "time", "datetime")]
    rules = F.array(*[specs._rule(f"f{i}", s, selector=x, attribute=a) for i, (s, x, a) in enumerate(cases)])
    got = body.select_body(trees(spark, page)).select(quality.check_rules(
        rules, F.col("nodes"), F.col("tokens"), F.col("body")).alias("c")).first().c
    assert [d.reason for d in got.diagnostics] == ["document_scope"] * 3 + [
        "invalid_selector", "no_matches", "empty_value", "ambiguous_matches"]
    assert [r.selector for r in got.rules] == ["time"]


def test_incomplete_body_rule_is_replaced(spark):
    page = "<div class='summary'>Short.</div><article class='content'>" + "<p>Long body text number one.</p>" * 3 + "</article>"
    rows = body.select_body(trees(spark, page)).withColumn("rules", F.array(specs._rule("content", "css", selector=".summary"))) \
        .withColumn("fields", F.array(F.struct(F.lit("content").alias("name"))))
    got = quality.fit_programs(rows).first()
    assert [d.reason for d in got.diagnostics] == ["body_incomplete"]
    assert [r.selector for r in got.rules] == ["article.content"]


def test_suggestions_rank_telling_unique_short(spark):
    page = ("<div class='x'>aa</div><div class='x'>bb</div><p id='t1'>cc</p><h2 class='title big wide'>dd</h2>"
            "<nav><i class='n'>z</i></nav><div class=''>e</div>")
    got = trees(spark, page).select(F.inline(views.selector_suggestions(F.col("nodes"), F.col("tokens")))).collect()
    assert [(r.selector, r.match_count) for r in got] == [("h2.title.big", 1), ("p#t1", 1), ("div.x", 2)]


def test_partitioning_does_not_matter(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    def digest(n):
        t = signature.page_signatures(body.select_body(intent.assess_intent(dom.page_trees(pages.repartition(n)))))
        return t.agg(F.sum(F.xxhash64("structure.page_intent", "body.text", "intent.confidence").cast("decimal(38,0)"))).first()[0]
    assert digest(1) == digest(8)


def test_deep_page_takes_linear_memory(spark):
    html = "<div>" * 20_000 + "<p class='x'>end</p>"
    rows = dom.page_trees(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = rows.select(F.size("nodes").alias("n"), F.element_at("nodes", -1).alias("p")).first()
    assert (got.n, got.p.depth, got.p.tag) == (20_003, 20_002, "p")
    up = dom.nearest_above(F.col("nodes"), lambda a: a["tag"] == "body")
    assert rows.select(F.element_at(up, -1)).first()[0] == 1


def random_page(rng, size):
    out, open_ = [], []
    for i in range(size):
        while open_ and rng.random() < 0.35:
            out.append(f"</{open_.pop()}>")
        tag = rng.choice(["div", "section", "span"])
        out.append(f"<{tag} class='{rng.choice('ab')}' id='{rng.choice('xyz')}{i % 3}'>t{i}")
        open_.append(tag)
    return "<body>" + "".join(out)


def test_nearest_marked_ancestors_like_a_plain_walk(spark):
    rng = random.Random(5)
    pages = trees(spark, *[random_page(rng, n) for n in (1, 2, 3, 8, 17, 64, 300)])
    near = dom.nearest_above(F.col("nodes"), lambda a: (a["tag"] == "section") & (a["class_attr"] == "a"))
    for row in pages.select("nodes", near.alias("near")).collect():
        for n, got in zip(row.nodes, row.near):
            at = n.parent
            while at >= 0 and (row.nodes[at].tag, row.nodes[at].class_attr) != ("section", "a"):
                at = row.nodes[at].parent
            assert got == at


@pytest.mark.parametrize("selector,steps", [
    ("div div", [(" ", "div", ""), (" ", "div", "")]), ("div > div", [(" ", "div", ""), (">", "div", "")]),
    ("section div.a > span", [(" ", "section", ""), (" ", "div", "a"), (">", "span", "")]),
    ("div.a > section span.b div", [(" ", "div", "a"), (">", "section", ""), (" ", "span", "b"), (" ", "div", "")]),
    ("html > body div > div > div", [(" ", "html", ""), (">", "body", ""), (" ", "div", ""), (">", "div", ""), (">", "div", "")])])
def test_selection_like_a_plain_search(spark, selector, steps):
    rng = random.Random(7)
    parsed = selectors.parse_selector(F.lit("css"), F.lit(selector))
    found = selectors.select_nodes(F.col("nodes"), F.get(parsed, F.lit(0))["steps"])["id"]
    hits = 0
    for row in trees(spark, *[random_page(rng, n) for n in (5, 40, 200)]).select("nodes", found.alias("found")).collect():
        def fits(n, at):
            gap, tag, name = steps[at]
            if n.tag != tag or name and n.class_attr != name:
                return False
            if at == 0:
                return True
            up = n.parent
            while up >= 0:
                if fits(row.nodes[up], at - 1):
                    return True
                if gap == ">":
                    return False
                up = row.nodes[up].parent
            return False

        want = [n.id for n in row.nodes if fits(n, len(steps) - 1)]
        assert row.found == want
        hits += len(want)
    assert hits


def test_deep_pages_take_linear_time(spark):
    """Twenty thousand nested elements: selection, blocks, intent, noise and focus in seconds."""
    deep = trees(spark, "<div>" * 20_000 + "<p>deep</p>")
    cols = F.col("nodes"), F.col("tokens")
    parsed = selectors.parse_selector(F.lit("css"), F.lit("div div"))
    start = time.monotonic()
    row = deep.select(
        F.size(selectors.select_nodes(cols[0], F.get(parsed, F.lit(0))["steps"])).alias("hits"),
        views.text_blocks(*cols).alias("blocks"), views.focus_region(*cols).alias("focus"),
        F.size(noise.noise_depth(cols[0])["above"]).alias("above")).first()
    assert row.hits == 19_999 and row.focus == "deep"
    assert row.blocks[0].text == "deep" and row.blocks[0].xpath == "/html/body" + "/div" * 20_000 + "/p"
    assert intent.assess_intent(deep).select("intent.intent").first()[0]
    assert time.monotonic() - start < 60


def test_suggestions_equal_a_plain_count(spark):
    """Counts and first elements of random pages against a scan of every element for every selector."""
    rng = random.Random(5)
    sources = []
    for _ in range(12):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            tag = rng.choice(["div", "p", "h2", "nav", "section"])
            names = " ".join(rng.choice(["a", "b", "c", "title", "a"]) for _ in range(rng.randrange(0, 4)))
            own = f" id='{rng.choice(['x', 'y', 'Z'])}'" if rng.random() < 0.2 else ""
            parts.append(f"<{tag} class='{names}'{own}>{rng.choice(['', 'text', 'longer text ' * 30])}" + rng.choice(["", f"</{tag}>"]))
        sources.append("".join(parts))
    rows = trees(spark, *sources).select("nodes", "tokens", views.selector_suggestions(
        F.col("nodes"), F.col("tokens"), 10_000).alias("found")).collect()
    for row in rows:
        want = {}
        for n in row.nodes:
            up, chrome = n.parent, False
            while up >= 0:
                chrome, up = chrome or row.nodes[up].tag in views.CHROME_TAGS, row.nodes[up].parent
            own = n.class_attr.split()
            if chrome or not n.chars or n.tag in ("html", "body", *views.CHROME_TAGS) or not (n.id_attr or own):
                continue
            name = f"{n.tag}#{n.id_attr}" if n.id_attr else f"{n.tag}." + ".".join(own[:2])
            if name not in want:
                same = [m for m in row.nodes if m.tag == n.tag and (
                    m.id_attr == n.id_attr if n.id_attr else set(own[:2]) <= set(m.class_attr.split()))]
                text = " ".join(t.text for t in row.tokens[n.tok_from:n.tok_to])[:240]
                dull = not any(w in name.lower() for w in views.TELLING_WORDS)
                want[name] = (dull, len(same) != 1, len(text), n.id, name, len(same), text)
        assert [(f.selector, f.match_count, f.text_sample) for f in row.found] == [w[4:] for w in sorted(want.values())]
    assert any(f.match_count > 1 for row in rows for f in row.found)


def test_suggestions_of_large_pages_take_linear_time(spark):
    """Twenty thousand elements that share one class and have another of their own."""
    page = trees(spark, "".join(f"<div class='item n{i}'>t{i}</div>" for i in range(20_000)) + "<div>" * 5_000 + "<p id='title'>end")
    start = time.monotonic()
    found = page.select(views.selector_suggestions(F.col("nodes"), F.col("tokens")).alias("s")).first().s
    assert [(f.selector, f.match_count) for f in found[:2]] == [("p#title", 1), ("div.item.n0", 1)] and len(found) == 45
    assert time.monotonic() - start < 60


def test_focus_markup(spark):
    """Chrome goes, its tail stays, text is escaped, void elements have no end, the region brings its tail."""
    def markup(source, limit=16000):
        return trees(spark, source).select(views.focus_markup(F.col("nodes"), F.col("tokens"), limit)).first()[0]

    assert markup("<p>a <b>b</b>c</p>") == "<html><body><p>a <b>b</b> c</p></body></html>"
    assert markup("<nav><main>no</main></nav><main class='x &amp; y'><h1>T &lt; 1</h1><nav>n<i>m</i></nav>tail<p>one<br>two<p></main>after"
                  "<footer>f</footer>more<p>end") == (
        '<main class="x &amp; y"><h1>T &lt; 1</h1> tail <p>one <br> two</p><p></p></main> after  more ')
    assert markup("<article>" + "<div>" * 3 + "<p id='a'>x</p>" + "</div>" * 3 + "<i></i><u></u></article>") == (
        '<article><div><div><div><p id="a">x</p></div></div></div><i></i><u></u></article>')
    assert markup("<article><p>abc", 12) == "<article><p>" and markup("") == "" and markup("text") == (
        "<html><body><p>text</p></body></html>")
    start = time.monotonic()
    deep = markup("<div>" * 20_000 + "<p>deep", 1 << 20)
    assert deep.count("</div>") == 20_000 and deep.endswith("</html>") and time.monotonic() - start < 60


def test_path_of_every_block_is_tried(spark, tmp_path):
    """A page of more blocks than a table of blocks shows; the paragraphs are those of the SQL twin."""
    many = "".join(f"<p>Text {i} of {i % 7}.</p>" for i in range(450))
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul></nav><article><h1>T</h1>{many}</article></body></html>"
    spark.createDataFrame([(1, "http://a.b/c", page), (2, "http://a.b/d", page.replace(many, "<p>One.</p><p>Two.</p>"))],
                          "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(all_oracles()["block_path_roundtrip"]).fetchall()
    got = all_queries()["block_path_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 452
