"""Queries over the ``pages`` table: views, trees, intent, body, signatures, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import unfold
from ..functions import text as tx
from ..functions import web
from ..operators import body, collection, dom, intent, selectors, signature, views
from ..session import shared_folder
from ..sources.files import read_page_files, write_page_files
from ..sources.tables import spread, supplied_pages, table
from . import sql
from .registry import query


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"), "html")


def viewed(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).withColumn("lines", tx.lines_of("html")) \
        .withColumn("text", tx.join_lines(F.col("lines")))


def trees(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return dom.page_trees(pages(spark, folder), ("page_id", *keep))


def big(name: str):
    return F.col(name).cast("bigint").alias(name.split(".")[-1])


@query(f"WITH {sql.TEXT} SELECT page_id, len(lines) AS line_count, txt AS text FROM view")
def page_text_view(spark, folder):
    return viewed(spark, folder).select("page_id", F.size("lines").cast("bigint").alias("line_count"), "text")


@query(f"WITH {sql.TEXT} SELECT page_id, n AS line_no, lines[n] AS line "
       "FROM view, unnest(range(1,len(lines)+1)) AS t(n)")
def page_lines(spark, folder):
    return unfold(viewed(spark, folder), ["page_id"], F.col("lines"), "line", "p").select(
        "page_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


@query(rf"""SELECT page_id,
  {sql.collapse(sql.entities(sql.entities("regexp_extract(html,'(?s)<title>(.*?)</title>',1)")))} AS title,
  array_to_string(list_filter(list_transform(regexp_extract_all(html,'<h[123]>([^<]+)',1),
    lambda c: {sql.collapse(sql.entities(sql.entities("c")))}), lambda c: c<>''),'|') AS headings FROM pages""")
def page_titles_headings(spark, folder):
    return pages(spark, folder).select(
        "page_id", tx.title_of("html").alias("title"),
        F.array_join(tx.headings_of("html"), "|").alias("headings"))


@query(r"""SELECT page_id, sha256(html) AS page_hash, regexp_extract(url,'^(https?)://',1)||'://'||
  lower(regexp_extract(url,'^https?://([^/?#]*)',1))||regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1) AS safe_url
  FROM pages""")
def page_fingerprint_safe_url(spark, folder):
    return pages(spark, folder).select("page_id", web.fingerprint(F.col("html")).alias("page_hash"),
                                       web.safe_url(F.col("url")).alias("safe_url"))


# Statuses stand in for a crawl log: they are derived from the page id.
_STATUS = "CASE page_id%7 WHEN 0 THEN 403 WHEN 1 THEN 500 WHEN 2 THEN NULL ELSE 200 END"
_CLASS = f"""CASE WHEN {_STATUS} IN (401,403,429,468) THEN 'access_limited' WHEN {_STATUS}>=400 THEN 'server_error'
  WHEN trim(txt)='' THEN 'empty_page' WHEN {_STATUS} IS NULL THEN 'unknown' ELSE 'usable_content' END"""


def _classified(spark, folder):
    return collection.classify_pages(viewed(spark, folder).withColumn("status_code", F.expr(_STATUS)))


@query(f"""WITH {sql.TEXT} SELECT page_id, {_CLASS} AS classification, CASE {_CLASS}
  WHEN 'access_limited' THEN 'http_'||({_STATUS}) WHEN 'server_error' THEN 'http_'||({_STATUS})
  WHEN 'empty_page' THEN 'empty_visible_text' WHEN 'unknown' THEN 'missing_http_response' END AS signal FROM view""")
def page_classification(spark, folder):
    return _classified(spark, folder).select("page_id", "classification", "signal")


@query(f"""WITH {sql.TEXT} SELECT {_CLASS} AS classification, {_CLASS}='usable_content' AS kept, count(*) AS pages
  FROM view GROUP BY 1,2""")
def usable_and_rejected_pages(spark, folder):
    """Both sides of the gate in one pass over the pages."""
    rows = _classified(spark, folder).withColumn("kept", collection.is_usable())
    return rows.groupBy("classification", "kept").agg(F.count("*").alias("pages"))


_ATTEMPTS = """attempts AS (
  SELECT page_id, 1 AS attempt_no, 'rendered' AS collector,
    CASE page_id%4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE NULL END AS http_status,
    CASE page_id%4 WHEN 0 THEN 'usable_content' WHEN 1 THEN 'access_limited' WHEN 2 THEN 'server_error'
      ELSE 'network_error' END AS classification,
    CASE page_id%4 WHEN 3 THEN 'timeout' END AS error_message FROM pages
  UNION ALL SELECT page_id, 2, 'http_fallback', CASE page_id%3 WHEN 0 THEN 200 ELSE 404 END,
    CASE page_id%3 WHEN 0 THEN 'usable_content' WHEN 1 THEN 'server_error' ELSE 'empty_page' END, NULL FROM pages)"""


def _attempts(spark, folder):
    ids = pages(spark, folder).select("page_id")
    first = ids.selectExpr(
        "page_id", "1 AS attempt_no", "'rendered' AS collector",
        "CASE page_id%4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 500 END AS http_status",
        "CASE page_id%4 WHEN 0 THEN 'usable_content' WHEN 1 THEN 'access_limited' WHEN 2 THEN 'server_error' "
        "ELSE 'network_error' END AS classification", "CASE page_id%4 WHEN 3 THEN 'timeout' END AS error_message")
    second = ids.selectExpr(
        "page_id", "2 AS attempt_no", "'http_fallback' AS collector",
        "CASE page_id%3 WHEN 0 THEN 200 ELSE 404 END AS http_status",
        "CASE page_id%3 WHEN 0 THEN 'usable_content' WHEN 1 THEN 'server_error' ELSE 'empty_page' END "
        "AS classification", "CAST(NULL AS STRING) AS error_message")
    return first.unionByName(second)


@query(f"""WITH {_ATTEMPTS}, walked AS (SELECT *, coalesce(bool_or(classification='access_limited') OVER (
    PARTITION BY page_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),false) AS barred
  FROM attempts)
  SELECT page_id, coalesce(bool_or(classification='usable_content' AND NOT barred),false) AS collected,
    CAST(min(attempt_no) FILTER (classification='usable_content' AND NOT barred) AS BIGINT) AS attempt_no,
    arg_min(collector, attempt_no) FILTER (classification='usable_content' AND NOT barred) AS collector
  FROM walked GROUP BY page_id""")
def resolved_attempts(spark, folder):
    return collection.resolve_attempts(_attempts(spark, folder)).select(
        "page_id", "collected", big("attempt_no"), "collector")


@query(f"""WITH {_ATTEMPTS}, lim AS (SELECT page_id, min(attempt_no) FILTER (classification='access_limited') AS cut,
    min(attempt_no) FILTER (classification='usable_content') AS won FROM attempts GROUP BY 1)
  SELECT a.page_id, 'page collection failed; attempts: '||string_agg(collector||': HTTP '||
    coalesce(CAST(http_status AS VARCHAR),'None')||', '||classification||': '||coalesce(error_message,
    CASE classification WHEN 'empty_page' THEN 'empty visible text' ELSE '' END),' | ' ORDER BY attempt_no) AS reason
  FROM attempts a JOIN lim USING (page_id)
  WHERE (won IS NULL OR won>cut) AND (cut IS NULL OR attempt_no<=cut) GROUP BY 1""")
def collection_failure_reasons(spark, folder):
    return collection.failure_reasons(_attempts(spark, folder))


@query("SELECT page_id, 200::BIGINT AS status_code, length(trim(html)) AS chars FROM pages WHERE trim(html)<>''")
def supplied_page_scan(spark, folder):
    return supplied_pages(pages(spark, folder)).select(
        "page_id", big("status_code"), F.length("html").cast("bigint").alias("chars"))


@query("SELECT CAST(page_id AS VARCHAR) AS item_id, octet_length(encode(html)) AS bytes, sha256(html) AS page_hash FROM pages")
def page_file_scan(spark, folder):
    """All pages written as files by tasks, then read back from their folder."""
    place = shared_folder(spark, "page-files")
    rows = pages(spark, folder).select(F.col("page_id").cast("string").alias("item_id"), "html")
    write_page_files(rows, place).write.format("noop").mode("overwrite").save()
    return read_page_files(spark, place).select("item_id", "bytes", web.fingerprint(F.col("html")).alias("page_hash"))


_HOST = "lower(regexp_extract(url,'^https?://([^/?#]*)',1))"


@query(f"""WITH {sql.TEXT}, f AS (SELECT page_id, txt, {_HOST} AS host, strpos(txt,{_HOST})-1 AS p FROM view)
  SELECT page_id, host, CASE WHEN p>=0 THEN p END AS start_char, CASE WHEN p>=0 THEN p+length(host) END AS end_char,
    CASE WHEN p>=0 THEN {sql.collapse("substring(txt,greatest(0,p-60)+1,least(length(txt),p+length(host)+60)-greatest(0,p-60))")}
    END AS snippet FROM f""")
def evidence_offsets(spark, folder):
    rows = viewed(spark, folder).withColumn("host", web.host(F.col("url"))) \
        .withColumn("at", tx.locate(F.col("text"), F.col("host")))
    end = F.col("at") + F.length("host")
    return rows.select("page_id", "host", F.col("at").cast("bigint").alias("start_char"),
                       end.cast("bigint").alias("end_char"),
                       F.when(F.col("at").isNotNull(), tx.snippet(F.col("text"), F.col("at"), end)).alias("snippet"))


@query(r"""WITH p AS (SELECT a.page_id, a.url AS u, b.url AS v FROM pages a JOIN pages b ON b.page_id=a.page_id+1
    UNION ALL SELECT page_id, url, url FROM pages
    UNION ALL SELECT page_id, url, regexp_replace(url,'^(https?://[^/]*).*$','\1/other') FROM pages),
  q AS (SELECT *, regexp_extract(u,'^(https?)://',1) AS su, regexp_extract(v,'^(https?)://',1) AS sv,
    lower(regexp_extract(u,'^https?://([^/?#]*)',1)) AS hu, lower(regexp_extract(v,'^https?://([^/?#]*)',1)) AS hv FROM p)
  SELECT page_id, v AS second_url, CASE WHEN su<>sv OR hu<>hv THEN 'different_origin'
    WHEN regexp_replace(u,'#.*$','')=regexp_replace(v,'#.*$','') THEN 'same_page_or_credentials' END AS problem FROM q""")
def second_page_checks(spark, folder):
    base = table(spark, folder, "pages").select("page_id", "url")
    after = base.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("second_url"))
    same = base.withColumn("second_url", F.col("url"))
    other = base.withColumn("second_url", F.regexp_replace("url", r"^(https?://[^/]*).*$", "$1/other"))
    pairs = base.join(after, "page_id").unionByName(same).unionByName(other)
    return pairs.select("page_id", "second_url", web.second_page_problem(
        F.col("url"), F.col("second_url")).alias("problem"))


# -- trees -----------------------------------------------------------------------------------

# The elements of the given pages; ``_t`` has every piece of text behind a tag.
_NODES = rf"""{sql.BLOCKS}, _s AS (SELECT page_id, string_split(h,'<')[2:] AS s FROM _bare),
  _l AS (SELECT page_id, list_transform(s, lambda x: regexp_extract(x,'^/?[a-z][a-z0-9]*')) AS g,
    list_transform(s, lambda x: {sql.entities("regexp_replace(x,'^[^>]*>','')")}) AS t FROM _s),
  _t AS (SELECT page_id, k, g[k] AS tag, t FROM _l, unnest(range(1,len(g)+1)) AS u(k)),
  _e AS (SELECT page_id, k, tag, t, row_number() OVER (PARTITION BY page_id ORDER BY k)-1 AS id FROM _t WHERE regexp_matches(tag,'^[a-z]')),
  -- Bold text is never closed; it ends with its paragraph, which ends with the next one or the article.
  _z AS (SELECT e.page_id, e.id, e.tag, e.k, any_value(e.t) AS t, min(c.k) AS z FROM _e e LEFT JOIN _t c ON c.page_id=e.page_id AND c.k>e.k
    AND CASE WHEN e.tag IN ('p','b') THEN c.tag IN ('p','/p','/article') ELSE c.tag='/'||e.tag END GROUP BY 1,2,3,4),
  _m(tag, up, depth) AS (VALUES ('html','',0), ('head','html',1), ('body','html',1), ('meta','head',2), ('title','head',2),
    ('nav','body',2), ('div','body',2), ('article','body',2), ('footer','body',2), ('ul','nav',3), ('li','ul',4), ('a','li',5),
    ('h1','article',3), ('p','article',3), ('b','p',4), ('br','b',5)),
  _p AS (SELECT z.*, m.depth, coalesce((SELECT max(o.id) FROM _e o WHERE o.page_id=z.page_id AND o.tag=m.up AND o.id<z.id),-1) AS parent
    FROM _z z JOIN _m m USING (tag))"""


@query(rf"""WITH {_NODES}
  SELECT page_id, id, parent, depth, tag, row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY id) AS nth,
    CASE WHEN tag IN ('br','meta') THEN '' ELSE {sql.collapse("array_to_string(list_slice(t,k,coalesce(z-1,len(t))),' ')")} END AS text FROM _p""")
def dom_nodes(spark, folder):
    return dom.node_table(trees(spark, folder)).select(
        "page_id", big("id"), big("parent"), big("depth"), "tag", big("nth"), "text")


@query(rf"""WITH {_NODES}, _n AS (SELECT page_id, k AS lo, coalesce(z, 1000000000) AS hi FROM _p WHERE tag IN ('nav','aside','footer','header','script','style','noscript','form')),
  _v AS (SELECT page_id, k, CASE WHEN tag IN ('br','meta') THEN '' ELSE {sql.collapse("array_to_string(list_slice(t,k,coalesce(z-1,len(t))),' ')")} END AS x FROM _p),
  _o AS (SELECT page_id, k, {sql.collapse("t[k]")} AS x FROM _t),
  seen AS (SELECT page_id, sum(length(x)+1) AS n FROM _v WHERE x<>'' AND NOT EXISTS (FROM _n WHERE _n.page_id=_v.page_id AND k>=lo AND k<hi) GROUP BY 1),
  once AS (SELECT page_id, sum(length(x)+1) AS n FROM _o WHERE x<>'' AND NOT EXISTS (FROM _n WHERE _n.page_id=_o.page_id AND k>=lo AND k<hi) GROUP BY 1)
  SELECT page_id, greatest(0,coalesce(seen.n,0)-1)::BIGINT AS visible_text_chars, greatest(0,coalesce(once.n,0)-1)::BIGINT AS distinct_text_chars
  FROM pages LEFT JOIN seen USING (page_id) LEFT JOIN once USING (page_id)""")
def visible_text_lengths(spark, folder):
    """Text outside noise, counted at every level of nesting, and counted once."""
    rows = intent.assess_intent(trees(spark, folder))
    return rows.select("page_id", big("intent.visible_text_chars"), big("intent.distinct_text_chars"))


@query(rf"""WITH {sql.BLOCKS} SELECT page_id, tag, count(*) AS nodes FROM (SELECT page_id,
    unnest(regexp_extract_all(h,'<([a-z][a-z0-9]*)[^>]*>',1)) AS tag FROM _bare) GROUP BY 1,2""")
def dom_tag_counts(spark, folder):
    tags = trees(spark, folder).select("page_id", F.explode("nodes.tag").alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("nodes"))


@query(rf"""WITH {sql.BLOCKS}, ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM blk
    WHERE text<>'')
  SELECT page_id, k-1 AS block_no, tag, text, CASE tag WHEN 'li' THEN '/html/body/nav/ul/li'
    ELSE '/html/body/article/'||tag END||CASE WHEN same>1 THEN '['||nth||']' ELSE '' END AS xpath,
    CASE tag WHEN 'li' THEN 'html > body > nav > ul > li' ELSE 'html > body > article > '||tag END
    ||CASE WHEN same>1 THEN ':nth-of-type('||nth||')' ELSE '' END AS selector FROM ok WHERE k<=200""")
def text_blocks(spark, folder):
    return views.block_table(trees(spark, folder)).select(
        "page_id", big("block_no"), "tag", "text", "xpath", "selector")


@query(rf"""WITH {sql.SHAPE} SELECT page_id, intent,
  round(CASE WHEN intent IN ('list','home') THEN least(1.0,0.55+ratio*0.5)
    ELSE least(1.0,0.25+CASE WHEN headings=1 THEN 0.3 ELSE 0 END+least(0.25,paragraphs*0.08)) END,6) AS confidence,
  round(ratio,6) AS repeated_item_ratio, repeated AS repeated_item_count, headings AS heading_count,
  content_blocks AS content_block_count, paragraphs AS continuous_block_count, intent NOT IN ('list','home') AS gate_passed,
  array_to_string(list_filter([CASE WHEN headings=1 THEN 'unique_primary_heading' END,
    CASE WHEN paragraphs>=2 THEN 'continuous_body' END, CASE WHEN repeated>0 THEN 'repeated_items' END,
    'primary_content_region'], lambda s: s IS NOT NULL),',') AS signals,
  CASE WHEN intent IN ('list','home') THEN 'page_intent_mismatch' WHEN intent='unknown' THEN 'page_intent_low_confidence'
    ELSE '' END AS reasons FROM judged""")
def page_intent(spark, folder):
    rows = intent.assess_intent(trees(spark, folder), "single_resource")
    return rows.select(
        "page_id", "intent.intent", F.round("intent.confidence", 6).alias("confidence"),
        F.round("intent.repeated_item_ratio", 6).alias("repeated_item_ratio"),
        big("intent.repeated_item_count"), big("intent.heading_count"), big("intent.content_block_count"),
        big("intent.continuous_block_count"), "intent.gate_passed",
        F.array_join("intent.signals", ",").alias("signals"), F.array_join("intent.reasons", ",").alias("reasons"))


@query(rf"""WITH {sql.SHAPE} SELECT intent, count(*) AS pages, round(avg(ratio),6) AS mean_ratio
  FROM judged WHERE intent NOT IN ('list','home') GROUP BY 1""")
def intent_gate(spark, folder):
    kept = intent.passing_gate(intent.assess_intent(trees(spark, folder), "single_resource"))
    return kept.groupBy(F.col("intent.intent").alias("intent")).agg(
        F.count("*").alias("pages"), F.round(F.avg("intent.repeated_item_ratio"), 6).alias("mean_ratio"))


@query(rf"""WITH {sql.SHAPE}, {sql.ARTICLE} SELECT page_id, length(article)>=8 AS accepted, article AS text,
  round(length(article)*1.35,4) AS score, content_blocks AS block_count, 'article' AS selector,
  '/html/body/article' AS xpath, 1.0::DOUBLE AS coverage, 1.0::DOUBLE AS block_coverage, 1.0::DOUBLE AS continuity, 0.0::DOUBLE AS noise,
  CASE WHEN length(article)<8 THEN 'body_text_too_short' ELSE '' END AS reasons FROM judged JOIN _art USING (page_id)""")
def body_selection(spark, folder):
    rows = body.select_body(trees(spark, folder))
    one = F.col("body.candidates")[0]
    return rows.select(
        "page_id", "body.accepted", "body.text", F.round(one["score"], 4).alias("score"),
        one["block_count"].cast("bigint").alias("block_count"), one["selector"].alias("selector"),
        one["xpath"].alias("xpath"), F.col("body.visible_text_coverage").alias("coverage"), "body.block_coverage",
        F.col("body.continuity_score").alias("continuity"), F.col("body.noise_ratio").alias("noise"),
        F.array_join("body.rejected_reasons", ",").alias("reasons"))


def structures(spark, folder, *keep: str) -> DataFrame:
    assessed = body.select_body(intent.assess_intent(trees(spark, folder, *keep)))
    return signature.page_signatures(assessed)


@query(rf"""WITH {sql.SHAPE} SELECT page_id, intent AS page_intent, repeat('h1,',headings::INT) AS title_shape,
  'article' AS content_shape, headings AS heading_count, all_blocks AS text_block_count,
  round(ratio,6) AS repeated_item_ratio FROM judged""")
def structure_signatures(spark, folder):
    s = structures(spark, folder)
    return s.select(
        "page_id", "structure.page_intent",
        F.array_join(F.transform("structure.title_shape", lambda t: F.concat(t, F.lit(","))), "").alias("title_shape"),
        F.array_join("structure.content_shape", ",").alias("content_shape"), big("structure.heading_count"),
        big("structure.text_block_count"), F.round("structure.repeated_item_ratio", 6).alias("repeated_item_ratio"))


@query(rf"""WITH {sql.SHAPE} SELECT intent AS page_intent, headings AS heading_count, count(*) AS pages,
  min(page_id) AS first_page, round(avg(all_blocks),6) AS mean_blocks, max(ratio)-min(ratio)<=0.35 AS uniform
  FROM judged GROUP BY 1,2""")
def structure_clusters(spark, folder):
    return signature.structure_clusters(structures(spark, folder)).select(
        "page_intent", F.size("title_shape").cast("bigint").alias("heading_count"), "pages", "first_page",
        F.round("mean_blocks", 6).alias("mean_blocks"), "uniform")


@query(rf"""WITH {sql.SHAPE}, o AS (SELECT page_id, intent, headings, ratio, CAST(round(ratio*1000000) AS BIGINT) AS x,
    coalesce(ratio-lag(ratio) OVER (PARTITION BY intent, headings ORDER BY ratio, page_id)>0.35,false) AS cut FROM judged),
  g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY intent, headings ORDER BY ratio, page_id ROWS UNBOUNDED PRECEDING) AS part FROM o),
  c AS (SELECT *, min(page_id) OVER w AS cluster, count(*) OVER w AS pages, sum(x) OVER w AS total FROM g WINDOW w AS (PARTITION BY intent, headings, part))
  SELECT page_id, cluster, pages, first_value(page_id) OVER (PARTITION BY cluster ORDER BY abs(pages*x-total), page_id) AS medoid FROM c""")
def template_clusters(spark, folder):
    return signature.template_clusters(structures(spark, folder)).select("page_id", "cluster", "pages", "medoid")


@query(rf"""SELECT page_id, 'div.ad' AS selector, 1::BIGINT AS match_count,
  left({sql.collapse(sql.entities("regexp_extract(html,'(?s)<div class=.ad.>(.*?)</div>',1)"))},240) AS text_sample
  FROM pages""")
def selector_suggestions(spark, folder):
    rows = trees(spark, folder).select("page_id", views.selector_suggestions(
        F.col("nodes"), F.col("tokens")).alias("s"))
    return unfold(rows, ["page_id"], F.col("s")).select("page_id", "selector", big("match_count"), "text_sample")


def varied(spark, folder, *keep: str) -> DataFrame:
    """The pages in four shapes: as they are, in a main element, with named paragraphs, with the menu in the article."""
    shape = F.col("page_id") % 4
    markup = F.when(shape == 1, F.replace(F.replace("html", F.lit("<article>"), F.lit(
        '<main class="content wide"><article id="story">')), F.lit("</article>"), F.lit("</article></main>"))) \
        .when(shape == 2, F.replace("html", F.lit("<p>"), F.lit('<p class="para text">'))) \
        .when(shape == 3, F.replace(F.replace("html", F.lit("<article>"), F.lit('<article><header class="title">menu</header>')),
                                    F.lit('class="ad"'), F.lit('class="ad body ad"'))).otherwise(F.col("html"))
    return dom.page_trees(pages(spark, folder).withColumn("html", markup), ("page_id", *keep))


@query(rf"""WITH {sql.BLOCKS}, {sql.ARTICLE}, a AS ({sql.AD}),
  para AS (SELECT page_id, count(*) AS c, arg_min(text, n) FILTER (text<>'') AS first FROM blk WHERE tag='p' GROUP BY 1),
  found AS (SELECT page_id, 1 AS place, CASE page_id%4 WHEN 3 THEN 'div.ad.body' ELSE 'div.ad' END AS selector, 1::BIGINT AS match_count, ad AS text_sample FROM a
    UNION ALL SELECT page_id, 2, unnest(['main.content.wide','article#story']), 1, left(article,240) FROM _art WHERE page_id%4=1
    UNION ALL SELECT page_id, 2, 'p.para.text', c, left(first,240) FROM para WHERE page_id%4=2)
  SELECT page_id, selector, match_count, text_sample, row_number() OVER (PARTITION BY page_id ORDER BY
    NOT regexp_matches(selector,'title|author|content|article|body'), match_count<>1, length(text_sample), place,
    selector<>'main.content.wide') AS place FROM found WHERE text_sample<>''""")
def varied_suggestions(spark, folder):
    rows = varied(spark, folder).select("page_id", views.selector_suggestions(F.col("nodes"), F.col("tokens")).alias("s"))
    return unfold(rows, ["page_id"], F.col("s"), position="at").select(
        "page_id", "selector", big("match_count"), "text_sample", (F.col("at") + 1).cast("bigint").alias("place"))


@query(rf"""WITH {sql.BLOCKS}, {sql.MARKUP} SELECT page_id, left(CASE page_id%4
    WHEN 1 THEN '<main class="content wide">'||replace(markup,'<article>','<article id="story">')||'</main>'
    WHEN 2 THEN replace(markup,'<p>','<p class="para text">') ELSE markup END,16000) AS markup FROM mk""")
def focus_markups(spark, folder):
    return varied(spark, folder).select("page_id", views.focus_markup(F.col("nodes"), F.col("tokens")).alias("markup"))


@query(f"WITH {sql.ARTICLE} SELECT page_id, left(article,16000) AS focus_text FROM _art")
def focus_regions(spark, folder):
    return trees(spark, folder).select("page_id", views.focus_region(
        F.col("nodes"), F.col("tokens")).alias("focus_text"))


def _matched(spark, folder, selector, attribute=None):
    found = selectors.matches(F.col("nodes"), F.col("tokens"), selector, F.lit(attribute).cast("string"))
    return unfold(trees(spark, folder), ["page_id"], found, "m", "p").select(
        "page_id", (F.col("p") + 1).cast("bigint").alias("match_no"), F.col("m.tag").alias("tag"),
        F.col("m.value").alias("value"))


@query("""SELECT page_id, n AS match_no, 'a' AS tag, v[n] AS value FROM (SELECT page_id,
  regexp_extract_all(html,'<li><a href="([^"]*)"',1) AS v FROM pages), unnest(range(1,len(v)+1)) AS t(n)""")
def css_selection(spark, folder):
    return _matched(spark, folder, selectors.css_selector(F.lit("nav > ul li a[href^='/']")), "href")


@query(f"""WITH {sql.BLOCKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS match_no, tag,
  text AS value FROM blk WHERE tag='h1' OR (tag='li' AND nth=2)""")
def xpath_selection(spark, folder):
    return _matched(spark, folder, selectors.xpath_selector(F.lit("//nav//li[2] | //article/h1")))


@query(f"""WITH {sql.BLOCKS} SELECT page_id, k AS selector, count(*) AS matches FROM (
  SELECT page_id, 'article > p:nth-of-type('||nth||')' AS k FROM blk WHERE tag='p' AND text<>'' AND same>1) GROUP BY 1,2""")
def block_path_roundtrip(spark, folder):
    """Every block's own path selects that block: a different selector on every row."""
    t = trees(spark, folder)
    blocks = views.text_blocks(F.col("nodes"), F.col("tokens"), limit=None)
    found = F.transform(blocks, lambda b: F.struct(
        b["tag"].alias("tag"), F.regexp_replace(b["selector"], "^html > body > ", "").alias("selector"),
        F.size(F.filter(selectors.matches(F.col("nodes"), F.col("tokens"), selectors.css_selector(b["selector"]),
                                          F.lit(None).cast("string")), lambda m: m["value"] == b["text"]))
        .cast("bigint").alias("matches")))
    return unfold(t, ["page_id"], found).filter("tag = 'p' and selector like '%nth-of-type%'") \
        .select("page_id", "selector", "matches")
