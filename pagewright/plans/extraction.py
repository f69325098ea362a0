"""Queries that extract, verify, repair and score fields of ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import unfold
from ..functions import text as tx
from ..functions import web
from ..operators import alignment
from ..operators import answers as ans
from ..operators import body, dom, evaluate, extract, quality, review, selectors, specs, verify, views
from ..session import durable
from . import sql
from .pages import big, pages, trees, viewed
from .registry import query

# The schema and program these queries run. Name, type, required, then one rule.
PAGE_FIELDS = (
    ("title", "text", True, dict(strategy="css", selector="h1")),
    ("language", "string", True, dict(strategy="css", selector="html", attribute="lang")),
    ("publisher", "string", True, dict(strategy="regex_on_text", pattern=r"©\s*(\S+)\s*·")),
    ("phrase", "text", True, dict(strategy="regex_on_text", pattern=r"(?: |^)la (\S+)")),
    ("stamp", "date", False, dict(strategy="regex_on_text", pattern=r"(\d{13,16})")),
)


def page_program() -> tuple[Column, Column]:
    fields = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(n).alias("description"), F.lit(t).alias("type"), F.lit(q).alias("required"),
        specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE)
        for n, t, q, _ in PAGE_FIELDS])
    steps = {"date": specs.POSTPROCESS}
    rules = []
    for name, kind, _, rule in PAGE_FIELDS:
        post = specs._strings(*steps.get(kind, specs.POSTPROCESS[:2]))
        rules.append(specs._rule(name, postprocess=post, **rule))
        rules.append(specs._rule(name, "llm_fallback", postprocess=post))
    return fields, F.array(*rules)


def program_table(spark: SparkSession) -> DataFrame:
    """The program as a one-row table, compiled once for all pages."""
    fields, rules = page_program()
    return spark.range(1).select(F.lit("page").alias("schema_id"), fields.alias("fields"), rules.alias("rules"))


def seen(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their lines and title, worked out once for everything that asks for them."""
    return durable(pages(spark, folder).select("page_id", "url", "html", tx.lines_of("html").alias("lines"),
                                               tx.title_of("html").alias("title")))


def answered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Seen pages with the model's answers, tree and program on one row; trees are made behind the join and never move.

    The join has as many parts as there were, which takes both sides dealt so: what follows costs far more than
    the bytes that are joined tell.
    """
    parts = rows.rdd.getNumPartitions()
    answers = ans.answer_arrays(anchored(rows)).repartition(parts, "page_id")
    asked = rows.repartition(parts, "page_id").join(answers, "page_id", "left").withColumn(
        "answers", F.coalesce("answers", F.array().cast(f"array<{extract.ANSWER_TYPE}>")))
    trees_ = dom.page_trees(asked, ("page_id", "url", "lines", "title", "answers"))
    return extract.with_one_program(trees_.withColumn("text", tx.join_lines(F.col("lines"))), program_table(spark))


def ready(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with views, tree and program on one row."""
    rows = dom.page_trees(pages(spark, folder), ("page_id", "url", "html"))
    rows = rows.withColumn("lines", tx.lines_of("html")).withColumn("text", tx.join_lines(F.col("lines"))) \
        .withColumn("title", tx.title_of("html")).drop("html")
    return extract.with_one_program(rows, program_table(spark))


def _pattern_sql(pos, name, kind, required, pattern):
    whole, value = f"regexp_extract(txt,'(?im){pattern}',0)", sql.collapse(f"regexp_extract(txt,'(?im){pattern}',1)")
    return f"""SELECT page_id AS id, {pos} AS pos, '{name}' AS field, '{kind}' AS ftype, {required} AS required,
      nullif({value},'') AS raw, CASE WHEN {whole}<>'' THEN strpos(txt,{whole})-1 END AS s,
      CASE WHEN {whole}<>'' THEN strpos(txt,{whole})-1+length({whole}) END AS e, 'regex_on_text' AS strategy, txt FROM view"""


_FOUND = rf"""{sql.TEXT}, {sql.BLOCKS},
_css AS (SELECT page_id AS id, 0 AS pos, 'title' AS field, 'text' AS ftype, true AS required, text AS raw FROM blk WHERE tag='h1'
  UNION ALL SELECT page_id, 1, 'language', 'string', true, regexp_extract(html,'<html lang="([^"]*)"',1) FROM pages),
_all AS (SELECT id, pos, field, ftype, required, raw, CASE WHEN strpos(txt,raw)>0 THEN strpos(txt,raw)-1 END AS s,
    CASE WHEN strpos(txt,raw)>0 THEN strpos(txt,raw)-1+length(raw) END AS e, 'css' AS strategy, txt
    FROM _css JOIN view ON id=page_id
  UNION ALL {_pattern_sql(2, "publisher", "string", "true", r"©\s*(\S+)\s*·")}
  UNION ALL {_pattern_sql(3, "phrase", "text", "true", r"(?: |^)la (\S+)")}
  UNION ALL {_pattern_sql(4, "stamp", "date", "false", r"(\d{13,16})")}),
fr AS (SELECT id, pos, field, ftype, required, raw, CASE WHEN ftype='date' THEN {sql.iso_date("raw")} ELSE raw END AS val,
    CASE WHEN raw IS NULL THEN NULL WHEN strategy='css' THEN raw ELSE {sql.snippet("txt", "s", "e")} END AS ev,
    CASE WHEN raw IS NULL THEN 0.0 ELSE (CASE strategy WHEN 'css' THEN 0.81 ELSE 0.755 END)
      -CASE WHEN length(raw)<2 THEN 0.075 ELSE 0 END END AS conf,
    CASE WHEN raw IS NULL THEN 'none' ELSE strategy END AS strategy, CAST(NULL AS VARCHAR) AS err,
    CASE WHEN raw IS NULL THEN 'missing' ELSE 'extracted' END AS status,
    CASE WHEN raw IS NOT NULL THEN s END AS s, CASE WHEN raw IS NOT NULL THEN e END AS e FROM _all)"""


def extracted(spark, folder) -> DataFrame:
    return extract.extract_fields(ready(spark, folder))


@query(f"""WITH {_FOUND} SELECT id AS page_id, raw AS value, round(conf,4) AS confidence, s AS start_char, e AS end_char,
  ev AS evidence, round(conf,4) AS overall FROM fr WHERE field='publisher'""")
def extract_publisher_regex(spark, folder):
    """The smallest slice: one text rule, so no tree is ever built."""
    rows = pages(spark, folder).withColumn("lines", tx.lines_of("html")) \
        .withColumn("text", tx.join_lines(F.col("lines")))
    out = extract.extract_fields(extract.with_one_program(
        rows, program_table(spark).withColumn("fields", F.slice("fields", 3, 1))))
    r = F.col("results")[0]
    e = r["evidence"][0]
    return out.select("page_id", r["normalized_value"].alias("value"), r["confidence"].alias("confidence"),
                      e["start_char"].cast("bigint").alias("start_char"), e["end_char"].cast("bigint").alias("end_char"),
                      e["text"].alias("evidence"), F.col("overall_confidence").alias("overall"))


@query(f"""WITH {_FOUND} SELECT id AS page_id, pos AS field_pos, field AS field_name, raw AS value, val AS normalized_value,
  round(conf,4) AS confidence, strategy, status, ev AS evidence, s AS start_char, e AS end_char FROM fr""")
def field_results(spark, folder):
    rows = extract.field_results(extracted(spark, folder))
    e = F.get("evidence", F.lit(0))
    return rows.select(
        "page_id", big("field_pos"), "field_name", "value", "normalized_value", "confidence", "strategy", "status",
        e["text"].alias("evidence"), e["start_char"].cast("bigint").alias("start_char"),
        e["end_char"].cast("bigint").alias("end_char"))


@query(f"""WITH {_FOUND} SELECT id AS page_id, max(val) FILTER (field='title') AS title,
  max(val) FILTER (field='language') AS language, max(val) FILTER (field='publisher') AS publisher,
  max(val) FILTER (field='phrase') AS phrase, max(val) FILTER (field='stamp') AS stamp,
  round(sum(CASE WHEN raw IS NOT NULL THEN conf ELSE 0 END)/5,4) AS overall FROM fr GROUP BY 1""")
def extract_fields_wide(spark, folder):
    names = [f[0] for f in PAGE_FIELDS]
    return extract.wide_records(extracted(spark, folder).withColumnRenamed("overall_confidence", "overall"),
                                names, "page_id", "overall")


@query(f"""WITH {_FOUND} SELECT id AS page_id, field AS field_name, strategy AS source, ev AS text FROM fr
  WHERE ev IS NOT NULL""")
def evidence_bundle(spark, folder):
    return extract.evidence_rows(extracted(spark, folder)).select("page_id", "field_name", "source", "text")


def verified(spark, folder) -> DataFrame:
    return verify.verify(extracted(spark, folder))


@query(f"WITH {_FOUND}, {sql.ISSUES} {sql.REPORT}")
def verify_reports(spark, folder):
    return verify.report_rows(verified(spark, folder)).select(
        "page_id", "passed", big("error_count"), big("warning_count"), "score")


@query(f"WITH {_FOUND}, {sql.ISSUES} SELECT id AS page_id, field AS field_name, code, severity FROM iss")
def verify_issues(spark, folder):
    return verify.issue_rows(verified(spark, folder)).select("page_id", "field_name", "code", "severity")


# Which field goes to the model: the last telling issue, overruled by the schema-level rules.
_DECIDED = f"""{_FOUND}, {sql.ISSUES},
dec AS (SELECT fr.id, fr.field, CASE WHEN required AND status='missing' THEN 'required_field_missing'
    WHEN conf<0.35 AND ev IS NULL THEN 'low_confidence' ELSE x.code END AS reason FROM fr LEFT JOIN (
    SELECT iss.id, iss.field, arg_max(code, ord) AS code FROM iss JOIN fr ON iss.id=fr.id AND iss.field=fr.field
    WHERE code NOT IN ('llm_fallback_failed','program_execution_failed')
      AND NOT (severity='warning' AND NOT required AND conf>=0.45 AND ev IS NOT NULL) GROUP BY 1,2) x
  ON x.id=fr.id AND x.field=fr.field)"""


@query(f"WITH {_DECIDED} SELECT id AS page_id, field AS field_name, reason FROM dec WHERE reason IS NOT NULL")
def fallback_candidates(spark, folder):
    rows = verify.decide_fallback(verified(spark, folder))
    return unfold(rows, ["page_id"], F.col("fallback")).select("page_id", "field_name", "reason")


@query(f"""WITH {_DECIDED} SELECT id AS page_id, field AS field_name, reason, title,
  '{{"name":"'||field||'","description":"'||field||'","type":"'||ftype||'","required":'||required||',"aliases":[],"examples":[]}}'
   AS field, left(txt,12000) AS text FROM dec JOIN fr USING (id, field) JOIN view ON id=page_id JOIN (SELECT id, val AS title
  FROM fr WHERE field='title') USING (id) WHERE reason IS NOT NULL""")
def model_requests(spark, folder):
    rows = verify.decide_fallback(verified(spark, folder))
    return ans.field_requests(rows).drop("url")


_FIELDS_JSON = "[" + ",".join(
    f'{{"name":"{n}","description":"{n}","type":"{t}","required":{str(q).lower()},"aliases":[],"examples":[]}}'
    for n, t, q, _ in PAGE_FIELDS) + "]"
_VIEW_JSON = """'{{"url":'||to_json(url)||',"title":'||to_json(title)||',"headings":'||to_json(hs)||',"lines":'||to_json(lines[1:{n}])
  ||',"text_excerpt":'||to_json(left(txt,{m}))||'}}'"""


@query(rf"""WITH {sql.TEXT}, h AS (SELECT view.*, {sql.collapse(sql.entities(sql.entities(
    "regexp_extract(html,'(?s)<title>(.*?)</title>',1)")))} AS title,
    list_filter(list_transform(regexp_extract_all(html,'<h[123]>([^<]+)',1), lambda c: {sql.collapse(sql.entities(sql.entities("c")))}),
      lambda c: c<>'') AS hs FROM view),
  {sql.BLOCKS},{sql.MARKUP}, a AS ({sql.AD})
  SELECT page_id, {_VIEW_JSON.format(n=160, m=12000)} AS record_page, {_VIEW_JSON.format(n=140, m=10000)} AS schema_page,
    {_VIEW_JSON.format(n=120, m=8000)} AS page, '{_FIELDS_JSON}' AS schema_fields, left(markup,6000) AS excerpt,
    '[{{"selector":"div.ad","match_count":1,"text_sample":'||to_json(ad)||'}}]' AS selector_candidates
  FROM h JOIN mk USING (page_id) JOIN a USING (page_id)""")
def page_requests(spark, folder):
    """The three whole-page requests to a model, each cut to its own limits."""
    nodes, tokens = F.col("nodes"), F.col("tokens")
    rows = dom.page_trees(pages(spark, folder), ("page_id", "url", "html"))
    rows = rows.withColumn("lines", tx.lines_of("html")).withColumn("text", tx.join_lines(F.col("lines"))) \
        .withColumn("title", tx.title_of("html")).withColumn("headings", tx.headings_of("html")) \
        .withColumn("fields", page_program()[0]).withColumn("focus_markup", views.focus_markup(nodes, tokens)) \
        .withColumn("selector_candidates", views.selector_suggestions(nodes, tokens)) \
        .withColumn("record_page", ans.page_view(ans.RECORD_LINES, ans.FIELD_TEXT)) \
        .withColumn("schema_page", ans.page_view(ans.SCHEMA_LINES, ans.SCHEMA_TEXT))
    return ans.program_requests(rows, "record_page", "schema_page")


# Answers as a provider might return them: fenced JSON, prose, an abstention, or a value that is not on the page.
_ANSWER = r"""CASE page_id%4 WHEN 0 THEN '```json
{"value":"'||word||'","evidence_text":"'||replace(title,'"','')||'","confidence":0.7}
```' WHEN 1 THEN 'sorry, no answer' WHEN 2 THEN '{"value":"'||word||'","abstain":true}'
  ELSE '{"value":"zzz nowhere","evidence_text":null,"confidence":"high"}' END"""
_WORD = r"regexp_extract(title,'^([A-Za-zÀ-ÿ]+)',1)"


def titled(spark, folder) -> DataFrame:
    return pages(spark, folder).select("page_id", tx.title_of("html").alias("title"), tx.lines_of("html").alias("lines"))


def responses(pages: DataFrame) -> DataFrame:
    """Answers for pages with title and lines."""
    rows = pages.select("page_id", "title", tx.join_lines(F.col("lines")).alias("text"))
    word = F.regexp_extract("title", "^([A-Za-zÀ-ÿ]+)", 1)
    good = F.concat(F.lit('```json\n{"value":"'), word, F.lit('","evidence_text":"'),
                    F.replace("title", F.lit('"'), F.lit("")), F.lit('","confidence":0.7}\n```'))
    content = F.when(F.col("page_id") % 4 == 0, good).when(F.col("page_id") % 4 == 1, "sorry, no answer") \
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"value":"'), word, F.lit('","abstain":true}'))) \
        .otherwise('{"value":"zzz nowhere","evidence_text":null,"confidence":"high"}')
    return rows.withColumn("field_name", F.lit("phrase")).withColumn("content", content)


def anchored(pages: DataFrame) -> DataFrame:
    rows = responses(pages)
    a = ans.anchor(F.col("content"), F.col("text"), F.lit("text"))
    return rows.withColumn("a", a).select(
        "page_id", "field_name", F.col("a.value").alias("value"), F.col("a.evidence").alias("evidence"),
        ans.content_error(F.col("content")).alias("error"))


_ANCHORED = rf"""ttl AS (SELECT view.page_id, txt, {sql.collapse(sql.entities(sql.entities("regexp_extract(html,'(?s)<title>(.*?)</title>',1)")))} AS title FROM view),
ans0 AS (SELECT *, {_WORD} AS word, replace(title,'"','') AS quote FROM ttl),
ans AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN nullif(word,'') WHEN 3 THEN 'zzz nowhere' END AS value,
  CASE WHEN page_id%4=1 THEN 'answer is not a JSON object' END AS error,
  CASE page_id%4 WHEN 0 THEN CASE WHEN word='' THEN NULL WHEN strpos(txt,quote)>0 THEN quote
      ELSE {sql.snippet("txt", "strpos(txt,word)-1", "strpos(txt,word)-1+length(word)")} END WHEN 3 THEN 'zzz nowhere' END AS ev,
  CASE WHEN page_id%4=0 AND word<>'' THEN CASE WHEN strpos(txt,quote)>0 THEN strpos(txt,quote)-1 ELSE strpos(txt,word)-1 END END AS s,
  CASE page_id%4 WHEN 0 THEN CASE WHEN word<>'' THEN 0.7 END WHEN 3 THEN 0.55 END AS score FROM ans0)"""


@query(f"""WITH {sql.TEXT}, {_ANCHORED} SELECT page_id, value, error, ev AS evidence, s AS start_char,
  s+length(ev) AS end_char, score FROM ans""")
def anchored_answers(spark, folder):
    return anchored(titled(spark, folder)).select(
        "page_id", "value", "error", F.col("evidence.text").alias("evidence"),
        F.col("evidence.start_char").cast("bigint").alias("start_char"),
        F.col("evidence.end_char").cast("bigint").alias("end_char"), F.col("evidence.score").alias("score"))


@query(f"""WITH {sql.TEXT}, {_ANCHORED} SELECT page_id, CASE WHEN page_id%4=1 THEN 'answer is not a JSON object'
    WHEN page_id%4=0 AND NOT contains({sql.collapse("txt")},quote) THEN 'field evidence is absent from the saved snapshot'
    WHEN page_id%4=3 THEN 'nonempty field value requires page evidence' END AS problem,
  CASE WHEN page_id%4=0 AND word<>'' AND strpos(txt,quote)>0 THEN word END AS value FROM ans0""")
def strict_answers(spark, folder):
    field = page_program()[0][3]
    rows = responses(titled(spark, folder)).withColumn("s", ans.anchor_strict(F.col("content"), F.col("text"), field))
    return rows.select("page_id", F.col("s.problem").alias("problem"), F.col("s.value").alias("value"))


@query(rf"""WITH {sql.TEXT}, {_ANCHORED} SELECT page_id, 'headline' AS field_name, quote AS value, 0.9::DOUBLE AS confidence,
    quote AS evidence_text, 'extracted' AS status FROM ans0 WHERE quote<>''
  UNION ALL SELECT page_id, 'site', lower(regexp_extract(url,'^https?://([^/?#]*)',1)), 1.0, NULL, 'extracted'
  FROM pages""")
def open_record_answers(spark, folder):
    """Schema-free answers: a record with its own keys and evidence for some of them."""
    title = F.replace("title", F.lit('"'), F.lit(""))
    content = F.to_json(F.struct(
        F.struct(F.nullif(title, F.lit("")).alias("headline"), web.host(F.col("url")).alias("site")).alias("record"),
        F.struct(F.struct(title.alias("text"), F.lit(0.9).alias("confidence")).alias("headline"),
                 F.struct(F.lit(7).alias("confidence")).alias("site")).alias("evidence")))
    rows = pages(spark, folder).select("page_id", "url", tx.title_of("html").alias("title"))
    return ans.record_rows(rows.withColumn("content", content))


def repaired(spark, folder) -> DataFrame:
    found = extract.extract_fields(answered(spark, seen(spark, folder)))
    return verify.repair(verify.decide_fallback(verify.verify(found)))


# Results after repair: flagged fields take the answer, keep their value on an error or an abstention.
_REPAIRED = f"""{_DECIDED}, {_ANCHORED},
fixed AS (SELECT fr.*, dec.reason, a.value AS avalue, a.ev AS aev, a.error AS aerr,
    CASE WHEN dec.reason IS NULL THEN 'kept' WHEN a.error IS NOT NULL THEN 'failed'
      WHEN a.value IS NOT NULL THEN 'repaired' ELSE 'abstained' END AS result
  FROM fr JOIN dec USING (id, field) LEFT JOIN (SELECT page_id AS id, 'phrase' AS field, value, ev, error FROM ans) a USING (id, field))"""
_AFTER = """SELECT id, pos, field, ftype, required, CASE WHEN result='repaired' THEN avalue ELSE val END AS val,
  CASE WHEN result='repaired' THEN aev ELSE ev END AS ev, CASE WHEN result='repaired' THEN 0.42 ELSE conf END AS conf,
  CASE WHEN result='repaired' THEN 'llm_fallback' ELSE strategy END AS strategy,
  CASE WHEN result='failed' THEN aerr WHEN result='abstained' THEN 'LLM fallback abstained: '||reason ELSE err END AS err,
  CASE WHEN result='repaired' THEN 'repaired' WHEN result IN ('failed','abstained') THEN 'fallback_failed' ELSE status END AS status"""


@query(f"""WITH {_REPAIRED}, after AS ({_AFTER} FROM fixed), open AS (SELECT DISTINCT id, field FROM (
    SELECT id, field FROM after WHERE status='fallback_failed' OR NOT coalesce(contains(ev,val),false)
      OR length(trim(coalesce(ev,'')))<4)) 
  SELECT f.id AS page_id, f.field AS field_name, val AS before, CASE WHEN result='repaired' THEN avalue ELSE val END AS after,
    reason, result, result='repaired' AND o.id IS NULL AS verified FROM fixed f LEFT JOIN open o ON o.id=f.id AND o.field=f.field
  WHERE reason IS NOT NULL""")
def repair_outcomes(spark, folder):
    return unfold(repaired(spark, folder), ["page_id"], F.col("repair_outcomes"))


@query(f"""WITH {_REPAIRED}, after AS ({_AFTER} FROM fixed)
  SELECT id AS page_id, field AS field_name, val AS value, round(conf,4) AS confidence, strategy, status, err AS error_message,
    round(sum(conf) OVER (PARTITION BY id)/5,4) AS overall FROM after""")
def repaired_results(spark, folder):
    rows = repaired(spark, folder)
    return unfold(rows, ["page_id", F.col("overall_confidence").alias("overall")], F.col("results")).select(
        "page_id", "field_name", F.coalesce("normalized_value", "value").alias("value"), "confidence", "strategy",
        "status", "error_message", "overall")


@query(f"""WITH {_FOUND} SELECT id AS page_id, field AS field_name, coalesce(val,'') AS value, status='extracted' AS accepted,
  '' AS note FROM fr""")
def review_rows(spark, folder):
    return review.review_fields(extracted(spark, folder))


@query(f"""WITH {_FOUND}, {sql.ISSUES}, want AS (SELECT page_id AS id, lower(regexp_extract(url,'^https?://([^/?#]*)',1)) AS p,
    regexp_extract(url,'^https?://[^/]*/([a-z][a-z])/',1) AS l FROM pages),
  bad AS (SELECT id, count(*) AS n FROM fr JOIN want USING (id) WHERE (field='publisher' AND coalesce(val,'')<>p)
    OR (field='language' AND coalesce(val,'')<>'en') GROUP BY 1)
  SELECT id AS page_id, error_count+coalesce(n,0)=0 AS passed, coalesce(n,0) AS mismatches,
    round(CASE WHEN error_count+coalesce(n,0)>0 THEN least(0.5,greatest(0,1-0.25*error_count-0.08*warning_count))
      ELSE greatest(0,1-0.25*error_count-0.08*warning_count) END,4) AS score FROM rep LEFT JOIN bad USING (id)""")
def confirmed_value_checks(spark, folder):
    rows = verified(spark, folder).withColumn("expected_values", F.create_map(
        F.lit("publisher"), web.host(F.col("url")), F.lit("language"), F.lit("en")))
    out = verify.check_expected(rows)
    return out.select("page_id", "report.passed", F.size(F.filter(
        "issues", lambda i: i["code"] == "guidance_mismatch")).cast("bigint").alias("mismatches"),
        F.round("report.score", 4).alias("score"))


@query(f"""WITH {_FOUND}, {sql.ISSUES} SELECT a.id AS page_id, a.error_count=0 AND coalesce(b.error_count,0)=0 AS passed,
  coalesce(b.error_count,0)>0 AS second_failed FROM rep a LEFT JOIN rep b ON b.id=a.id+1""")
def second_page_gate(spark, folder):
    rows = verified(spark, folder).select("page_id", "issues", "report")
    second = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("report.passed").alias("passed"))
    out = verify.second_page_gate(rows, second, "page_id")
    return out.select("page_id", "passed", F.exists(
        "issues", lambda i: i["code"] == "second_page_failed").alias("second_failed"))


# -- rules checked on every page -------------------------------------------------------------

CHECKED_RULES = (
    ("title", "css", "h1"), ("scope", "css", "html > body"), ("head", "xpath", "//head/title/text()"),
    ("count", "xpath", "count(//h1)"), ("absent", "css", ".absent"), ("blank", "css", "meta"),
    ("para", "css", "article p"), ("body", "css", ".ad"), ("items", "xpath", "//nav//a[@href]"),
)


def _checked(spark, folder) -> DataFrame:
    rules = F.array(*[specs._rule(f, s, selector=x) for f, s, x in CHECKED_RULES])
    fields = F.array(*[F.struct(
        F.lit(f).alias("name"), F.lit(f).alias("description"), F.lit("text").alias("type"), F.lit(False).alias("required"),
        specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE)
        for f, _, _ in CHECKED_RULES])
    rows = body.select_body(trees(spark, folder)).withColumn("rules", rules).withColumn("fields", fields)
    return quality.fit_programs(rows)


_VERDICTS = rf"""{sql.BLOCKS}, {sql.ARTICLE},
  cnt AS (SELECT page_id, count(*) FILTER (tag='p') AS p, count(*) FILTER (tag='p' AND text='') AS blank_p,
    count(*) FILTER (tag='h1') AS h, count(*) FILTER (tag='li') AS li, any_value(text) FILTER (tag='p') AS one FROM blk GROUP BY 1),
  f AS (SELECT pages.page_id, cnt.*, length(article) AS n, length({sql.collapse(sql.entities(
    "regexp_extract(html,'(?s)<div class=.ad.>(.*?)</div>',1)"))}) AS ad FROM pages JOIN cnt USING (page_id) JOIN _art USING (page_id)),
  v AS (SELECT page_id, 'title' AS field, CASE WHEN h>1 THEN 'ambiguous_matches' WHEN h=0 THEN 'no_matches' END AS reason, h AS c FROM f
    UNION ALL SELECT page_id, 'scope', 'document_scope', 1 FROM f UNION ALL SELECT page_id, 'head', 'document_scope', 1 FROM f
    UNION ALL SELECT page_id, 'count', 'invalid_selector', NULL FROM f UNION ALL SELECT page_id, 'absent', 'no_matches', 0 FROM f
    UNION ALL SELECT page_id, 'blank', 'empty_value', 1 FROM f
    UNION ALL SELECT page_id, 'para', CASE WHEN p>1 THEN 'ambiguous_matches' WHEN p=0 THEN 'no_matches' WHEN one='' THEN 'empty_value' END, p FROM f
    UNION ALL SELECT page_id, 'body', CASE WHEN n>=8 AND ad/n<0.5 THEN 'body_incomplete' END, 1 FROM f
    UNION ALL SELECT page_id, 'items', CASE WHEN li>1 THEN 'ambiguous_matches' WHEN li=0 THEN 'no_matches' END, li FROM f)"""


@query(f"WITH {_VERDICTS} SELECT page_id, field, reason, c AS match_count FROM v WHERE reason IS NOT NULL")
def rule_validation(spark, folder):
    rows = unfold(_checked(spark, folder), ["page_id"], F.col("diagnostics"))
    return rows.select("page_id", "field", "reason", big("match_count"))


@query(f"""WITH {_VERDICTS} SELECT page_id, field AS field_name, CASE field WHEN 'title' THEN 'h1' WHEN 'para' THEN 'article p'
    WHEN 'body' THEN '.ad' WHEN 'items' THEN '//nav//a[@href]' END AS selector FROM v WHERE reason IS NULL
  UNION ALL SELECT page_id, 'body', 'article' FROM v JOIN f USING (page_id) WHERE field='body' AND reason IS NOT NULL AND n>=8""")
def page_programs(spark, folder):
    rows = unfold(_checked(spark, folder), ["page_id"], F.col("rules"))
    return rows.select("page_id", "field_name", "selector")


@query(f"""WITH {_VERDICTS} SELECT page_id, field AS rule, coalesce(reason,'success') AS outcome, c AS match_count FROM v
  WHERE field IN ('title','absent','blank','para','items','count')""")
def selector_outcomes(spark, folder):
    picked = [r for r in CHECKED_RULES if r[0] in ("title", "absent", "blank", "para", "items", "count")]
    none = F.lit(None).cast("string")
    states = F.array(*[F.struct(F.lit(n).alias("rule"), selectors.matches(
        F.col("nodes"), F.col("tokens"), selectors.parse_selector(F.lit(s), F.lit(x)), none).alias("m"))
        for n, s, x in picked])
    rows = unfold(trees(spark, folder), ["page_id"], states)
    return rows.select("page_id", "rule", selectors.outcome(F.col("m")).alias("outcome"),
                       F.when(F.col("m").isNotNull(), F.size("m")).cast("bigint").alias("match_count"))


# -- scoring ---------------------------------------------------------------------------------

def gold(pages: DataFrame) -> DataFrame:
    """Labels the pages carry themselves: title element, URL language, URL host, first title word."""
    rows = pages.select(
        "page_id", "title", F.regexp_extract("url", "^https?://[^/]*/([a-z][a-z])/", 1).alias("language"),
        web.host(F.col("url")).alias("publisher"))
    word = F.regexp_extract("title", "^([A-Za-zÀ-ÿ]+)", 1)
    return rows.select("page_id", F.create_map(
        F.lit("title"), "title", F.lit("language"), "language", F.lit("publisher"), "publisher",
        F.lit("phrase"), word).alias("gold"))


def open_answer() -> Column:
    """What a model might return for a page without being told the schema: own keys, prose, or an empty record."""
    lang = F.regexp_extract("url", "^https?://[^/]*/([a-z][a-z])/", 1)
    known = F.to_json(F.struct(
        F.struct(F.col("title").alias("title"), web.host(F.col("url")).alias("publisher"), lang.alias("lang")).alias("record"),
        F.struct(F.struct(F.col("title").alias("text"), F.lit(0.9).alias("confidence")).alias("title")).alias("evidence")))
    other = F.to_json(F.struct(F.struct(F.col("title").alias("Page Title"), web.host(F.col("url")).alias("publisherName")).alias("record")))
    return F.when(F.col("page_id") % 4 == 0, known).when(F.col("page_id") % 4 == 1, "sorry, no answer") \
        .when(F.col("page_id") % 4 == 2, other).otherwise('{"record":{}}')


def benchmark_runs(spark, pages: DataFrame) -> DataFrame:
    """Five methods over the same seen pages, with the cost of each run; answers never see the gold labels."""
    base = answered(spark, pages).withColumn("_open", open_answer())

    # All methods run on the row of their page: the page is read, decoded and parsed once, and its rules run once.
    # Without a model the rules alone and the full method start from the same results.
    ruled = extract.extract_fields(base, with_model="_hybrid").withColumn("_plain", F.col("results"))
    full = verify.repair(verify.decide_fallback(verify.verify(ruled)))
    rows = full.withColumns({"_model": extract.model_only(),
                             "_direct": evaluate.direct_results(ans.open_record(F.col("_open"))),
                             "_broken": ans.content_error(F.col("_open"))})
    none = F.slice("repair_outcomes", 1, 0)
    size = F.floor((F.length("text") + 3) / 4).cast("bigint")

    def run(place, name, results, outcomes=none, overall=None, error=None, calls=0, reused=F.lit(False)):
        mean = extract.overall_confidence(F.col(results)) if overall is None else overall
        failure = F.lit(None).cast("string") if error is None else error
        asked, lost = F.lit(calls), F.when(failure.isNull(), 0).otherwise(calls)
        used = F.when(lost == 0, asked * size)
        return F.struct(F.lit(name).alias("method"), F.col(results).alias("results"), outcomes.alias("repair_outcomes"),
                        mean.alias("overall_confidence"), failure.alias("error"), reused.alias("program_reused"),
                        (F.col("page_id") % 97 + place).cast("bigint").alias("runtime_ms"), asked.alias("model_call_count"),
                        lost.alias("token_usage_missing_calls"), (asked * size).alias("token_cost"),
                        used.alias("actual_input_tokens"), F.coalesce(used, F.lit(0)).alias("partial_actual_input_tokens"))

    broken = F.col("_broken")
    return unfold(rows, ("page_id", "fields"), F.array(
        run(1, "Direct LLM", "_direct", overall=F.when(broken.isNull(), evaluate.mean_confidence(F.col("_direct"))), error=broken, calls=1),
        run(2, "LLM + Schema", "_model", calls=1), run(3, "Program Only", "_plain"), run(4, "Hybrid without Verifier", "_hybrid"),
        run(5, "Ours Full", "results", F.col("repair_outcomes"), F.col("overall_confidence"), reused=F.col("page_id") % 5 == 0)))


def benchmark_records(spark, folder) -> DataFrame:
    rows = seen(spark, folder)
    return evaluate.to_records(benchmark_runs(spark, rows), gold(rows))


_SCORES = f"""{_REPAIRED}, after AS ({_AFTER} FROM fixed),
runs AS (SELECT 'Program Only' AS method, id, field, ftype, required, val, ev, conf FROM fr
  UNION ALL SELECT 'Hybrid without Verifier', fr.id, fr.field, ftype, required, CASE WHEN raw IS NULL THEN a.value ELSE val END,
    CASE WHEN raw IS NULL THEN a.ev ELSE fr.ev END,
    CASE WHEN raw IS NULL THEN CASE WHEN a.value IS NULL THEN 0 ELSE round((0.48-CASE WHEN length(a.value)<2 THEN 0.15 ELSE 0 END+a.score)/2,4) END
      ELSE conf END FROM fr LEFT JOIN ans a ON a.page_id=fr.id AND fr.field='phrase'
  UNION ALL SELECT 'LLM + Schema', fr.id, fr.field, ftype, required, a.value, a.ev, coalesce(a.score,0) FROM fr
    LEFT JOIN ans a ON a.page_id=fr.id AND fr.field='phrase'
  UNION ALL SELECT 'Ours Full', id, field, ftype, required, val, ev, conf FROM after),
gold AS (SELECT page_id AS id, 'title' AS field, title AS want FROM ttl
  UNION ALL SELECT page_id, 'phrase', word FROM ans0
  UNION ALL SELECT page_id, 'language', regexp_extract(url,'^https?://[^/]*/([a-z][a-z])/',1) FROM pages
  UNION ALL SELECT page_id, 'publisher', lower(regexp_extract(url,'^https?://([^/?#]*)',1)) FROM pages),
j AS (SELECT r.*, want, want IS NOT NULL AS has_gold, want IS NOT NULL AND val=want AS good FROM runs r LEFT JOIN gold USING (id, field)),
perpage AS (SELECT method, id, count(*) FILTER (CASE ftype WHEN 'date' THEN coalesce(regexp_full_match(val,'\\d{{4}}-\\d{{2}}-\\d{{2}}'),false)
    ELSE coalesce(trim(val),'')<>'' END)+1+CASE WHEN bool_and(NOT required OR coalesce(val,'')<>'') THEN 1 ELSE 0 END AS passed, count(*)+2 AS checks
  FROM j GROUP BY 1,2),
rr AS (SELECT count(*) AS n, count(*) FILTER (result='repaired' AND avalue=want AND NOT coalesce(val=want,false)) AS k
  FROM fixed JOIN gold USING (id, field) WHERE reason IS NOT NULL)"""


# The schema-free method has rows of its own keys; ``page`` has what all methods need of a page.
_DIRECT = r"""page AS (SELECT ttl.page_id AS id, page_id%4 AS m, title, lower(regexp_extract(url,'^https?://([^/?#]*)',1)) AS host,
    regexp_extract(url,'^https?://[^/]*/([a-z][a-z])/',1) AS lang, (length(txt)+3)//4 AS size FROM ttl JOIN pages USING (page_id)),
d AS (SELECT count(*) AS n, count(*) FILTER (m=0) AS n0, count(*) FILTER (m=1) AS n1, count(*) FILTER (m=2) AS n2, count(*) FILTER (m=3) AS n3,
    count(*) FILTER (m=0 AND title<>'') AS t0, count(*) FILTER (m=0 AND trim(title)<>'') AS typed, sum((m=0)::INT+(m=2)::INT) AS hosts,
    count(*) FILTER (m IN (0,2) AND title<>'') AS titles, count(*) FILTER (m=0 AND lang<>'') AS langs FROM page),
cost AS (SELECT method, count(*) FILTER (method='Direct LLM' AND m=1)::BIGINT AS failure_count, sum(id%97+place)::BIGINT AS runtime_ms,
    sum(CASE WHEN place<3 THEN size ELSE 0 END)::BIGINT AS estimated_token_cost,
    CASE WHEN method='LLM + Schema' THEN sum(size) END::BIGINT AS actual_input_tokens,
    CASE method WHEN 'LLM + Schema' THEN sum(size) WHEN 'Direct LLM' THEN coalesce(sum(size) FILTER (m<>1),0) ELSE 0 END::BIGINT AS partial_actual_input_tokens,
    CASE method WHEN 'Direct LLM' THEN count(*) FILTER (m=1) ELSE 0 END::BIGINT AS token_usage_missing_calls,
    CASE WHEN place<3 THEN count(*) ELSE 0 END::BIGINT AS model_call_count,
    CASE WHEN method='Ours Full' THEN round(count(*) FILTER (id%5=0)/count(*),4) WHEN place>2 THEN 0.0 END AS program_reuse_rate
  FROM page, (VALUES (1,'Direct LLM'),(2,'LLM + Schema'),(3,'Program Only'),(4,'Hybrid without Verifier'),(5,'Ours Full')) v(place, method)
  GROUP BY method, place)"""


@query(f"""WITH {_SCORES}, {_DIRECT}, five AS (
  SELECT method, round(count(*) FILTER (good)/count(*) FILTER (has_gold),4) AS field_accuracy,
  round(count(*) FILTER (required AND coalesce(val,'')='')/count(*) FILTER (required),4) AS required_field_missing_rate,
  round(any_value(adh),4) AS schema_adherence,
  round(count(*) FILTER (coalesce(val,'')<>'' AND ev IS NOT NULL)/count(*) FILTER (coalesce(val,'')<>''),4) AS evidence_coverage,
  round(avg(conf),4) AS average_confidence,
  round(count(*) FILTER (good AND round(conf,4)>=0.8)/nullif(count(*) FILTER (has_gold AND round(conf,4)>=0.8 AND coalesce(val,'')<>''),0),4) AS selective_accuracy,
  count(*) FILTER (has_gold AND round(conf,4)>=0.8 AND coalesce(val,'')<>'') AS accepted_field_count,
  CASE WHEN method='Ours Full' THEN (SELECT round(k/n,4) FROM rr) END AS repair_success_rate, count(DISTINCT id) AS sample_count
  FROM j JOIN (SELECT method, sum(passed)/sum(checks) AS adh FROM perpage GROUP BY 1) USING (method) GROUP BY method
  UNION ALL SELECT 'Direct LLM', round(2*n0/(4*n),4), round((4*(n-n0)+2*n0+(n0-t0))/(4*n),4), round((typed+n0+n1+n3)/(7*n),4),
    round(t0/(titles+hosts+langs),4), round(0.9*n0/(3*n0+2*n2+n3),4), round(n0/nullif(t0,0),4), t0, NULL, n FROM d)
  SELECT five.*, sample_count-failure_count AS success_count, cost.* EXCLUDE (method) FROM five JOIN cost USING (method)""")
def method_scores(spark, folder):
    return evaluate.score_methods(benchmark_records(spark, folder)).select(
        "method", "field_accuracy", "required_field_missing_rate", "schema_adherence", "evidence_coverage",
        "average_confidence", "selective_accuracy", "accepted_field_count", "repair_success_rate", "sample_count",
        "success_count", "failure_count", "runtime_ms", "estimated_token_cost", "actual_input_tokens",
        "partial_actual_input_tokens", "token_usage_missing_calls", "model_call_count", "program_reuse_rate")


@query(f"""WITH {_SCORES}, {_DIRECT}, s AS (SELECT method, count(*) FILTER (has_gold AND round(conf,4)>=0.8 AND coalesce(val,'')<>'') AS accepted
    FROM j GROUP BY 1 UNION ALL SELECT 'Direct LLM', t0 FROM d)
  SELECT method, metric, CASE metric WHEN 'evidence_precision' THEN 'independent evidence annotations are absent'
      WHEN 'selective_accuracy' THEN 'no accepted fields at the configured confidence threshold'
      WHEN 'repair_success_rate' THEN 'method does not attempt verifier-directed repair'
      WHEN 'program_reuse_rate' THEN 'method is not a program method'
      ELSE CASE method WHEN 'Direct LLM' THEN 'provider usage missing for one or more calls' ELSE 'no model calls' END END AS reason
  FROM s, d, (VALUES ('evidence_precision'),('selective_accuracy'),('repair_success_rate'),('program_reuse_rate'),
    ('actual_input_tokens'),('actual_output_tokens')) m(metric)
  WHERE metric='evidence_precision' OR (metric IN ('actual_input_tokens','actual_output_tokens') AND method<>'LLM + Schema'
    AND (method<>'Direct LLM' OR n1>0)) OR (metric='selective_accuracy' AND accepted=0)
    OR (metric='repair_success_rate' AND method<>'Ours Full') OR (metric='program_reuse_rate' AND method IN ('LLM + Schema','Direct LLM'))""")
def metric_provenance(spark, folder):
    rows = evaluate.score_methods(benchmark_records(spark, folder))
    return rows.select("method", F.explode("unavailable_reasons").alias("metric", "reason"))


@query(f"""WITH {sql.TEXT}, {_ANCHORED} SELECT 'Direct LLM' AS method, CAST(page_id AS VARCHAR) AS item_id,
  'Direct LLM: answer is not a JSON object' AS error FROM ttl WHERE page_id%4=1""")
def method_failures(spark, folder):
    rows = evaluate.sample_errors(benchmark_records(spark, folder))
    return rows.select("method", "item_id", F.explode("errors").alias("error"))


@query(f"""WITH {sql.TEXT}, {_ANCHORED}, {_DIRECT}
  SELECT id AS page_id, unnest(['title','publisher']) AS field_name, unnest(CASE m WHEN 0 THEN ['title','publisher']
    ELSE ['Page Title','publisherName'] END) AS key, CASE m WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score,
    unnest([title, host]) AS value FROM page WHERE m IN (0,2)""")
def open_record_alignment(spark, folder):
    """Keys of schema-free answers paired with schema fields, and the values the fields take."""
    rows = pages(spark, folder).select("page_id", "url", tx.title_of("html").alias("title"))
    rows = rows.withColumn("entries", ans.open_record(open_answer())).withColumn("fields", page_program()[0])
    pairs = rows.withColumn("pairs", alignment.align(F.col("entries")["key"], F.col("fields")))
    out = unfold(pairs, ["page_id", "entries"], F.col("pairs"))
    value = F.get(F.filter("entries", lambda e: e["key"] == F.col("key")), F.lit(0))["value"]
    return out.select("page_id", "field_name", "key", "score", value.alias("value"))


def marked_spans(pages: DataFrame) -> DataFrame:
    """Spans an annotator might have marked: whole, shifted, cut or missing, by page."""
    rows = pages.select("page_id", tx.join_lines(F.col("lines")).alias("text"), web.host(F.col("url")).alias("host"), "title")
    at, size, kind = tx.locate(F.col("text"), F.col("host")), F.length("host"), F.col("page_id") % 5
    host = F.struct(F.lit("publisher").alias("field_name"), (at + F.when(kind == 1, size - 2).when(kind == 2, -3).otherwise(0)).alias("start_char"),
                    (at + F.when(kind == 1, size + 40).when(kind == 2, 4).otherwise(size)).alias("end_char"))
    half = F.struct(F.lit("title").alias("field_name"), F.lit(0).alias("start_char"), F.floor(F.length("title") / 2).cast("int").alias("end_char"))
    return unfold(rows, ["page_id"], F.when(kind == 3, F.array()).when(kind == 4, F.array(host, half)).otherwise(F.array(host)))


_PRECISION = rf"""{_SCORES}, {_DIRECT}, spot AS (SELECT page_id AS id, page_id%5 AS kind, strpos(txt,host)-1 AS p, length(host) AS n, length(title) AS t
    FROM view JOIN page ON id=page_id),
marks AS (SELECT id, 'publisher' AS field, p+CASE kind WHEN 1 THEN n-2 WHEN 2 THEN -3 ELSE 0 END AS a,
    p+CASE kind WHEN 1 THEN n+40 WHEN 2 THEN 4 ELSE n END AS b FROM spot WHERE kind<>3 AND p>=0
  UNION ALL SELECT id, 'publisher', NULL, NULL FROM spot WHERE kind<>3 AND p<0
  UNION ALL SELECT id, 'title', 0, t//2 FROM spot WHERE kind=4),
spans AS (SELECT method, id, field, s, e FROM (VALUES ('Program Only'),('Hybrid without Verifier'),('Ours Full')) v(method), fr WHERE field IN ('title','publisher')),
hit AS (SELECT DISTINCT method, spans.id, field FROM spans JOIN marks USING (id, field)
  WHERE s<e AND a<b AND least(e,b)-greatest(s,a)>=0.5*(b-a)),
shown AS (SELECT method, id, count(*) FILTER (coalesce(val,'')<>'' AND ev IS NOT NULL) AS k FROM runs GROUP BY 1,2
  UNION ALL SELECT 'Direct LLM', id, CASE WHEN m=0 AND title<>'' THEN 1 ELSE 0 END FROM page)"""


@query(f"""WITH {_PRECISION}, one AS (SELECT method, id, k, (SELECT count(DISTINCT field) FROM marks WHERE marks.id=shown.id) AS marked,
    (SELECT count(*) FROM hit WHERE hit.id=shown.id AND hit.method=shown.method) AS met FROM shown)
  SELECT method, round(sum(met)/sum(greatest(k,marked)),4) AS evidence_precision, sum(met)::BIGINT AS fields_met,
    sum(marked)::BIGINT AS fields_marked FROM one GROUP BY 1""")
def evidence_precision(spark, folder):
    """Evidence against independently marked spans, which it may meet in part."""
    rows = seen(spark, folder)
    runs = durable(benchmark_runs(spark, rows))
    marks = marked_spans(rows)
    records = evaluate.to_records(alignment.annotate(runs, evaluate.evidence_spans(runs), marks, "page_id"), gold(rows))
    told = records.groupBy("method").agg(
        F.sum(F.coalesce(F.size(F.map_filter("annotations", lambda _, v: v)), F.lit(0))).alias("fields_met"),
        F.sum(F.coalesce(F.size("annotations"), F.lit(0))).alias("fields_marked"))
    return evaluate.score_methods(records).select("method", "evidence_precision").join(told, "method")


@query(f"""WITH {_FOUND}, l AS (SELECT page_id AS id, regexp_extract(url,'^https?://[^/]*/([a-z][a-z])/',1) AS lang FROM pages)
  SELECT id AS page_id, lang AS schema_id, CASE WHEN lang='en' THEN max(val) FILTER (field='title') END AS title,
    max(val) FILTER (field='publisher') AS publisher, lang='en' AS parsed FROM fr JOIN l USING (id) WHERE lang IN ('en','de','fr','es')
  GROUP BY 1,2""")
def programs_by_language(spark, folder):
    """A program per language: one with a DOM rule, the others on text alone and so never parsed."""
    fields, rules = page_program()
    names = F.array(*[F.lit(n) for n in ("title", "publisher")])
    picked = F.filter(rules, lambda r: F.array_contains(names, r["field_name"]))
    lang = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]))
    programs = spark.range(1).select(lang.alias("schema_id")).select(
        "schema_id", F.filter(fields, lambda f: F.array_contains(names, f["name"])).alias("fields"),
        F.filter(picked, lambda r: (F.col("schema_id") == "en") | (r["strategy"] != "css")).alias("rules"))
    rows = pages(spark, folder).withColumn("schema_id", F.regexp_extract("url", "^https?://[^/]*/([a-z][a-z])/", 1))
    done = extract.extract_fields(extract.prepare(rows, programs)).withColumn("parsed", F.size("nodes") > 0)
    return extract.wide_records(done, ["title", "publisher"], "page_id", "schema_id", "parsed")
