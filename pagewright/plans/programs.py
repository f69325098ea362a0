"""Schema and program queries: one proposed schema or program per part, supplier or event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import unfold
from ..operators import evaluate, signature, specs
from ..sources.sinks import upsert_programs
from ..sources.tables import explode_items, items_without_schema, require_schemas, table
from .pages import big
from .registry import query


def _field(name, description, kind, required, aliases=None):
    def c(x):
        return x if not isinstance(x, (str, bool)) else F.lit(x)

    return F.struct(
        c(name).alias("name"), c(description).alias("description"), c(kind).alias("type"), c(required).alias("required"),
        (specs._strings() if aliases is None else aliases).alias("aliases"), specs._strings().alias("examples")) \
        .cast(specs.FIELD_TYPE)


def part_schemas(spark, folder) -> DataFrame:
    p = table(spark, folder, "part")
    described = F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.col("p_brand"))
    dated = F.when(F.col("p_size") % 2 == 0, F.lit("发布日期")).otherwise(F.lit("何时"))
    fields = F.when(F.col("p_size") == 1, F.array().cast(f"array<{specs.FIELD_TYPE}>")).otherwise(F.array(
        _field("title", F.col("p_type"), "text", True), _field(F.col("p_name"), described, "text", F.col("p_size") % 3 == 0),
        _field("publish_date", dated, "date", False, F.array(F.lit("日期"), F.col("p_brand")))))
    bare = F.when(F.col("p_size") % 7 == 0, F.transform(fields, lambda f: F.struct(
        f["name"], f["description"], f["type"], f["required"], specs._strings(), f["examples"]).cast(specs.FIELD_TYPE)))
    return p.select(F.col("p_partkey").alias("schema_id"), F.col("p_type").alias("name"),
                    F.col("p_name").alias("description"), F.lit("parts").alias("domain"),
                    F.coalesce(bare, fields).alias("fields"))


@query("""SELECT p_partkey AS schema_id, array_to_string(list_filter(CASE WHEN p_size=1 THEN ['schema must contain at least one field'] ELSE [
    CASE WHEN p_size%3=0 AND p_size%5=0 THEN 'required field '''||p_name||''' should include a description' END,
    CASE WHEN p_size%2<>0 AND p_size%7=0 THEN 'date field ''publish_date'' should include date/time semantics' END] END,
    lambda x: x IS NOT NULL),'; ') AS errors,
  NOT (p_size=1 OR (p_size%3=0 AND p_size%5=0) OR (p_size%2<>0 AND p_size%7=0)) AS valid FROM part""")
def schema_validation(spark, folder):
    return specs.validate_schemas(part_schemas(spark, folder)).select(
        "schema_id", F.array_join("errors", "; ").alias("errors"), "valid")


_RULES = """r AS (SELECT p_partkey AS id, p_type, p_name, trim(CASE WHEN p_size%5=0 THEN ' ' ELSE p_brand END) AS d0,
    CASE WHEN p_size%5=0 THEN ' ' ELSE p_brand END AS described, CASE WHEN p_size%2=0 THEN '发布日期' ELSE '何时' END AS dated,
    p_brand, p_size FROM part WHERE p_size<>1),
  lab AS (SELECT id, 0 AS f, 'title' AS field, 'text' AS kind, ['title', p_type] AS labels, ['title', p_type] AS pat FROM r
    UNION ALL SELECT id, 1, p_name, 'text', [p_name, described], [p_name, described] FROM r
    UNION ALL SELECT id, 2, 'publish_date', 'date', CASE WHEN p_size%7=0 THEN ['publish_date', dated] ELSE ['publish_date', dated, p_brand] END,
      CASE WHEN p_size%7=0 THEN ['publish_date', dated] ELSE ['publish_date', dated, '日期', p_brand] END FROM r),
  rules AS (SELECT id, f, 0 AS grp, n, field AS field_name, 'css' AS strategy, s AS selector, NULL AS label, NULL AS pattern
    FROM lab, (VALUES (1,'h1'),(2,'*[class*=''title''] h2'),(3,'*[class*=''title''] h3')) v(n,s) WHERE field='title'
    UNION ALL SELECT id, f, 1, n, field, 'text_near_label', NULL, labels[n], NULL FROM lab, unnest(range(1,len(labels)+1)) t(n)
    UNION ALL SELECT id, f, 2, 1, field, 'regex_on_text', NULL, NULL, '(?:'||array_to_string(list_transform(pat,
      lambda x: replace(x,'#','\\#')),'|')||')\\s*[：:\\-]\\s*(\\d{4}\\s*[年\\-/\\.]\\s*\\d{1,2}\\s*[月\\-/\\.]\\s*\\d{1,2}\\s*日?)'
      FROM lab WHERE kind='date'
    UNION ALL SELECT id, f, 3, 1, field, 'llm_fallback', NULL, NULL, NULL FROM lab)"""


@query(f"""WITH {_RULES} SELECT id AS schema_id, row_number() OVER (PARTITION BY id ORDER BY f, grp, n)-1 AS rule_pos, field_name,
  strategy, selector, label, pattern FROM rules""")
def default_programs(spark, folder):
    rows = specs.rule_table(specs.build_programs(part_schemas(spark, folder)))
    return rows.select("schema_id", big("rule_pos"), "field_name", "strategy", "selector", "label", "pattern")


@query("""SELECT p_partkey AS schema_id, field_name, array_to_string(strategies,',') AS strategies, n AS labels FROM (
  SELECT p_partkey, 'title' AS field_name, ['css','xpath','text_near_label','llm_fallback'] AS strategies, 2 AS n FROM part WHERE p_size<>1
  UNION ALL SELECT p_partkey, p_name, ['text_near_label','regex_on_text','llm_fallback'], 2 FROM part WHERE p_size<>1
  UNION ALL SELECT p_partkey, 'publish_date', ['text_near_label','regex_on_text','llm_fallback'],
    CASE WHEN p_size%7=0 THEN 2 ELSE 4 END FROM part WHERE p_size<>1)""")
def extraction_plans(spark, folder):
    rows = unfold(part_schemas(spark, folder), ["schema_id"], specs.plan_fields(F.col("fields")))
    return rows.select("schema_id", "field_name", F.array_join("strategies", ",").alias("strategies"),
                       F.size("labels").cast("bigint").alias("labels"))


# -- proposed rules --------------------------------------------------------------------------

# One candidate rule per part; the part key picks the kind of mistake.
_CANDIDATE = """SELECT p_partkey AS id, CASE p_partkey%10 WHEN 0 THEN 'ghost' WHEN 1 THEN NULL ELSE 'title' END AS field_name,
  CASE p_partkey%10 WHEN 2 THEN 'script' WHEN 3 THEN 'css' WHEN 4 THEN 'xpath' WHEN 5 THEN 'regex_on_text'
    WHEN 6 THEN 'text_near_label' WHEN 7 THEN 'llm_fallback' WHEN 8 THEN 'css' ELSE 'xpath' END AS strategy,
  CASE p_partkey%10 WHEN 3 THEN concat(' .',replace(p_name,' ','-'),CASE WHEN p_size%2=0 THEN '' ELSE ' <b>' END,' ')
    WHEN 4 THEN CASE WHEN p_size%2=0 THEN '//h1' ELSE 'h1' END WHEN 8 THEN 'time' WHEN 9 THEN '//time'
    ELSE NULL END AS selector,
  CASE p_partkey%10 WHEN 8 THEN CASE WHEN p_size%2=0 THEN 'datetime' ELSE '1bad' END WHEN 9 THEN ' ' END AS attribute,
  CASE p_partkey%10 WHEN 5 THEN concat('(',p_brand,CASE WHEN p_size%2=0 THEN ')' ELSE '' END) END AS pattern,
  CASE p_partkey%10 WHEN 6 THEN CASE WHEN p_size%2=0 THEN p_type ELSE ' ' END END AS label FROM {part}"""
_SQL = _CANDIDATE.replace("{part}", "part")


def candidates(spark, folder) -> DataFrame:
    rows = spark.sql(_CANDIDATE, part=table(spark, folder, "part"))
    return rows.withColumn("rule", specs._rule(
        F.col("field_name"), F.col("strategy"), F.col("selector"), F.col("attribute"), F.col("pattern"), F.col("label"),
        postprocess=specs._strings("normalize_whitespace", "evil")))


@query(f"""WITH c AS ({_SQL}), j AS (SELECT *, CASE WHEN field_name IS NULL THEN '已忽略未知字段的 ProgramSpec 规则：未命名字段'
    WHEN field_name='ghost' THEN '已忽略未知字段的 ProgramSpec 规则：ghost'
    WHEN strategy='script' THEN '已忽略字段 title 的非白名单策略：script'
    WHEN (strategy='css' AND (selector IS NULL OR selector LIKE '%<%')) OR (strategy='xpath' AND coalesce(selector,'') NOT LIKE '//%')
      OR (strategy='regex_on_text' AND pattern NOT LIKE '%)') OR (strategy='text_near_label' AND trim(label)='')
      OR attribute='1bad' THEN '已忽略字段 title 的不完整或不安全 ProgramSpec 规则' END AS issue FROM c)
  SELECT id, issue, CASE WHEN issue IS NULL THEN strategy END AS strategy, CASE WHEN issue IS NULL THEN trim(selector) END AS selector,
    CASE WHEN issue IS NULL THEN nullif(trim(attribute),'') END AS attribute, CASE WHEN issue IS NULL THEN pattern END AS pattern,
    CASE WHEN issue IS NULL THEN label END AS labels,
    CASE WHEN issue IS NULL THEN 'strip,normalize_whitespace' END AS postprocess FROM j""")
def sanitize_rules(spark, folder):
    types = F.create_map(F.lit("title"), F.lit("text"))
    rows = candidates(spark, folder).select("id", specs.clean_rule(F.col("rule"), types).alias("c"))
    r = F.col("c.rule")
    return rows.select("id", F.col("c.issue").alias("issue"), r["strategy"].alias("strategy"),
                       r["selector"].alias("selector"), r["attribute"].alias("attribute"), r["pattern"].alias("pattern"),
                       F.nullif(F.array_join(r["labels"], ","), F.lit("")).alias("labels"),
                       F.array_join(r["postprocess"], ",").alias("postprocess"))


@query(f"""WITH c AS ({_SQL}) SELECT id, CASE WHEN strategy IN ('css','xpath') AND coalesce(trim(selector),'')=''
    THEN field_name||': '||strategy||' requires selector' WHEN strategy='text_near_label' AND trim(label)=''
    THEN field_name||': text_near_label requires label or labels' WHEN strategy='script' THEN field_name||': unsupported strategy'
    END AS problem FROM c""")
def rule_shape_errors(spark, folder):
    return candidates(spark, folder).select("id", specs.shape_error(F.col("rule")).alias("problem"))


def _pairs(spark, folder) -> DataFrame:
    """A preferred and a fallback program per part, with equal and repeated rules."""
    p = table(spark, folder, "part")

    def near(field, label):
        return specs._rule(field, "text_near_label", label=label, labels=F.array(label))

    a, b = F.col("p_name"), F.col("p_brand")
    even = F.col("p_size") % 2 == 0
    preferred = F.array(near("title", a), near("body", b), near("title", b), near("title", a))
    fallback = F.array(near("title", F.when(even, a).otherwise(F.lit("x"))), near("extra", b), near("ghost", b))
    return p.select(F.col("p_partkey").alias("id"), preferred.alias("preferred"), fallback.alias("fallback"))


@query("""WITH c AS (SELECT p_partkey AS id, src, pos, field, CASE lab WHEN 'a' THEN p_name WHEN 'b' THEN p_brand
      WHEN 'm' THEN CASE WHEN p_size%2=0 THEN p_name ELSE 'x' END END AS label, fpos FROM part, (VALUES (0,0,'title','a',1),(0,1,'body','b',0),
      (0,2,'title','b',1),(0,3,'title','a',1),(1,0,'title','m',1),(1,1,'extra','b',2)) v(src,pos,field,lab,fpos)),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, field, label ORDER BY src, pos) AS seen FROM c)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY fpos, src, pos)-1 AS rule_pos, field AS field_name, label FROM k WHERE seen=1""")
def merge_rules(spark, folder):
    merged = specs.merge_rules(F.col("preferred"), F.col("fallback"), specs._strings("body", "title", "extra"))
    rows = specs.rule_table(_pairs(spark, folder).withColumn("rules", merged), "id")
    return rows.select("id", big("rule_pos"), "field_name", "label")


@query("""SELECT p_partkey AS id, n AS rule_pos, f AS field_name FROM part, (VALUES (0,'title'),(1,'body'),(2,'title'),(3,'title'),
  (4,'extra'),(5,'ghost')) v(n,f)""")
def cover_missing_fields(spark, folder):
    merged = specs.cover_missing_fields(F.col("preferred"), F.col("fallback"))
    rows = specs.rule_table(_pairs(spark, folder).withColumn("rules", merged), "id")
    return rows.select("id", big("rule_pos"), "field_name")


@query(f"""WITH c AS ({_SQL}), ok AS (SELECT id, strategy FROM c WHERE field_name='title' AND strategy<>'script'
    AND NOT ((strategy='css' AND (selector IS NULL OR selector LIKE '%<%')) OR (strategy='xpath' AND coalesce(selector,'') NOT LIKE '//%')
      OR (strategy='regex_on_text' AND pattern NOT LIKE '%)') OR (strategy='text_near_label' AND trim(label)='')
      OR coalesce(attribute,'')='1bad'))
  SELECT p_partkey AS id, CASE WHEN ok.id IS NULL THEN 'llm_fallback' WHEN ok.strategy='llm_fallback' THEN 'llm_fallback,llm_fallback'
    ELSE ok.strategy||',llm_fallback' END AS strategies FROM part LEFT JOIN ok ON ok.id=p_partkey""")
def safe_programs(spark, folder):
    fields = F.array(_field("title", "title", "text", True))
    fallback = F.array(specs._rule("title", "llm_fallback", postprocess=specs._strings("strip")))
    rows = candidates(spark, folder).withColumn("rules", specs.safe_program(F.array("rule"), fallback, fields))
    return rows.select("id", F.array_join("rules.strategy", ",").alias("strategies"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey%3 WHEN 0 THEN '自动字段契约 - '||left(s_name,24) ELSE s_name END AS name,
  CASE s_suppkey%4 WHEN 0 THEN 'title,price_usd,field_2nd' ELSE 'price_usd,title,field_2nd' END AS fields,
  CASE s_suppkey%4 WHEN 0 THEN 'text,string,date' ELSE 'string,text,date' END AS types FROM supplier""")
def inferred_schemas(spark, folder):
    s = table(spark, folder, "supplier")
    extra = F.when(F.col("s_suppkey") % 4 != 0, _field("Title", "t", "text", True))
    fields = F.array_compact(F.array(
        _field("价格 Price-USD!", "p", "money", True), extra, _field("2nd", "d", "date", False),
        _field("price usd", "again", "text", True), _field("价格", "none", "text", True)))
    named = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    rows = s.select(F.col("s_suppkey").alias("id"), specs.clean_schema(
        named, F.lit("d"), F.lit(None).cast("string"), fields, F.col("s_name")).alias("x"))
    return rows.select("id", F.col("x.name").alias("name"), F.array_join("x.fields.name", ",").alias("fields"),
                       F.array_join("x.fields.type", ",").alias("types"))


# -- registries ------------------------------------------------------------------------------

_SIG = "sha256(event_type||'-'||(user_id%{n}))"


def _registry(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    known = e.select(F.col("event_type").alias("schema_name"), (F.col("user_id") % 3).alias("k")).distinct()
    sig = F.sha2(F.concat_ws("-", "schema_name", F.col("k").cast("string")), 256)
    return known.select(sig.alias("schema_signature"), "schema_name", (F.col("k") + 1).alias("version"),
                        F.when(F.col("k") == 0, "builtin").otherwise("runtime").alias("source"))


def _arrivals(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    sig = F.sha2(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")), 256)
    return e.select(sig.alias("schema_signature"), F.col("event_type").alias("schema_name"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                    F.col("event_id").alias("arrival"))


_VERSIONS = f"""reg AS (SELECT DISTINCT {_SIG.format(n=3)} AS sig, event_type AS name, user_id%3+1 AS v,
    CASE user_id%3 WHEN 0 THEN 'builtin' ELSE 'runtime' END AS src FROM events),
  arr AS (SELECT {_SIG.format(n=20)} AS sig, event_type AS name, min(event_id) AS first, arg_max('u'||user_id, event_id) AS src
    FROM events GROUP BY 1,2),
  new AS (SELECT arr.*, row_number() OVER (PARTITION BY arr.name ORDER BY first) AS n FROM arr WHERE sig NOT IN (SELECT sig FROM reg)),
  ver AS (SELECT reg.sig AS schema_signature, reg.name AS schema_name, v AS version, coalesce(arr.src,reg.src) AS source
    FROM reg LEFT JOIN arr USING (sig)
  UNION ALL SELECT sig, name, n+(SELECT max(v) FROM reg r WHERE r.name=new.name), src FROM new)"""


@query(f"WITH {_VERSIONS} SELECT * FROM ver")
def schema_versions(spark, folder):
    return specs.register_versions(_registry(spark, folder), _arrivals(spark, folder))


@query(f"WITH {_VERSIONS} SELECT * FROM ver WHERE schema_name='click' AND source NOT IN ('builtin','system')")
def listed_versions(spark, folder):
    done = specs.register_versions(_registry(spark, folder), _arrivals(spark, folder))
    return specs.user_schemas(specs.list_versions(done, "click"))


@query("""SELECT s_suppkey AS schema_id, sha256('{"description":"'||n_name||'","domain":"supply","fields":[{"aliases":["'||s_name||
  '"],"description":"d","examples":[],"name":"f","required":true,"type":"text"}],"name":"'||s_name||'"}') AS sig
  FROM supplier JOIN nation ON s_nationkey=n_nationkey""")
def content_signatures(spark, folder):
    s = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fields = F.array(_field("f", "d", "text", True, F.array(F.col("s_name"))))
    return s.select(F.col("s_suppkey").alias("schema_id"), specs.schema_signature(
        F.col("s_name"), F.col("n_name"), F.lit("supply"), fields).alias("sig"))


@query("""SELECT p_partkey AS item_id, method, method<>'Direct LLM' AS schema_input, method='Ours Full' AS verifier,
  method='Ours Full' AS repair, count(*) OVER (PARTITION BY p_brand, method) AS same_program
  FROM part, (VALUES ('Direct LLM'),('LLM + Schema'),('Program Only'),('Hybrid without Verifier'),('Ours Full')) m(method)""")
def experiment_records(spark, folder):
    """Items with the same program share its signature."""
    p = table(spark, folder, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.array(specs._rule(
        "title", "text_near_label", label=F.col("p_brand"))).alias("rules"))
    rows = evaluate.program_signatures(items)
    shared = rows.groupBy("program_signature", "method").agg(F.count("*").alias("same_program"))
    return rows.join(shared, ["program_signature", "method"]).select(
        "item_id", "method", "schema_input", "verifier", "repair", "same_program")


# -- signatures and reuse --------------------------------------------------------------------

def _order_signature(shift: int):
    """Structure signatures as an order's numbers would give them."""
    k = F.col("o_orderkey") + shift * F.col("o_custkey")
    return F.struct(
        F.lit("1").alias("signature_version"), F.when(k % 4 == 0, "list").otherwise("article").alias("page_intent"),
        F.when(k % 5 == 0, specs._strings("h1", "h2")).otherwise(specs._strings("h1")).alias("title_shape"),
        specs._strings("article").alias("content_shape"), F.lit(1).alias("heading_count"),
        F.lit(3).alias("text_block_count"), ((k % 11) / 10.0).alias("repeated_item_ratio"),
        F.create_map(F.lit("title"), (k % 3).cast("int"),
                     F.when(k % 2 == 0, "body").otherwise("side"), F.lit(1)).alias("selector_match_counts"),
        F.when(k % 13 != 0, (k % 10) / 10.0).alias("body_visible_text_coverage"),
        F.when(k % 17 != 0, F.lit(0.9)).alias("body_continuity_score"),
        ((k % 7) / 10.0).alias("body_noise_ratio")).cast(signature.SIGNATURE_TYPE)


def _num(k):
    return f"""({k})%4=0 AS i_{{x}}, ({k})%5=0 AS t_{{x}}, (({k})%11)/10.0 AS r_{{x}}, ({k})%3 AS m_{{x}}, ({k})%2=0 AS b_{{x}},
      CASE WHEN ({k})%13<>0 THEN (({k})%10)/10.0 END AS c_{{x}}, CASE WHEN ({k})%17<>0 THEN 0.9 END AS q_{{x}}, (({k})%7)/10.0 AS n_{{x}}"""


_COMPARED = f"""n AS (SELECT o_orderkey AS id, o_custkey, {_num("o_orderkey").format(x="e")}, {_num("o_orderkey+o_custkey").format(x="a")} FROM orders),
  w AS (SELECT *, list_filter([CASE WHEN i_e<>i_a THEN 'page_intent_mismatch' END, CASE WHEN t_e<>t_a THEN 'title_shape_mismatch' END,
      CASE WHEN abs(r_e-r_a)>0.35 THEN 'repeated_item_ratio_out_of_range' END,
      CASE WHEN c_e IS NULL OR c_a IS NULL THEN 'missing_body_coverage' WHEN abs(c_e::DOUBLE-c_a::DOUBLE)>0.45 THEN 'body_coverage_out_of_range' END,
      CASE WHEN abs(n_e::DOUBLE-n_a::DOUBLE)>0.35 THEN 'body_noise_ratio_out_of_range' END,
      CASE WHEN m_e=1 AND m_a<>1 THEN 'selector_match_mismatch:title' END,
      CASE WHEN b_e AND NOT b_a THEN 'missing_selector_match:body' WHEN NOT b_e AND b_a THEN 'missing_selector_match:side' END],
      lambda x: x IS NOT NULL) AS why, c_e IS NULL OR c_a IS NULL OR q_e IS NULL OR q_a IS NULL AS unknown FROM n),
  v AS (SELECT *, CASE WHEN len(list_filter(why, lambda x: NOT starts_with(x,'missing_')))>0 THEN 'incompatible' WHEN unknown THEN 'unknown'
      ELSE 'compatible' END AS status, CASE WHEN len(list_filter(why, lambda x: NOT starts_with(x,'missing_') OR starts_with(x,'missing_selector_match:')))>0
      THEN 'incompatible' WHEN unknown THEN 'unknown' ELSE 'compatible' END AS strict_status FROM w)"""


@query(f"""WITH {_COMPARED} SELECT id, status, strict_status, CASE WHEN status='compatible' THEN '' ELSE array_to_string(why,',') END AS reasons FROM v""")
def signature_compatibility(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows = o.select(F.col("o_orderkey").alias("id"), _order_signature(0).alias("e"), _order_signature(1).alias("a"))
    return rows.select("id", signature.compare(F.col("e"), F.col("a")).alias("v"),
                       signature.compare(F.col("e"), F.col("a"), strict=True)["status"].alias("strict_status")) \
        .select("id", "v.status", "strict_status", F.array_join("v.reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT c_custkey, c_custkey%3<>0 AS verified, c_custkey%5<>0 AS has, (c_custkey%11)/10.0 AS r FROM customer)
  SELECT o_orderkey AS page_id, CASE WHEN verified IS NOT TRUE THEN 'unknown' WHEN NOT has OR o_orderkey%19=0 THEN 'unknown'
    WHEN abs(r::DOUBLE-((o_orderkey%11)/10.0)::DOUBLE)>0.35 THEN 'incompatible' ELSE 'compatible' END AS status,
    CASE WHEN verified IS NOT TRUE THEN 'no_verified_program' WHEN NOT has OR o_orderkey%19=0 THEN 'missing_structure_signature'
    WHEN abs(r::DOUBLE-((o_orderkey%11)/10.0)::DOUBLE)>0.35 THEN 'repeated_item_ratio_out_of_range' ELSE '' END AS reasons,
    CASE WHEN verified AND has AND o_orderkey%19<>0 AND abs(r::DOUBLE-((o_orderkey%11)/10.0)::DOUBLE)<=0.35 THEN c_custkey END AS program_id
  FROM orders LEFT JOIN p ON c_custkey=o_custkey""")
def program_reuse(spark, folder):
    """Pages (orders) of many schemas (customers) meet the verified program of their schema."""
    def structure(k):
        return F.struct(
            F.lit("1").alias("signature_version"), F.lit("article").alias("page_intent"),
            specs._strings("h1").alias("title_shape"), specs._strings("article").alias("content_shape"),
            F.lit(1).alias("heading_count"), F.lit(1).alias("text_block_count"),
            ((k % 11) / 10.0).alias("repeated_item_ratio"), F.create_map().cast("map<string,int>").alias("c"),
            F.lit(1.0).alias("v"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z")).cast(signature.SIGNATURE_TYPE)

    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("schema_signature"),
        F.when(F.col("o_orderkey") % 19 != 0, structure(F.col("o_orderkey"))).alias("structure"))
    key = F.col("c_custkey")
    programs = table(spark, folder, "customer").select(
        key.alias("schema_signature"), key.alias("program_id"), (key % 3 != 0).alias("user_verified"),
        F.when(key % 5 != 0, structure(key)).alias("structure"))
    return signature.resolve_programs(o, programs).select(
        "page_id", "reuse.status", F.array_join("reuse.reasons", ",").alias("reasons"), "program_id")


def _stored_programs(spark, folder) -> DataFrame:
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("schema_signature"), F.col("c_mktsegment").alias("schema_name"), (key % 2 == 0).alias("user_verified"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("rule_name"),
        F.array_repeat(F.lit("r"), (key % 4).cast("int")).alias("rules"),
        F.when(key % 5 != 0, F.concat(F.lit("old"), key.cast("string"))).alias("structure"), key.alias("created_at"))


@query("""SELECT c_custkey AS schema_signature, CASE WHEN c_custkey%3=0 THEN c_mktsegment ELSE c_name END AS rule_name,
  c_custkey%4 AS program_count FROM customer WHERE c_custkey%2=0""")
def verified_programs(spark, folder):
    return signature.verified_programs(_stored_programs(spark, folder)).select(
        "schema_signature", "rule_name", big("program_count"))


@query("""WITH u AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS rule_name,
    arg_max('new'||o_orderkey, o_orderkey) FILTER (o_orderkey%2=0) AS any_s,
    arg_max(CASE WHEN o_orderkey%2=0 THEN 'new'||o_orderkey ELSE '' END, o_orderkey) AS last_s FROM orders GROUP BY 1)
  SELECT coalesce(c_custkey,k) AS schema_signature, coalesce(u.rule_name, CASE WHEN c_custkey%3=0 THEN ' ' ELSE c_name END) AS rule_name,
    coalesce(nullif(last_s,''), any_s, CASE WHEN c_custkey%5<>0 THEN 'old'||c_custkey END) AS structure
  FROM customer FULL JOIN u ON k=c_custkey""")
def program_upsert(spark, folder):
    o = table(spark, folder, "orders")
    updates = o.select(
        F.col("o_custkey").alias("schema_signature"), F.lit("s").alias("schema_name"), F.lit(True).alias("user_verified"),
        F.col("o_orderpriority").alias("rule_name"), specs._strings("x").alias("rules"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("new"), F.col("o_orderkey").cast("string"))).alias("structure"),
        F.col("o_orderkey").alias("created_at"))
    return upsert_programs(_stored_programs(spark, folder), updates).select("schema_signature", "rule_name", "structure")


@query("""SELECT c_mktsegment AS dataset_name, 'item-'||c_custkey AS item_id, c_name AS url, c_custkey%4<>0 AS has_schema,
  CAST(c_nationkey AS VARCHAR) AS gold_nation FROM customer""")
def labelled_items(spark, folder):
    """Datasets as JSON text, one per customer, unfolded to items."""
    c = table(spark, folder, "customer")
    schema = F.when(F.col("c_custkey") % 4 != 0, F.struct(F.lit("s").alias("name"), F.array(F.struct(
        F.lit("nation").alias("name"), F.lit("text").alias("type"))).alias("fields")))
    item = F.struct(
        F.concat(F.lit("item-"), F.col("c_custkey").cast("string")).alias("item_id"), F.col("c_name").alias("url"),
        F.lit("<p>x</p>").alias("html"), schema.alias("schema_spec"),
        F.struct(F.col("c_nationkey").cast("string").alias("nation")).alias("gold_record"))
    items = explode_items(c.select(F.to_json(F.struct(
        F.col("c_mktsegment").alias("name"), F.array(item).alias("items"))).alias("payload")))
    lacking = items_without_schema(items).withColumn("has_schema", F.lit(False))
    whole = require_schemas(items.filter("schema_spec is not null")).withColumn("has_schema", F.lit(True))
    return whole.unionByName(lacking).select("dataset_name", "item_id", "url", "has_schema",
                                            F.col("gold_record")["nation"].alias("gold_nation"))
