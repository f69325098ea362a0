"""Label and date queries: every order rendered as a short notice, then read back.

Also the scalar functions over ``documents`` and ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import unfold
from ..functions import text as tx
from ..functions import web
from ..operators import answers as ans
from ..operators import evaluate, extract, specs, verify
from ..sources.tables import dump_payload, load_payload, spread, table, with_defaults
from . import sql
from .pages import big
from .registry import query

# name, description, type, required, aliases
NOTICE_FIELDS = (
    ("order_no", "订单号", "text", True, ()),
    ("customer", "客户", "text", True, ()),
    ("publish_date", "发布日期", "date", True, ("日期",)),
    ("deadline", "截止日期", "date", False, ("报名截止",)),
    ("priority", "优先级", "text", False, ()),
    ("amount", "金额", "number", True, ()),
)


def notice_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """One schema per order priority, so notices meet their program through a keyed lookup."""
    fields = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(t).alias("type"), F.lit(r).alias("required"),
        specs._strings(*a).alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE)
        for n, d, t, r, a in NOTICE_FIELDS])
    kinds = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("schema_id")).distinct()
    return kinds.withColumn("fields", fields)


# One SQL text serves both engines; it only renders the input.
def _date(expr: str) -> str:
    y, m, d = f"year({expr})", f"month({expr})", f"day({expr})"

    def s(x):
        return f"CAST({x} AS {{s}})"

    two = [f"lpad({s(x)},2,'0')" for x in (m, d)]
    return (f"CASE o_orderkey%4 WHEN 0 THEN concat({s(y)},'年',{s(m)},'月',{s(d)},'日') "
            f"WHEN 1 THEN concat({s(y)},'/',{s(m)},'/',{s(d)}) WHEN 2 THEN concat({s(y)},'.',{s(m)},'.',{s(d)}) "
            f"ELSE concat({s(y)},{two[0]},{two[1]}) END")


_DUE = "CASE WHEN o_orderkey%5=0 THEN o_orderdate ELSE o_orderdate + INTERVAL '20' DAY END"
_RENDER = f"""SELECT o_orderkey AS id, concat('订单号：',CAST(o_orderkey AS {{s}})) AS l1, concat('客户：',c_name) AS l2,
  concat(CASE WHEN o_orderkey%7=0 THEN '公告' ELSE '' END,'发布日期：',{_date("o_orderdate")}) AS l3,
  CASE WHEN o_orderkey%3<>0 THEN concat('报名截止：',{_date(_DUE)}) END AS l4,
  concat(CASE WHEN o_orderkey%2=0 THEN '- ' ELSE '' END,'优先级:',o_orderpriority) AS l5,
  o_orderpriority AS kind, CASE WHEN o_orderkey%11<>0 THEN concat('金额-',CASE WHEN o_orderkey%13=0 THEN '约' ELSE '' END,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS {{s}})) END AS l6,
  {_date("o_orderdate")} AS pub, {_date(_DUE)} AS due FROM orders JOIN customer ON o_custkey=c_custkey"""


def notices(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(_RENDER.format(s="STRING").replace(
        "FROM orders JOIN customer", "FROM {orders} JOIN {customer}"),
        orders=spread(table(spark, folder, "orders")), customer=table(spark, folder, "customer"))
    return rows.select(F.col("id").alias("page_id"), F.col("kind").alias("schema_id"),
                       F.array_compact(F.array("l1", "l2", "l3", "l4", "l5", "l6")).alias("lines")) \
        .withColumn("text", F.array_join("lines", "\n"))


def read_back(spark, folder) -> DataFrame:
    programs = specs.build_programs(notice_schemas(spark, folder))
    return extract.extract_fields(extract.with_programs(notices(spark, folder), programs))


def _label_sql(pos, name, kind, required, line, value):
    return f"""SELECT id, {pos} AS pos, '{name}' AS field, '{kind}' AS ftype, {required} AS required, {value} AS raw,
      {line} AS line, 'text_near_label' AS strategy, txt FROM src"""


_FOUND = f"""src0 AS ({_RENDER.format(s="VARCHAR")}), src AS (SELECT *, concat_ws(chr(10),l1,l2,l3,l4,l5,l6) AS txt FROM src0),
_r AS ({_label_sql(0, "order_no", "text", "true", "l1", "CAST(id AS VARCHAR)")}
  UNION ALL {_label_sql(1, "customer", "text", "true", "l2", "substring(l2,4)")}
  UNION ALL SELECT id, 2, 'publish_date', 'date', true, CASE WHEN id%7=0 AND id%4=3 THEN NULL ELSE pub END,
    CASE WHEN id%7=0 THEN concat('发布日期：',pub) ELSE l3 END, CASE WHEN id%7=0 THEN 'regex_on_text' ELSE 'text_near_label' END, txt FROM src
  UNION ALL {_label_sql(3, "deadline", "date", "false", "l4", "CASE WHEN l4 IS NOT NULL THEN due END")}
  UNION ALL {_label_sql(4, "priority", "text", "false", "l5", "CASE WHEN id%2=1 THEN substring(l5,5) END")}
  UNION ALL {_label_sql(5, "amount", "number", "true", "l6", "substring(l6,4)")}),
fr AS MATERIALIZED (SELECT id, pos, field, ftype, required, raw, CASE WHEN ftype='date' THEN {sql.iso_date("raw")} ELSE raw END AS val,
    CASE WHEN raw IS NOT NULL THEN {sql.snippet("txt", "(strpos(txt,line)-1)", "(strpos(txt,line)-1+length(line))")} END AS ev,
    CASE WHEN raw IS NULL THEN 0.0 ELSE CASE strategy WHEN 'regex_on_text' THEN 0.755 ELSE 0.855 END
      -CASE WHEN length(raw)<2 THEN 0.075 ELSE 0 END END AS conf,
    CASE WHEN raw IS NULL THEN 'none' ELSE strategy END AS strategy, CAST(NULL AS VARCHAR) AS err,
    CASE WHEN raw IS NULL THEN 'missing' ELSE 'extracted' END AS status,
    CASE WHEN raw IS NOT NULL THEN strpos(txt,line)-1 END AS s FROM _r)"""


@query(f"""WITH {_FOUND} SELECT id AS page_id, field AS field_name, raw AS value, val AS normalized_value, strategy,
  round(conf,4) AS confidence, ev AS evidence, s AS start_char FROM fr""")
def label_extraction(spark, folder):
    rows = extract.field_results(read_back(spark, folder))
    e = F.get("evidence", F.lit(0))
    return rows.select("page_id", "field_name", "value", "normalized_value", "strategy", "confidence",
                       e["text"].alias("evidence"), e["start_char"].cast("bigint").alias("start_char"))


@query(f"WITH {_FOUND}, {sql.ISSUES} {sql.REPORT}")
def notice_reports(spark, folder):
    return verify.report_rows(verify.verify(read_back(spark, folder))).select(
        "page_id", "passed", big("error_count"), big("warning_count"), "score")


@query(f"WITH {_FOUND}, {sql.ISSUES} SELECT field AS field_name, code, severity, count(*) AS issues FROM iss GROUP BY 1,2,3")
def verify_issue_counts(spark, folder):
    return verify.issue_rows(verify.verify(read_back(spark, folder))).groupBy(
        "field_name", "code", "severity").agg(F.count("*").alias("issues"))


@query(f"""WITH {_FOUND}, {sql.ISSUES}, x AS (SELECT id, field, arg_max(code, ord) AS code, arg_max(code, ord) FILTER (
    severity<>'warning') AS hard FROM iss GROUP BY 1,2)
  SELECT fr.id AS page_id, fr.field AS field_name,
  CASE WHEN required AND status='missing' THEN 'required_field_missing' WHEN conf<0.35 AND ev IS NULL THEN 'low_confidence'
    WHEN NOT required AND conf>=0.45 AND ev IS NOT NULL THEN x.hard ELSE x.code END AS reason
  FROM fr LEFT JOIN x ON x.id=fr.id AND x.field=fr.field
  WHERE (required AND status='missing') OR (conf<0.35 AND ev IS NULL)
    OR CASE WHEN NOT required AND conf>=0.45 AND ev IS NOT NULL THEN x.hard ELSE x.code END IS NOT NULL""")
def notice_fallback(spark, folder):
    rows = verify.decide_fallback(verify.verify(read_back(spark, folder)))
    return unfold(rows, ["page_id"], F.col("fallback"))


@query(f"""WITH {_FOUND} SELECT id AS page_id, field AS field_name, CASE WHEN required THEN 'field_not_returned' END AS code,
  CASE WHEN required THEN 'error' END AS severity FROM fr WHERE pos=id%6""")
def unreturned_fields(spark, folder):
    """Each notice's results without one field: an error if the field is required, else nothing."""
    rows = read_back(spark, folder).withColumn("results", F.filter(
        "results", lambda r: r["field_pos"] != F.col("page_id") % 6))
    judged = verify.verify(rows).withColumn("f", F.get("fields", (F.col("page_id") % 6).cast("int"))["name"])
    issue = F.get(F.filter("issues", lambda i: i["field_name"] == F.col("f")), F.lit(0))
    found = F.when(issue["code"] == "field_not_returned", issue)
    return judged.select("page_id", F.col("f").alias("field_name"), found["code"].alias("code"), found["severity"].alias("severity"))


@query(f"""WITH {_FOUND} SELECT id AS page_id, CASE WHEN kind IN ('1-URGENT','2-HIGH') OR id%5=0 THEN 0 ELSE count(*) END AS fields,
  CASE WHEN id%5=0 THEN 'no program for schema (none)' WHEN kind IN ('1-URGENT','2-HIGH') THEN 'no program for schema '||kind END AS program_error
  FROM fr JOIN (SELECT o_orderkey AS k, o_orderpriority AS kind FROM orders) o ON o.k=fr.id GROUP BY id, kind""")
def pages_without_program(spark, folder):
    """Notices of unknown and missing schemas stay, without results and with the reason."""
    programs = specs.build_programs(notice_schemas(spark, folder).filter("schema_id NOT IN ('1-URGENT','2-HIGH')"))
    rows = notices(spark, folder).withColumn("schema_id", F.when(F.col("page_id") % 5 != 0, F.col("schema_id")))
    out = extract.extract_fields(extract.with_programs(rows, programs))
    return out.select("page_id", F.size("results").cast("bigint").alias("fields"), "program_error")


@query(r"""WITH d AS (SELECT doc_id, doc_id%4 AS n, '🙂 '||text AS t FROM documents),
  m AS (SELECT *, regexp_extract(t,'(?i)[a-z]+ing',0) AS v FROM d)
  SELECT doc_id, CASE WHEN v<>'' THEN strpos(t,v)-1 END AS start_char, CASE WHEN v<>'' THEN strpos(t,v)-1+length(v) END AS end_char,
    CASE WHEN n=0 THEN 'invalid pattern: (open' WHEN n=1 THEN 'unsupported strategy: guess' END AS broken_rule FROM m""")
def pattern_offsets(spark, folder):
    """Offsets behind a character of two units; a rule that cannot run leaves the next field alone."""
    d = spread(table(spark, folder, "documents")).select("doc_id", F.concat(F.lit("🙂 "), "text").alias("text"))
    field = [F.struct(F.lit(n).alias("name"), F.lit("").alias("description"), F.lit("text").alias("type"), F.lit(False).alias("required"),
                      specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE) for n in ("bad", "good")]
    bad = F.when(F.col("doc_id") % 4 == 0, F.array(specs._rule("bad", "regex_on_text", pattern="(open"))).when(
        F.col("doc_id") % 4 == 1, F.array(specs._rule("bad", "guess"))).otherwise(F.array(specs._rule("bad", "text_near_label", label="§§")))
    rows = d.withColumn("lines", specs._strings()).withColumn("fields", F.array(*field)).withColumn(
        "rules", F.concat(bad, F.array(specs._rule("good", "regex_on_text", pattern="[a-z]+ing"))))
    done = extract.extract_fields(rows).select("doc_id", F.get("results", F.lit(0))["error_message"].alias("broken_rule"),
                                               F.get(F.get("results", F.lit(1))["evidence"], F.lit(0)).alias("e"))
    return done.select("doc_id", big("e.start_char"), big("e.end_char"), "broken_rule")


@query(f"""SELECT o_orderkey AS order_id, {_date("o_orderdate").format(s="VARCHAR")} AS written,
  strftime(o_orderdate,'%Y-%m-%d') AS iso, concat('共',CAST(o_orderkey AS VARCHAR),' 2024-13-99') AS broken FROM orders""")
def date_normalisation(spark, folder):
    rows = spark.sql(f"SELECT o_orderkey AS order_id, {_date('o_orderdate').format(s='STRING')} AS written FROM {{orders}}",
                     orders=table(spark, folder, "orders"))
    return rows.select("order_id", "written", tx.normalize_date(F.concat(F.lit("自 "), "written")).alias("iso"),
                       tx.normalize_date(F.concat(F.lit(" 共"), F.col("order_id").cast("string"), F.lit("  2024-13-99")))
                       .alias("broken"))


# -- scalar functions over whole texts -------------------------------------------------------

@query(r"""WITH d AS (SELECT doc_id, source, lang, text, trim(regexp_replace(text,'\s+',' ','g')) AS c,
    list_transform(string_split(text,chr(10)), lambda l: nullif(left(trim(regexp_replace(l,'\s+',' ','g')),120),'')) AS ls FROM documents),
  k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(c),'-','_'),' ','_'),
    '[^\x00-\x7F]','','g'),'[^a-z0-9_]','_','g'),'_+','_','g'),'_') AS ident FROM d)
  SELECT doc_id, nullif(left(CASE WHEN regexp_matches(ident,'^[0-9]') THEN 'field_'||ident ELSE ident END,64),'') AS identifier,
    nullif(left(c,240),'') AS safe, CASE WHEN length(trim(text,' '||chr(9)||chr(10)||chr(13))) BETWEEN 1 AND 500
      THEN trim(text,' '||chr(9)||chr(10)||chr(13)) END AS optional,
    greatest(1,length(text)//4) AS tokens, sha256(text) AS hash FROM k""")
def text_cleanup(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return d.select(
        "doc_id", tx.field_identifier(tx.collapse(F.col("text"))).alias("identifier"),
        tx.safe_text(F.col("text")).alias("safe"), tx.optional_text(F.col("text")).alias("optional"),
        tx.estimate_tokens(F.length("text")).cast("bigint").alias("tokens"),
        web.fingerprint(F.col("text")).alias("hash"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text,chr(10)),
    lambda l: left(trim(regexp_replace(l,'\s+',' ','g')),120)), lambda l: l<>'') AS ls FROM documents),
  u AS (SELECT doc_id, ls[n] AS v, min(n) AS n FROM d, unnest(range(1,len(ls)+1)) AS t(n) GROUP BY 1,2),
  r AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM u)
  SELECT doc_id, k AS item_no, v AS item FROM r WHERE k<=8""")
def distinct_text_lists(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return unfold(d, ["doc_id"], tx.safe_text_list(F.split("text", "\n")), "item", "p").select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("item_no"), "item")


@query(r"""SELECT doc_id, left(regexp_replace(replace(replace('see https://me:pw@site/'||source||' '||text,'token','[redacted]'),
  '@mail','[redacted]'),'(https?://)[^/\s@]+@','\1[redacted]@','g'),1000) AS redacted FROM documents""")
def redacted_documents(spark, folder):
    d = spread(table(spark, folder, "documents"))
    whole = F.concat(F.lit("see https://me:pw@site/"), "source", F.lit(" "), "text")
    return d.select("doc_id", web.redact(whole, ["token", "@mail", ""]).alias("redacted"))


@query("""WITH c AS (SELECT conv_id, turn, greatest(1,length(text)//4) AS est, CASE WHEN turn%3<>2 THEN length(text) END AS actual,
    role='assistant' OR turn%2=0 AS tried FROM conversations)
  SELECT conv_id, count(*) FILTER (tried) AS model_call_count, count(*) FILTER (tried AND actual IS NULL) AS token_usage_missing_calls,
    coalesce(sum(actual) FILTER (tried),0)::BIGINT AS partial_actual_input_tokens,
    coalesce(sum(est) FILTER (tried),0)::BIGINT AS estimated_input_tokens,
    CASE WHEN count(*) FILTER (tried AND actual IS NULL)=0 THEN coalesce(sum(actual) FILTER (tried),0)::BIGINT END AS actual_input_tokens
  FROM c GROUP BY 1""")
def token_accounting(spark, folder):
    c = table(spark, folder, "conversations")
    calls = c.select(
        "conv_id", ((F.col("role") == "assistant") | (F.col("turn") % 2 == 0)).alias("http_attempted"),
        F.when(F.col("turn") % 3 != 2, F.length("text")).alias("actual_input_tokens"),
        F.lit(1).alias("actual_output_tokens"),
        tx.estimate_tokens(F.length("text")).alias("estimated_input_tokens"), F.lit(0).alias("estimated_output_tokens"))
    return ans.token_metrics(calls, "conv_id").select(
        "conv_id", "model_call_count", "token_usage_missing_calls", "partial_actual_input_tokens",
        "estimated_input_tokens", "actual_input_tokens")


@query("""WITH c AS (SELECT conv_id, turn, role, left(trim(text),40) AS t FROM conversations)
  SELECT conv_id, turn, role='user' AS is_object, CASE WHEN role='user' THEN CAST(turn AS VARCHAR) END AS turn_text FROM c""")
def fenced_answers(spark, folder):
    """User turns arrive as fenced JSON, the others as prose."""
    c = table(spark, folder, "conversations")
    good = F.concat(F.lit("```JSON\n"), F.to_json(F.struct("turn", "text")), F.lit("\n```"))
    content = F.when(F.col("role") == "user", good).otherwise(F.concat(F.lit("["), F.to_json(F.struct("turn")), F.lit("]")))
    parsed = ans.parse_content(content)
    return c.select("conv_id", "turn", parsed.isNotNull().alias("is_object"),
                    F.get_json_object(parsed, "$.turn").alias("turn_text"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN length(text)>=1500 THEN '1' ELSE '0' END AS guess,
    least(1.0,length(text)/2000.0) AS conf, CAST(quality AS VARCHAR) AS want FROM documents JOIN labels USING (doc_id))
  SELECT 'Program Only' AS method, round(avg(CASE WHEN guess=want THEN 1 ELSE 0 END),4) AS field_accuracy,
    round(count(*) FILTER (guess=want AND conf>=0.8)/nullif(count(*) FILTER (conf>=0.8),0),4) AS selective_accuracy,
    count(*) FILTER (conf>=0.8) AS accepted_field_count, count(*) AS sample_count FROM r""")
def classifier_scoring(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    n = F.length("text")
    records = evaluate.as_records(d.select(
        F.lit("Program Only").alias("method"), F.col("doc_id").cast("string").alias("item_id"),
        F.create_map(F.lit("quality"), F.when(n >= 1500, "1").otherwise("0")).alias("predicted"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("gold"),
        specs._strings("quality").alias("required"),
        F.array(F.struct(F.lit("quality").alias("name"), F.lit("text").alias("type"))).alias("fields"),
        F.create_map(F.lit("quality"), F.least(F.lit(1.0), n / 2000.0)).alias("field_confidences")))
    return evaluate.score_methods(records).select(
        "method", "field_accuracy", "selective_accuracy", "accepted_field_count", "sample_count")


@query("""SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k,
  '{"event_id":'||event_id||',"kind":"'||event_type||'"}' AS payload, 'v1' AS version FROM events""")
def payload_roundtrip(spark, folder):
    """JSON payloads to columns and back; a column older files lack gets its default."""
    e = table(spark, folder, "events")
    rows = e.select("event_id", load_payload(F.col("props"), "k bigint")["k"].alias("k"), dump_payload(F.struct(
        "event_id", F.col("event_type").alias("kind"))).alias("payload"))
    return with_defaults(rows, {"version": ("string", "v1")})
