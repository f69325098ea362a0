"""Field schemas and rule programs as rows: validation, versions, planning, clean-up, merging.

A schema row holds ``fields`` and a program row holds ``rules``, both ordered arrays, so every
per-schema or per-page step is a row-local array expression. ``rule_table`` unfolds a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, compact, let, reason
from ..functions.text import field_identifier, label_list, optional_text, safe_text, safe_text_list, strip
from ..functions.web import signature
from .skew import attach, with_position

FIELD_TYPE = ("struct<name:string,description:string,type:string,required:boolean,"
              "aliases:array<string>,examples:array<string>>")
RULE_TYPE = ("struct<field_name:string,strategy:string,enabled:boolean,selector:string,attribute:string,"
             "pattern:string,label:string,labels:array<string>,postprocess:array<string>>")
PLAN_TYPE = ("struct<field_name:string,field_type:string,labels:array<string>,"
             "strategies:array<string>,required:boolean>")

# The closed lists of the rule language.
FIELD_TYPES = ("string", "text", "number", "date", "url", "list")
STRATEGIES = ("css", "xpath", "regex_on_text", "text_near_label", "llm_fallback")
POSTPROCESS = ("strip", "normalize_whitespace", "normalize_date")
DATE_WORDS = ("日期", "时间", "date")
DATED_FIELDS = ("publish_date", "deadline", "effective_date")
TITLE_SELECTORS = ("h1", "*[class*='title'] h2", "*[class*='title'] h3")
BODY_WORDS = ("body", "content", "description", "details", "article", "text", "body_text")
BODY_PARTS = ("body", "content", "description", "detail", "article")


def _strings(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _rule(field, strategy, selector=None, attribute=None, pattern=None, label=None, labels=None,
          postprocess=None, enabled=None) -> Column:
    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return F.struct(
        text(field).alias("field_name"), text(strategy).alias("strategy"),
        (F.lit(True) if enabled is None else enabled).alias("enabled"),
        text(selector).alias("selector"), text(attribute).alias("attribute"),
        text(pattern).alias("pattern"), text(label).alias("label"),
        (_strings() if labels is None else labels).alias("labels"),
        (_strings() if postprocess is None else postprocess).alias("postprocess"),
    ).cast(RULE_TYPE)


# -- schemas ---------------------------------------------------------------------------------

def schema_errors(fields: Column) -> Column:
    """All problems of one schema; an empty array means it is valid."""
    def check(f):
        meaning = F.concat(F.coalesce(f["description"], F.lit("")),
                           F.array_join(F.coalesce(f["aliases"], _strings()), " "))
        dated = F.lit(False)
        for word in DATE_WORDS:
            dated = dated | meaning.contains(word)
        # Results are compared by these texts.
        return compact(
            reason(strip(f["name"]) == "", "field name must not be empty"),
            F.when(f["required"] & (strip(F.coalesce(f["description"], F.lit(""))) == ""), F.concat(
                F.lit("required field '"), f["name"], F.lit("' should include a description"))),
            F.when((f["type"] == "date") & ~dated, F.concat(
                F.lit("date field '"), f["name"], F.lit("' should include date/time semantics"))))

    none = F.coalesce(F.size(fields), F.lit(0)) <= 0
    return F.when(none, _strings("schema must contain at least one field")).otherwise(
        F.flatten(F.transform(fields, check)))


def duplicate_names(fields: Column) -> Column:
    return let(fields["name"], lambda names: F.array_distinct(
        F.filter(names, lambda n, i: F.array_position(names, n) != i + 1)))


def validate_schemas(schemas: DataFrame) -> DataFrame:
    return schemas.withColumn("errors", schema_errors(F.col("fields"))) \
        .withColumn("valid", F.size("errors") == 0)


def schema_signature(name: Column, description: Column, domain: Column, fields: Column) -> Column:
    """Content address of a schema; keys are in alphabetical order at every level."""
    canon = F.transform(fields, lambda f: F.struct(
        f["aliases"], f["description"], f["examples"], f["name"], f["required"], f["type"]))
    return signature(F.struct(description.alias("description"), domain.alias("domain"),
                              canon.alias("fields"), name.alias("name")))


def rules_signature(rules: Column) -> Column:
    canon = F.transform(rules, lambda r: F.struct(
        r["attribute"], r["enabled"], r["field_name"], r["label"], r["labels"], r["pattern"],
        r["postprocess"], r["selector"], r["strategy"]))
    return F.when(F.size(rules) > 0, signature(F.struct(canon.alias("rules"))))


def register_versions(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Version registry after ``arrivals`` (schema_signature, schema_name, source, arrival).

    A known signature is refreshed and keeps its version; a new one gets the next number of its
    name. ``registry`` has schema_signature, schema_name, version, source.
    """
    last = arrivals.groupBy("schema_signature").agg(
        F.max_by(F.struct("schema_name", "source"), "arrival").alias("now"),
        F.min_by("schema_name", "arrival").alias("first_name"), F.min("arrival").alias("first_arrival"))
    merged = registry.alias("r").join(last.alias("a"), "schema_signature", "full")
    known = merged.filter("version is not null").select(
        "schema_signature", F.coalesce("now.schema_name", "schema_name").alias("schema_name"),
        "version", F.coalesce("now.source", "source").alias("source"))
    new = merged.filter("version is null").select(
        "schema_signature", "first_name", "first_arrival", "now")
    numbered = with_position(new, ["first_name"], [F.col("first_arrival"), F.col("schema_signature")], "_n")
    highest = registry.groupBy(F.col("schema_name").alias("first_name")).agg(F.max("version").alias("_top"))
    fresh = attach(numbered, highest, "first_name").select(
        "schema_signature", F.col("now.schema_name").alias("schema_name"),
        (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint").alias("version"),
        F.col("now.source").alias("source"))
    return known.withColumn("version", F.col("version").cast("bigint")).unionByName(fresh)


def list_versions(registry: DataFrame, name: str | None = None) -> DataFrame:
    rows = registry.filter(F.col("schema_name") == name) if name else registry
    return rows.orderBy("schema_name", "version")


def user_schemas(registry: DataFrame) -> DataFrame:
    return registry.filter(~F.coalesce(F.col("source"), F.lit("")).isin("builtin", "system"))


def clean_schema(name: Column, description: Column, domain: Column, fields: Column,
                 page_title: Column, most: int = 8) -> Column:
    """Usable schema struct from a proposed one; null when no field survives."""
    def tidy(f):
        ident = field_identifier(f["name"])
        kind = F.when(f["type"].isin(*FIELD_TYPES), f["type"]).otherwise("string")
        return F.struct(
            ident.alias("name"), F.coalesce(safe_text(f["description"]), ident).alias("description"),
            kind.alias("type"), F.coalesce(f["required"], F.lit(True)).alias("required"),
            safe_text_list(f["aliases"]).alias("aliases"),
            safe_text_list(f["examples"]).alias("examples")).cast(FIELD_TYPE)

    named = F.filter(F.transform(F.slice(fields, 1, most), tidy), lambda f: f["name"].isNotNull())
    first = let(named, lambda k: let(k["name"], lambda names: F.filter(
        k, lambda f, i: F.array_position(names, f["name"]) == i + 1)))
    title = F.struct(
        F.lit("title").alias("name"), F.lit("页面标题").alias("description"), F.lit("text").alias("type"),
        F.lit(True).alias("required"), _strings("标题", "名称").alias("aliases"),
        F.array(F.substring(page_title, 1, 120)).alias("examples")).cast(FIELD_TYPE)
    given = F.coalesce(page_title, F.lit(""))
    auto = F.when(given != "", F.concat(F.lit("自动字段契约 - "), F.substring(safe_text(given), 1, 24))) \
        .otherwise("自动字段契约")

    def finish(kept):
        whole = F.when(~F.array_contains(kept["name"], "title") & (given != ""),
                       F.concat(F.array(title), kept)).otherwise(kept)
        return F.when(F.size(kept) > 0, F.struct(
            F.coalesce(safe_text(name), auto).alias("name"),
            F.coalesce(safe_text(description), F.lit("AI 根据当前 URL 页面内容生成的字段契约")).alias("description"),
            F.coalesce(safe_text(domain), F.lit("auto_inferred")).alias("domain"),
            F.slice(whole, 1, most).alias("fields")))

    return let(first, finish)


# -- planning --------------------------------------------------------------------------------

def plan_fields(fields: Column) -> Column:
    def plan(f):
        labels = F.filter(F.concat(F.array(f["name"], f["description"]),
                                   F.coalesce(f["aliases"], _strings())),
                          lambda x: F.coalesce(x, F.lit("")) != "")
        strategies = F.when(f["name"] == "title", _strings("css", "xpath", "text_near_label", "llm_fallback")) \
            .otherwise(_strings("text_near_label", "regex_on_text", "llm_fallback"))
        return F.struct(f["name"].alias("field_name"), f["type"].alias("field_type"),
                        labels.alias("labels"), strategies.alias("strategies"),
                        f["required"].alias("required")).cast(PLAN_TYPE)

    return F.transform(fields, plan)


def _steps_for(field_type: Column) -> Column:
    return F.when(field_type == "date", _strings(*POSTPROCESS)).otherwise(_strings(*POSTPROCESS[:2]))


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-#&~\s])", r"\\$1")


def default_rules(plans: Column) -> Column:
    """Deterministic program: title selectors, one rule per label, a date pattern, model fallback."""
    plain = _strings(*POSTPROCESS[:2])

    def rules(p):
        steps = _steps_for(p["field_type"])
        dated = p["field_name"].isin(*DATED_FIELDS)
        labels = F.array_distinct(F.filter(p["labels"], lambda x: ~(dated & (x == "日期"))))
        title = F.array(*[_rule(p["field_name"], "css", selector=s, postprocess=plain)
                          for s in TITLE_SELECTORS])
        none = F.array().cast(f"array<{RULE_TYPE}>")
        pattern = F.concat(
            F.lit("(?:"), F.array_join(F.transform(p["labels"], _quote), "|"),
            F.lit(r")\s*[：:\-]\s*(\d{4}\s*[年\-/\.]\s*\d{1,2}\s*[月\-/\.]\s*\d{1,2}\s*日?)"))
        near = let(labels, lambda ls: F.transform(ls, lambda x: _rule(
            p["field_name"], "text_near_label", label=x, labels=ls, postprocess=steps)))
        return F.concat(
            F.when(p["field_name"] == "title", title).otherwise(none), near,
            F.when(p["field_type"] == "date", F.array(_rule(
                p["field_name"], "regex_on_text", pattern=pattern,
                postprocess=_strings(*POSTPROCESS)))).otherwise(none),
            F.array(_rule(p["field_name"], "llm_fallback", postprocess=steps)))

    return F.flatten(F.transform(plans, rules))


def build_programs(schemas: DataFrame) -> DataFrame:
    """schema_id, fields, plans, rules."""
    return schemas.withColumn("plans", plan_fields(F.col("fields"))) \
        .withColumn("rules", default_rules(F.col("plans")))


def rule_table(programs: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("schema_id",)
    return programs.select(*keys, F.posexplode("rules").alias("rule_pos", "r")).select(*keys, "rule_pos", "r.*")


# -- clean-up of proposed rules --------------------------------------------------------------

def pattern_compiles(pattern: Column) -> Column:
    """Checked with the regex engine that will run the rule; nothing is raised for a bad one."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java_pattern(pattern)).isNotNull()


def java_pattern(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\(\?P<", "(?<")


def _clean_steps(steps: Column, field_type: Column) -> Column:
    """Allowed steps in their order, completed with the obligatory ones."""
    def complete(kept):
        first = F.when(F.array_contains(kept, "strip"), kept).otherwise(F.concat(_strings("strip"), kept))

        def spaced(s):
            at = F.when(F.get(s, F.lit(0)) == "strip", 1).otherwise(0)
            added = F.concat(F.slice(s, 1, at), _strings("normalize_whitespace"),
                             F.slice(s, at + 1, F.size(s)))
            return F.when(F.array_contains(s, "normalize_whitespace"), s).otherwise(added)

        dated = let(let(first, spaced), lambda s: F.when(
            (field_type == "date") & ~F.array_contains(s, "normalize_date"),
            F.concat(s, _strings("normalize_date"))).otherwise(s))
        return F.array_distinct(dated)

    allowed = F.filter(steps, lambda s: s.isin(*POSTPROCESS))
    return F.when(steps.isNull(), _steps_for(field_type)).otherwise(let(allowed, complete))


def clean_rule(rule: Column, field_types: Column) -> Column:
    """STRUCT<rule, issue>: a safe rule or the reason it was dropped."""
    field_type = F.try_element_at(field_types, rule["field_name"])
    strategy = rule["strategy"]
    allowed = strategy.isin(*STRATEGIES)
    selector, pattern = optional_text(rule["selector"]), optional_text(rule["pattern"])
    label, labels = optional_text(rule["label"]), label_list(rule["labels"])
    attribute = optional_text(rule["attribute"])
    dom = strategy.isin("css", "xpath")
    bad_attribute = dom & attribute.isNotNull() & ~attribute.rlike(r"(?U)^[a-zA-Z_][\w:.\-]*$")
    fits = F.when(strategy == "css", selector.isNotNull() & ~selector.rlike(r"[<{}]")) \
        .when(strategy == "xpath", selector.isNotNull() & selector.startswith("//")) \
        .when(strategy == "regex_on_text", pattern.isNotNull() & pattern_compiles(pattern)) \
        .when(strategy == "text_near_label", label.isNotNull() | (F.size(labels) > 0)).otherwise(True)
    safe = F.coalesce(fits, F.lit(False)) & ~F.coalesce(bad_attribute, F.lit(False))
    near = strategy == "text_near_label"
    kept = _rule(
        rule["field_name"], strategy, enabled=F.coalesce(rule["enabled"], F.lit(True)),
        selector=F.when(dom, selector), attribute=F.when(dom, attribute),
        pattern=F.when(strategy == "regex_on_text", pattern), label=F.when(near, label),
        labels=F.when(near & (F.size(labels) > 0), labels).when(near, F.array(label)).otherwise(_strings()),
        postprocess=_clean_steps(rule["postprocess"], field_type))
    # Results are compared by these texts.
    issue = F.when(field_type.isNull(), F.concat(
        F.lit("已忽略未知字段的 ProgramSpec 规则："),
        F.coalesce(F.nullif(rule["field_name"], F.lit("")), F.lit("未命名字段")))) \
        .when(~F.coalesce(allowed, F.lit(False)), F.concat(
            F.lit("已忽略字段 "), rule["field_name"], F.lit(" 的非白名单策略："),
            F.coalesce(F.nullif(strategy, F.lit("")), F.lit("未指定策略")))) \
        .when(~safe, F.concat(F.lit("已忽略字段 "), rule["field_name"], F.lit(" 的不完整或不安全 ProgramSpec 规则")))
    return F.struct(F.when(issue.isNull(), kept).alias("rule"), issue.alias("issue"))


def field_type_map(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], f["type"])))


def clean_rules(rules: Column, fields: Column) -> Column:
    """STRUCT<rules, issues> for one program; issues are distinct in order of appearance."""
    checked = bind(lambda rules, types: F.transform(rules, lambda r: clean_rule(r, types)),
                   rules=rules, types=field_type_map(fields))
    return let(checked, lambda c: F.struct(
        F.filter(c["rule"], lambda r: r.isNotNull()).alias("rules"),
        F.array_distinct(F.filter(c["issue"], lambda i: i.isNotNull())).alias("issues")))


def shape_error(rule: Column) -> Column:
    """Why a rule's parameters do not belong to its strategy; null when they do."""
    def has(x):
        return F.coalesce(strip(x) != "", F.lit(False))

    selector, attribute, pattern, label = (has(rule[k]) for k in ("selector", "attribute", "pattern", "label"))
    labels = F.exists(F.coalesce(rule["labels"], _strings()), has)
    s, name = rule["strategy"], rule["field_name"]

    def say(text):
        return F.concat(name, F.lit(": "), text if isinstance(text, Column) else F.lit(text))

    # Results are compared by these texts.
    return F.when(s.isin("css", "xpath") & ~selector, say(F.concat(s, F.lit(" requires selector")))) \
        .when(s.isin("css", "xpath") & (pattern | label | labels),
              say(F.concat(s, F.lit(" cannot include regex or label parameters")))) \
        .when((s == "regex_on_text") & ~pattern, say("regex_on_text requires pattern")) \
        .when((s == "regex_on_text") & (selector | attribute | label | labels),
              say("regex_on_text cannot include DOM or label parameters")) \
        .when((s == "text_near_label") & ~(label | labels), say("text_near_label requires label or labels")) \
        .when((s == "text_near_label") & (selector | attribute | pattern),
              say("text_near_label cannot include selector or pattern")) \
        .when((s == "llm_fallback") & (selector | attribute | pattern | label | labels),
              say("llm_fallback cannot include locator parameters")) \
        .when(~F.coalesce(s.isin(*STRATEGIES), F.lit(False)), say("unsupported strategy"))


# -- merging ---------------------------------------------------------------------------------

def _same_rule(rule: Column) -> Column:
    """Everything but ``enabled`` identifies a rule."""
    return F.struct(*[rule[k] for k in ("field_name", "strategy", "selector", "attribute", "pattern",
                                        "label", "labels", "postprocess")])


def merge_rules(preferred: Column, fallback: Column, field_names: Column) -> Column:
    """Per field in schema order: preferred rules, then fallback ones, first of equals kept."""
    return bind(_merge_rules, preferred=preferred, fallback=fallback, field_names=field_names)


def _merge_rules(preferred: Column, fallback: Column, field_names: Column) -> Column:
    by_field = F.flatten(F.transform(field_names, lambda n: F.filter(
        F.concat(preferred, fallback), lambda r: r["field_name"] == n)))
    return let(by_field, lambda rules: let(F.transform(rules, _same_rule), lambda ids: F.filter(
        rules, lambda r, i: F.array_position(ids, _same_rule(r)) == i + 1)))


def cover_missing_fields(safe: Column, fallback: Column) -> Column:
    """Safe rules plus the fallback rules of fields that have none."""
    return let(safe["field_name"], lambda have: F.concat(
        safe, F.filter(fallback, lambda r: ~F.array_contains(have, r["field_name"]))))


def safe_program(candidate: Column, fallback: Column, fields: Column) -> Column:
    return let(clean_rules(candidate, fields), lambda c: merge_rules(c["rules"], fallback, fields["name"]))


def is_body_field(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip(name)), "[- ]", "_")
    hit = plain.isin(*BODY_WORDS)
    for part in BODY_PARTS:
        hit = hit | plain.contains(part)
    return hit
