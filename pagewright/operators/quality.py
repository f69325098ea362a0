"""Checking DOM rules against the page they are meant for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, let
from .selectors import DOCUMENT_TAGS, matches, outcome, parse_selector
from .specs import RULE_TYPE, _rule, _strings, is_body_field

DIAGNOSTIC_TYPE = "struct<field:string,strategy:string,selector:string,reason:string,match_count:int>"


def rule_reason(rule: Column, nodes: Column, tokens: Column, body: Column) -> Column:
    """STRUCT<reason, match_count>; a null reason accepts the rule."""
    def judge(found):
        state = outcome(found)
        document = F.exists(found, lambda m: m["tag"].isin(*DOCUMENT_TAGS))
        share = F.length(F.get(found, F.lit(0))["value"]) / F.length(body["text"])
        short = body["accepted"] & is_body_field(rule["field_name"]) & (F.length(body["text"]) > 0) & (share < 0.5)
        why = F.when(found.isNull(), "invalid_selector").when(document, "document_scope") \
            .when(state != "success", state).when(F.coalesce(short, F.lit(False)), "body_incomplete")
        return F.struct(why.alias("reason"), F.when(found.isNotNull(), F.size(found)).alias("match_count"))

    return let(matches(nodes, tokens, parse_selector(rule["strategy"], rule["selector"]),
                       rule["attribute"]), judge)


def check_rules(rules: Column, nodes: Column, tokens: Column, body: Column) -> Column:
    """STRUCT<rules, diagnostics>. Disabled and text rules pass unchecked."""
    return bind(_check_rules, rules=rules, nodes=nodes, tokens=tokens, body=body)


def _check_rules(rules: Column, nodes: Column, tokens: Column, body: Column) -> Column:
    def check(r):
        nothing = F.lit(None).cast("struct<reason:string,match_count:int>")
        state = F.when(r["strategy"].isin("css", "xpath") & r["enabled"],
                       rule_reason(r, nodes, tokens, body)).otherwise(nothing)
        return F.struct(r.alias("r"), state.alias("s"))

    def split(checked):
        return F.struct(
            F.filter(checked, lambda c: c["s"]["reason"].isNull())["r"].alias("rules"),
            F.transform(F.filter(checked, lambda c: c["s"]["reason"].isNotNull()), lambda c: F.struct(
                c["r"]["field_name"].alias("field"), c["r"]["strategy"].alias("strategy"),
                c["r"]["selector"].alias("selector"), c["s"]["reason"].alias("reason"),
                c["s"]["match_count"].alias("match_count")).cast(DIAGNOSTIC_TYPE)).alias("diagnostics"))

    return let(F.transform(rules, check), split)


def add_body_rules(rules: Column, fields: Column, body: Column) -> Column:
    """CSS rules from the accepted body regions for body-like fields without a DOM rule."""
    return bind(_add_body_rules, rules=rules, fields=fields, body=body)


def _add_body_rules(rules: Column, fields: Column, body: Column) -> Column:
    steps = _strings("strip", "normalize_whitespace")

    def for_field(f):
        covered = F.exists(rules, lambda r: (r["field_name"] == f["name"])
                           & r["strategy"].isin("css", "xpath") & r["selector"].isNotNull())
        regions = F.filter(body["candidates"], lambda c: c["selector"] != "")
        return F.when(is_body_field(f["name"]) & ~covered, F.transform(
            regions, lambda c: _rule(f["name"], "css", selector=c["selector"], postprocess=steps))) \
            .otherwise(F.array().cast(f"array<{RULE_TYPE}>"))

    return F.when(body["accepted"], F.concat(rules, F.flatten(F.transform(fields, for_field)))).otherwise(rules)


def fit_programs(pages: DataFrame) -> DataFrame:
    """Check each page's ``rules`` and complete them: adds ``diagnostics`` and replaces ``rules``.

    Needs nodes, tokens, body, fields and rules on the row.
    """
    checked = pages.withColumn("_checked", check_rules(
        F.col("rules"), F.col("nodes"), F.col("tokens"), F.col("body")))
    return checked.withColumns({
        "rules": add_body_rules(F.col("_checked.rules"), F.col("fields"), F.col("body")),
        "diagnostics": F.col("_checked.diagnostics")}).drop("_checked")
