"""Work that several methods share is done once a page."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright import session
from pagewright.functions import text as tx
from pagewright.operators import extract, specs
from pagewright.plans import extraction as plans

RULES = [("a", "regex_on_text", "(\\d+)"), ("a", "llm_fallback", None), ("b", "llm_fallback", None), ("b", "regex_on_text", "x(y)"),
         ("c", "llm_fallback", None), ("d", "regex_on_text", "("), ("d", "llm_fallback", None), ("d", "regex_on_text", "(z)"), ("e", "regex_on_text", "none")]


def test_both_results_come_from_one_run_of_the_rules(spark):
    rules = F.array(*[specs._rule(f, s, **({"pattern": p} if p else {})) for f, s, p in RULES])
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n).alias("description"), F.lit("text").alias("type"), F.lit(False).alias("required"),
                                specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE) for n in "abcdef"])
    answer = [("b", "m", None, None), ("c", "", None, "no answer"), ("d", "q", ("llm_fallback", "q", 0, 1, 0.5), None)]
    pages = spark.createDataFrame(
        [(1, ["7 xy z"], "7 xy z", answer), (2, ["xy"], "xy", []), (3, [], "", answer), (4, ["z"], "z", [("a", "1", None, None)])],
        f"page_id int, lines array<string>, text string, answers array<{extract.ANSWER_TYPE}>")
    for rows in (extract.with_one_program(pages, spark.range(1).select(fields.alias("fields"), rules.alias("rules"))),
                 pages.withColumns({"fields": fields, "rules": rules})):
        both = extract.extract_fields(rows, with_model="asked")
        got = {r.page_id: (r.results, r.asked, r.overall_confidence) for r in both.select("page_id", "results", "asked", "overall_confidence").collect()}
        plain = {r.page_id: r for r in extract.extract_fields(rows).select("page_id", "results", "overall_confidence").collect()}
        model = {r.page_id: r.r for r in rows.select("page_id", extract.results_of(rows, True).alias("r")).collect()}
        assert got == {k: (plain[k].results, model[k], plain[k].overall_confidence) for k in plain}
        assert [r.strategy for r in got[1][1]] == ["regex_on_text", "llm_fallback", "none", "llm_fallback", "none", "none"]


@pytest.mark.parametrize("name", ["evidence_precision", "method_failures", "metric_provenance", "method_scores", "repair_outcomes"])
def test_a_page_is_viewed_once(spark, folder, monkeypatch, name):
    """Lines and title of the markup are worked out in one place, and that is stored before anyone asks for them."""
    kept, plans_ = [], []

    def watched(df):
        plans_.append(df._jdf.queryExecution().optimizedPlan().toString())
        kept.append(session.durable(df))
        return kept[-1]

    monkeypatch.setattr(plans, "durable", watched)
    out = getattr(plans, name)(spark, folder)
    plans_.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans_) > 1 and "noscript" in plans_[0] and not any("noscript" in p for p in plans_[1:])


def test_alternatives_of_a_tag_are_tried_at_its_sign_alone(spark):
    hidden = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in tx.HIDDEN)
    pairs = ((rf"(?is)(<!--.*?-->)|{hidden}|<[!?][^>]*>", tx._DROP_RE),
             (rf"(?i)</(?:{tx.LINE_ENDERS})(?:[\s/][^>]*)?>|<(?:{tx.LINE_ENDERS})(?:\s[^>]*)?/>", tx._ENDER_RE))
    rng, parts = random.Random(3), ["<", "</", ">", "/>", "!", "!--", "-->", "?", "script", "STYLE", "noscript", "template", "p", "h1", "h12", "br", " ", "\n", "x", "é", "="]
    soup = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in soup], "x string")
    for old, new in pairs:
        assert new.startswith(old[:old.index(")") + 1] + "<(?:")
        got = df.select(F.regexp_replace("x", old, "~").alias("a"), F.regexp_replace("x", new, "~").alias("b")).collect()
        assert all(r.a == r.b for r in got) and any("~" in r.a for r in got)


def test_the_join_of_answers_has_as_many_parts_as_the_pages(spark, folder):
    """Shuffle partitions are a setting for bytes; trees and rules behind this join are paid by the page."""
    rows = session.durable(plans.titled(spark, folder).withColumns({"url": F.lit("u"), "html": F.lit("")}).repartition(13))
    got = plans.answered(spark, rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r.p for r in got) >= 8 and sum(r["count"] for r in got) == rows.count()
