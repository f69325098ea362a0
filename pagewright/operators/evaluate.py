"""Scoring extraction methods against labelled pages.

``records``: one row per (method, item) with predicted / gold maps, required names, declared
fields, confidences and run counters. Tallies are taken on the row, then summed per method with
map-side combining, so five method keys over any number of items move only partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, let, unfold
from .extract import EVIDENCE_TYPE, RESULT_TYPE, effective, record_map
from .specs import rules_signature
from .verify import matches_type

ENVELOPE = "struct<value:double,source:string,unit:string,sample_count:bigint,reason:string>"

# Method names and their switches.
FULL_METHOD = "Ours Full"
METHODS = {
    "Direct LLM": dict(schema_input=False, program=False, allow_model=True, verifier=False, repair=False),
    "LLM + Schema": dict(schema_input=True, program=False, allow_model=True, verifier=False, repair=False),
    "Program Only": dict(schema_input=True, program=True, allow_model=False, verifier=False, repair=False),
    "Hybrid without Verifier": dict(schema_input=True, program=True, allow_model=True, verifier=False,
                                    repair=False),
    FULL_METHOD: dict(schema_input=True, program=True, allow_model=False, verifier=True, repair=True),
}
PROGRAM_METHODS = [m for m, s in METHODS.items() if s["program"]]
CONFIDENCE_THRESHOLD = 0.8

RECORD_TYPE = {
    "method": "string", "item_id": "string", "status": "string", "errors": "array<string>",
    "predicted": "map<string,string>", "gold": "map<string,string>", "required": "array<string>",
    "fields": "array<struct<name:string,type:string>>", "confidence": "double",
    "field_confidences": "map<string,double>", "program_reused": "boolean", "runtime_ms": "bigint",
    "token_cost": "bigint", "evidenced_fields": "bigint", "nonempty_fields": "bigint",
    "annotations": "map<string,boolean>", "repair_attempt_fields": "bigint",
    "repair_success_fields": "bigint", "model_call_count": "bigint", "token_usage_missing_calls": "bigint",
    "actual_input_tokens": "bigint", "actual_output_tokens": "bigint",
    "partial_actual_input_tokens": "bigint", "partial_actual_output_tokens": "bigint",
}


def as_records(df: DataFrame) -> DataFrame:
    """Fill absent record columns with nulls and fix the types."""
    return df.select(*[
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in RECORD_TYPE.items()])


def per_method(pages: DataFrame) -> DataFrame:
    """Every page once per method, with the method's switches. Rows unfold in place, without a join."""
    methods = F.array(*[F.struct(F.lit(m).alias("method"), *[F.lit(v).alias(n) for n, v in s.items()])
                        for m, s in METHODS.items()])
    return pages.select("*", F.inline(methods))


def method_rules(rules: Column, method: Column) -> Column:
    """The shared program as a method runs it: the rules-only method switches the model off."""
    return F.transform(rules, lambda r: F.struct(
        r["field_name"], r["strategy"],
        F.when(method == "Program Only", r["strategy"] != "llm_fallback").otherwise(r["enabled"]).alias("enabled"),
        *[r[k] for k in ("selector", "attribute", "pattern", "label", "labels", "postprocess")]))


def direct_results(entries: Column) -> Column:
    """Results of a schema-free answer: its own keys are the field names. A failed answer (null) has none."""
    none = F.array().cast(f"array<{EVIDENCE_TYPE}>")

    def one(e, i):
        evidence = F.struct(F.lit("llm_fallback").alias("source"), e["evidence_text"].alias("text"), F.lit(None).alias("start_char"),
                            F.lit(None).alias("end_char"), e["confidence"].alias("score")).cast(EVIDENCE_TYPE)
        return F.struct(
            i.alias("field_pos"), e["key"].alias("field_name"), e["value"].alias("value"), e["value"].alias("normalized_value"),
            e["confidence"].alias("confidence"), F.when(e["evidence_text"].isNotNull(), F.array(evidence)).otherwise(none).alias("evidence"),
            F.lit("llm_fallback").alias("strategy"), F.when(F.coalesce(e["value"], F.lit("")) != "", "extracted").otherwise("missing")
            .alias("status"), F.lit(None).alias("error_message")).cast(RESULT_TYPE)

    return F.coalesce(F.transform(entries, one), F.array().cast(f"array<{RESULT_TYPE}>"))


def mean_confidence(results: Column) -> Column:
    """Mean over all fields of a schema-free record, 0 if it has none."""
    total = F.aggregate(results, F.lit(0.0), lambda acc, r: acc + r["confidence"])
    return F.round(F.coalesce(F.try_divide(total, F.size(results)), F.lit(0.0)), 4)


def evidence_spans(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """Places of the evidence of every run, for ``alignment.annotate``."""
    placed = F.flatten(F.transform("results", lambda r: F.transform(r["evidence"], lambda e: F.struct(
        r["field_name"].alias("field_name"), e["start_char"].alias("start_char"), e["end_char"].alias("end_char")))))
    return unfold(extracted, ("method", key), placed)


# What a run may bring along, and what holds where it does not.
_RUN_COLUMNS = {"program_reused": False, "model_call_count": 0, "token_usage_missing_calls": 0, "runtime_ms": None,
                "token_cost": None, "actual_input_tokens": None, "actual_output_tokens": None,
                "partial_actual_input_tokens": None, "partial_actual_output_tokens": None, "annotations": None}


def to_records(extracted: DataFrame, gold: DataFrame, key: str = "page_id") -> DataFrame:
    """Score-ready records; gold joins here and nowhere earlier.

    A run with an ``error`` failed: it stays with its item and scores as one without fields. Run times, calls,
    tokens and annotations are taken along where the rows have them.
    """
    joined = extracted.join(gold.select(key, "gold"), key)
    shown = F.filter("results", lambda r: F.coalesce(effective(r), F.lit("")) != "")
    failure = F.col("error") if "error" in extracted.columns else F.lit(None).cast("string")
    outcomes = F.col("repair_outcomes") if "repair_outcomes" in extracted.columns else None
    repair = {}
    if outcomes is not None:
        eligible = F.filter(outcomes, lambda o: F.map_contains_key(F.col("gold"), o["field_name"]))
        fixed = F.filter(eligible, lambda o: let(F.element_at("gold", o["field_name"]), lambda g: (
            ~o["before"].eqNullSafe(g)) & o["after"].eqNullSafe(g)))
        repair = {"repair_attempt_fields": F.size(eligible), "repair_success_fields": F.size(fixed)}
    return as_records(joined.select(
        "method", F.col(key).cast("string").alias("item_id"),
        F.when(failure.isNull(), "completed").otherwise("failed").alias("status"),
        F.when(failure.isNotNull(), F.array(F.concat_ws(": ", "method", failure))).otherwise(F.array().cast("array<string>")).alias("errors"),
        record_map(F.col("results")).alias("predicted"), "gold",
        F.transform(F.filter("fields", lambda f: f["required"]), lambda f: f["name"]).alias("required"),
        F.transform("fields", lambda f: F.struct(f["name"], f["type"])).alias("fields"),
        F.col("overall_confidence").alias("confidence"),
        F.map_from_entries(F.transform("results", lambda r: F.struct(r["field_name"], r["confidence"])))
        .alias("field_confidences"),
        F.size(F.filter(shown, lambda r: F.size(r["evidence"]) > 0)).alias("evidenced_fields"),
        F.size(shown).alias("nonempty_fields"),
        *[F.col(n) if n in extracted.columns else F.lit(v).alias(n) for n, v in _RUN_COLUMNS.items()],
        *[v.alias(k) for k, v in repair.items()]))


def tally(records: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Per-record counts that add up to every metric."""
    names = ("predicted", "gold", "required", "fields", "confidence", "field_confidences", "annotations")
    counts = bind(lambda **r: _counts(threshold, **r), **{n: F.col(n) for n in names})
    return records.withColumn("_t", counts).select("*", "_t.*").drop("_t")


def _counts(threshold, predicted, gold, required, fields, confidence, field_confidences, annotations) -> Column:
    def got(name):
        return F.try_element_at(predicted, name)

    def empty(name):
        return F.coalesce(got(name), F.lit("")) == ""

    def sure(name):
        own = F.when(F.map_contains_key(field_confidences, name), F.try_element_at(field_confidences, name)) \
            .otherwise(confidence)
        return F.coalesce(own >= threshold, F.lit(False))

    def count(items, test):
        return F.size(F.filter(items, test)).cast("bigint")

    def right(e):
        return got(e["key"]).eqNullSafe(e["value"])

    labels, needed = F.map_entries(gold), F.array_distinct(required)
    confidences = F.coalesce(F.map_values(field_confidences), F.array().cast("array<double>"))
    listed = F.when(F.size(confidences) > 0, confidences).otherwise(F.array_compact(F.array(confidence)))
    declared = F.transform(fields, lambda f: f["name"])
    adherence = F.size(F.array_except(F.map_keys(predicted), declared)) == 0
    complete = F.forall(needed, lambda n: ~empty(n) & (got(n) != "[]"))
    annotated = annotations.isNotNull()
    return F.struct(
        F.size(labels).cast("bigint").alias("_gold"), count(labels, right).alias("_correct"),
        F.size(needed).cast("bigint").alias("_required"), count(needed, empty).alias("_required_missing"),
        count(labels, lambda e: sure(e["key"]) & ~empty(e["key"])).alias("_accepted"),
        count(labels, lambda e: sure(e["key"]) & right(e)).alias("_accepted_correct"),
        F.aggregate(listed, F.lit(0.0), lambda acc, c: acc + c).alias("_confidence_sum"),
        F.size(listed).cast("bigint").alias("_confidences"),
        (F.lit(2) + F.size(fields)).cast("bigint").alias("_checks"),
        (adherence.cast("bigint") + complete.cast("bigint")
         + count(fields, lambda f: matches_type(got(f["name"]), f["type"]))).alias("_checks_passed"),
        annotated.alias("_annotated"),
        F.when(annotated, count(F.map_values(annotations), lambda v: v)).otherwise(F.lit(0))
        .cast("bigint").alias("_evidence_right"),
        F.when(annotated, F.size(annotations)).otherwise(F.lit(0)).cast("bigint").alias("_annotation_count"))


def score_methods(records: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per method: metrics (null where undefined), their sources and the reasons."""
    def total(name):
        return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0))), F.lit(0)).cast("bigint")

    sums = tally(records, threshold).groupBy("method").agg(
        F.count("*").alias("sample_count"), F.count_if(F.col("status") == "completed").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        *[total(n).alias(n) for n in (
            "_gold", "_correct", "_required", "_required_missing", "_accepted", "_accepted_correct",
            "_confidences", "_checks", "_checks_passed", "_evidence_right")],
        F.sum("_confidence_sum").alias("_confidence_sum"), F.max("_annotated").alias("_annotated"),
        F.sum(F.greatest(F.coalesce("evidenced_fields", F.lit(0)), "_annotation_count")).alias("_evidence_total"),
        *[total(n).alias(n) for n in (
            "runtime_ms", "token_cost", "evidenced_fields", "nonempty_fields", "repair_attempt_fields",
            "repair_success_fields", "model_call_count", "token_usage_missing_calls", "actual_input_tokens",
            "actual_output_tokens", "partial_actual_input_tokens", "partial_actual_output_tokens")],
        F.sum(F.coalesce("program_reused", F.lit(False)).cast("bigint")).alias("_reused"))
    program = F.col("method").isin(*PROGRAM_METHODS)
    full = F.col("method") == FULL_METHOD
    used = (F.col("model_call_count") > 0) & (F.col("token_usage_missing_calls") == 0)

    def ratio(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    values = {
        "field_accuracy": ratio("_correct", "_gold"),
        "required_field_missing_rate": ratio("_required_missing", "_required"),
        "schema_adherence": ratio("_checks_passed", "_checks"),
        "evidence_precision": F.when(F.col("_annotated"), ratio("_evidence_right", "_evidence_total")),
        "evidence_coverage": ratio("evidenced_fields", "nonempty_fields"),
        "average_confidence": ratio("_confidence_sum", "_confidences"),
        "selective_accuracy": ratio("_accepted_correct", "_accepted"),
        "program_reuse_rate": F.when(program, ratio("_reused", "sample_count")),
        "repair_success_rate": F.when(full, ratio("repair_success_fields", "repair_attempt_fields")),
    }
    scored = sums.select(
        "*", *[F.round(v, 4).alias(n) for n, v in values.items()],
        F.when(used, F.col("actual_input_tokens")).alias("actual_in"),
        F.when(used, F.col("actual_output_tokens")).alias("actual_out"))
    # Results are compared by these texts.
    no_checks = "no eligible annotated fields or schema checks"
    tokens = F.when(F.col("model_call_count") == 0, "no model calls").when(
        F.col("token_usage_missing_calls") > 0, "provider usage missing for one or more calls")
    # A null reason means the metric was measured.
    reasons = {
        **{n: F.when(F.col(n).isNull(), no_checks)
           for n in ("field_accuracy", "required_field_missing_rate", "schema_adherence")},
        "evidence_precision": F.when(~F.col("_annotated"), "independent evidence annotations are absent"),
        "evidence_coverage": F.when(F.col("evidence_coverage").isNull(), "no non-empty prediction fields"),
        "average_confidence": F.when(F.col("_confidences") == 0, "no extracted fields with confidence"),
        "selective_accuracy": F.when(F.col("_accepted") == 0,
                                     "no accepted fields at the configured confidence threshold"),
        "program_reuse_rate": F.when(~program, "method is not a program method"),
        "repair_success_rate": F.when(~full, "method does not attempt verifier-directed repair").when(
            F.col("repair_success_rate").isNull(), "no verifier-directed repair fields were attempted"),
        "actual_input_tokens": tokens, "actual_output_tokens": tokens,
    }
    sources = [x for n, why in reasons.items()
               for x in (F.lit(n), F.when(why.isNotNull(), "unavailable").otherwise("measured"))]
    sources += [F.lit("runtime_ms"), F.lit("measured"), F.lit("estimated_token_cost"),
                F.when(F.col("model_call_count") == 0, "measured").otherwise("estimated")]
    why = F.map_filter(F.create_map(*[x for n, w in reasons.items() for x in (F.lit(n), w)]),
                       lambda _, v: v.isNotNull())
    return scored.select(
        "method", *values, F.col("token_cost").alias("estimated_token_cost"), "runtime_ms",
        F.col("actual_in").alias("actual_input_tokens"), F.col("actual_out").alias("actual_output_tokens"),
        "partial_actual_input_tokens", "partial_actual_output_tokens", "token_usage_missing_calls",
        "sample_count", "success_count", "failure_count", F.col("_accepted").alias("accepted_field_count"),
        "model_call_count", F.create_map(*sources).alias("metric_sources"), why.alias("unavailable_reasons"))


def sample_errors(records: DataFrame) -> DataFrame:
    """Errors per method and item as rows; a map of all items would grow without bound."""
    return records.filter(F.size("errors") > 0).select("method", "item_id", "errors")


def program_signatures(items: DataFrame) -> DataFrame:
    """The experiment record: each item's cold-start program and each method's switches."""
    return per_method(items.select("item_id", rules_signature(F.col("rules")).alias("program_signature"))) \
        .select("item_id", "method", "schema_input", "verifier", "repair",
                F.lit(False).alias("reuse_verified_program"), "program_signature")
