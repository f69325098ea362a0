"""Verification of extraction results, the choice of fields for the model, and repair.

A record row carries its schema ``fields`` and its ``results``; everything is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import BLANK, bind, collapse, let, once, unfold
from ..functions.text import date_of, normalize_date
from .extract import RESULT_TYPE, effective

ISSUE_TYPE = "struct<field_name:string,code:string,severity:string,message:string>"

# Scoring weights, confidence floors, and the codes that call for the model.
ERROR_COST, WARNING_COST = 0.25, 0.08
FLOORS = {"css": 0.55, "xpath": 0.55, "regex_on_text": 0.55, "text_near_label": 0.55, "llm_fallback": 0.35}
MODEL_CODES = (
    "required_field_missing", "field_not_returned", "field_type_mismatch", "date_normalization_failure",
    "evidence_not_supporting_value", "empty_or_low_quality_evidence", "low_confidence",
    "publish_date_deadline_confusion",
)
REPAIR_CONFIDENCE = 0.42
#: Texts of at most three characters between blanks.
THIN = rf"\A{BLANK}*+(?s:.{{0,3}}?){BLANK}*+\z"
_NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def is_missing(value: Column) -> Column:
    """Null, blank, or an empty JSON list."""
    return value.isNull() | value.rlike(rf"\A{BLANK}*+(?:\[\])?{BLANK}*+\z")


def matches_type(value: Column, field_type: Column) -> Column:
    """Null never matches a known type; an unknown type matches anything."""
    test = F.when(field_type.isin("string", "text"), ~value.rlike(rf"\A{BLANK}*+\z")) \
        .when(field_type == "date", value.rlike(r"^\d{4}-\d{2}-\d{2}$")) \
        .when(field_type == "number", value.rlike(_NUMBER)) \
        .when(field_type == "url", value.rlike("^https?://")) \
        .when(field_type == "list", value.rlike(r"(?s)^\s*\[.*\]\s*$")).otherwise(True)
    return F.coalesce(test, F.lit(False))


def supports(evidence: Column, value: Column) -> Column:
    """Does any evidence text contain the value, ignoring dashes, or name the same date?

    A value that stands in the text as it is needs no clean-up of either.
    """
    def close(w):
        def one(e):
            return let(collapse(e["text"]), lambda t: t.contains(w["wanted"])
                       | F.replace(t, F.lit("-")).contains(w["relaxed"]) | (date_of(t) == w["wanted"]))
        return (w["wanted"] != "") & F.exists(evidence, one)

    plain = ~value.rlike(rf"\A{BLANK}*+\z") & F.exists(evidence, lambda e: e["text"].contains(value))
    return F.coalesce(plain, F.lit(False)) | let(let(collapse(value), lambda w: F.struct(
        w.alias("wanted"), F.replace(w, F.lit("-")).alias("relaxed"))), close)


def _issue(field, code, severity, message) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (field, code, severity, message)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("field_name", "code", "severity", "message"))]) \
        .cast(ISSUE_TYPE)


def _field_issues(field: Column, result: Column) -> Column:
    absent = F.when(field["required"], F.array(_issue(
        field["name"], "field_not_returned", "error", "Extraction gave no row for the field."))) \
        .otherwise(F.array().cast(f"array<{ISSUE_TYPE}>"))
    # The value and whether it is missing decide nearly every check: each is worked out once.
    given = let(effective(result), lambda v: F.struct(v.alias("value"), is_missing(v).alias("missing")))
    return F.when(result.isNull(), absent).otherwise(let(given, lambda g: _checks(field, result, g["value"], g["missing"])))


def _checks(field: Column, result: Column, value: Column, missing: Column) -> Column:
    name, required = field["name"], F.coalesce(field["required"], F.lit(False))
    weight = F.when(required, "error").otherwise("warning")
    failed = result["status"] == "fallback_failed"
    note = F.coalesce(result["error_message"], F.lit(""))
    thin = F.forall(result["evidence"], lambda e: e["text"].rlike(THIN))
    floor = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), result["strategy"]), F.lit(0.0))
    first = F.when(failed, _issue(name, "llm_fallback_failed", weight, F.coalesce(
        F.nullif(note, F.lit("")), F.lit("The model gave an error.")))) \
        .when(note != "", _issue(name, "program_execution_failed",
                                 F.when(required & missing, "error").otherwise("warning"), note))
    rest = (
        F.when(missing, _issue(name, "required_field_missing", "error", "A required field has no value.")),
        F.when(~missing & ~matches_type(value, field["type"]), _issue(
            name, "field_type_mismatch", weight,
            F.concat(F.lit("The value is no "), field["type"], F.lit(".")))),
        F.when(~missing & (field["type"] == "date") & (normalize_date(value) != value), _issue(
            name, "date_normalization_failure", "warning", "The date is not written year-month-day.")),
        F.when(~missing & ~supports(result["evidence"], value), _issue(
            name, "evidence_not_supporting_value", "warning", "The evidence does not show the value.")),
        F.when(thin, _issue(name, "empty_or_low_quality_evidence",
                            F.when(missing, "error").otherwise("warning"), "Evidence is absent or too short.")),
        F.when(~missing & (result["confidence"] < floor), _issue(
            name, "low_confidence", "warning", "Confidence is lower than usual for this strategy.")))
    # An optional field without a value is not checked further.
    return F.array_compact(F.when(required | ~missing, F.array(first, *rest)).otherwise(F.array(first)))


def _named(results: Column, name: str | Column) -> Column:
    """The first result of that name, found among the names alone."""
    return F.get(results, (F.array_position(results["field_name"], name) - 1).cast("int"))


def _date_confusion(results: Column) -> Column:
    def judge(pair):
        published, due = pair["p"], pair["d"]
        same = (F.coalesce(effective(published), F.lit("")) != "") & (effective(published) == effective(due))
        mixed = F.array_join(published["evidence"]["text"], " ").contains("截止") \
            | F.array_join(due["evidence"]["text"], " ").contains("发布")
        return F.when(F.coalesce(same & mixed, F.lit(False)), _issue(
            "publish_date", "publish_date_deadline_confusion", "warning", "Publication date and deadline may be swapped."))

    return let(F.struct(_named(results, "publish_date").alias("p"), _named(results, "deadline").alias("d")), judge)


def issues_of(fields: Column, results: Column) -> Column:
    return bind(_issues, fields=fields, results=results)


def _issues(fields: Column, results: Column) -> Column:
    per_field = F.flatten(F.transform(fields, lambda f: let(
        _named(results, f["name"]), lambda r: _field_issues(f, r))))
    return F.concat(per_field, F.array_compact(F.array(_date_confusion(results))))


def report_of(issues: Column) -> Column:
    def count(items, severity):
        return F.size(F.filter(items, lambda i: i["severity"] == severity))

    def both(items):
        return F.struct(count(items, "error").alias("e"), count(items, "warning").alias("w"))

    return let(let(issues, both), lambda n: F.struct(
        (n["e"] == 0).alias("passed"), n["e"].alias("error_count"), n["w"].alias("warning_count"),
        F.round(F.greatest(F.lit(0.0), 1.0 - n["e"] * ERROR_COST - n["w"] * WARNING_COST), 4).alias("score")))


def verify(records: DataFrame) -> DataFrame:
    """Add ``issues`` and ``report``; a record without issues scores 1."""
    return records.withColumn("issues", _issues_column()).withColumn("report", report_of(F.col("issues")))


@once
def _issues_column() -> Column:
    return issues_of(F.col("fields"), F.col("results"))


def issue_rows(verified: DataFrame, *keys: str) -> DataFrame:
    return unfold(verified, keys or ("page_id",), F.col("issues"))


def report_rows(verified: DataFrame, *keys: str) -> DataFrame:
    return verified.select(*(keys or ("page_id",)), "report.*")


# -- model fallback --------------------------------------------------------------------------

def model_fields(fields: Column, results: Column, issues: Column) -> Column:
    """ARRAY<STRUCT<field_name, reason>>: where a model's answer is worth asking for."""
    return bind(_model_fields, fields=fields, results=results, issues=issues)


def _model_fields(fields: Column, results: Column, issues: Column) -> Column:
    def decide(f):
        result = _named(results, f["name"])

        def reason_for(r):
            trusted = (r["confidence"] >= 0.45) & (F.size(r["evidence"]) > 0)
            own = F.filter(issues, lambda i: (i["field_name"] == f["name"]) & i["code"].isin(*MODEL_CODES)
                           & ~((i["severity"] == "warning") & ~f["required"] & F.coalesce(trusted, F.lit(False))))
            last = F.try_element_at(own, F.lit(-1))["code"]
            return F.when(r.isNull(), "field_not_returned") \
                .when(f["required"] & (r["status"] == "missing"), "required_field_missing") \
                .when((r["confidence"] < 0.35) & (F.size(r["evidence"]) == 0), "low_confidence") \
                .otherwise(last)

        return F.struct(f["name"].alias("field_name"), let(result, reason_for).alias("reason"))

    return F.filter(F.transform(fields, decide), lambda d: d["reason"].isNotNull())


def decide_fallback(verified: DataFrame) -> DataFrame:
    return verified.withColumn("fallback", _fallback_column())


@once
def _fallback_column() -> Column:
    return model_fields(F.col("fields"), F.col("results"), F.col("issues"))


def repair(decided: DataFrame, attempts: Column | None = None) -> DataFrame:
    """Apply model ``answers`` to the ``fallback`` fields, at most once, and verify again.

    Adds ``repair_outcomes``, ``repair_status`` and ``repair_attempts``; replaces results,
    overall_confidence, issues and report. A missing answer counts as an abstention.
    """
    tried = F.lit(0) if attempts is None else attempts
    names = ("repair_outcomes", "overall_confidence", "results", "issues", "report", "repair_status",
             "repair_attempts")
    step = decided.withColumn("_tried", tried).withColumn("_r", _repair_column())
    return step.withColumns({n: F.col("_r")[n] for n in names}).drop("_r", "_tried")


@once
def _repair_column() -> Column:
    return bind(_repair, fields=F.col("fields"), results=F.col("results"), fallback=F.col("fallback"),
                answers=F.col("answers"), overall=F.col("overall_confidence"), tried=F.col("_tried"))


def _repair(fields, results, fallback, answers, overall, tried) -> Column:
    active = (F.size(fallback) > 0) & (tried < 1)

    def named(items, name):
        return F.get(F.filter(items, lambda x: x["field_name"] == name), F.lit(0))

    def failed(r, message):
        kept = [r[k] for k in ("field_pos", "field_name", "value", "normalized_value", "confidence", "evidence",
                               "strategy")]
        return F.struct(*kept, F.lit("fallback_failed").alias("status"), message.alias("error_message")) \
            .cast(RESULT_TYPE)

    def rework(r):
        kind = F.get(F.filter(fields, lambda f: f["name"] == r["field_name"]), F.lit(0))["type"]

        def apply(x):
            given = x["a"]["value"]
            value = F.when(x["kind"] == "date", normalize_date(given)).otherwise(given)
            fixed = F.struct(
                r["field_pos"], r["field_name"], given.alias("value"), value.alias("normalized_value"),
                F.lit(REPAIR_CONFIDENCE).alias("confidence"), F.array(x["a"]["evidence"]).alias("evidence"),
                F.lit("llm_fallback").alias("strategy"), F.lit("repaired").alias("status"),
                F.lit(None).cast("string").alias("error_message")).cast(RESULT_TYPE)
            usable = (F.coalesce(given, F.lit("")) != "") & x["a"]["evidence"].isNotNull()
            return F.when(x["d"].isNull(), r).when(x["a"]["error"].isNotNull(), failed(r, x["a"]["error"])) \
                .when(usable, fixed).otherwise(failed(r, F.concat(
                    F.lit("LLM fallback abstained: "), x["d"]["reason"])))

        return let(F.struct(named(fallback, r["field_name"]).alias("d"), named(answers, r["field_name"]).alias("a"),
                            kind.alias("kind")), apply)

    def outcome(old, new):
        state = F.when(new["status"] == "repaired", "repaired").when(
            new["error_message"].startswith("LLM fallback abstained: "), "abstained").otherwise("failed")
        return F.struct(
            old["field_name"].alias("field_name"), effective(old).alias("before"), effective(new).alias("after"),
            named(fallback, old["field_name"])["reason"].alias("reason"), state.alias("result"))

    def mean(items):
        total = F.aggregate(items, F.lit(0.0), lambda acc, r: acc + r["confidence"])
        return F.when(F.size(items) > 0, F.round(total / F.size(items), 4)).otherwise(0.0)

    def finish(new):
        return let(F.struct(new.alias("r"), issues_of(fields, new).alias("i")), report)

    def report(x):
        asked = let(fallback["field_name"], lambda names: F.filter(
            F.zip_with(results, x["r"], outcome), lambda o: F.array_contains(names, o["field_name"])))
        checked = let(x["i"]["field_name"], lambda open_: F.transform(asked, lambda o: F.struct(
            o["field_name"], o["before"], o["after"], o["reason"], o["result"],
            ((o["result"] == "repaired") & ~F.array_contains(open_, o["field_name"])).alias("verified"))))
        return F.struct(
            F.when(active, checked).otherwise(F.slice(checked, 1, 0)).alias("repair_outcomes"),
            F.when(active, mean(x["r"])).otherwise(overall).alias("overall_confidence"),
            x["r"].alias("results"), x["i"].alias("issues"), report_of(x["i"]).alias("report"),
            F.when(active, "repaired").otherwise("repair_skipped").alias("repair_status"),
            (tried + active.cast("int")).alias("repair_attempts"))

    return let(F.when(active, F.transform(results, rework)).otherwise(results), finish)


# -- rule checks before publication ----------------------------------------------------------

def check_expected(verified: DataFrame, expected: str = "expected_values") -> DataFrame:
    """Confirmed values (MAP) must be reproduced; any error caps the score at one half."""
    def test(e, results):
        got = F.get(F.filter(results, lambda r: r["field_name"] == e["key"]), F.lit(0))
        return F.when(collapse(effective(got)) != collapse(e["value"]), _issue(
            e["key"], "guidance_mismatch", "error", "The rules do not give the confirmed value."))

    def check(results, issues, expected, report):
        mismatch = F.array_compact(F.transform(F.map_entries(expected), lambda e: test(e, results)))
        whole = F.concat(issues, F.coalesce(mismatch, F.array().cast(f"array<{ISSUE_TYPE}>")))
        return let(whole, lambda all_: F.struct(all_.alias("issues"), capped(report_of(all_), report).alias("report")))

    def capped(fresh, report):
        return let(fresh, lambda n: F.struct(
            n["passed"], n["error_count"], n["warning_count"],
            F.when(n["passed"], report["score"]).otherwise(F.least(report["score"], F.lit(0.5))).alias("score")))

    state = bind(check, results=F.col("results"), issues=F.col("issues"), expected=F.col(expected),
                 report=F.col("report"))
    return verified.withColumn("_c", state).withColumns(
        {"issues": F.col("_c.issues"), "report": F.col("_c.report")}).drop("_c")


def second_page_gate(checks: DataFrame, second: DataFrame, key: str = "check_id") -> DataFrame:
    """A check whose second page fails is itself failed. ``second``: key, passed."""
    failed = second.filter(~F.col("passed")).select(key).distinct().withColumn("_second_failed", F.lit(True))
    issue = _issue("", "second_page_failed", "error", "A second page of this structure failed.")
    joined = checks.join(failed, key, "left")
    return joined.withColumn("issues", F.when(
        F.col("_second_failed"), F.concat("issues", F.array(issue))).otherwise(F.col("issues"))) \
        .withColumn("passed", F.col("report.passed") & F.col("_second_failed").isNull()).drop("_second_failed")


