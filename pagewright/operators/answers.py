"""Batch exchange with a language model: request rows out, answer rows in. No network here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, collapse, let, unfold
from ..functions.text import locate, normalize_date, snippet, strip
from .extract import ANSWER_TYPE, EVIDENCE_TYPE

# How much of a page goes into each kind of request.
FIELD_TEXT, PROGRAM_TEXT, PROGRAM_MARKUP = 12000, 8000, 6000
SCHEMA_TEXT, SCHEMA_LINES = 10000, 140
HEADINGS, RECORD_LINES, PROGRAM_LINES = 20, 160, 120
DEFAULT_CONFIDENCE = 0.55


def page_view(lines_limit: int, text_limit: int) -> Column:
    """JSON of the truncated page view from url, title, headings, lines and text."""
    return F.to_json(F.struct(
        "url", "title", F.slice("headings", 1, HEADINGS).alias("headings"),
        F.slice("lines", 1, lines_limit).alias("lines"),
        F.substring("text", 1, text_limit).alias("text_excerpt")))


def record_requests(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", page_view(RECORD_LINES, FIELD_TEXT).alias("page"))


def schema_requests(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", page_view(SCHEMA_LINES, SCHEMA_TEXT).alias("page"))


def program_requests(pages: DataFrame, *keep: str) -> DataFrame:
    """Page view, schema and, from the page context, the focus region's markup and selector suggestions."""
    return pages.select(
        "page_id", *keep, page_view(PROGRAM_LINES, PROGRAM_TEXT).alias("page"), F.to_json("fields").alias("schema_fields"),
        F.substring("focus_markup", 1, PROGRAM_MARKUP).alias("excerpt"),
        F.to_json("selector_candidates").alias("selector_candidates"))


def field_requests(decided: DataFrame) -> DataFrame:
    """One request per field the verifier flagged."""
    rows = unfold(decided, ("page_id", "url", "title", F.substring("text", 1, FIELD_TEXT).alias("text"), "fields"),
                  F.col("fallback"), "d")
    spec = F.get(F.filter("fields", lambda f: f["name"] == F.col("d.field_name")), F.lit(0))
    return rows.select("page_id", F.col("d.field_name").alias("field_name"), F.col("d.reason").alias("reason"),
                       F.to_json(spec).alias("field"), "title", "url", "text")


def parse_content(content: Column) -> Column:
    """JSON object text without code fences; null when the answer is not an object."""
    bare = strip(content)
    fenced = F.regexp_replace(bare, "^`+|`+$", "")
    open_ = F.when(F.lower(fenced).startswith("json"), strip(F.substring(fenced, 5, 1 << 30))).otherwise(fenced)
    text = F.when(bare.startswith("```"), open_).otherwise(bare)
    return let(text, lambda t: F.when(
        F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), strip(t)))


def content_error(content: Column) -> Column:
    return F.when(parse_content(content).isNull(), "answer is not a JSON object")


_ANSWER = "struct<value:string,evidence_text:string,confidence:string,abstain:string,field_name:string>"


def _clean(a: Column, field_type: Column) -> Column:
    value = collapse(a["value"])
    return F.when((F.coalesce(a["value"], F.lit("")) != "") & ~F.coalesce(a["abstain"] == "true", F.lit(False)),
                  F.when(field_type == "date", normalize_date(value)).otherwise(value))


def _score(a: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
        a["confidence"].try_cast("double"), F.lit(DEFAULT_CONFIDENCE))))


def _evidence(text: Column, start: Column, end: Column, score: Column) -> Column:
    return F.struct(F.lit("llm_fallback").alias("source"), text.alias("text"), start.alias("start_char"),
                    end.alias("end_char"), score.alias("score")).cast(EVIDENCE_TYPE)


def anchor(content: Column, text: Column, field_type: Column) -> Column:
    """STRUCT<value, evidence>: the answer tied to the page text where it can be found."""
    def tie(a):
        value = _clean(a, field_type)
        quoted = collapse(F.coalesce(F.nullif(a["evidence_text"], F.lit("")), value))

        def place(x):
            def result(p):
                shown = F.when(p["q"].isNull() & p["v"].isNotNull(), snippet(
                    text, p["v"], p["v"] + F.length(x["value"]))).otherwise(x["quoted"])
                start = F.coalesce(p["q"], p["v"])
                return F.when(x["value"].isNotNull(), F.struct(
                    x["value"].alias("value"),
                    _evidence(shown, start, start + F.length(shown), _score(a)).alias("evidence")))

            return let(F.struct(locate(text, x["quoted"]).alias("q"), locate(text, x["value"]).alias("v")), result)

        return let(F.struct(value.alias("value"), quoted.alias("quoted")), place)

    return let(F.from_json(parse_content(content), _ANSWER), tie)


def anchor_strict(content: Column, text: Column, field: Column) -> Column:
    """STRUCT<value, evidence, problem>: evidence must be on the page and the field unchanged."""
    def tie(a):
        value = _clean(a, field["type"])
        quoted = collapse(F.coalesce(F.nullif(a["evidence_text"], F.lit("")), value))
        start = F.when(quoted != "", locate(text, quoted))
        moved = a["field_name"].isNotNull() & (a["field_name"] != field["name"])
        lost = (F.coalesce(a["evidence_text"], F.lit("")) != "") & ~collapse(text).contains(quoted)
        # Results are compared by these texts.
        problem = F.when(a.isNull(), "answer is not a JSON object") \
            .when(moved, "field agent changed field identity") \
            .when(lost, "field evidence is absent from the saved snapshot") \
            .when(value.isNotNull() & start.isNull(), "nonempty field value requires page evidence")
        kept = problem.isNull() & value.isNotNull()
        return F.struct(F.when(kept, value).alias("value"), F.when(kept, _evidence(
            quoted, start, start + F.length(quoted), _score(a))).alias("evidence"), problem.alias("problem"))

    return let(F.when(parse_content(content).isNotNull(), F.from_json(parse_content(content), _ANSWER)), tie)


def answer_arrays(answers: DataFrame, key: str = "page_id") -> DataFrame:
    """Anchored answers (page_id, field_name, value, evidence, error) as one array per page.

    A field has one answer per page, so the array is no longer than the schema.
    """
    one = answers.groupBy(key, "field_name").agg(F.max(F.struct("value", "evidence", "error")).alias("a"))
    return one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "field_name", "a.value", "a.evidence", "a.error").cast(ANSWER_TYPE))).alias("answers"))


_OPEN = "struct<record:map<string,string>,evidence:map<string,struct<text:string,confidence:string>>>"


def open_record(content: Column) -> Column:
    """A schema-free answer: ARRAY<STRUCT<key, value, confidence, evidence_text>>, null unless it is a JSON object."""
    def entries(typed, flat):
        def entry(e):
            seen = F.try_element_at(typed["evidence"], e["key"])
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
                seen["confidence"].try_cast("double"), F.lit(0.0))))
            return F.struct(e["key"].alias("key"), e["value"].alias("value"), score.alias("confidence"),
                            F.nullif(seen["text"], F.lit("")).alias("evidence_text"))

        own = F.filter(F.map_entries(F.coalesce(typed["record"], flat)), lambda e: (e["key"] != "") & (e["key"] != "evidence"))
        return F.transform(own, entry)

    return let(parse_content(content), lambda t: bind(
        entries, typed=F.from_json(t, _OPEN), flat=F.from_json(t, "map<string,string>")))


def record_rows(answers: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """Schema-free record answers as field rows with clamped confidence."""
    rows = unfold(answers, keys or ("page_id",), open_record(F.col(content)))
    return rows.select(*(keys or ("page_id",)), F.col("key").alias("field_name"), "value", "confidence", "evidence_text",
                       F.when(F.coalesce("value", F.lit("")) != "", "extracted").otherwise("missing").alias("status"))


def token_metrics(calls: DataFrame, *keys: str) -> DataFrame:
    """Token totals over attempted calls; actual totals are null once any call lacks usage."""
    tried = calls.withColumn("_t", F.coalesce(F.col("http_attempted"), F.lit(False)))
    lacking = F.col("_t") & (F.col("actual_input_tokens").isNull() | F.col("actual_output_tokens").isNull())

    def total(name):
        return F.coalesce(F.sum(F.when(F.col("_t"), F.col(name))), F.lit(0))

    grouped = (tried.groupBy(*keys) if keys else tried).agg(
        F.count_if("_t").alias("model_call_count"), F.count_if(lacking).alias("token_usage_missing_calls"),
        total("actual_input_tokens").alias("partial_actual_input_tokens"),
        total("actual_output_tokens").alias("partial_actual_output_tokens"),
        total("estimated_input_tokens").alias("estimated_input_tokens"),
        total("estimated_output_tokens").alias("estimated_output_tokens"))
    complete = F.col("token_usage_missing_calls") == 0
    return grouped.withColumn("actual_input_tokens", F.when(complete, F.col("partial_actual_input_tokens"))) \
        .withColumn("actual_output_tokens", F.when(complete, F.col("partial_actual_output_tokens")))
