"""Field extraction: run a program of rules over pages.

Each page row carries its views (``text``, ``lines`` and, for DOM rules, ``nodes``/``tokens``),
its schema ``fields`` and its ``rules``. All rules of a page run on that row; nothing moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, collapse, let, once, present, unfold
from ..functions.text import join_lines, lines_of, locate, normalize_date, snippet
from .dom import NODE_TYPE, TOKEN_TYPE, page_trees
from .labels import HITS_TYPE, label_hits, label_walk, longest_first
from .patterns import MARK, MOST, first_match, movable, routed
from .selectors import SELECTOR_TYPE, matches, outcome, parse_selector
from .skew import attach, fits_broadcast
from .specs import POSTPROCESS, STRATEGIES, java_pattern, pattern_compiles

EVIDENCE_TYPE = "struct<source:string,text:string,start_char:int,end_char:int,score:double>"
RESULT_TYPE = ("struct<field_pos:int,field_name:string,value:string,normalized_value:string,"
               f"confidence:double,evidence:array<{EVIDENCE_TYPE}>,strategy:string,status:string,"
               "error_message:string>")
ANSWER_TYPE = f"struct<field_name:string,value:string,evidence:{EVIDENCE_TYPE},error:string>"
_HIT_TYPE = f"struct<value:string,evidence:{EVIDENCE_TYPE},error:string>"

# Confidence base per strategy and evidence score per source.
BASE = {"css": 0.82, "xpath": 0.8, "regex_on_text": 0.76, "text_near_label": 0.86, "llm_fallback": 0.48}
SCORE = {"dom": 0.8, "regex_on_text": 0.75, "text_near_label": 0.85}


def _hit(value, source, text, start, end, score) -> Column:
    return F.struct(value.alias("value"), F.struct(
        source.alias("source"), text.alias("text"), start.cast("int").alias("start_char"),
        end.cast("int").alias("end_char"), score.cast("double").alias("score")).alias("evidence"),
        F.lit(None).cast("string").alias("error")).cast(_HIT_TYPE)


def _miss(error: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if error is None else error
    return F.struct(F.lit(None).cast("string").alias("value"),
                    F.lit(None).cast(EVIDENCE_TYPE).alias("evidence"), text.alias("error")).cast(_HIT_TYPE)


def _located(text: Column, start: Column, length: Column, value: Column, source: str) -> Column:
    """A hit with the text around it; its place is worked out once."""
    return let(F.struct(start.alias("at"), (start + length).alias("end"), value.alias("v")), lambda m: _hit(
        m["v"], F.lit(source), snippet(text, m["at"], m["end"]), m["at"], m["end"], F.lit(SCORE[source])))


COMPILED_TYPE = ("struct<field_name:string,strategy:string,enabled:boolean,selector:string,attribute:string,"
                 f"postprocess:array<string>,steps:{SELECTOR_TYPE},pattern:string,has_group:boolean,"
                 "labels:array<string>,error:string>")


def compile_rules(rules: Column) -> Column:
    """Everything about a rule that does not depend on the page, worked out once per program.

    A rule that cannot run (a pattern that does not compile, an unknown strategy or step) carries an
    error instead; it fails on its field and the other rules go on.
    """
    def one(r):
        given = F.nullif(r["pattern"], F.lit(""))
        full = F.concat(F.lit("(?imUd)"), java_pattern(given))
        unknown = F.filter(r["postprocess"], lambda s: ~s.isin(*POSTPROCESS))
        error = F.when((r["strategy"] == "regex_on_text") & given.isNotNull() & ~pattern_compiles(given),
                       F.concat(F.lit("invalid pattern: "), given)) \
            .when(~r["strategy"].isin(*STRATEGIES), F.concat(F.lit("unsupported strategy: "), r["strategy"])) \
            .when(F.size(unknown) > 0, F.concat(F.lit("unsupported postprocess function: "), F.get(unknown, F.lit(0))))
        return F.struct(
            r["field_name"], r["strategy"], r["enabled"], r["selector"], r["attribute"], r["postprocess"],
            parse_selector(r["strategy"], r["selector"]).alias("steps"),
            F.when((r["strategy"] == "regex_on_text") & error.isNull(), full).alias("pattern"),
            has_group(r["pattern"]).alias("has_group"),
            ranked_labels(r["label"], r["labels"]).alias("labels"), error.alias("error")).cast(COMPILED_TYPE)

    # A label rule carries all labels of its field, so an equal one behind it can never succeed.
    def repeated(kept, r):
        return (r["strategy"] == "text_near_label") & F.exists(kept, lambda k: (
            k["strategy"] == r["strategy"]) & (k["field_name"] == r["field_name"]) & (k["labels"] == r["labels"])
            & (k["enabled"] == r["enabled"]))

    start = F.array().cast(f"array<{COMPILED_TYPE}>")
    return F.aggregate(F.transform(rules, one), start, lambda kept, r: F.when(
        repeated(kept, r), kept).otherwise(F.concat(kept, F.array(r))))


def ranked_labels(label: Column, labels: Column) -> Column:
    """Distinct non-empty labels, longest first, then by text."""
    given = F.array_distinct(F.filter(
        F.concat(F.array(label), F.coalesce(labels, F.array().cast("array<string>"))),
        lambda x: F.coalesce(x, F.lit("")) != ""))
    return longest_first(given)


def program_walk(compiled: Column) -> Column:
    """The label tree of a program's enabled label rules."""
    own = F.filter(compiled, lambda r: (r["strategy"] == "text_near_label") & r["enabled"])
    return label_walk(F.flatten(F.transform(own, lambda r: r["labels"])))


def near_label(hits: Column, text: Column, labels: Column) -> Column:
    """Value behind ``label：`` on the first line that carries one of the labels, the longest of them."""
    def report(h):
        start = F.greatest(F.instr(text, h["line"]) - 1, F.lit(0))
        return F.when(h.isNull(), _miss()).otherwise(_located(
            text, start, F.length(h["line"]), h["value"], "text_near_label"))

    return let(F.get(F.filter(hits, lambda h: F.array_contains(labels, h["label"])), F.lit(0)), report)


def has_group(pattern: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[[^\]]*\]", "")
    return F.coalesce(plain.rlike(r"\((?!\?)|\(\?P?<[A-Za-z]"), F.lit(False))


def by_pattern(text: Column, pattern: Column, grouped: Column, known: Sequence[tuple[str, bool]] = ()) -> Column:
    """First match, case-insensitive, multi-line; group 1 if the pattern has groups."""
    def report(at, whole, value):
        return _located(text, at, F.length(whole), collapse(value), "regex_on_text")

    def literal(p):
        return let(first_match(text, p, groups[p]), lambda parts: F.when(F.size(parts) > 1, report(
            F.length(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(_miss()))

    start = _code_points(text, F.call_function("regexp_instr", text, pattern) - 1)
    whole = F.call_function("regexp_extract", text, pattern, F.lit(0))
    value = F.call_function("regexp_extract", text, pattern, grouped.cast("int"))
    found = let(F.struct(start.alias("at"), whole.alias("w"), value.alias("v")), lambda m: F.when(
        m["at"] >= 0, report(m["at"], m["w"], m["v"])).otherwise(_miss()))
    groups = {p: g for p, g in known if movable(p)}
    if groups:
        found = F.when(F.contains(text, F.lit(MARK)), found).otherwise(routed(pattern, list(groups), literal, found))
    return F.when(pattern.isNull(), _miss()).otherwise(found)


def _code_points(text: Column, units: Column) -> Column:
    """The pattern engine counts UTF-16 units; texts are counted in characters.

    Where a text holds characters of two units, each is written as two marks to find out how many
    lie before the match.
    """
    marked = F.regexp_replace(F.regexp_replace(text, "[\ue000\ue001]", "x"), r"[\x{10000}-\x{10FFFF}]", "\ue000\ue001")
    before = F.substring(marked, F.lit(1), units)
    pairs = F.length(before) - F.length(F.replace(before, F.lit("\ue001"), F.lit("")))
    return F.when((units > 0) & text.rlike(r"[\x{10000}-\x{10FFFF}]"), units - pairs).otherwise(units)


def by_selector(rule: Column, nodes: Column, tokens: Column, text: Column) -> Column:
    """Exactly one non-empty match is a value; ambiguity and bad selectors are errors."""
    def judge(found):
        state = outcome(found)
        value = F.get(found, F.lit(0))["value"]
        start = locate(text, value)
        fail = F.concat(F.when(found.isNull(), "invalid ").otherwise("ambiguous "), rule["strategy"],
                        F.lit(" selector: "), rule["selector"])
        return F.when(state == "success", _hit(
            value, rule["strategy"], value, start, start + F.length(value), F.lit(SCORE["dom"]))) \
            .when(state.isin("invalid_selector", "ambiguous_matches"), _miss(fail)).otherwise(_miss())

    return F.when(F.coalesce(rule["selector"], F.lit("")) == "", _miss()).otherwise(
        let(matches(nodes, tokens, rule["steps"], rule["attribute"]), judge))


def postprocess(value: Column, steps: Column) -> Column:
    """The three steps do not depend on their order; rules with unknown steps never get here."""
    return F.when(F.array_contains(steps, "normalize_date"), normalize_date(value)) \
        .when(F.array_contains(steps, "normalize_whitespace"), collapse(value)) \
        .when(F.array_contains(steps, "strip"), F.trim(value)).otherwise(value)


def confidence(strategy: Column, value: Column, score: Column) -> Column:
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), strategy)
    short = F.when(F.length(value) < 2, 0.15).otherwise(0.0)
    raw = F.round((base - short + score) / 2, 4)
    return F.when((F.coalesce(value, F.lit("")) == "") | score.isNull(), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def run_rule(rule: Column, page: dict[str, Column], known: Sequence[tuple[str, bool]] = ()) -> Column:
    """STRUCT<value, evidence, error> of one compiled rule on one page."""
    strategy = rule["strategy"]
    branch = F.when(rule["error"].isNotNull(), _miss(rule["error"])) \
        .when(strategy == "text_near_label", near_label(page["hits"], page["text"], rule["labels"])) \
        .when(strategy == "regex_on_text", by_pattern(page["text"], rule["pattern"], rule["has_group"], known))
    if "nodes" in page:
        branch = branch.when(strategy.isin("css", "xpath"), by_selector(
            rule, page["nodes"], page["tokens"], page["text"]))
    else:
        branch = branch.when(strategy.isin("css", "xpath"), _miss())
    if "answers" in page:
        answer = F.get(F.filter(page["answers"], lambda a: a["field_name"] == rule["field_name"]), F.lit(0))
        branch = branch.when(strategy == "llm_fallback", F.struct(
            answer["value"], answer["evidence"], answer["error"]).cast(_HIT_TYPE))
    else:
        branch = branch.when(strategy == "llm_fallback", _miss())
    return branch.otherwise(_miss())


def rules_by_field(fields: Column, rules: Column) -> Column:
    """The enabled rules of every field, in the order of the fields."""
    return F.transform(fields, lambda f: F.filter(rules, lambda r: (r["field_name"] == f["name"]) & r["enabled"]))


def _untried() -> Column:
    return F.struct(
        F.lit(None).cast(_HIT_TYPE).alias("hit"), F.lit(None).cast("string").alias("strategy"),
        F.array().cast("array<string>").alias("steps"), F.array().cast("array<string>").alias("errors"))


def _tried(state: Column, rule: Column, h: Column) -> Column:
    return F.struct(
        F.when(present(h["value"]), h).alias("hit"), rule["strategy"].alias("strategy"),
        rule["postprocess"].alias("steps"),
        F.when(h["error"].isNull(), state["errors"]).otherwise(F.concat(state["errors"], F.array(h["error"]))).alias("errors"))


def _result(field: Column, position: Column, s: Column) -> Column:
    value = postprocess(s["hit"]["value"], s["steps"])
    found = let(value, lambda v: F.struct(
        position.cast("int").alias("field_pos"), field["name"].alias("field_name"),
        s["hit"]["value"].alias("value"), v.alias("normalized_value"),
        confidence(s["strategy"], v, s["hit"]["evidence"]["score"]).alias("confidence"),
        F.array_compact(F.array(s["hit"]["evidence"])).alias("evidence"),
        s["strategy"].alias("strategy"), F.lit("extracted").alias("status"),
        F.lit(None).cast("string").alias("error_message")).cast(RESULT_TYPE))
    missing = F.struct(
        position.cast("int").alias("field_pos"), field["name"].alias("field_name"),
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("normalized_value"),
        F.lit(0.0).alias("confidence"), F.array().cast(f"array<{EVIDENCE_TYPE}>").alias("evidence"),
        F.lit("none").alias("strategy"), F.lit("missing").alias("status"),
        F.nullif(F.array_join(s["errors"], "; "), F.lit("")).alias("error_message")).cast(RESULT_TYPE)
    return F.when(s["hit"].isNotNull(), found).otherwise(missing)


def run_field(field: Column, position: Column, rules: Column, page: dict[str, Column],
              allow_model: bool, known: Sequence[tuple[str, bool]] = ()) -> Column:
    """First successful one of a field's own rules; later rules are not evaluated."""
    own = rules if allow_model else F.filter(rules, lambda r: r["strategy"] != "llm_fallback")

    def step(state, rule):
        return F.when(state["hit"].isNotNull(), state).otherwise(
            let(run_rule(rule, page, known), lambda h: _tried(state, rule, h)))

    return let(F.aggregate(own, _untried(), step), lambda s: _result(field, position, s))


def run_field_twice(field: Column, position: Column, rules: Column, page: dict[str, Column],
                    known: Sequence[tuple[str, bool]] = ()) -> Column:
    """STRUCT<plain, model>: what ``run_field`` gives without and with the model; a rule runs once for both."""
    def step(state, rule):
        plain = state["plain"]["hit"].isNull() & (rule["strategy"] != "llm_fallback")
        model = state["model"]["hit"].isNull()
        return F.when(~(plain | model), state).otherwise(let(run_rule(rule, page, known), lambda h: F.struct(
            F.when(plain, _tried(state["plain"], rule, h)).otherwise(state["plain"]).alias("plain"),
            F.when(model, _tried(state["model"], rule, h)).otherwise(state["model"]).alias("model"))))

    start = F.struct(_untried().alias("plain"), _untried().alias("model"))
    return let(F.aggregate(rules, start, step), lambda s: F.struct(
        _result(field, position, s["plain"]).alias("plain"), _result(field, position, s["model"]).alias("model")))


def overall_confidence(results: Column) -> Column:
    return let(results, _mean_of_found)


def _mean_of_found(results: Column) -> Column:
    total = F.aggregate(results, F.lit(0.0), lambda acc, r: acc + F.when(
        r["status"] != "missing", r["confidence"]).otherwise(0.0))
    return F.when(F.size(results) > 0, F.round(total / F.size(results), 4)).otherwise(0.0)


_VIEWS = ("text", "lines", "nodes", "tokens", "answers")


@once
def _results(views: tuple[str, ...], compiled: bool, allow_model: bool | None, patterns: tuple[tuple[str, bool], ...],
             walks: tuple[str, ...]) -> Column:
    def run(fields, rules, walk, **view):
        found = label_hits(view["lines"], walk, walks) if "lines" in view else F.array().cast(HITS_TYPE)
        if allow_model is None:
            pairs = let(found, lambda hits: F.transform(fields, lambda f, i: run_field_twice(
                f, i, F.get(rules, i), view | {"hits": hits}, patterns)))
            return let(pairs, lambda p: F.struct(p["plain"].alias("plain"), p["model"].alias("model")))
        return let(found, lambda hits: F.transform(fields, lambda f, i: run_field(
            f, i, F.get(rules, i), view | {"hits": hits}, allow_model, patterns)))

    given = {v: F.col(v) for v in views}
    if compiled:
        return bind(run, fields=F.col("fields"), rules=F.col("field_rules"), walk=F.col("label_walk"), **given)
    return let(compile_rules(F.col("rules")), lambda rules: bind(
        run, fields=F.col("fields"), rules=rules_by_field(F.col("fields"), rules), walk=program_walk(rules), **given))


def results_of(pages: DataFrame, allow_model: bool | None = False) -> Column:
    """``results`` for pages holding fields, rules (or compiled rules) and the views rules need.

    Without a choice (None): STRUCT<plain, model>, both results from one run of the rules.
    """
    views = tuple(n for n in _VIEWS if n in pages.columns)
    compiled = "compiled" in pages.columns
    known = pages.schema["compiled"].metadata.get(KNOWN, {}) if compiled else {}
    return _results(views, compiled, allow_model, tuple((p, g) for p, g in zip(known.get("patterns", ()), known.get("groups", ()))),
                    tuple(known.get("walks", ())))


def extract_fields(pages: DataFrame, allow_model: bool = False, with_model: str | None = None) -> DataFrame:
    """Add ``results`` (one struct per schema field) and ``overall_confidence``.

    Needs text, lines, fields and rules; nodes and tokens for DOM rules; answers for the model. ``with_model``
    names a column for what the same rules give when the model may be asked; ``results`` are then without it.
    """
    if with_model is not None:
        both = pages.withColumn("_both", results_of(pages, None))
        return both.withColumns({"results": F.col("_both.plain"), with_model: F.col("_both.model")}).drop("_both") \
            .withColumn("overall_confidence", overall_confidence(F.col("results")))
    return pages.withColumn("results", results_of(pages, allow_model)) \
        .withColumn("overall_confidence", overall_confidence(F.col("results")))


#: Where a column of compiled rules says which patterns it can hold.
KNOWN = "known"


def _ready(programs: DataFrame, *on: str) -> tuple[DataFrame, dict, bool]:
    """Programs compiled, the patterns they hold (as far as they are few), and whether any rule reads elements."""
    ready = programs.select(*on, "fields", compile_rules(F.col("rules")).alias("compiled")) \
        .withColumn("label_walk", program_walk(F.col("compiled"))) \
        .withColumn("field_rules", rules_by_field(F.col("fields"), F.col("compiled")))
    each = ready.select(F.explode(F.concat(
        F.transform("compiled", lambda r: F.struct(
            F.when(r["enabled"] & (r["strategy"] == "regex_on_text"), r["pattern"]).alias("pattern"), r["has_group"].alias("grouped"),
            F.lit(None).cast("string").alias("walk"), (r["enabled"] & r["strategy"].isin("css", "xpath")).alias("dom"))),
        F.array(F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(False).alias("grouped"),
                         F.col("label_walk.pattern").alias("walk"), F.lit(False).alias("dom"))))).alias("r")).select("r.*").distinct()
    rows = each.limit(4 * MOST + 1).collect()
    patterns = sorted({(r["pattern"], r["grouped"]) for r in rows if r["pattern"] is not None})
    walks = sorted({r["walk"] for r in rows if r["walk"] is not None})
    few = len(rows) <= 4 * MOST
    known = {"patterns": [p for p, _ in patterns], "groups": [g for _, g in patterns]} if few and len(patterns) <= MOST else {}
    if few and len(walks) <= MOST:
        known["walks"] = walks
    return ready, known, not few or any(r["dom"] for r in rows)


def _marked(df: DataFrame, known: dict) -> DataFrame:
    return df.withMetadata("compiled", {KNOWN: known})


def _attached(pages: DataFrame, ready: DataFrame, known: dict, on: str, small: bool | None = None) -> DataFrame:
    """Every page with its schema's fields and compiled rules; a page without a program has none.

    ``program_error`` says so, and such a page has no results.
    """
    joined = attach(pages, ready, on, how="left", small=small)
    types = dict(ready.dtypes)
    missing = F.when(F.col("fields").isNull(), F.concat(F.lit("no program for schema "), F.coalesce(
        F.col(on).cast("string"), F.lit("(none)"))))
    return _marked(joined.withColumn("program_error", missing).withColumns({
        c: F.coalesce(c, F.array().cast(types[c])) for c in ("fields", "compiled")}), known)


def with_programs(pages: DataFrame, programs: DataFrame, on: str = "schema_id") -> DataFrame:
    """Bring each page its schema's fields and compiled rules; no page is lost."""
    ready, known, _ = _ready(programs, on)
    return _attached(pages, ready, known, on)


def prepare(pages: DataFrame, programs: DataFrame, on: str = "schema_id", keep: tuple[str, ...] = ("page_id", "url"),
            markup: str = "html") -> DataFrame:
    """Views and programs for pages with their markup.

    Only pages whose program holds an enabled DOM rule are parsed into trees; without any such program
    there is no parsing stage. Rules do not go through that stage: a flag does, and programs join behind it.
    """
    ready, known, dom = _ready(programs, on)
    rows, small = pages.select(*keep, on, markup), fits_broadcast(ready)
    if dom:
        flags = ready.select(on, F.exists("compiled", lambda r: r["enabled"] & r["strategy"].isin("css", "xpath")).alias("_dom"))
        flagged = attach(rows, flags, on, how="left", small=small).withColumn("_markup", F.when(F.col("_dom"), F.col(markup)))
        rows = page_trees(flagged, (*keep, on, markup), "_markup")
    else:
        rows = rows.withColumn("nodes", F.array().cast(f"array<{NODE_TYPE}>")).withColumn("tokens", F.array().cast(f"array<{TOKEN_TYPE}>"))
    viewed = rows.withColumn("lines", lines_of(markup)).withColumn("text", join_lines(F.col("lines"))).drop(markup)
    return _attached(viewed, ready, known, on, small)


def with_one_program(pages: DataFrame, program: DataFrame) -> DataFrame:
    """The same when all pages share one program: a scalar subquery, so there is no join at all."""
    ready, known, _ = _ready(program)
    parts = ("fields", "compiled", "label_walk", "field_rules")
    one = ready.select(F.struct(*parts).alias("p")).scalar()
    return _marked(pages.withColumn("_p", one).withColumns({c: F.col(f"_p.{c}") for c in parts}).drop("_p"), known)


def field_results(extracted: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per page and field."""
    keys = keys or ("page_id",)
    return unfold(extracted, keys, F.col("results"))


def effective(result: Column) -> Column:
    return F.coalesce(result["normalized_value"], result["value"])


def record_map(results: Column) -> Column:
    return F.map_from_entries(F.transform(results, lambda r: F.struct(r["field_name"], effective(r))))


def wide_records(extracted: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """One column per field, without a shuffle."""
    record = record_map(F.col("results"))
    return extracted.select(*(keys or ("page_id",)), record.alias("_r")).select(
        *(keys or ("page_id",)), *[F.try_element_at("_r", F.lit(n)).alias(n) for n in names])


def evidence_rows(extracted: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("page_id",)
    rows = unfold(extracted, keys, F.col("results"), "r")
    return unfold(rows, (*keys, "r.field_pos", "r.field_name"), F.col("r.evidence"), position="evidence_no")


@once
def model_only() -> Column:
    """Results of asking a model for every field, without any program."""
    return model_results(F.col("fields"), F.col("answers"))


def model_results(fields: Column, answers: Column) -> Column:
    def one(f, i, answers):
        answer = F.get(F.filter(answers, lambda a: a["field_name"] == f["name"]), F.lit(0))
        return let(answer, lambda a: F.struct(
            i.cast("int").alias("field_pos"), f["name"].alias("field_name"), a["value"].alias("value"),
            a["value"].alias("normalized_value"), F.coalesce(a["evidence"]["score"], F.lit(0.0)).alias("confidence"),
            F.array_compact(F.array(a["evidence"])).alias("evidence"), F.lit("llm_fallback").alias("strategy"),
            F.when(F.coalesce(a["value"], F.lit("")) != "", "extracted").otherwise("missing").alias("status"),
            a["error"].alias("error_message")).cast(RESULT_TYPE))

    return bind(lambda fields, answers: F.transform(fields, lambda f, i: one(f, i, answers)),
                fields=fields, answers=answers)
