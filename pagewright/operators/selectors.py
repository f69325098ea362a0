"""CSS and XPath selection over page trees.

A selector is data: a column of alternatives, each an array of steps. The same expression
therefore serves one hand-written rule and a table with a different selector on every row.
Supported CSS: tag, *, .class, #id, [attr], [attr op 'v'], :nth-of-type(n), descendant, child
and comma. Supported XPath: // and / steps, name or *, [@a], [@a='v'], [contains(@a,'v')],
`or`/`and` between them, [n], a final /text() or /@attr, and unions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import collapse, let
from .dom import is_below, nearest_marked, node_text

TEST_TYPE = "struct<op:string,name:string,value:string>"
STEP_TYPE = f"struct<child:boolean,tag:string,tests:array<array<{TEST_TYPE}>>>"
SELECTOR_TYPE = f"array<struct<steps:array<{STEP_TYPE}>,tail:string>>"

_NAME = r"[A-Za-z_][\w\-]*"
_CSS_ATTR = r"\[\s*[\w:\-]+\s*(?:[*^$~|]?=\s*(?:'[^'\]]*'|\"[^\"\]]*\"|[\w\-]+)\s*)?\]"
_CSS_COMPOUND = (
    rf"(?=[^\s>])(?:{_NAME}|\*)?(?:#[\w\-]+|\.[\w\-]+|{_CSS_ATTR}|:nth-of-type\(\d+\))*")
_CSS_OK = rf"^{_CSS_COMPOUND}(?:\s*>\s*{_CSS_COMPOUND}|\s+{_CSS_COMPOUND})*$"
_X_TEST = (r"(?:@[\w:\-]+(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?"
           r"|contains\(\s*@[\w:\-]+\s*,\s*(?:'[^']*'|\"[^\"]*\")\s*\))")
_X_PRED = rf"\[\s*(?:\d+|{_X_TEST}(?:\s+(?:or|and)\s+{_X_TEST})*)\s*\]"
_X_STEP = rf"//?(?:{_NAME}|\*)(?:{_X_PRED})*"
_X_OK = rf"^(?:{_X_STEP})+(?:/text\(\)|/@[\w:\-]+)?$"


def _test(op, name, value) -> Column:
    as_column = [x if isinstance(x, Column) else F.lit(x) for x in (op, name, value)]
    return F.struct(as_column[0].cast("string").alias("op"), as_column[1].cast("string").alias("name"),
                    as_column[2].cast("string").alias("value"))


def _unquote(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^['\"]|['\"]$", "")


def _grab(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _css_tests(compound: Column) -> Column:
    bare = F.regexp_replace(compound, r"\[[^\]]*\]", "")

    def single(items, make):
        return F.transform(items, lambda x: F.array(make(x)))

    def attribute(text):
        head = r"^\s*([\w:\-]+)\s*([*^$~|]?=)?\s*(.*)$"
        op = F.regexp_extract(text, head, 2)
        return _test(F.when(op == "", "has").otherwise(op), F.regexp_extract(text, head, 1),
                     _unquote(F.regexp_extract(text, head, 3)))

    return F.concat(
        single(_grab(bare, r"#([\w\-]+)"), lambda x: _test("=", "id", x)),
        single(_grab(bare, r"\.([\w\-]+)"), lambda x: _test("~=", "class", x)),
        single(_grab(compound, r"\[([^\]]*)\]"), attribute),
        single(_grab(bare, r":nth-of-type\((\d+)\)"), lambda x: _test("nth", None, x)),
    )


def css_selector(text: Column) -> Column:
    """Parsed selector, or null when it is outside the supported forms."""
    parts = F.transform(F.split(F.trim(text), r"\s*,\s*(?![^\[]*\])"), lambda x: F.trim(x))
    cut = rf"(^|\s*>\s*|\s+)((?:{_NAME}|\*)?(?:#[\w\-]+|\.[\w\-]+|{_CSS_ATTR}|:nth-of-type\(\d+\))*)"

    def steps(part):
        pairs = F.arrays_zip(_grab(part, cut, 1).alias("gap"), _grab(part, cut, 2).alias("body"))
        return F.transform(F.filter(pairs, lambda p: p["body"] != ""), lambda p: F.struct(
            p["gap"].contains(">").alias("child"),
            F.coalesce(F.nullif(F.lower(F.regexp_extract(p["body"], rf"^({_NAME}|\*)", 1)), F.lit("")),
                       F.lit("*")).alias("tag"),
            _css_tests(p["body"]).alias("tests")))

    parsed = F.transform(parts, lambda p: F.struct(
        steps(p).alias("steps"), F.lit(None).cast("string").alias("tail")))
    return F.when(F.forall(parts, lambda p: p.rlike(_CSS_OK)), parsed).cast(SELECTOR_TYPE)


def _xpath_brackets(predicates: Column) -> Column:
    """Every bracket becomes a list of OR alternatives; `and` splits into further brackets."""
    def test(text):
        name = F.regexp_extract(text, r"@([\w:\-]+)", 1)
        quoted = F.regexp_extract(text, r"['\"](.*)['\"]", 1)
        return F.when(text.rlike(r"^\d+$"), _test("nth", None, text)) \
            .when(text.startswith("contains"), _test("*=", name, quoted)) \
            .when(text.contains("="), _test("=", name, quoted)).otherwise(_test("has", name, None))

    groups = F.flatten(F.transform(_grab(predicates, rf"({_X_PRED})"), lambda b: F.split(
        F.regexp_replace(b, r"^\[\s*|\s*\]$", ""), r"\s+and\s+")))
    return F.transform(groups, lambda g: F.transform(F.split(g, r"\s+or\s+"), lambda t: test(F.trim(t))))


def xpath_selector(text: Column) -> Column:
    parts = F.transform(F.split(F.trim(text), r"\s*\|\s*"), lambda x: F.trim(x))
    cut = rf"(//?)({_NAME}|\*)((?:{_X_PRED})*)"

    def steps(part):
        body = F.regexp_replace(part, r"/text\(\)$|/@[\w:\-]+$", "")
        zipped = F.arrays_zip(_grab(body, cut, 1).alias("gap"), _grab(body, cut, 2).alias("tag"),
                              _grab(body, cut, 3).alias("preds"))
        return F.transform(zipped, lambda p: F.struct(
            (p["gap"] == "/").alias("child"), F.lower(p["tag"]).alias("tag"),
            _xpath_brackets(p["preds"]).alias("tests")))

    parsed = F.transform(parts, lambda p: F.struct(
        steps(p).alias("steps"),
        F.nullif(F.regexp_extract(p, r"/(text\(\)|@[\w:\-]+)$", 1), F.lit("")).alias("tail")))
    return F.when(F.forall(parts, lambda p: p.rlike(_X_OK)), parsed).cast(SELECTOR_TYPE)


def parse_selector(strategy: Column, text: Column) -> Column:
    return F.when(strategy == "css", css_selector(text)).when(strategy == "xpath", xpath_selector(text))


def _passes(node: Column, test: Column) -> Column:
    value = F.try_element_at(node["attrs"], test["name"])
    op, wanted = test["op"], test["value"]
    return F.coalesce(
        F.when(op == "nth", node["nth"] == wanted.cast("int"))
        .when(op == "has", value.isNotNull())
        .when(op == "=", value == wanted)
        .when(op == "~=", F.array_contains(F.split(value, r"\s+"), wanted))
        .when(op == "*=", (wanted != "") & value.contains(wanted))
        .when(op == "^=", (wanted != "") & value.startswith(wanted))
        .when(op == "$=", (wanted != "") & value.endswith(wanted))
        .when(op == "|=", (value == wanted) | value.startswith(F.concat(wanted, F.lit("-")))),
        F.lit(False))


def _fits(node: Column, step: Column) -> Column:
    return ((step["tag"] == "*") | (step["tag"] == node["tag"])) & F.forall(
        step["tests"], lambda bracket: F.exists(bracket, lambda t: _passes(node, t)))


def select_nodes(nodes: Column, steps: Column) -> Column:
    """Elements matching one alternative, in document order.

    Steps are taken from the left, each for the whole page: marked are the elements that fit it and
    stand right below (a child step) or anywhere below an element marked for the step before.
    """
    def advance(state, step):
        def placed(n, nearest):
            return F.when(state["first"], ~step["child"] | (n["parent"] < 0)) \
                .when(step["child"], F.coalesce(F.get(state["marks"], n["parent"]), F.lit(False))) \
                .otherwise(is_below(n, nearest))

        nearest = F.when(~state["first"] & ~step["child"], nearest_marked(nodes, state["marks"]))
        return let(nearest, lambda up: F.struct(F.lit(False).alias("first"), F.transform(
            nodes, lambda n: placed(n, up) & _fits(n, step)).alias("marks")))

    start = F.struct(F.lit(True).alias("first"), F.array().cast("array<boolean>").alias("marks"))
    last = F.element_at(steps, -1)
    walked = let(F.aggregate(steps, start, advance)["marks"], lambda marks: F.filter(nodes, lambda n: F.get(marks, n["id"])))
    return F.when((F.size(steps) == 1) & ~last["child"], F.filter(nodes, lambda n: _fits(n, last))).otherwise(walked)


def matches(nodes: Column, tokens: Column, selector: Column, attribute: Column) -> Column:
    """ARRAY<STRUCT<node, tag, value>> in document order; null for an invalid selector."""
    def values(alternative):
        def of(n):
            tail = alternative["tail"]
            whole = F.when(attribute.isNotNull(),
                           F.coalesce(F.try_element_at(n["attrs"], attribute), F.lit(""))) \
                .otherwise(node_text(n, tokens))
            own = F.transform(F.filter(
                F.slice(tokens, n["tok_from"] + 1, n["tok_to"] - n["tok_from"]),
                lambda t: t["node"] == n["id"]), lambda t: t["text"])
            attr = F.try_element_at(n["attrs"], F.substring(tail, F.lit(2), F.length(tail)))
            found = F.when(tail.isNull(), F.array(whole)).when(tail == "text()", own) \
                .otherwise(F.array_compact(F.array(attr)))
            return F.transform(found, lambda v: F.struct(
                n["id"].alias("node"), n["tag"].alias("tag"), collapse(v).alias("value")))

        return F.flatten(F.transform(select_nodes(nodes, alternative["steps"]), of))

    whole = F.flatten(F.transform(selector, values))
    # A union may meet an element twice; text and attribute matches are kept as they are.
    united = F.when(F.size(selector) > 1, F.array_sort(F.array_distinct(whole))).otherwise(whole)
    tailed = F.exists(selector, lambda a: a["tail"].isNotNull())
    return F.when(selector.isNull() | (tailed & attribute.isNotNull()), None).otherwise(united)


# Elements that stand for the document rather than for its content.
DOCUMENT_TAGS = ("html", "body", "head", "title")


def outcome(found: Column) -> Column:
    """invalid_selector / no_matches / ambiguous_matches / empty_value / success."""
    return F.when(found.isNull(), "invalid_selector") \
        .when(F.size(found) == 0, "no_matches") \
        .when(F.size(found) > 1, "ambiguous_matches") \
        .when(F.get(found, F.lit(0))["value"] == "", "empty_value").otherwise("success")
