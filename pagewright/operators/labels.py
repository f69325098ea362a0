"""Labels of a program as one prefix tree, walked once per line.

All labels of a program's label rules become one pattern that is factored by their first letters, so a
line is read once however many labels there are. The pattern gives the longest label the line begins
with; the shorter ones it also begins with are that label's own prefixes, which are known beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import BLANK, collapse, let, present
from .patterns import routed

WALK_TYPE = "struct<pattern:string,chains:map<string,array<string>>>"
HITS_TYPE = "array<struct<line:string,label:string,value:string>>"
#: Letters that are factored out; behind them labels stand side by side, the longest first.
DEPTH = 3
_VALUE = rf"^{BLANK}*[：:\-]{BLANK}*(.+)$"


def longest_first(texts: Column) -> Column:
    return F.array_sort(F.transform(texts, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}])", r"\\$1")


def _tree(labels: Column, depth: int) -> Column:
    """Alternatives that prefer the longest label; labels with different first letters exclude each other."""
    if not depth:
        return F.array_join(F.transform(longest_first(labels), _quoted), "|")
    heads = F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.substring(x, 1, 1))))

    def branch(head: Column) -> Column:
        rest = F.transform(F.filter(labels, lambda x: F.substring(x, 1, 1) == head),
                           lambda x: F.substring(x, F.lit(2), F.length(x)))
        return F.concat(_quoted(head), F.lit("(?:"), let(rest, lambda r: _tree(r, depth - 1)), F.lit(")"))

    ended = F.when(F.array_contains(labels, ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.transform(heads, branch), ended), "|")


def label_walk(labels: Column) -> Column:
    """The tree of a program's distinct labels; for labels that begin with others, those (itself first)."""
    def built(all_: Column) -> Column:
        chains = F.filter(F.transform(all_, lambda x: F.struct(x.alias("label"), longest_first(
            F.filter(all_, lambda y: x.startswith(y))).alias("chain"))), lambda c: F.size(c["chain"]) > 1)
        return F.when(F.size(all_) > 0, F.struct(
            F.concat(F.lit("^(?:"), _tree(all_, DEPTH), F.lit(")")).alias("pattern"),
            F.map_from_entries(chains).alias("chains")).cast(WALK_TYPE))

    return let(F.array_distinct(F.filter(labels, present)), built)


def label_hits(lines: Column, walk: Column, known: Sequence[str] = ()) -> Column:
    """line, label, value of every label that a line carries, by line and with longer labels first."""
    def first_label(line: Column) -> Column:
        return routed(walk["pattern"], known, lambda p: F.regexp_extract(line, p, 0),
                      F.call_function("regexp_extract", line, walk["pattern"], F.lit(0)))

    def values(named: Column) -> Column:
        chain = F.coalesce(F.try_element_at(walk["chains"], named["label"]), F.array(named["label"]))
        return F.filter(F.transform(chain, lambda x: F.struct(
            named["line"].alias("line"), x.alias("label"),
            collapse(F.regexp_extract(F.substring(named["line"], F.length(x) + 1, F.length(named["line"])), _VALUE, 1)).alias("value"))),
            lambda h: h["value"] != "")

    named = F.filter(F.transform(lines, lambda line: F.struct(line.alias("line"), first_label(line).alias("label"))),
                     lambda n: n["label"] != "")
    return F.when(walk.isNotNull(), F.flatten(F.transform(named, values))).otherwise(F.array().cast(HITS_TYPE))
