"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline a projected array into a lambda and so re-evaluate it for every
    element; a lambda variable is always evaluated once per row. The start of an aggregate over no
    elements is such a variable, without an array around the value and without a copy of the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


# Large expressions are immutable plan fragments over named columns: assemble each one once per process.
once = lru_cache(maxsize=256)


def bind(body: Callable[..., Column], /, **columns: Column) -> Column:
    """``body`` over several columns, each evaluated once per row however often it is used."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return let(packed, lambda s: body(**{n: s[n] for n in columns}))


def unfold(df: DataFrame, keys: Sequence, items: Column, name: str | None = None, position: str | None = None) -> DataFrame:
    """One row per element of an array: the keys, the element (its fields, if no ``name`` is given) and its place.

    The generator is an outer one, and its rows without an element are dropped behind it. In front of any
    other the optimizer puts a filter on the array's size, which works the whole array out a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(items).alias("_at", "_item")).filter(F.col("_at").isNotNull())
    at = [] if position is None else [F.col("_at").alias(position)]
    return rows.select(*rows.columns[:-2], *at, F.col("_item").alias(name) if name else "_item.*")


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.length(collapse(value)) == 0)


def present(value: Column) -> Column:
    """Neither null nor the empty string; a blank-only string still counts."""
    return value.isNotNull() & (value != "")


# White space as the extraction rules understand it. Single Latin-1 characters share one bit test
# and one range guards the rest, so an ordinary letter costs two comparisons.
_FAR = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_WIDE = rf"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0{_FAR}"
BLANK = rf"[ {_WIDE}]"
# Every blank run except a lone space, which needs no change. An ordinary letter is looked at once.
_RUN = rf"{BLANK}(?:(?<! ){BLANK}*+|{BLANK}++)"


def one_space(value: Column) -> Column:
    return F.regexp_replace(value, _RUN, " ")


def collapse(value: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed; null becomes ''."""
    return F.trim(one_space(F.coalesce(value, F.lit(""))))


def first_or_null(items: Column) -> Column:
    return F.get(items, F.lit(0))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def reason(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))
