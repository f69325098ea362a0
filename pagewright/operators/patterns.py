"""Rule patterns as literals: one compiled engine for each, and one call for position, match and group.

A pattern that comes from a column is compiled again whenever the next rule brings another one. The
patterns of a program table are few and known before the job runs, so they go into the plan as literals
and every rule is routed to its own. Tables with more than ``MOST`` distinct patterns, and patterns whose
meaning would change inside a larger one, keep the column form; results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 64
FLAGS = "(?imUd)"
#: Separates the parts of a marked text. Texts that hold it take the column form.
MARK = "\x01"
# Numbered back references, comment mode, literal quotes and \G depend on what stands around them.
_ROOTED = re.compile(r"\\[1-9GQE]|\(\?[a-zA-Z]*x|\(\?\(")


def movable(pattern: str) -> bool:
    return pattern.startswith(FLAGS) and not _ROOTED.search(pattern)


def routed(value: Column, known: Sequence[str], literal: Callable[[str], Column], other: Column) -> Column:
    """``literal`` of the known text that equals ``value``, else ``other``."""
    out = None
    for text in known:
        out = (F if out is None else out).when(value == F.lit(text), literal(text))
    return other if out is None else out.otherwise(other)


def first_match(text: Column, pattern: str, grouped: bool) -> Column:
    """array [before, match, group 1, behind] of the first match; one element without any.

    The engine looks for the shortest text before a match and writes marks around the parts.
    """
    inner = pattern[len(FLAGS):]
    around = rf"\A((?s:.*?))({FLAGS[:-1]}:{inner}))"
    return F.split(F.regexp_replace(text, around, f"$1{MARK}$2{MARK}{'$3' if grouped else '$2'}{MARK}"), MARK, -1)
