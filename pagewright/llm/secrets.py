"""Secrets in texts by fixed patterns and by sliding-window entropy, in DataFrame operations only.

Three patterns give the base spans. Beyond them, every maximal run of a character class is a candidate
string. A window slides over it one character at a time: the counts of characters change by one that
enters and one that leaves, and so does the sum of c*log2(c), from which the Shannon entropy of the
window follows. Windows of at least the class's entropy are merged into spans. Candidates that an
allow-list pattern matches (numbers, words without digits, ordered alphabets, placeholders) give none.

The sum of c*log2(c) is kept in whole millionths, so results do not hang on the order of additions.
All of it is array expressions on the document's row: nothing is shuffled.

Defined results: a null text is empty and has no spans; every row gives one row, repeated ids too; an
empty table gives no rows; other columns are not looked at. Positions are code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, once


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the base spans are: fixed by the contract. The letters of the words stand in either case. Classes are
#: spelt out: the Java engine tests single characters in one table look-up, ranges one after the other.
ASSIGN = ("(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?"
          + either_case("key") + rf""")["']?\x20*[:=]\x20*["']?([{_UPPER}{_LOWER}{_DIGITS}+/_.=-]+)""")
ACCESS = f"AKIA[{_UPPER}{_DIGITS}]{{14,}}"
HEX = f"[{_DIGITS}abcdef]{{16,}}"
#: One of these stands in lower case in every text with an assignment; a plain search for them is cheap.
ASSIGN_SIGNS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGNED = 12


@dataclass(frozen=True)
class CharacterClass:
    """Maximal runs of ``letters`` of at least ``window`` characters are looked at; ``bits`` is the least entropy."""
    kind: str
    letters: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.letters}]{{{self.window},}}"


CLASSES = (CharacterClass("entropy_hex", _DIGITS + "ABCDEFabcdef", 20, 3.0),
           CharacterClass("entropy_token", _DIGITS + _UPPER + _LOWER + "+/_-", 20, 3.7))
#: Candidates that are no secrets.
ALLOWED = ("^[0-9]+$", "^[^0-9]+$", "0123456789|123456789012|abcdefghijk|ABCDEFGHIJK",
           "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
           "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
MILLIONTHS = 1_000_000
#: Prefix sums are made in blocks of so many, which keeps long lists from quadratic copying.
BLOCK = 256
SPANS = "array<struct<start:bigint,end:bigint,found:string>>"


def weights(window: int) -> list[int]:
    """c*log2(c) in millionths, for every count that a window can hold."""
    return [0, *(round(c * math.log2(c) * MILLIONTHS) for c in range(1, window + 1))]


def most_weight(cls: CharacterClass) -> int:
    """The largest sum of c*log2(c) at which a window still has the entropy of its class."""
    return math.floor(cls.window * (math.log2(cls.window) - cls.bits) * MILLIONTHS)


def _running(items: Column, start: Column) -> Column:
    """The sums before every item of a short list."""
    grown = F.aggregate(items, F.struct(F.array().cast("array<bigint>").alias("a"), start.cast("bigint").alias("t")),
                        lambda s, x: F.struct(F.concat(s["a"], F.array(s["t"])).alias("a"), (s["t"] + x).alias("t")))
    return grown["a"]


def before(lengths: Column) -> Column:
    """The sums before every item of a non-empty list of longs."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def shifted(blk: Column) -> Column:
        totals = F.transform(blk, lambda one: F.aggregate(one, F.lit(0).cast("bigint"), lambda s, x: s + x))
        return let(_running(totals, F.lit(0)), lambda at: F.flatten(F.transform(
            blk, lambda one, i: _running(one, F.get(at, i)))))

    return let(blocks, shifted)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in order.

    The texts between matches give the positions, so only rows with a match are read a second time.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def spans(g: Column) -> Column:
            steps = F.transform(found, lambda m, i: (F.length(F.get(g, i)) + F.length(m)).cast("bigint"))
            starts = let(steps, before)
            return let(starts, lambda at: F.transform(found, lambda m, i: let(
                F.get(at, i) + F.length(F.get(g, i)),
                lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))))

        return F.when(F.size(found) > 0, let(gaps, spans)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def dense_windows(run: Column, cls: CharacterClass) -> Column:
    """array<struct<start, end>>: merged windows of a run whose entropy reaches that of the class."""
    w, most = cls.window, F.lit(most_weight(cls)).cast("bigint")
    table = F.array(*[F.lit(v).cast("bigint") for v in weights(w)])
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(cls.letters), c) - 1)
    state = F.struct(F.array_repeat(F.lit(0), len(cls.letters)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def slide(code: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters = F.get(code, i)
            leaves = F.when(i >= w, F.get(code, i - w)).otherwise(F.lit(-1))

            def moved(c: Column) -> Column:
                n_in, n_out = F.get(c["counts"], c["enters"]), F.get(c["counts"], c["leaves"])
                gain = F.get(table, n_in + 1) - F.get(table, n_in)
                loss = F.when(c["leaves"] >= 0, F.get(table, n_out) - F.get(table, n_out - 1)).otherwise(F.lit(0))
                same = c["enters"] == c["leaves"]
                total = F.when(same, s["sum"]).otherwise(s["sum"] + gain - loss)
                counts = F.when(same, c["counts"]).otherwise(F.transform(
                    c["counts"], lambda n, k: n + (k == c["enters"]).cast("int") - (k == c["leaves"]).cast("int")))
                return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(
                    (i >= w - 1) & (t <= most), _covered(s["spans"], i - (w - 1), i + 1)).otherwise(s["spans"]).alias("spans")))

            return let(F.struct(s["counts"].alias("counts"), enters.alias("enters"), leaves.alias("leaves")), moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), state, step, lambda s: s["spans"])

    return let(codes, slide)


def _covered(spans: Column, start: Column, end: Column) -> Column:
    """The spans with one more, which begins no earlier than the last and may touch it."""
    last = F.try_element_at(spans, F.lit(-1))
    one = lambda a: F.array(F.struct(a.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
    return F.when(last["end"] >= start, F.concat(F.slice(spans, 1, F.size(spans) - 1), one(last["start"]))) \
        .otherwise(F.concat(spans, one(start)))


def entropy_spans(text: Column, cls: CharacterClass, allowed: Sequence[str] = ALLOWED) -> Column:
    """array<struct<start, end>> of one character class, without candidates that the allow-list matches."""
    runs = F.filter(located(text, cls.pattern),
                    lambda r: reduce(lambda kept, p: kept & ~r["found"].rlike(p), allowed, F.lit(True)))
    return F.flatten(F.transform(runs, lambda r: F.transform(
        dense_windows(r["found"], cls), lambda s: F.struct((r["start"] + s["start"]).alias("start"), (r["start"] + s["end"]).alias("end")))))


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@once
def _spans(classes: tuple[CharacterClass, ...], allowed: tuple[str, ...]) -> Column:
    """struct<base, added> of the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hinted = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in ASSIGN_SIGNS])
    assigned = F.when(hinted, located(text, ASSIGN)).otherwise(F.array().cast(SPANS))
    long_enough: Callable[[Column], Column] = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= ASSIGNED
    kinds = [("assign", F.filter(assigned, long_enough)), ("access", located(text, ACCESS)),
             ("hex", located(text, HEX))]
    base = F.concat(*[_named(spans, i, kind) for i, (kind, spans) in enumerate(kinds)])
    added = F.concat(*[_named(entropy_spans(text, c, allowed), len(kinds) + i, c.kind) for i, c in enumerate(classes)])
    return F.struct(base.alias("base"), added.alias("added"))


def find(documents: DataFrame, classes: Sequence[CharacterClass] = CLASSES,
         allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id, base and added: array<struct<start, order, end, kind>> of every document row.

    The spans come out of a generator, so whoever uses them often does not work them out again.
    """
    return documents.select("doc_id", F.inline(F.array(_spans(tuple(classes), tuple(allowed)))))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document row."""
    out = find(documents)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"),
                      F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      _written(F.concat("base", "added")).alias("spans"))
