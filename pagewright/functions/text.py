"""Text views, dates, snippets and identifier clean-up as native expressions."""

from __future__ import annotations

import html.entities as entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import BLANK, collapse, let, once, one_space

# Marks used while a page is a flat string: a line break and a chunk boundary.
BREAK, EDGE = "\u0001", "\u0002"

# Elements whose content is never text, and elements whose end tag breaks a line.
HIDDEN = ("script", "style", "noscript", "template")
LINE_ENDERS = "p|div|li|tr|h1|h2|h3|br"

# The opening sign stands in front of all alternatives: they are tried only where it is.
_HIDDEN_RE = "|".join(rf"{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in HIDDEN)
# One scan decides whether a comment opens first or a hidden element does.
_DROP_RE = rf"(?is)<(?:!--.*?-->|{_HIDDEN_RE}|[!?][^>]*>)"
_ENDER_RE = rf"(?i)<(?:/(?:{LINE_ENDERS})(?:[\s/][^>]*)?>|(?:{LINE_ENDERS})(?:\s[^>]*)?/>)"
_QUOTED_TAG_RE = r"""</?[A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
_TAG_RE = r"</?[A-Za-z][^>]*>"


def _string_map(pairs: dict[str, str]) -> Column:
    """One literal, folded at planning time."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


# Entity tables come from the standard library's HTML5 list, so there is nothing to keep in step.
_NAMED = {k[:-1]: v for k, v in entities.html5.items() if k.endswith(";") and k != "amp;"}
_LEGACY = {k: v for k, v in entities.html5.items() if not k.endswith(";") and k != "amp"}
_LEGACY_RE = "&(" + "|".join(sorted(_LEGACY, key=len, reverse=True)) + ")(?!;)"
_CP1252 = {
    str(n): bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)
    if bytes([n]).decode("cp1252", "ignore")
}


def _code_point(number: Column) -> Column:
    control = number.between(1, 8) | number.between(14, 31) | number.isin(11, 127)
    safe = F.when((number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF), number)
    char = F.when(control, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))
    return F.coalesce(F.try_element_at(_string_map(_CP1252), number.cast("string")), char, F.lit("�"))


def _substitute(text: Column, pattern: str, form: str, value) -> Column:
    """Replace every distinct ``form % name`` found by ``pattern`` with ``value(name)``."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return F.aggregate(
        names, text, lambda acc, n: F.replace(acc, F.format_string(form, n), value(n))
    )


def _unescape_once(text: Column) -> Column:
    def known(n):
        return F.coalesce(F.try_element_at(_string_map(_NAMED), n), F.format_string("&%s;", n))

    text = _substitute(text, r"&#([0-9]{1,7});", "&#%s;", lambda n: _code_point(n.cast("bigint")))
    text = let(text, lambda t: _substitute(
        t, r"&#[xX]([0-9a-fA-F]{1,6});", "&#x%s;",
        lambda n: _code_point(F.conv(n, 16, 10).cast("bigint"))))
    text = let(text, lambda t: _substitute(t, r"&([A-Za-z][A-Za-z0-9]*);", "&%s;", known))
    text = let(text, lambda t: _substitute(
        t, _LEGACY_RE, "&%s", lambda n: F.try_element_at(_string_map(_LEGACY), n)))
    # Last, so that an ampersand made here is not read as the start of another entity.
    return F.regexp_replace(text, "&amp;?", "&")


def unescape(text: Column) -> Column:
    """HTML entity decoding; the table look-ups run only on text that needs them."""
    rare = text.rlike(r"&(?!(amp|copy|middot);)")
    quick = F.replace(F.replace(F.replace(text, F.lit("&copy;"), F.lit("©")),
                                F.lit("&middot;"), F.lit("·")), F.lit("&amp;"), F.lit("&"))
    return F.when(~text.contains("&"), text).when(rare, _unescape_once(text)).otherwise(quick)


def text_lines(markup: Column) -> Column:
    """Visible lines of a page as ARRAY<STRING>.

    Chunks between tags are collapsed on their own and glued without a separator, an end tag
    of a line-ending element breaks the line, entities are decoded twice.
    """
    flat = F.regexp_replace(F.coalesce(markup, F.lit("")), f"[{BREAK}{EDGE}]", " ")
    flat = F.regexp_replace(flat, _DROP_RE, EDGE)
    flat = F.regexp_replace(flat, _ENDER_RE, f"{EDGE}{BREAK}{EDGE}")
    flat = F.regexp_replace(F.regexp_replace(flat, _QUOTED_TAG_RE, EDGE), _TAG_RE, EDGE)
    flat = let(let(flat, unescape), unescape)
    # Blank runs collapse, then blanks touching a chunk edge vanish with the edge.
    flat = one_space(flat)
    flat = F.regexp_replace(flat, f" ?{EDGE}[ {EDGE}]*", "")
    lines = F.transform(F.split(flat, BREAK), collapse)
    return F.filter(lines, lambda line: line != "")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def page_text(markup: Column) -> Column:
    return join_lines(text_lines(markup))


strip_tags = page_text


@once
def lines_of(markup: str) -> Column:
    return text_lines(F.col(markup))


@once
def title_of(markup: str) -> Column:
    return page_title(F.col(markup))


@once
def headings_of(markup: str) -> Column:
    return page_headings(F.col(markup))


def _chunks_after(markup: Column, tag_pattern: str) -> Column:
    """Text chunks whose latest start tag matches; a comment ends a chunk, an element ends the run."""
    flat = F.regexp_replace(F.coalesce(markup, F.lit("")), f"[{BREAK}{EDGE}]", " ")
    flat = F.regexp_replace(flat, r"(?s)(?<=[^<])<!--.*?-->", EDGE)
    flat = F.regexp_replace(flat, _DROP_RE, "<x>")
    runs = F.regexp_extract_all(flat, F.lit(rf"(?i)<{tag_pattern}\b[^>]*>([^<]+)"), F.lit(1))
    chunks = F.flatten(F.transform(runs, lambda r: F.split(r, EDGE)))
    clean = F.transform(chunks, lambda c: collapse(let(let(c, unescape), unescape)))
    return F.filter(clean, lambda c: c != "")


def page_title(markup: Column, fallback: Column | None = None) -> Column:
    title = F.array_join(_chunks_after(markup, "title"), " ")
    return title if fallback is None else F.coalesce(F.nullif(title, F.lit("")), fallback)


def page_headings(markup: Column) -> Column:
    """Text directly after an h1/h2/h3 start tag; text behind a nested tag is not a heading."""
    return _chunks_after(markup, "h[123]")


_YMD = r"(\d{4})\s*[年\-/.]\s*(\d{1,2})\s*[月\-/.]\s*(\d{1,2})\s*日?"
_DIGITS = r"(\d{4})(\d{2})(\d{2})"
# Written so already; most values that are checked are.
_ISO = r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\z"


def normalize_date(value: Column) -> Column:
    """First year-month-day in the text as ISO; anything else comes back collapsed."""
    return F.when(value.rlike(_ISO), value).otherwise(let(collapse(value), date_of))


def date_of(text: Column) -> Column:
    """The same of a text that is collapsed already."""
    def iso(t, pattern):
        parts = F.struct(*[F.lpad(F.regexp_extract(t, pattern, i), n, "0").alias(k) for i, k, n in (
            (1, "y", 4), (2, "m", 2), (3, "d", 2))])
        # Two digits compare as text as they do as numbers.
        return let(parts, lambda p: F.when(p["m"].between("01", "12") & p["d"].between("01", "31"), F.concat_ws(
            "-", p["y"], p["m"], p["d"])).otherwise(t))

    return F.when(text.rlike(_ISO), text).when(text.rlike(_YMD), iso(text, _YMD)).when(text.rlike(_DIGITS), iso(text, _DIGITS)).otherwise(text)


def snippet(text: Column, start: Column, end: Column, radius: int = 60) -> Column:
    """Text around [start, end), collapsed."""
    # A substring ends with its text, wherever the window would.
    return let(F.greatest(F.lit(0), start - radius), lambda first: collapse(
        F.substring(text, first + 1, F.greatest(F.lit(0), end + radius - first))))


def locate(text: Column, value: Column) -> Column:
    """0-based offset of the first occurrence, or null."""
    at = F.when(value == "", F.lit(0)).otherwise(F.instr(text, value) - 1)
    return F.when(at >= 0, at)


def field_identifier(value: Column) -> Column:
    """Stable ASCII snake_case field name; null when nothing is left."""
    text = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    text = F.regexp_replace(text, r"[\p{L}\p{N}&&[^a-z0-9]]", "")
    text = F.regexp_replace(text, "[^a-z0-9_]", "_")
    text = F.regexp_replace(F.trim(text, F.lit("_")), "_+", "_")
    text = F.when(text.rlike("^[0-9]"), F.concat(F.lit("field_"), text)).otherwise(text)
    return F.nullif(F.substring(text, 1, 64), F.lit(""))


def safe_text(value: Column, limit: int = 240) -> Column:
    return F.nullif(F.substring(collapse(value), 1, limit), F.lit(""))


def safe_text_list(values: Column, limit: int = 120, most: int = 8) -> Column:
    clean = F.filter(F.transform(values, lambda v: safe_text(v, limit)), lambda v: v.isNotNull())
    return F.coalesce(F.slice(F.array_distinct(clean), 1, most), F.array().cast("array<string>"))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{BLANK}+|{BLANK}+$", "")


def optional_text(value: Column, limit: int = 500) -> Column:
    text = strip(value)
    return F.when(F.length(text).between(1, limit), text)


def label_list(values: Column, most: int = 8) -> Column:
    clean = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.coalesce(F.slice(F.array_distinct(clean), 1, most), F.array().cast("array<string>"))


def estimate_tokens(chars: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / chars_per_token).cast("int"))
