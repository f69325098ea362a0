"""URLs, redaction and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import compact, let

INVALID_URL = "[invalid-url]"
REDACTED = "[redacted]"


def redact(value: Column, secrets: Sequence[str] = (), limit: int = 1000) -> Column:
    """Blank out secret literals and URL user-info, then truncate."""
    for secret in secrets:
        if secret:
            value = F.replace(value, F.lit(secret), F.lit(REDACTED))
    return F.substring(F.regexp_replace(value, r"(https?://)[^/\s@]+@", rf"$1{REDACTED}@"), 1, limit)


def redact_list(values: Column, secrets: Sequence[str] = ()) -> Column:
    return F.transform(values, lambda v: redact(v, secrets))


def redact_map(values: Column, secrets: Sequence[str] = ()) -> Column:
    return F.transform_values(values, lambda _, v: redact(v, secrets))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(_authority(url), "^.*@", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    name = F.regexp_replace(_host_port(url), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(name, r"^\[|\]$", ""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(_host_port(url), r":([0-9]+)$", 1), F.lit("")).cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def safe_url(url: Column, secrets: Sequence[str] = ()) -> Column:
    """Scheme, lower-case host, port and path; no user-info, query or fragment."""
    bad_port = F.regexp_extract(_host_port(url), r":([^:\]]*)$", 1).rlike("[^0-9]")
    bad = (bad_port & ~_host_port(url).rlike(r"^\[.*\]$")) | (F.coalesce(port(url), F.lit(0)) > 65535) \
        | (_authority(url).contains("[") != _authority(url).contains("]"))
    named = F.when(host(url).contains(":"), F.concat(F.lit("["), host(url), F.lit("]"))) \
        .otherwise(host(url))
    place = F.concat(named, F.when(port(url) > 0, F.concat(F.lit(":"), port(url).cast("string")))
                     .otherwise(""))
    lead = F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise("")
    whole = F.concat(lead, F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""), path(url))
    return F.when(bad, F.lit(INVALID_URL)).otherwise(redact(whole, secrets))


def second_page_problem(first: Column, second: Column) -> Column:
    """Why ``second`` cannot serve as another page of the same site; null when it can."""
    def origin(u):
        return F.struct(scheme(u), host(u), F.coalesce(port(u), F.lit(-1)))

    same_page = (scheme(first) == scheme(second)) & (_authority(first) == _authority(second)) \
        & (path(first) == path(second)) & (query(first) == query(second))
    return F.when(~scheme(second).isin("http", "https") | (origin(first) != origin(second)),
                  F.lit("different_origin")) \
        .when(_authority(second).contains("@") | same_page, F.lit("same_page_or_credentials"))


def fingerprint(markup: Column) -> Column:
    """Content hash of the page; null for an empty page."""
    return F.when(F.length(markup) > 0, F.sha2(markup, 256))


def signature(value: Column) -> Column:
    """Hash of a struct, array or map as JSON; give struct fields in alphabetical order."""
    return F.sha2(F.to_json(value), 256)


def origin_parts(url: Column) -> Column:
    return let(url, lambda u: F.struct(
        scheme(u).alias("scheme"), host(u).alias("host"), port(u).alias("port"),
        path(u).alias("path"), F.array_join(compact(query(u)), "").alias("query")))
