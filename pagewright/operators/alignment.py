"""Schema-free records against a schema, and evidence spans against annotated spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, let

ALIAS_WEIGHT = 0.9
LEAST_SCORE = 0.5
LEAST_SHARE = 0.5
#: Characters of text that share a bucket of the range join.
SPAN_BUCKET = 256


def key_words(name: Column) -> Column:
    """Distinct lower-case words of a key: page_title, pageTitle and "Page title" are the same two."""
    parted = F.regexp_replace(F.coalesce(name, F.lit("")), r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(parted), r"[^\p{L}\p{Nd}]+"), lambda w: w != ""))


def _likeness(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 where neither has any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def align(keys: Column, fields: Column, least: float = LEAST_SCORE) -> Column:
    """One-to-one pairs of record keys and schema fields: ARRAY<STRUCT<field_name, key, score>>.

    A key scores the share of words it has in common with a field's name, or 0.9 of that with an alias. Pairs
    are taken best first: a key that is a field's very name, then by score, field and key order; each field and
    key once. Pairs below ``least`` do not count. Keys are distinct; null arrays align nothing.
    """
    def pairs(keys, fields):
        words = F.transform(keys, key_words)

        def scored(f, i, words):
            names = F.transform(F.coalesce(f["aliases"], F.array().cast("array<string>")), key_words)

            def one(own, k, j):
                alias = F.coalesce(F.array_max(F.transform(names, lambda n: _likeness(n, k) * ALIAS_WEIGHT)), F.lit(0.0))
                score = F.greatest(_likeness(own, k), alias)
                return F.struct((F.get(keys, j) != f["name"]).alias("other"), (-score).alias("rank"), i.alias("i"), j.alias("j"))

            return let(key_words(f["name"]), lambda own: F.transform(words, lambda k, j: one(own, k, j)))

        rated = let(words, lambda w: F.flatten(F.transform(fields, lambda f, i: scored(f, i, w))))
        good = F.sort_array(F.filter(rated, lambda p: ~p["other"] | (p["rank"] <= -least)))
        none = F.array().cast("array<struct<i:int,j:int,score:double>>")

        def take(acc, p):
            free = ~F.exists(acc, lambda a: (a["i"] == p["i"]) | (a["j"] == p["j"]))
            pair = F.struct(p["i"].alias("i"), p["j"].alias("j"), F.when(p["other"], -p["rank"]).otherwise(1.0).alias("score"))
            return F.when(free, F.concat(acc, F.array(pair.cast("struct<i:int,j:int,score:double>")))).otherwise(acc)

        return F.transform(F.aggregate(good, none, take), lambda a: F.struct(
            F.get(fields, a["i"])["name"].alias("field_name"), F.get(keys, a["j"]).alias("key"), a["score"].alias("score")))

    return bind(pairs, keys=keys, fields=fields)


def rename(entries: Column, fields: Column, least: float = LEAST_SCORE) -> Column:
    """Record entries (``key`` first) under the names of the fields they align with; others keep their key."""
    def named(entries, fields):
        return let(align(entries["key"], fields, least), lambda pairs: F.transform(entries, lambda e: e.withField(
            "key", F.coalesce(F.get(F.filter(pairs, lambda p: p["key"] == e["key"]), F.lit(0))["field_name"], e["key"]))))

    return bind(named, entries=entries, fields=fields)


def matched_spans(spans: DataFrame, marks: DataFrame, *keys: str, share: float = LEAST_SHARE, bucket: int = SPAN_BUCKET) -> DataFrame:
    """Annotated spans that a span of the same item and field covers to at least ``share``: one row per pair.

    ``spans``: any columns with ``keys``, field_name, start_char and end_char (exclusive). ``marks``: keys,
    field_name, start_char, end_char. Both sides go into buckets of text, so an item with very many spans is
    met bucket by bucket and not in one task; a pair counts in the first bucket that both have. Empty, turned
    and null spans match nothing.
    """
    def cut(df, *extra):
        whole = df.filter("start_char < end_char and start_char is not null and end_char is not null")
        last = F.col("end_char") - 1
        return whole.select(*extra, F.struct("start_char", "end_char").alias("span"), F.explode(F.sequence(
            F.floor(F.col("start_char") / bucket), F.floor(last / bucket))).alias("_bucket"))

    on = [*keys, "field_name"]
    left = cut(spans, *[c for c in spans.columns if c not in ("start_char", "end_char")])
    right = cut(marks, *on).withColumnRenamed("span", "mark")
    joined = left.join(right, [*on, "_bucket"])
    begin = F.greatest("span.start_char", "mark.start_char")
    common = F.least("span.end_char", "mark.end_char") - begin
    here = F.col("_bucket") == F.floor(begin / bucket)
    enough = common >= F.lit(share) * (F.col("mark.end_char") - F.col("mark.start_char"))
    return joined.filter(here & (common > 0) & enough).drop("_bucket")


def annotate(records: DataFrame, spans: DataFrame, marks: DataFrame, key: str, *, share: float = LEAST_SHARE) -> DataFrame:
    """Add ``annotations`` to records of (method, key): each annotated field, and whether its evidence meets a mark.

    ``spans``: method, key, field_name, start_char, end_char of the evidence. ``marks``: key, field_name,
    start_char, end_char. A record of an item without marks has no annotations (null). The map is no longer
    than the list of annotated fields.
    """
    met = matched_spans(spans.select("method", key, "field_name", "start_char", "end_char"), marks, key, share=share)
    hits = met.groupBy("method", key).agg(F.collect_set("field_name").alias("_met"))
    known = marks.filter("field_name is not null").groupBy(key).agg(F.sort_array(F.collect_set("field_name")).alias("_marked"))
    joined = records.join(known, key, "left").join(hits, ["method", key], "left")
    right = F.transform("_marked", lambda f: F.struct(f, F.coalesce(F.array_contains("_met", f), F.lit(False))))
    return joined.withColumn("annotations", F.when(F.col("_marked").isNotNull(), F.map_from_entries(right))).drop("_met", "_marked")
