"""Structure signatures, their comparison, and reuse of verified programs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, compact, let, reason
from ..session import durable
from .noise import BLOCKS
from .skew import attach

SIGNATURE_VERSION = "1"
SIGNATURE_TYPE = (
    "struct<signature_version:string,page_intent:string,title_shape:array<string>,"
    "content_shape:array<string>,heading_count:int,text_block_count:int,repeated_item_ratio:double,"
    "selector_match_counts:map<string,int>,body_visible_text_coverage:double,"
    "body_continuity_score:double,body_noise_ratio:double>"
)

# Measure, tolerance, and the reason when it is exceeded.
TOLERANCES = (
    ("repeated_item_ratio", 0.35, "repeated_item_ratio_out_of_range"),
    ("body_visible_text_coverage", 0.45, "body_coverage_out_of_range"),
    ("body_continuity_score", 0.45, "body_continuity_out_of_range"),
    ("body_noise_ratio", 0.35, "body_noise_ratio_out_of_range"),
)
EXACT = (
    ("signature_version", "signature_version_mismatch"), ("page_intent", "page_intent_mismatch"),
    ("title_shape", "title_shape_mismatch"), ("content_shape", "content_shape_mismatch"),
)


def signature_of(nodes: Column, intent: Column, body: Column, match_counts: Column) -> Column:
    titles = F.filter(nodes, lambda n: n["tag"].isin("h1", "h2", "h3") & (n["chars"] > 0))["tag"]
    regions = F.filter(nodes, lambda n: n["tag"].isin("main", "article")
                       | (F.coalesce(n["attrs"]["role"], F.lit("")) == "main"))["tag"]
    blocks = F.filter(nodes, lambda n: n["tag"].isin(*BLOCKS) & (n["chars"] > 0))
    return F.struct(
        F.lit(SIGNATURE_VERSION).alias("signature_version"), intent["intent"].alias("page_intent"),
        F.slice(titles, 1, 8).alias("title_shape"),
        F.slice(F.array_distinct(regions), 1, 8).alias("content_shape"),
        F.size(titles).alias("heading_count"), F.size(blocks).alias("text_block_count"),
        intent["repeated_item_ratio"].alias("repeated_item_ratio"),
        match_counts.alias("selector_match_counts"),
        body["visible_text_coverage"].alias("body_visible_text_coverage"),
        body["continuity_score"].alias("body_continuity_score"),
        body["noise_ratio"].alias("body_noise_ratio"),
    ).cast(SIGNATURE_TYPE)


def page_signatures(assessed: DataFrame, match_counts: Column | None = None) -> DataFrame:
    """Add ``structure`` to a frame holding ``nodes``, ``intent`` and ``body``."""
    counts = F.create_map().cast("map<string,int>") if match_counts is None else match_counts
    return assessed.withColumn("structure", bind(
        signature_of, nodes=F.col("nodes"), intent=F.col("intent"), body=F.col("body"), match_counts=counts))


def compare(expected: Column, actual: Column, strict: bool = False) -> Column:
    """STRUCT<status, reasons>.

    A missing selector count does not by itself make two pages incompatible; ``strict`` makes it.
    """
    return bind(lambda expected, actual: _compare(expected, actual, strict), expected=expected, actual=actual)


def _compare(expected: Column, actual: Column, strict: bool) -> Column:
    reasons = [reason(~expected[name].eqNullSafe(actual[name]), text) for name, text in EXACT]
    unknown = F.lit(False)
    for name, tolerance, text in TOLERANCES:
        missing = expected[name].isNull() | actual[name].isNull()
        unknown = unknown | missing
        if name == "body_visible_text_coverage":
            reasons.append(reason(missing, "missing_body_coverage"))
        reasons.append(reason(F.abs(expected[name] - actual[name]) > tolerance, text))

    def selector(entry):
        seen = F.try_element_at(actual["selector_match_counts"], entry["key"])
        return F.when(seen.isNull(), F.concat(F.lit("missing_selector_match:"), entry["key"])) \
            .when((entry["value"] == 1) & (seen != 1),
                  F.concat(F.lit("selector_match_mismatch:"), entry["key"]))

    counts = F.array_compact(F.transform(F.map_entries(expected["selector_match_counts"]), selector))
    nothing = F.array().cast("array<string>")
    whole = F.array_distinct(F.concat(compact(*reasons), F.coalesce(counts, nothing)))

    def decide(why):
        hard = F.exists(why, lambda r: ~r.startswith("missing_") | (
            F.lit(strict) & r.startswith("missing_selector_match:")))
        status = F.when(hard, "incompatible").when(unknown, "unknown").otherwise("compatible")
        kept = F.when(hard | unknown, why).otherwise(nothing)
        return F.struct(status.alias("status"), kept.alias("reasons"))

    return let(whole, decide)


def resolve_programs(pages: DataFrame, programs: DataFrame, strict: bool = False) -> DataFrame:
    """Decide for every page whether the verified program of its schema may be reused.

    ``pages``: schema_signature and structure. ``programs``: schema_signature (unique),
    program_id, user_verified, structure (nullable).
    """
    verified = programs.filter("user_verified").select(
        "schema_signature", "program_id", F.col("structure").alias("stored"), F.lit(True).alias("known"))
    joined = attach(pages, verified, "schema_signature", how="left")

    def unknown(text):
        return F.struct(F.lit("unknown").alias("status"), F.array(F.lit(text)).alias("reasons"))

    verdict = F.when(F.col("known").isNull(), unknown("no_verified_program")) \
        .when(F.col("stored").isNull() | F.col("structure").isNull(), unknown("missing_structure_signature")) \
        .otherwise(compare(F.col("stored"), F.col("structure"), strict))
    decided = joined.withColumn("reuse", verdict)
    return decided.withColumn("program_id", F.when(F.col("reuse.status") == "compatible", F.col("program_id"))) \
        .drop("stored", "known")


def verified_programs(programs: DataFrame) -> DataFrame:
    """Verified programs, newest first, with their rule counts."""
    return programs.filter("user_verified").select(
        "schema_signature", "schema_name",
        F.coalesce(F.nullif(F.trim("rule_name"), F.lit("")), F.col("schema_name")).alias("rule_name"),
        F.size("rules").alias("program_count"), "created_at",
    ).orderBy(F.desc("created_at"), "schema_signature")


def structure_clusters(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages grouped by the exact part of the signature, with each measure's spread.

    ``uniform`` says whether any two pages of the group are within tolerance of each other.
    """
    s = F.col("structure")
    measures = [m for m, _, _ in TOLERANCES]
    aggs = [f(s[m]).alias(f"{n}_{m}") for m in measures for n, f in (("min", F.min), ("max", F.max))]
    flat = pages.groupBy(
        s["signature_version"].alias("signature_version"), s["page_intent"].alias("page_intent"),
        s["title_shape"].alias("title_shape"), s["content_shape"].alias("content_shape"),
    ).agg(F.count("*").alias("pages"), F.min(key).alias("first_page"),
          F.avg(s["text_block_count"]).alias("mean_blocks"), *aggs)
    uniform = F.lit(True)
    for name, tolerance, _ in TOLERANCES:
        uniform = uniform & (F.col(f"max_{name}") - F.col(f"min_{name}") <= tolerance)
    return flat.withColumn("uniform", uniform)


#: Measures are summed as whole millionths, so that means do not depend on the order of the rows.
_PARTS = 1_000_000
#: Distances to the middle of a cluster count in tolerances: 0.35 and 0.45 are as 7 to 9.
_WEIGHTS = {0.35: 9, 0.45: 7}


def _cut(cells: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one key's cells: split wherever a measure has a gap beyond its tolerance, until none has."""
    open_, done = [cells.index.to_numpy()], []
    while open_:
        part = open_.pop()
        for measure, tolerance, _ in TOLERANCES:
            by = cells.loc[part].sort_values(f"min_{measure}", kind="stable")
            reached = by[f"max_{measure}"].cummax().shift()
            new = (by[f"min_{measure}"] - reached > tolerance).cumsum()
            if new.iloc[-1] > 0:
                open_ += [group.index.to_numpy() for _, group in by.groupby(new.to_numpy())]
                break
        else:
            done.append(part)
    for part in done:
        cells.loc[part, "cluster"] = cells.loc[part, "first_page"].min()
        cells.loc[part, "pages"] = cells.loc[part, "rows"].sum()
        for measure, _, _ in TOLERANCES:
            cells.loc[part, f"sum_{measure}"] = cells.loc[part, f"part_{measure}"].sum()
    return cells


def template_clusters(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Every page with its template cluster: ``cluster`` (its smallest key), ``medoid`` and ``pages``.

    Pages of a cluster agree in the exact part of the signature and in which measures are missing, and no
    measure has a gap beyond its tolerance among them, so chains of near pages stay together. The medoid is
    the page nearest to the means, by the sum of distances in tolerances, ties to the smallest key. Pages
    without a structure have a cluster of their own kind. Keys are whole numbers.

    Pages are first counted by cells of half a tolerance. Values of a cell cannot be parted, so gaps are
    looked for between cells only; measures are shares, so a signature has few cells however many pages it has.
    """
    s = F.col("structure")
    exact = [s[name] for name, _ in EXACT]
    cells = [F.floor(s[m] / (t / 2)) for m, t, _ in TOLERANCES]
    whole = {m: F.round(s[m] * _PARTS).cast("bigint") for m, _, _ in TOLERANCES}
    gaps = [s[m].isNull() for m, _, _ in TOLERANCES]
    rows = pages.select(key, F.to_json(F.array(*[F.to_json(F.struct(e)) for e in (*exact, *gaps)])).alias("_template"),
                        F.to_json(F.array(*cells)).alias("_cell"), *[v.alias(f"_{m}") for m, v in whole.items()],
                        *[s[m].alias(m) for m in whole])
    # Pages are parsed once; what is kept of each is short.
    rows = durable(rows)
    counted = rows.groupBy("_template", "_cell").agg(
        F.count("*").alias("rows"), F.min(key).cast("bigint").alias("first_page"),
        *[f(m).alias(f"{n}_{m}") for m in whole for n, f in (("min", F.min), ("max", F.max))],
        *[F.coalesce(F.sum(f"_{m}"), F.lit(0)).alias(f"part_{m}") for m in whole])
    found = counted.withColumns({"cluster": F.lit(0).cast("bigint"), "pages": F.lit(0).cast("bigint"),
                                 **{f"sum_{m}": F.lit(0).cast("bigint") for m in whole}})
    labelled = found.groupBy("_template").applyInPandas(_cut, found.schema).select(
        F.struct("_template", "_cell").alias("_place"), "cluster", "pages", *[f"sum_{m}" for m in whole])
    joined = attach(rows.withColumn("_place", F.struct("_template", "_cell")), labelled, "_place")
    # Null measures are null on all pages of a cluster and add nothing.
    far = sum((F.coalesce(F.abs(F.col("pages") * F.col(f"_{m}") - F.col(f"sum_{m}")), F.lit(0)) * _WEIGHTS[t]
               for m, t, _ in TOLERANCES), F.lit(0).cast("bigint"))
    placed = joined.select(key, "cluster", "pages", far.alias("_far"))
    middle = placed.groupBy("cluster").agg(F.min(F.struct("_far", key))[key].alias("medoid"))
    return attach(placed.drop("_far"), middle, "cluster")
