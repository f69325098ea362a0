"""Body selection: which regions hold the page's main text, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, compact, let, once, reason
from .dom import identity, is_below, nearest_above, node_path
from .noise import CONTENT_RE, NOISE_RE, NOISE_TAGS, blocks_in_scope, is_noise, noise_depth

REGION_TYPE = (
    "struct<rank:int,id:int,last:int,selector:string,xpath:string,text:string,chars:int,"
    "score:double,block_count:int,document_order:int>"
)


def _clean_text(node: Column, tokens: Column, upto: Column) -> Column:
    """Text of a subtree without the noise elements strictly inside it."""
    part = F.slice(tokens, node["tok_from"] + 1, node["tok_to"] - node["tok_from"])
    return F.array_join(F.filter(part, lambda t: F.get(upto, t["node"]) <= node["id"])["text"], " ")


def _own_selector(node: Column) -> Column:
    classes = F.slice(F.filter(F.split(node["class_attr"], r"\s+"), lambda c: c != ""), 1, 2)
    return F.when(node["id_attr"] != "", F.concat(node["tag"], F.lit("#"), node["id_attr"])) \
        .when(F.size(classes) > 0, F.concat(node["tag"], F.lit("."), F.array_join(classes, "."))) \
        .otherwise(node["tag"])


def _region(node: Column, rank: Column, nodes: Column, tokens: Column, noise: Column) -> Column:
    plain = node["tag"].isin("article", "main")
    text = F.when(is_noise(node) & ~plain, "").otherwise(_clean_text(node, tokens, noise["upto"]))
    bonus = F.when(plain, 1.35).otherwise(1.15)
    return let(text, lambda t: F.struct(
        rank.cast("int").alias("rank"), node["id"].alias("id"), node["last"].alias("last"),
        F.when(node["tag"] == "body", "body").otherwise(_own_selector(node)).alias("selector"),
        node_path(node, nodes).alias("xpath"), t.alias("text"), F.length(t).alias("chars"),
        (F.length(t) * bonus).alias("score"),
        F.size(blocks_in_scope(nodes, noise["above"], node)).alias("block_count"),
        node["line"].alias("document_order")))


def candidates_of(nodes: Column, tokens: Column, noise: Column) -> Column:
    """Candidate regions; the body stands in when nothing looks like a content region."""
    def eligible(n, up):
        named = identity(n).rlike(CONTENT_RE) & ~identity(n).rlike(NOISE_RE)
        return (n["tag"].isin("article", "main") | named) & ~n["tag"].isin(*NOISE_TAGS) \
            & ~is_below(n, up)

    def rank(n):
        return F.when(n["tag"] == "article", 0).when(n["tag"] == "main", 1) \
            .when(n["attrs"]["role"] == "main", 2).when(n["attrs"]["class"].isNotNull(), 3).otherwise(4)

    fit = let(nearest_above(nodes, lambda a: a["tag"].isin(*NOISE_TAGS)),
              lambda up: F.filter(nodes, lambda n: eligible(n, up)))
    found = F.filter(
        F.transform(fit, lambda n: _region(n, rank(n), nodes, tokens, noise)),
        lambda r: r["chars"] > 0)
    bodies = F.slice(F.filter(nodes, lambda n: n["tag"] == "body"), 1, 1)
    fallback = F.filter(F.transform(bodies, lambda n: _region(n, F.lit(0), nodes, tokens, noise)),
                        lambda r: r["block_count"] > 0)
    return let(found, lambda c: F.when(F.size(c) > 0, F.array_sort(c)).otherwise(fallback)) \
        .cast(f"array<{REGION_TYPE}>")


def _inside(inner: Column, outer: Column) -> Column:
    return (inner["id"] > outer["id"]) & (inner["id"] <= outer["last"])


def _without_nesting(candidates: Column) -> Column:
    """Leaf regions first, then by score: a wrapper replaces its leaves only when clearly larger."""
    longest = F.array_max(candidates["chars"])
    leaves = F.filter(candidates, lambda c: (c["chars"] >= longest * 0.2) & ~F.exists(
        candidates, lambda o: _inside(o, c) & (o["chars"] >= c["chars"] * 0.2)))

    def order(pool):
        keyed = F.transform(pool, lambda r, i: F.struct((-r["score"]).alias("k"), i.alias("i"), r.alias("r")))
        return F.array_sort(keyed)["r"]

    def choose(chosen, c):
        held = F.filter(chosen, lambda s: _inside(s, c))
        weight = F.aggregate(held, F.lit(0), lambda acc, s: acc + s["chars"])
        replaced = F.concat(F.filter(chosen, lambda s: ~_inside(s, c)), F.array(c))
        return F.when(F.size(held) > 0, F.when(c["chars"] >= weight * 1.15, replaced).otherwise(chosen)) \
            .when(F.exists(chosen, lambda s: _inside(c, s)), chosen) \
            .otherwise(F.concat(chosen, F.array(c)))

    pool = let(leaves, lambda x: F.when(F.size(x) > 0, x).otherwise(candidates))
    none = F.array().cast(f"array<{REGION_TYPE}>")
    return let(pool, lambda p: F.aggregate(order(p), none, choose))


def _in_page_order(regions: Column) -> Column:
    keyed = F.transform(regions, lambda r, i: F.struct(
        r["document_order"].alias("k"), i.alias("i"), r.alias("r")))
    return F.array_sort(keyed)["r"]


def _continuity(selected: Column) -> Column:
    lines = selected["document_order"]
    gaps = F.zip_with(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)),
                      F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)),
                      lambda right, left: F.greatest(F.lit(0), right - left - 1))
    mean = F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g) / F.size(gaps)
    return F.when(F.size(selected) <= 1, 1.0).otherwise(1.0 / (1.0 + mean))


def _noise_chars(nodes: Column, selected: Column, noise: Column) -> Column:
    """Length of the text in the top-most noise elements inside the selected regions."""
    top = F.filter(nodes, lambda n: (n["chars"] > 0) & is_noise(n) & F.exists(
        selected, lambda s: _inside(n, s) & (F.get(noise["above"], n["id"]) <= s["id"])))
    return F.greatest(F.lit(0), F.aggregate(top, F.lit(-1), lambda acc, n: acc + n["chars"] + 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.least(F.lit(1.0), part / F.greatest(F.lit(1), whole))


def body_of(nodes: Column, tokens: Column) -> Column:
    def measure(candidates, selected, noise):
        text = F.array_join(selected["text"], " ")
        blocks = F.aggregate(selected, F.lit(0), lambda acc, s: acc + s["block_count"])
        facts = F.struct(
            text.alias("text"), F.length(text).alias("chars"),
            F.array_max(candidates["chars"]).alias("longest"), blocks.alias("blocks"),
            F.array_max(candidates["block_count"]).alias("most_blocks"),
            _continuity(selected).alias("continuity"),
            _noise_chars(nodes, selected, noise).alias("noise"),
            F.size(candidates).alias("found"), selected.alias("selected"))
        return let(facts, judge)

    def judge(f):
        values = F.struct(
            _ratio(f["chars"], f["longest"]).alias("coverage"),
            _ratio(f["blocks"], f["most_blocks"]).alias("blocks"),
            _ratio(f["noise"], f["chars"] + f["noise"]).alias("noise"))
        return let(values, lambda v: verdict(f, v))

    def verdict(f, v):
        rejected = compact(
            reason(v["coverage"] < 0.35, "body_coverage_too_low"),
            reason(f["continuity"] < 0.25, "body_continuity_too_low"),
            reason((v["noise"] > 0.65) & ((v["coverage"] < 0.7) | (f["continuity"] < 0.4)),
                   "body_noise_too_high"),
            reason(f["chars"] < 8, "body_text_too_short"))
        return let(rejected, lambda why: _selection(
            F.size(why) == 0, f["text"], f["selected"], v["coverage"], v["blocks"], f["continuity"],
            v["noise"], f["found"], F.size(f["selected"]), why))

    def with_noise(noise):
        none = F.lit(0.0)
        return let(candidates_of(nodes, tokens, noise), lambda found: F.when(
            F.size(found) == 0, _selection(
                F.lit(False), F.lit(""), F.array().cast(f"array<{REGION_TYPE}>"), none, none, none, none,
                F.lit(0), F.lit(0), F.array(F.lit("no_body_candidates")))
        ).otherwise(let(_in_page_order(_without_nesting(found)),
                        lambda selected: measure(found, selected, noise))))

    return let(noise_depth(nodes), with_noise)


def _selection(accepted, text, regions, coverage, blocks, continuity, noise, found, merged, why) -> Column:
    return F.struct(
        accepted.alias("accepted"), text.alias("text"),
        F.transform(regions, lambda r: F.struct(
            r["selector"], r["xpath"], r["text"], r["score"], r["block_count"],
            r["document_order"])).alias("candidates"),
        coverage.cast("double").alias("visible_text_coverage"),
        blocks.cast("double").alias("block_coverage"),
        continuity.cast("double").alias("continuity_score"),
        noise.cast("double").alias("noise_ratio"), found.cast("int").alias("candidate_count"),
        merged.cast("int").alias("merged_candidate_count"), why.alias("rejected_reasons"))


def select_body(trees: DataFrame) -> DataFrame:
    """Add the ``body`` struct."""
    return trees.withColumn("body", _body_column())


@once
def _body_column() -> Column:
    return bind(body_of, nodes=F.col("nodes"), tokens=F.col("tokens"))
