"""Page intent: what kind of page this is, from its structure alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind, compact, let, once, reason
from .dom import identity, is_below, nearest_above
from .noise import NOISE_TAGS, blocks_in_page, noise_depth

# Tokens in id/class attributes.
_TITLE_RE = r"(?i)(?:^|[-_\s])(title|headline|page-name|entry-title|class-title)(?:$|[-_\s])"
_DETAIL_RE = r"(?i)author|date|version|meta"
_ITEM_RE = r"(?i)card|item|entry|result|list"
_SCOPES = ("article", "main")


def _is_scope(node: Column) -> Column:
    return node["tag"].isin(*_SCOPES) | (F.coalesce(node["attrs"]["role"], F.lit("")) == "main")


def _count(nodes: Column, test) -> Column:
    return F.size(F.filter(nodes, test))


def _headings(nodes: Column) -> Column:
    top = _count(nodes, lambda n: (n["tag"] == "h1") & (n["chars"] > 0))
    scoped = let(nearest_above(nodes, lambda a: identity(a).rlike(_TITLE_RE)), lambda up: _count(
        nodes, lambda n: n["tag"].isin("h2", "h3") & (n["chars"] > 0) & is_below(n, up)))
    named = _count(nodes, lambda n: identity(n).rlike(_TITLE_RE) & n["chars"].between(3, 240))
    return F.coalesce(F.nullif(top, F.lit(0)), F.nullif(scoped, F.lit(0)), F.least(named, F.lit(8)))


def _details(nodes: Column) -> Column:
    return _count(nodes, lambda n: (n["chars"] > 0) & (
        (n["tag"] == "time") | identity(n).rlike(_DETAIL_RE)))


def _repeated(nodes: Column) -> Column:
    items = _count(nodes, lambda n: (n["tag"] == "li") & (n["chars"] >= 3))
    cards = _count(nodes, lambda n: n["tag"].isin("section", "div") & (n["chars"] >= 3)
                   & identity(n).rlike(_ITEM_RE))
    return F.greatest(items, cards)


def _continuous(nodes: Column, above: Column) -> Column:
    scoped = let(nearest_above(nodes, _is_scope), lambda up: _count(
        nodes, lambda n: (n["tag"] == "p") & (n["chars"] > 0) & is_below(n, up)))
    # The document element is the scope here, so noise on it never counts.
    loose = let(nearest_above(nodes, lambda a: a["tag"] == "body"), lambda up: _count(
        nodes, lambda n: n["tag"].isin("p", "div") & (n["chars"] > 0) & is_below(n, up) & (F.get(above, n["id"]) <= 0)))
    return let(scoped, lambda s: F.when(s > 0, s).otherwise(loose))


def _visible_chars(nodes: Column, tagged: Column) -> Column:
    """Subtree text of every element outside noise tags, nested text counted at each level."""
    kept = F.filter(nodes, lambda n: (n["chars"] > 0) & ~n["tag"].isin(*NOISE_TAGS) & ~is_below(n, tagged))
    return F.greatest(F.lit(0), F.aggregate(kept, F.lit(-1), lambda acc, n: acc + n["chars"] + 1))


def _distinct_chars(nodes: Column, tokens: Column, tagged: Column) -> Column:
    """The same text counted once."""
    def outside(t):
        owner = F.get(nodes, t["node"])
        return ~owner["tag"].isin(*NOISE_TAGS) & ~is_below(owner, tagged)

    kept = F.filter(tokens, outside)
    return F.greatest(F.lit(0), F.aggregate(
        kept, F.lit(-1), lambda acc, t: acc + F.length(t["text"]) + 1))


def intent_of(nodes: Column, tokens: Column, requested: Column) -> Column:
    def facts(above, tagged):
        return F.struct(
            _headings(nodes).alias("headings"), (_details(nodes) > 0).alias("detail"),
            _repeated(nodes).alias("repeated"), _continuous(nodes, above).alias("continuous"),
            F.size(blocks_in_page(nodes, above)).alias("blocks"),
            F.exists(nodes, _is_scope).alias("region"),
            F.exists(nodes, lambda n: n["tag"] == "article").alias("article"),
            _visible_chars(nodes, tagged).alias("visible_text_chars"),
            _distinct_chars(nodes, tokens, tagged).alias("distinct_text_chars"))

    def judge(f):
        ratio = F.least(F.lit(1.0), f["repeated"] / F.greatest(F.lit(1), f["blocks"]))
        one = f["headings"] == 1
        intent = F.when((ratio >= 0.35) & ~f["detail"], "list") \
            .when((f["repeated"] >= 3) & ~f["detail"] & (f["continuous"] == 0), "home") \
            .when((f["article"] | f["detail"]) & one, "article") \
            .when(one & ((f["continuous"] >= 1) | f["detail"]), "single_resource") \
            .otherwise("unknown")
        return let(F.struct(intent.alias("intent"), ratio.alias("ratio")), lambda v: _assessment(f, v, one))

    def _assessment(f, v, one):
        listed = v["intent"].isin("list", "home")
        score = F.lit(0.25) + F.when(one, 0.3).otherwise(0.0) + F.when(f["detail"], 0.2).otherwise(0.0) \
            + F.least(F.lit(0.25), f["continuous"] * 0.08)
        confidence = F.when(listed, 0.55 + v["ratio"] * 0.5).otherwise(score)
        gate = (F.coalesce(requested, F.lit("")) != "single_resource") | ~listed
        return F.struct(
            v["intent"].alias("intent"), F.least(F.lit(1.0), confidence).alias("confidence"),
            gate.alias("gate_passed"),
            compact(reason(one, "unique_primary_heading"), reason(f["detail"], "detail_metadata"),
                    reason(f["continuous"] >= 2, "continuous_body"),
                    reason(f["repeated"] > 0, "repeated_items"),
                    reason(f["region"], "primary_content_region")).alias("signals"),
            compact(reason(~gate, "page_intent_mismatch"),
                    reason(gate & (v["intent"] == "unknown"), "page_intent_low_confidence")).alias("reasons"),
            v["ratio"].alias("repeated_item_ratio"), f["visible_text_chars"].alias("visible_text_chars"),
            f["distinct_text_chars"].alias("distinct_text_chars"),
            f["headings"].alias("heading_count"), f["repeated"].alias("repeated_item_count"),
            f["continuous"].alias("continuous_block_count"), f["blocks"].alias("content_block_count"))

    return let(noise_depth(nodes)["above"], lambda above: let(
        nearest_above(nodes, lambda a: a["tag"].isin(*NOISE_TAGS)), lambda tagged: let(facts(above, tagged), judge)))


def assess_intent(trees: DataFrame, requested: str | None = None) -> DataFrame:
    """Add the ``intent`` struct; ``requested='auto'`` means no request."""
    wanted = None if requested == "auto" else requested
    return trees.withColumn("intent", _intent_column(wanted))


@once
def _intent_column(requested: str | None) -> Column:
    return bind(intent_of, nodes=F.col("nodes"), tokens=F.col("tokens"), requested=F.lit(requested).cast("string"))


def passing_gate(assessed: DataFrame) -> DataFrame:
    return assessed.filter("intent.gate_passed")


