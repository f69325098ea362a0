"""Noise elements and the blocks that remain without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import let
from .dom import identity, nearest_marked

# Noise tags, noise and content tokens, block tags.
NOISE_TAGS = ("nav", "aside", "footer", "header", "script", "style", "noscript", "form")
NOISE_RE = (
    r"(?i)(?:^|[-_\s])(header|footer|nav|menu|sidebar|aside|comment|related|recommend|"
    r"history|breadcrumb|rating|author|user|meta|info|stats|notice|message|"
    r"toc|table-of-contents|infobox|metadata|hatnote|mbox|reflist|advert|"
    r"banner|portal|reference)(?:$|[-_\s])"
)
CONTENT_RE = (r"(?i)(?:^|[-_\s])(content|article|body|entry|post|resource|main|description|text-area)"
              r"(?:$|[-_\s])")
BLOCKS = ("p", "li", "td", "th", "h1", "h2", "h3")


def is_noise(node: Column) -> Column:
    return ~node["tag"].isin("html", "body") & (
        node["tag"].isin(*NOISE_TAGS) | identity(node).rlike(NOISE_RE))


def noise_depth(nodes: Column) -> Column:
    """Per element: id of the nearest noise element strictly above it and at-or-above it (-1: none)."""
    flags = F.transform(nodes, is_noise)
    return let(flags, lambda noisy: let(nearest_marked(nodes, noisy), lambda up: F.struct(up.alias("above"), F.transform(
        up, lambda x, i: F.when(F.get(noisy, i), i).otherwise(x)).alias("upto"))))


def blocks_in_page(nodes: Column, above: Column) -> Column:
    """Non-blank blocks of the whole page without a noise ancestor below the document element."""
    return F.filter(nodes, lambda n: n["tag"].isin(*BLOCKS) & (n["chars"] > 0)
                    & (F.get(above, n["id"]) <= 0))


def blocks_in_scope(nodes: Column, above: Column, scope: Column) -> Column:
    """Non-blank blocks inside ``scope``; the scope itself counts if it is a block."""
    below = F.slice(nodes, scope["id"] + 2, scope["last"] - scope["id"])
    inner = F.filter(below, lambda n: n["tag"].isin(*BLOCKS) & (n["chars"] > 0)
                     & (F.get(above, n["id"]) <= scope["id"]))
    own = scope["tag"].isin(*BLOCKS) & (scope["chars"] > 0) & (F.get(above, scope["id"]) < 0)
    return F.when(own, F.concat(F.array(scope), inner)).otherwise(inner)
