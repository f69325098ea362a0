"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of an item (the whole item if it has fewer) and stands for the set
of its five-word shingles. A window lies in a document only if all its shingles do, so its prefix is
its single rarest shingle; rarity is counted over all documents. Document shingles that the benchmark
holds are found once, with the words around them; they join the windows on the prefix, positions
bound where a window would have to start and end, and the words themselves are compared at last.

The benchmark's shingles go to the documents in blocks of at most ``BLOCK_SHINGLES`` (a broadcast of
bounded size); a larger benchmark takes more blocks, not larger ones.

Defined results: null and empty texts have no words; an item without words has no windows; an item
without id marks words but is not counted as an item; repeated items count once; rows with equal ids
are told apart by their texts; empty tables give zero counts; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup

WINDOW = 10
SHINGLE = 5
BLOCK_SHINGLES = 2_000_000
#: What a word is, after lower case: fixed by the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in A-Z lower case. Pure ASCII takes the fast built-in; other letters must keep their case."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _shingle(words_: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at``; missing where they do not all exist."""
    return F.when(at + size <= F.size(words_),
                  F.xxhash64(F.lit(size), *[F.get(words_, at + i) for i in range(size)]))


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, words: the windows of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - WINDOW, F.lit(0)))
    return items.filter(F.size("_w") > 0).select("item_id", F.explode(F.transform(
        starts, lambda i: F.slice("_w", i + 1, F.lit(WINDOW)))).alias("words")).distinct()


def _tokens(distinct: DataFrame) -> DataFrame:
    """words, size, offset, h: the shingles of every distinct window."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    out = distinct.withColumn("size", size).select("words", "size", F.explode(
        F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("offset"))
    hashed = reduce(lambda kept, s: kept.when(F.col("size") == s, _shingle(F.col("words"), F.col("offset"), s)),
                    range(2, SHINGLE + 1), F.when(F.col("size") == 1, _shingle(F.col("words"), F.col("offset"), 1)))
    return out.withColumn("h", hashed)


def _found(documents: DataFrame, hashes: DataFrame, sizes: list[int], every_row: bool) -> DataFrame:
    """doc_id, text_hash, n_words, pos, nth, row, h, low, around: document shingles that the benchmark holds.

    One pass: words are unfolded, hashed and probed in generated code. The generator is an outer one,
    which keeps the optimizer from extracting words a second time in a filter of its own. With
    ``every_row`` each document row also has one row with its number of words, marked ``row``: that of
    position 0 and shingle size 0, or of no position.
    """
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_w"))
    each = rows.select("doc_id", "text_hash", "_w", F.posexplode_outer("_w").alias("pos", "_word"))
    if len(sizes) == 1:
        each = each.withColumn("nth", F.lit(0)).withColumn("h", _shingle(F.col("_w"), F.col("pos"), sizes[0]))
    else:
        each = each.select("doc_id", "text_hash", "_w", "pos", F.posexplode_outer(F.array(
            *[_shingle(F.col("_w"), F.col("pos"), s) for s in sizes])).alias("nth", "h"))
    low = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    marked = F.broadcast(hashes.select(F.col("h").alias("_h"), F.lit(True).alias("held")))
    joined = each.join(marked, F.col("h") == F.col("_h"), "left" if every_row else "inner")
    row = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("nth") == 0) if every_row else F.lit(False)
    if every_row:
        joined = joined.filter(F.col("held") | row)
    return joined.select(
        "doc_id", "text_hash", F.size("_w").alias("n_words"), "pos", "nth", row.alias("row"), F.when(F.col("held"), F.col("h")).alias("h"),
        low.alias("low"), F.when(F.col("held"), F.slice("_w", low + 1, F.lit(2 * WINDOW))).alias("around"))


def _matches(documents: DataFrame, distinct: DataFrame, every_row: bool) -> tuple[DataFrame, DataFrame]:
    """The stored shingles of documents, and the occurrences of windows they lead to."""
    tokens = durable(_tokens(distinct))
    shape = tokens.agg(F.collect_set("size").alias("sizes"), F.approx_count_distinct("h").alias("n")).first()
    sizes = sorted(shape["sizes"]) or [SHINGLE]
    blocks = max(1, -(-(shape["n"] or 0) * 11 // (10 * BLOCK_SHINGLES)))
    held = tokens.select("h").distinct()
    parts = [_found(documents, held.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b), sizes, every_row and b == 0)
             for b in range(blocks)]
    stored_ = durable(reduce(DataFrame.unionByName, parts))
    found = stored_.filter("h is not null")
    # Rarity over all documents; a shingle that no document holds rules its windows out.
    rarity = found.groupBy("h").agg(F.count("*").alias("rows"))
    ranked = tokens.join(rarity, "h", "left").groupBy("words").agg(
        F.min(F.coalesce("rows", F.lit(0))).alias("least"),
        F.min_by(F.struct("h", "offset"), F.struct(F.coalesce("rows", F.lit(0)), "h", "offset")).alias("p"))
    prefix = ranked.filter("least > 0").select(F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), "words")
    start = F.col("pos") - F.col("offset")
    bounded = lookup(found, prefix, "h", "inner").withColumn("start", start).filter(
        (F.col("start") >= 0) & (F.col("start") >= F.col("low")) & (F.col("start") + F.size("words") <= F.col("n_words")))
    exact = F.slice("around", F.col("start") - F.col("low") + 1, F.size("words")) == F.col("words")
    return stored_, bounded.filter(exact).select("doc_id", "text_hash", "words", "start")


def occurrences(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, text_hash, words, start: where windows occur in documents."""
    return _matches(documents, distinct, False)[1]


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for every document row."""
    wide = durable(windows(benchmark))
    stored_, hits = _matches(documents, wide.select("words").distinct(), True)
    hits = durable(hits.distinct())
    keys = ["doc_id", "text_hash"]
    covered = hits.select(*keys, F.explode(F.sequence("start", F.col("start") + F.size("words") - 1)).alias("at")) \
        .distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    seen = hits.select(*keys, F.xxhash64("words").alias("_k"), "words").distinct()
    named = wide.filter(F.col("item_id").isNotNull()).select(
        F.xxhash64("words").alias("_k"), F.col("words").alias("_words"), "item_id")
    items = lookup(seen, named, "_k", "inner").filter("words = _words").groupBy(*keys).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = covered.withColumnsRenamed({k: f"_{k}" for k in keys}).alias("c").join(
        items.alias("i"), (F.col("_doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("_text_hash") == F.col("text_hash")),
        "left").select("_doc_id", "_text_hash", "n_hit", "items")
    rows = stored_.filter("row").select(
        "doc_id", "text_hash", F.greatest("n_words", F.lit(0)).cast("bigint").alias("n_words"))
    # Most rows have no hit: only marked keys are on the right.
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs."""
    hits = occurrences(documents, windows(benchmark).select("words").distinct())
    marked = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return documents.alias("d").join(marked.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m._id")) & (
        F.xxhash64("d.text") == F.col("m._hash")), "left_anti")
