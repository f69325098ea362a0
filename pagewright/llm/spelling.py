"""Spelling variants: words one edit apart, found over a reduced alphabet.

Every letter is hashed to one of a few symbols, which turns words into reduced words. Words one edit
apart have reduced words at most one edit apart. The full one-edit neighbourhood of every distinct
reduced word (deletions, replacements, insertions, itself) is generated and joined with the reduced
vocabulary; of the two directions of a pair one is kept before the shuffle. Words then join the pairs
of reduced words, and the edit distance of the original strings decides.

A reduced word that many words share is cut into tiles of about ``TILE`` words, so no task holds such a
group; only verified pairs are ever rows. Words of more than ``LONG`` letters would have neighbourhoods
that grow with the square of their length; one edit leaves their first or their second half as it was,
so they are joined on hashes of halves and verified in the same way.

Defined results: null texts have no words; a null id counts as empty text before the colon; rows that
repeat are each counted; ties between forms go to the smaller word; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, parts_for, stored
from .decontaminate import LOWER, UPPER

#: What a run is, which runs lose a letter, and what a word is: fixed by the contract.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
LETTER = f"[{UPPER}{LOWER}{_ACCENTED}]"
LOSES = 199
LETTERS, TIMES, RATIO = 6, 5, 5
#: Shorter runs cannot become words.
RUN = f"{LETTER}{{{LETTERS},}}"
#: Symbols that letters are hashed to.
SYMBOLS = 8
LONG = 40
TILE = 2000
#: Distinct reduced words of one task that generates neighbourhoods.
PART_WORDS = 20_000


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: words of enough letters and occurrences."""
    runs = documents.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"),
                            F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    runs = runs.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= TIMES) & (F.length("word") >= LETTERS))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """Every letter by its symbol: the code point modulo the number of symbols."""
    letters = LOWER + _ACCENTED
    return F.translate(word, letters, "".join(str(ord(c) % symbols) for c in letters))


def neighbourhood(word: Column, symbols: int = SYMBOLS) -> Column:
    """All strings at most one edit from a reduced word that do not come before it."""
    places = F.sequence(F.lit(1), F.length(word))
    left = lambda i: F.substring(word, F.lit(1), i - 1)
    right = lambda i: F.substring(word, i, F.length(word))
    signs = F.array(*[F.lit(str(s)) for s in range(symbols)])
    shorter = F.transform(places, lambda i: F.concat(left(i), right(i + 1)))
    other = F.flatten(F.transform(places, lambda i: F.transform(signs, lambda s: F.concat(left(i), s, right(i + 1)))))
    longer = F.flatten(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.transform(
        signs, lambda s: F.concat(left(i), s, right(i)))))
    return F.filter(F.array_distinct(F.concat(F.array(word), shorter, other, longer)), lambda v: v >= word)


def _short_pairs(words: DataFrame, symbols: int, tile: int) -> DataFrame:
    """a, b (a < b): words one edit apart among those of at most LONG letters."""
    short = words.filter(F.length("word") <= LONG).select("word", reduced(F.col("word"), symbols).alias("r"))
    sizes = short.groupBy("r").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    parts = parts_for(words.sparkSession, words.count(), PART_WORDS)
    near = sizes.repartition(parts, "r").select("r", F.col("tiles").alias("_ta"), F.explode(neighbourhood(F.col("r"), symbols)).alias("v"))
    pairs = near.join(sizes.select(F.col("r").alias("v"), F.col("tiles").alias("_tb")), "v")
    pairs = pairs.select("r", "v", "_ta", "_tb", F.explode(F.sequence(F.lit(0), F.col("_ta") - 1)).alias("ta")) \
        .select("r", "v", "ta", F.explode(F.sequence(F.lit(0), F.col("_tb") - 1)).alias("tb"))
    tiled = short.join(sizes, "r").select("r", "word", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("t"))
    first = pairs.join(tiled.select("r", F.col("t").alias("ta"), F.col("word").alias("_a")), ["r", "ta"])
    second = tiled.select(F.col("r").alias("v"), F.col("t").alias("tb"), F.col("word").alias("_b"))
    joined = first.join(second, ["v", "tb"]).filter((F.col("r") != F.col("v")) | (F.col("_a") < F.col("_b"))) \
        .filter(F.levenshtein("_a", "_b", 1) == 1)
    return joined.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def _long_pairs(words: DataFrame) -> DataFrame:
    """The same among words of at least LONG letters, over equal halves."""
    size = F.length("word")
    roles = F.array(*[F.struct((size - d).alias("least"), F.floor((size - d) / 2).cast("int").alias("half")) for d in (0, 1)])
    each = words.filter(size >= LONG).select("word", F.inline(roles))
    keyed = each.select("word", F.explode(F.array(
        F.xxhash64("least", F.lit(0), F.substring("word", F.lit(1), F.col("half"))),
        F.xxhash64("least", F.lit(1), F.substring("word", -F.col("half"), F.col("half"))))).alias("key")).distinct()
    return keyed.withColumnRenamed("word", "a").join(keyed.withColumnRenamed("word", "b"), "key").filter(
        (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, tile: int = TILE) -> DataFrame:
    """a, b (a < b): all pairs of words that differ by exactly one inserted, deleted or replaced letter."""
    return _short_pairs(words, symbols, tile).unionByName(_long_pairs(words)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, twice as far in each round. A chain has at most log5(n) words."""
    now = durable(forms.select("word", F.col("form").alias("to")))
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = durable(now.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"),
                                                           F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", F.col("to").alias("root"))
        now = step.select("word", "to")


def variants(documents: DataFrame, symbols: int = SYMBOLS, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the vocabulary."""
    words = stored(vocabulary(documents), "spelling")
    pairs = near_pairs(words.select("word"), symbols, tile)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("other")))))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("other_n")).alias("least"), F.col("other").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.least") >= RATIO * F.col("n")
    rows = durable(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n")))
    roots = _roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
