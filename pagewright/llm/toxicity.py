"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that training labels mark as telling (a likelihood-ratio test
   over a bounded sample of labelled rows), dealt out to many lexicon voters; fixed patterns are
   further voters, and the training label is one. A voter says toxic, clean, or nothing.
2. Label model: a generative model of the votes given the hidden label. Expectation maximisation
   estimates how often each voter speaks and errs; correlations of voters given the label, left over
   under independence, discount voters that repeat one another. It gives posterior labels.
3. A linear classifier over the lexicon and the patterns is trained on the posterior labels and
   scores every whole text. Scores see the text only.

Defined results: null and empty texts get the score of a text without any sign; a label that is null
or lacks a document is not used; repeated labels of one document count once, toxic if any says so;
without labels, or without both kinds, every score is that of the (assumed) share of toxic rows;
repeated rows are scored each on their own; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, crc32_mod, durable, ship

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of the id.
MAX_LABELLED = 20_000
#: Lexicon entries at most, and the likelihood ratio (chi square, one degree) an entry needs.
MAX_ENTRIES = 4096
SIGNIFICANT = 30.0
#: Share of toxic texts among those that hold an entry.
TELLING = 0.7
BEGINNINGS = (4, 5, 6, 7)
#: An entry is a word or beginning that occurs so often; the last level is a share of the text's words.
LEVELS = (1, 2, 3, 5)
DENSE = 1 / 50
#: Lexicon voters of each kind of entry.
VOTERS = 6
#: Trust in one training label, which is a voter among others.
LABEL_RIGHT = 0.97
WORD = re.compile(r"\w+")
#: Pattern voters: shouting, piled-up marks, stretched letters, masked letters, direct address, links, addresses.
PATTERNS = [re.compile(p) for p in (
    r"\b[A-Z]{4,}\b", r"[!?]{2,}", r"(\w)\1{3,}", r"\w[*@#$%]+\w", r"\b(?:[Yy]ou|[Yy]our|[Dd]u|[Tt]u|[Vv]ous|[Ii]hr)\b",
    r"https?://", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")]


def entries_of(text: str | None, roots: set[str] | None = None) -> set[str]:
    """Words, and beginnings of longer words, each with the levels that its count reaches.

    A mark of length stands in front (0: the whole word). ``roots`` limits what is looked for.
    """
    words = Counter(WORD.findall((text or "").lower()))
    held: Counter = Counter()
    for w, n in words.items():
        if roots is None or f"0{w}" in roots:
            held[f"0{w}"] += n
        for k in BEGINNINGS:
            if len(w) > k and (roots is None or f"{k}{w[:k]}" in roots):
                held[f"{k}{w[:k]}"] += n
    dense = max(2.0, words.total() * DENSE)
    out = set()
    for e, n in held.items():
        out.add(f"{e}\t1")
        if n > 1:
            out.update(f"{e}\t{level}" for level in LEVELS[1:] if n >= level)
            if n >= dense:
                out.add(f"{e}\tdense")
    return out


def _patterns(text: str | None) -> list[int]:
    return [int(bool(p.search(text or ""))) for p in PATTERNS]


def _mine(columns: list[pa.Array]) -> Iterator[list]:
    """How many toxic and clean texts of a batch hold each entry."""
    toxic, clean = Counter(), Counter()
    for text, label in zip(columns[0], columns[1].to_pylist()):
        (toxic if label else clean).update(entries_of(text.as_py()))
    # An entry that no toxic text of the batch holds may still occur in one elsewhere: all are counted.
    names = list(toxic.keys() | clean.keys())
    yield [names, [toxic[n] for n in names], [clean[n] for n in names]]


class Model(NamedTuple):
    entries: dict[str, int]
    roots: set[str]
    weights: np.ndarray  # entries, patterns, constant

    def score(self, text: str | None) -> float:
        total = float(self.weights[-1])
        if self.entries:
            total += sum(self.weights[self.entries[e]] for e in entries_of(text, self.roots) & self.entries.keys())
            total += sum(w for w, x in zip(self.weights[len(self.entries):-1], _patterns(text)) if x)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def lexicon(sample: DataFrame) -> list[tuple[str, int, int]]:
    """Entries that tell toxic texts, best first: entry, toxic texts, clean texts."""
    counted = arrow_stage(sample.select("text", "toxic"), _mine, "entry string, pos bigint, neg bigint", rows=1000) \
        .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, n = int(sizes["p"] or 0), int(sizes["n"] or 0)
    if not 0 < p < n:
        return []
    share = p / n

    def term(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    seen = F.col("pos") + F.col("neg")
    ratio = 2 * (term(F.col("pos"), seen * share) + term(F.col("neg"), seen * (1 - share)))
    rows = counted.filter(F.col("pos") >= seen * max(share, TELLING)).withColumn("g", ratio).filter(F.col("g") >= SIGNIFICANT) \
        .orderBy(F.desc("g"), "entry").limit(MAX_ENTRIES).collect()
    return [(r["entry"], r["pos"], r["neg"]) for r in rows]


def _signs(columns: list[pa.Array], entries: dict[str, int]) -> Iterator[list]:
    """Entries and patterns that each text of the sample holds."""
    out, roots = [], {e.partition("\t")[0] for e in entries}
    for text in columns[0]:
        hits = sorted(entries[e] for e in entries_of(text.as_py(), roots) & entries.keys())
        out.append(hits + [len(entries) + i for i, x in enumerate(_patterns(text.as_py())) if x])
    yield [columns[1], out]


def votes_of(rows: np.ndarray, cols: np.ndarray, n: int, entries: list[str], labels: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, 0 clean, -1 nothing) of lexicon voters, pattern voters and the label."""
    kinds = sorted({e[0] for e in entries})
    # Entries of a kind are dealt out in turn, so voters of one kind are alike in strength.
    voter = np.zeros(len(entries) + len(PATTERNS), np.int64)
    seen: Counter = Counter()
    for i, e in enumerate(entries):
        voter[i] = kinds.index(e[0]) * VOTERS + seen[e[0]] % VOTERS
        seen[e[0]] += 1
    base = len(kinds) * VOTERS
    voter[len(entries):] = base + np.arange(len(PATTERNS))
    count = base + len(PATTERNS)
    votes = np.full((n, count + 3), -1, np.int8)
    votes[rows, voter[cols]] = 1
    hits = np.bincount(rows[cols < len(entries)], minlength=n)
    votes[:, count] = np.where(hits == 0, 0, -1)  # says clean
    votes[:, count + 1] = np.where(hits >= 2, 1, -1)  # says toxic
    votes[:, count + 2] = labels
    return votes


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probability of toxic for each row of votes; the last voter is the label."""
    said = [votes == v for v in (-1, 0, 1)]
    share = float(np.clip(gold.mean(), 0.01, 0.99))
    post = np.where(gold == 1, LABEL_RIGHT, 1 - LABEL_RIGHT).astype(float)
    weight = np.ones(votes.shape[1])
    for round_ in range(rounds):
        tables = []
        for y in (1 - post, post):
            t = np.stack([(s * y[:, None]).sum(0) for s in said]) + np.array([[0.5], [0.25], [0.25]])
            tables.append(t / t.sum(0))
        for y in (0, 1):  # the label's own error is given, not learned
            tables[y][:, -1] = (1e-6, LABEL_RIGHT, 1 - LABEL_RIGHT) if y == 0 else (1e-6, 1 - LABEL_RIGHT, LABEL_RIGHT)
        gain = np.log(tables[1]) - np.log(tables[0])
        terms = sum(s * g for s, g in zip(said, gain))
        if round_ == rounds // 3:
            # Correlations that the label does not explain: such voters share their weight.
            x = (votes == 1).astype(float)
            left = x - (1 - post)[:, None] * tables[0][2] - post[:, None] * tables[1][2]
            scale = left.std(0) + 1e-9
            related = np.abs(left.T @ left / len(left) / scale[:, None] / scale)
            np.fill_diagonal(related, 0)
            weight = 1 / (1 + np.where(related > 0.1, related, 0).sum(0))
            weight[-1] = 1
        post = 1 / (1 + np.exp(-np.clip((terms * weight).sum(1) + math.log(share / (1 - share)), -30, 30)))
        share = float(np.clip(post.mean(), 0.01, 0.99))
    return post


def train_linear(rows: np.ndarray, cols: np.ndarray, n: int, width: int, target: np.ndarray, rounds: int = 600,
                 penalty: float = 1e-4, signs_from: int | None = None) -> np.ndarray:
    """Logistic regression on binary signs with soft targets: adaptive gradient steps.

    Signs from ``signs_from`` on may speak for toxic only: shouting is no excuse for what is shouted.
    """
    w, square = np.zeros(width + 1), np.full(width + 1, 1e-8)
    w[-1] = math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for _ in range(rounds):
        z = np.bincount(rows, w[cols], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        step = np.append(np.bincount(cols, error[rows], width), error.sum())
        step[:-1] += penalty * w[:-1] / max(1, width) ** 0.5
        square += step * step
        w -= 2.0 * step / np.sqrt(square)
        if signs_from is not None:
            np.maximum(w[signs_from:-1], 0, out=w[signs_from:-1])
    return w


def _sketch(columns: list[pa.Array]) -> Iterator[list]:
    """Smallest hashes of a text's four-word sequences, under three mixings."""
    out = []
    for text in columns[2]:
        words = (text.as_py() or "").lower().encode("utf-8", "replace").split()
        h = np.array([zlib.crc32(b" ".join(words[i:i + 4])) for i in range(max(1, len(words) - 3))], np.uint64)
        out.append([int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)])
    yield [columns[0], columns[1], columns[2], *map(list, zip(*out))] if out else [*columns, [], [], []]


def sample_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the training rows: at most MAX_LABELLED, chosen by a hash of the id.

    Copies and near copies are no further evidence: of rows that agree in one of three sketches of
    their texts only the first counts.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(crc32_mod("doc_id", FOLDS) != HELD_OUT) \
        .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    known = documents.select("doc_id").filter("doc_id is not null").distinct()
    chosen = usable.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = documents.select("doc_id", "text").join(F.broadcast(durable(chosen)), "doc_id")
    rows = durable(arrow_stage(texts.select("doc_id", "toxic", "text"), _sketch,
                               "doc_id bigint, toxic int, text string, m0 bigint, m1 bigint, m2 bigint",
                               rows=1000))
    # A row is the first of its group exactly if its id is some group's smallest.
    firsts = [rows.groupBy(f"m{i}").agg(F.min("doc_id").alias("doc_id")).select("doc_id") for i in range(3)]
    single = firsts[0].join(firsts[1], "doc_id", "left_semi").join(firsts[2], "doc_id", "left_semi")
    return rows.join(F.broadcast(single), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    sample = durable(sample_rows(documents, labels))
    found = lexicon(sample)
    names = [e for e, _, _ in found]
    entries = {e: i for i, e in enumerate(names)}
    if not names:
        sizes = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
        share = ((sizes["p"] or 0) + 1) / (sizes["n"] + 12)
        return Model({}, set(), np.append(np.zeros(len(PATTERNS)), math.log(share / (1 - share))))
    signs = arrow_stage(sample.select("text", "toxic"), _signs, "toxic int, signs array<int>", entries).toArrow()
    gold = signs.column("toxic").to_numpy().astype(np.int8)
    lists = signs.column("signs").combine_chunks()
    rows = np.repeat(np.arange(len(gold)), np.diff(lists.offsets.to_numpy()))
    cols = lists.flatten().to_numpy().astype(np.int64)
    post = label_model(votes_of(rows, cols, len(gold), names, gold), gold)
    return Model(entries, {e.partition("\t")[0] for e in names}, train_linear(rows, cols, len(gold), len(names) + len(PATTERNS), post,
                                       signs_from=len(names)))


def _scores(columns: list[pa.Array], shared) -> Iterator[list]:
    model = shared.value
    values = np.array([model.score(t.as_py()) for t in columns[1]])
    yield [columns[0], columns[2], values, (values >= THRESHOLD).astype(np.int32)]


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit(documents, labels))
    rows = documents.select("doc_id", "text", (crc32_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    return arrow_stage(rows, _scores, "doc_id bigint, held_out boolean, score double, predicted int", shared)


def _clean_rows(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            keep = [model.score(t.as_py()) < THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier does not call toxic."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(documents, labels))
    return documents.mapInArrow(_clean_rows(shared), documents.schema)
