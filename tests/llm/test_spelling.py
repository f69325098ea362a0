"""Variants against a plain comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from odd_texts import ODD

from oracle import connect, rows_of
from pagewright.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = sorted(w for w in n if len(w) >= 6 and n[w] >= 5)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def made(seed=3):
    """Words with variants in chains, ties, accents, and long ones."""
    rng = random.Random(seed)
    letters = "abcdeéßÿàxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(120)]
    words += ["q" * 39, "q" * 40, "q" * 41, "q" * 42, "q" * 40 + "z", "z" + "q" * 40, "w" * 3000, "w" * 2999 + "v", "w" * 1500 + "v" + "w" * 1500]
    times = {}
    for w in list(words):
        times[w] = rng.choice([5, 7, 130, 700])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:]])
            times[v] = times.get(v, 0) + rng.choice([5, 5, 26, 28])
    pool = [w for w, k in times.items() for _ in range(min(k, 40) if len(w) > 100 else k)]
    rng.shuffle(pool)
    return [(i, " ".join(pool[i::200]).upper() if i % 5 == 0 else ";".join(pool[i::200])) for i in range(200)]


MADE = made() + [(None, "Straße straße STRASSE " * 9), (7, "café×naïve÷ " * 6), (3, "abcdef " * 5 + "abcdefg " * 5)] + ODD


@pytest.mark.parametrize("symbols,tile", [(8, 2000), (2, 3), (1, 1000)])
def test_against_all_pairs(docs, symbols, tile):
    got = spelling.variants(docs(MADE), symbols, tile).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain(MADE)
    assert sorted(map(tuple, got)) == want
    assert sum(w[3] is not None and w[3] != w[5] for w in want) > 0, "chains of forms"


def test_against_sql(docs, folder):
    con = connect(folder)
    table = docs(MADE)
    con.register("odd", table.select("doc_id", "text").toArrow())
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM odd")
    want = con.execute(queries.ORACLES["op13_spelling"])
    columns = [d[0] for d in want.description]
    out = spelling.variants(table)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "few words")]])
def test_no_words(docs, rows):
    assert spelling.variants(docs(rows)).count() == 0


def test_neighbourhoods_hold_all_neighbours(spark):
    from pyspark.sql import functions as F
    words = ["0123", "0000", "7"]
    got = {r["w"]: set(r["v"]) for r in spark.createDataFrame([(w,) for w in words], "w string")
           .select("w", spelling.neighbourhood(F.col("w")).alias("v")).collect()}
    signs = "01234567"
    for w in words:
        every = {w} | {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + s + w[i + 1:] for i in range(len(w)) for s in signs} \
            | {w[:i] + s + w[i:] for i in range(len(w) + 1) for s in signs}
        assert got[w] == {v for v in every if v >= w}
