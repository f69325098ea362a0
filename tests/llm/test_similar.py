"""Near copies against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest
from odd_texts import ODD

from pagewright.llm import similar

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = (text or "").translate(LOWER).encode().split()
    k = min(5, len(words))
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def firsts(rows):
    """The smallest id of every component of texts with a similarity of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)) if sets[i] or sets[j] else True:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc)
    return {min((d for d in g if d is not None), default=None) for g in least.values()}


def copies(seed, n, rate, length=200):
    """A text and versions of it with some of the words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(length), round(rate * length)):
            words[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile,radius", [(512, 22), (3, 22)])
def test_components_are_those_of_all_pairs(docs, monkeypatch, tile, radius):
    monkeypatch.setattr(similar, "TILE", tile)
    texts = [t for s, rate in enumerate((0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05, 0.1)) for t in copies(s, 6, rate)]
    # Copies of copies: the ends of the chain are not alike, its neighbours are.
    words = copies(99, 0, 0, 300)[0].split()
    for step in range(8):
        words = words[12:] + [f"c{step}-{i}" for i in range(12)]
        texts.append(" ".join(words))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ODD + [(1, "Some words here now then"), (2, "some WORDS here now  then"), (3, "four words are here")]
    random.Random(1).shuffle(rows)
    kept = {r["doc_id"] for r in similar.keep_first(docs(rows)).collect()}
    assert kept == firsts(rows)


def test_planted_copies_are_caught(docs):
    """Of pairs at a similarity of 0.8 and little more, nearly all are found."""
    rows, near = [], 0
    for s in range(120):
        a, b = copies(1000 + s, 1, 0.02, 250)
        x, y = shingle_set(a), shingle_set(b)
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(2 * s, a), (2 * s + 1, b)]
            near += 1
    kept = similar.keep_first(docs(rows)).count()
    assert near > 40 and len(rows) - kept >= 0.97 * near


def test_within_finds_all_pairs_of_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 40)), replace=False)) for _ in range(160)]
    values = np.array([int(base[i % 40]) ^ f for i, f in enumerate(flips)], np.uint64)
    distance = lambda i, j: bin(int(values[i]) ^ int(values[j])).count("1")
    for border in (0, 70):
        got = {(int(p), int(q)) for ps, qs in similar.within(values, border) for p, q in zip(ps, qs)}
        want = {(i, j) for j in range(160) for i in range(j) if distance(i, j) <= similar.RADIUS and (not border or i < border <= j)}
        assert got == want


def test_rows_columns_and_no_rows(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (None, "x")]
    out = similar.keep_first(docs(rows))
    assert out.columns == docs(rows).columns and sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("4", "a b c d e f"), ("None", "x")]
    assert similar.keep_first(docs([])).count() == 0
