"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash
from odd_texts import ODD

from pagewright.llm import simhash


def plain(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    words = low.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(rows):
    """Smallest id over links of every row, by plain search."""
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                group[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return out


def test_odd_texts(docs):
    got = [tuple(r) for r in simhash.near_duplicates(docs(ODD)).collect()]
    assert sorted(got, key=str) == sorted(reach(ODD), key=str)


def test_real_texts(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(table).collect()]
    assert sorted(got) == sorted(reach(rows))


@pytest.mark.parametrize("size", [2, 3, 63, 64, 65, 130, 700])
def test_bit_sliced_comparison(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    values = np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4)))) for _ in range(size)])
    sizes = np.array([size - size // 3, size // 3]) if size > 3 else np.array([size])
    got = {(int(p), int(q)) for ps, qs in simhash.near(values, sizes) for p, q in zip(ps, qs)}
    cut = int(sizes[0])
    want = {(i, j) for i in range(size) for j in range(i + 1, size)
            if (i < cut) == (j < cut) and bin(int(values[i]) ^ int(values[j])).count("1") <= 2}
    assert got == want


def test_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << b) for b in range(48)] + [base ^ 0xFF00 ^ (1 << b) for b in range(16)]
    fps = spark.createDataFrame([(v,) for v in set(values)], "fp bigint")
    stars = simhash.components(simhash.links(fps)).collect()
    roots = {r["node"]: r["root"] for r in stars}
    near = [v for v in set(values) if bin(v ^ base).count("1") <= 1]
    assert len({roots.get(v, v) for v in near}) == 1


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_one_of_each_group_stays(docs):
    table = docs(ODD)
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    want, done = [], set()
    for (doc, text), (_, _, component) in sorted(zip(ODD, reach(ODD)), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        key = component if component is not None else (text,)
        if key not in done:
            done.add(key)
            want.append(doc)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    assert simhash.keep_first(docs([])).collect() == []
