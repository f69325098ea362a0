"""Removed bytes against a brute-force table of all 50-byte strings."""

import hashlib
import random

import numpy as np
from odd_texts import ODD

from pagewright.llm import suffixes


def plain(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            if doc is not None:
                first[raw[i:i + 50]] = min(first.get(raw[i:i + 50], doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if doc is not None and first[raw[i:i + 50]] < doc:
                gone[i:i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def check(docs, rows):
    got = [tuple(r) for r in suffixes.digests(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_odd_texts(docs):
    check(docs, ODD)


def test_passages_in_many_contexts(docs):
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passages = [noise(n) for n in (49, 50, 51, 75, 120, 400)] + ["ab" * 60, "é" * 40]
    rows = [(i, noise(rng.randrange(0, 90)) + rng.choice(passages)[rng.randrange(0, 3):] + noise(rng.randrange(0, 90))
             + rng.choice(passages) + noise(rng.randrange(0, 9))) for i in range(150)]
    rng.shuffle(rows)
    check(docs, rows + [(500, rows[0][1]), (501, rows[1][1]), (501, rows[2][1])])


def test_every_window_holds_a_sync_point():
    rng = np.random.default_rng(5)
    for kind in range(4):
        text = bytes(rng.integers(97, 97 + (1, 2, 4, 26)[kind], 500, dtype=np.uint8))
        at, _ = suffixes.sync_points(text)
        held = np.zeros(len(text) + 1, int)
        held[at] = 1
        sums = np.concatenate(([0], np.cumsum(held)))
        assert all(sums[i + suffixes.SPAN] - sums[i] > 0 for i in range(len(text) - 49))


def test_levels_double():
    def run(i):
        raw = np.zeros((1, suffixes.WIDTH), np.uint8)
        raw[0, 0], raw[0, -1] = i + 1, 1
        one = np.array([i])
        return suffixes.Run(raw.view(f"S{suffixes.WIDTH}").ravel(), one, one, one)

    family = suffixes.Family(lambda *_: None)
    for i in range(11):
        family.add(run(i))
    assert {rank: len(r.doc) for rank, r in family.levels.items()} == {0: 1, 1: 2, 3: 8}
    whole = family.close()
    assert whole.doc.tolist() == list(range(11))
    again = suffixes.Run.unpack(whole.pack())
    assert (again.keys == whole.keys).all() and (again.doc == whole.doc).all()


def test_rows_without_repeats(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert sorted(tuple(r) for r in suffixes.digests(table).collect()) == sorted(plain(rows))
    new = {r["doc_id"]: r for r in suffixes.remove(table).collect()}
    assert len(new) == len(rows) and table.columns == suffixes.remove(table).columns
    for doc, size, gone, _, digest in plain(rows):
        if "�" not in new[doc]["text"] and len(new[doc]["text"].encode()) == size - gone:
            assert hashlib.sha256(new[doc]["text"].encode()).hexdigest() == digest
        assert new[doc]["n_chars"] == len(new[doc]["text"])


def test_empty_table(docs):
    assert suffixes.digests(docs([])).collect() == []
    assert suffixes.remove(docs([])).collect() == []
