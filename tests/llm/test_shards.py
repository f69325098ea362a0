"""The law of the shards, their mixture, and independence of buckets."""

import zlib
from collections import Counter

from odd_texts import ODD

from pagewright.llm import shards


def laws(got, rows, n):
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows)
    assert max(sizes.values(), default=0) - min((sizes.get(i, 0) for i in range(n)), default=0) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}


def test_odd_rows(docs):
    got = shards.assign(docs(ODD), shards=4).collect()
    laws(got, ODD, 4)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_mixture_and_buckets(spark, monkeypatch):
    rows = [(i, f"text {i}", "big" if i % 3 else f"small{i % 7}") for i in range(3000)] + [(i, "no source", None) for i in range(3000, 3300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = sorted(tuple(r) for r in shards.assign(table, shards=11).collect())
    monkeypatch.setattr(shards, "BUCKET_ROWS", 10)
    assert one == sorted(tuple(r) for r in shards.assign(table, shards=11).collect())
    got = shards.assign(table, shards=11).collect()
    laws(got, rows, 11)
    share = Counter(s for _, _, s in rows)
    for source, n in share.items():
        for shard in range(11):
            held = sum(1 for r in got if r["shard"] == shard and r["source"] == source)
            assert abs(held - n / 11) <= 1.5


def test_seed_changes_order_only(spark):
    table = spark.createDataFrame([(i, str(i), "s") for i in range(200)], "doc_id bigint, text string, source string")
    a, b = ({r["doc_id"]: r["shard"] for r in shards.assign(table, 5, seed).collect()} for seed in (0, 1))
    assert a != b and Counter(a.values()) == Counter(b.values())


def test_empty_table(docs):
    assert shards.assign(docs([])).collect() == []
