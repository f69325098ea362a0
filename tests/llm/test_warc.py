"""Archives written and read back, and the order of the merged index."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import warc

LONG = "<html>" + "x" * 200 + "</html>"
PAGES = [(3, "http://www.B.example/x?q=1#f", LONG), (1, "https://a.example", LONG), (9, "http://a.example/\r\nEvil: 1", LONG),
         (4, "http://c.example/", "short"), (5, "http://c.example/", "short"), (6, None, None), (7, "", ""),
         (8, "http://d.example/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 9), (None, "http://e.example/", LONG),
         (10, "http://f.example/", "é🙂\u0000\r\n\r\n" * 30), (11, "http://f.example/", "é🙂\u0000\r\n\r\n" * 30),
         (12, "http://g.example/", "y" * 99), (13, "http://g.example/", "y" * 99), (1, "https://a.example", LONG),
         (14, "http://h.example/", "z" * 3_000_000)]


def plain(pages):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 100 and html in first and first[html] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [warc.SMALL_SIDE, 0])
def test_odd_pages(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "SMALL_SIDE", bound)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")) \
        .withColumn("size", F.lit("clash"))
    index = warc.archive(table).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index]
    assert sorted(got, key=str) == plain(PAGES)
    keys = [(r["urlkey"], r["captured"]) for r in index]
    assert keys == sorted(keys)
    assert len({(r["archive"], r["offset"]) for r in index}) == len(PAGES)


def test_records_of_an_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:3], "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    data = part.read_bytes()
    records = list(warc.parse(data))
    assert sum(r.length for r in records) == len(data)
    for r in records:
        assert data[r.offset:r.offset + 10] == b"WARC/1.1\r\n"
        assert (r.payload == LONG.encode()) == (r.fields["warc-type"] == "response")
    with pytest.raises(ValueError):
        list(warc.parse(data[:-2]))


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(0, 9))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_extreme_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    ids = [2**63 - 1, -2**63, 9 * 10**18, -9 * 10**18, 10**12, -1, 0, 1_000_000_000]
    pages = [(i, "http://a.example/", LONG if k % 2 else f"{k}") for k, i in enumerate(ids)]
    index = warc.archive(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index]
    assert sorted(got, key=str) == plain(pages)
    dates = [r["captured"] for r in index]
    assert dates == sorted(dates) and all(len(d) == 20 and "2023" <= d[:4] <= "2055" for d in dates)


def test_clashing_names(spark):
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    for name in ("first", "type", "date", "value", "archive", "_n"):
        table = table.withColumn(name, F.lit("clash"))
    got = [(r["page_id"], r["record_type"]) for r in warc.archive(table).collect()]
    assert sorted(got, key=str) == sorted(((p[0], p[3]) for p in plain(PAGES)), key=str)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
