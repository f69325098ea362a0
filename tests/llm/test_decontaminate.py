"""Hits against a plain scan of all windows, with odd items and documents."""

import hashlib
import re

import pytest
from odd_texts import ODD

from pagewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau É upsilon"
ITEMS = [(1, LONG), (2, "iota"), (3, "two words"), (10, "one two three four"), (4, None), (5, " .,; "), (None, "no id but words"),
         (1, LONG), (6, "the " * 14), (7, "kappa lambda mu nu xi omicron pi rho sigma tau"), (8, "Été ÉTÉ été")]
TEXTS = [(20, LONG), (21, "prefix " + LONG[6:70] + " suffix"), (22, "beta gamma delta"), (23, "TWO-WORDS iota Iota"),
         (24, "été Été ÉTÉ été"), (25, "one two three four one two three four"), (26, LONG + " " + LONG.upper()),
         (27, "no id but words"), (27, "no id but words again"), (None, "two words"), (28, "words two"),
         (29, "Été ÉTÉ été"), (30, "the " * 40)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in rows:
        w, hit, named = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id bigint, text string, words string")


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_odd_items_and_texts(docs, items, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    rows = ODD + TEXTS
    got = decontaminate.contamination(docs(rows), items).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, ITEMS)


def test_clean_rows_stay(docs, items):
    rows = ODD + TEXTS
    table = docs(rows)
    kept = decontaminate.clean(table, items)
    assert kept.columns == table.columns
    want = [r[0] for r in plain(rows, ITEMS) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_no_python_on_the_path(docs, items):
    plan = decontaminate.contamination(docs(ODD), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_empty_tables(docs, items, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs([]), items).collect() == []
    assert [r["contaminated"] for r in decontaminate.contamination(docs(TEXTS), none).collect()] == [False] * len(TEXTS)


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_texts_that_begin_with_an_item(docs, spark, monkeypatch, block):
    # Every item has five words or more, so there is one shingle size and texts begin with held shingles of all blocks.
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    items = [(1, LONG), (2, "one two three four five"), (3, "seven eight nine ten eleven twelve")]
    rows = ODD + [(n, t) for n, t in enumerate(
        [LONG, LONG + " more words", "one two three four five", "one two three four five six", "other words then " + LONG,
         *(" ".join(LONG.split()[i:]) for i in range(1, 12)), "seven eight nine ten eleven twelve and more", LONG], 50)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(rows), table).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, items)
