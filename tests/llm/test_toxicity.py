"""Accuracy on held-out labels, the label model's parts, odd inputs."""

import zlib

import numpy as np
from odd_texts import ODD

from pagewright.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.scores(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scored.filter("held_out").join(labels.filter("toxic is not null"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    toxic = [r for r in rows if r["toxic"]]
    assert right >= 0.97 * len(rows)
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_held_out_labels_change_nothing(spark, docs):
    rows = [(i, f"plain words here {'nastyword badstem' if i % 4 == 0 else 'niceword'} {i}") for i in range(300)]
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    true = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rows], LABELS)
    false = spark.createDataFrame([(i, 0, int((i % 4 == 0) != held[i])) for i, _ in rows], LABELS)
    a, b = (sorted(map(tuple, toxicity.scores(docs(rows), x).collect())) for x in (true, false))
    assert a == b
    assert all(p == int(i % 4 == 0) and h == held[i] and 0 <= s <= 1 for i, h, s, p in a)


def test_odd_texts_and_labels(spark, docs):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(9)] + [(None, 1, 1), (3, 0, None), (7, 0, 0), (7, 0, 1), (999, 0, 1)], LABELS)
    got = toxicity.scores(docs(ODD), labels).collect()
    assert len(got) == len(ODD)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    table = docs(ODD)
    assert toxicity.clean(table, labels).columns == table.columns


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.scores(docs(ODD), none).collect()} == {0}
    assert toxicity.scores(docs([]), none).collect() == []
    assert toxicity.clean(docs(ODD), none).count() == len(ODD)


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(0)
    truth = (rng.random(2000) < 0.3).astype(np.int8)
    voters = [np.where(truth == 1, np.where(rng.random(2000) < 0.8, 1, -1), np.where(rng.random(2000) < 0.02, 1, -1)) for _ in range(6)]
    clean = np.where(np.max(voters, axis=0) == 1, -1, 0)
    gold = np.where(rng.random(2000) < 0.02, 1 - truth, truth).astype(np.int8)
    post = toxicity.label_model(np.stack([*voters, clean, gold], axis=1).astype(np.int8), gold)
    assert ((post > 0.5) == (truth == 1)).mean() > (gold == truth).mean()


def test_linear_classifier_learns_signs():
    rng = np.random.default_rng(1)
    x = rng.random((500, 6)) < 0.2
    target = (x[:, 0] | x[:, 1]).astype(float)
    rows, cols = np.nonzero(x)
    w = toxicity.train_linear(rows, cols, 500, 6, target)
    z = x @ w[:-1] + w[-1]
    assert ((z > 0) == (target == 1)).all()
