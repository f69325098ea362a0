"""Each stage of the pipeline on its predecessor's rows, against what it promises."""

import corpus_pipeline
import pytest
from odd_texts import ODD
from test_similar import firsts

import __spark_entry__ as entry
from pagewright.llm import bpe, decontaminate, queries, suffixes, toxicity


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffixes", "decontamination", "bpe"]
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


def test_decisions_take_effect(spark, folder):
    read = spark.read.parquet
    docs, labels, bench = (read(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    columns = docs.columns
    step = {"docs": docs}

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    clean = corpus_pipeline.reject_toxic(spark, docs, folder)
    toxic = {r["doc_id"] for r in toxicity.scores(docs, labels).filter("predicted = 1").collect()}
    assert clean.columns == columns and ids(clean) == ids(docs) - toxic
    single = corpus_pipeline.near_dedup(spark, clean, folder)
    assert single.columns == columns and ids(single) == firsts([(r["doc_id"], r["text"]) for r in clean.collect()])
    cut = corpus_pipeline.passage_dedup(spark, single, folder)
    assert cut.columns == columns and ids(cut) == ids(single)
    removed = {r["doc_id"]: r["n_removed"] for r in suffixes.digests(single).collect()}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all((r["text"] == before[r["doc_id"]]) == (removed[r["doc_id"]] == 0) for r in cut.collect())
    fair = corpus_pipeline.decontamination(spark, cut, folder)
    marked = {r["doc_id"] for r in decontaminate.contamination(cut, bench).filter("contaminated").collect()}
    assert fair.columns == columns and ids(fair) == ids(cut) - marked
    last = corpus_pipeline.encode(spark, fair, folder)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, bpe.digests(fair, queries.tokenizer()).collect()))
    assert step["docs"].count() > last.count()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "ids_sha256" in out.columns


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_documents(spark, docs, folder, rows):
    table = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == docs([]).columns, name
    assert corpus_pipeline.encode(spark, table, folder).count() <= len(rows)
