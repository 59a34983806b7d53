"""The registered queries and the pipeline over the given tables."""

from collections import Counter

import pytest

import corpus_pipeline
from tallyhire.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_query_covers_its_table(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    table, key = {"op1": ("pages", "page_id"), "op7": ("pages", "page_id"), "op6": ("conversations", "conv_id"),
                  "op8": ("embeddings", "vec_id"), "op12": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[key] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    if name.startswith("op8"):
        assert {r.query_id for r in rows} == {i for i in ids if i % 20 == 0}
    else:
        assert {r[key] for r in rows} == ids | ({-1} if table == "conversations" else set())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in docs.collect())
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == names and not Counter(r.doc_id for r in docs.collect()) - before
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_run_equals_its_stages(spark):
    tokens = Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        tokens[r.doc_id] += r.length
        assert r.length <= r.doc_tokens
    assert tokens and all(n > 0 for n in tokens.values())
