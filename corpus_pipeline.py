"""The corpus pipeline: rules, classifier, near-duplicates, mixture, packing, each written and read again by the next.

A stage takes the documents that the one before kept and decides about all of them.  The first two drop what they reject,
the third keeps one document of each group of near-duplicates, the fourth lays all that is left in the order of the target
mixture, and the last packs that order into windows: its pools are filled file by file, so a window holds the mixture.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyhire.llm import mixing, packing, quality, rules, simhash
from tallyhire.llm.common import table
from tallyhire.operators.settle import run_folder

TOKENIZER = "word_bpe_49k.json"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept(docs)


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The trees are fitted on the labelled documents of the corpus as it came, then judge what the rules kept."""
    forest = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.passing(docs, forest)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs, stored=True)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_quality),
    ("near-duplicates", keep_one_of_each),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: Neither the classifier nor the packing can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = run_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
