"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyhire.llm import (
    alignment, chat, checks, mixing, neighbours, packing, pages, quality, rules, simhash, sketching, toxicity, warc, whitening,
)
from tallyhire.llm.common import table

PACKING_TOKENIZER = "word_bpe_49k.json"
CHAT_TOKENIZER = "byte_bpe_50k.json"
ALIGNED_TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.scored(documents, quality.fitted(documents, table(spark, folder, "labels")))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), stored=True).select("doc_id", "source", "mix_slot", "mix_offset")


def op5_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "n_same_as_last", "n_shouted")


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, table(spark, folder, "conversations")), public_tokenizers.path(CHAT_TOKENIZER)).drop(
        "n_tokens", "loss_tokens")


def op7_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_texts(table(spark, folder, "pages"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.scored(documents, toxicity.fitted(documents, table(spark, folder, "labels")))


def op11_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return sketching.near_duplicates(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(table(spark, folder, "documents"), *map(public_tokenizers.path, ALIGNED_TOKENIZERS))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_rules": op5_rules,
    "op6_chat": op6_chat,
    "op7_pages": op7_pages,
    "op8_neighbours": op8_neighbours,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_sketches": op11_sketches,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}
CHECKS: dict[str, str] = {"op1_warc": checks.WARC, "op5_rules": checks.RULES, "op6_chat": checks.CHAT}
