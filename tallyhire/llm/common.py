"""What the operators of this subpackage share: reading tables, Arrow batches as bytes, the split of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows turned into Python objects at a time; bounds a worker's memory whatever the size of the Arrow batch.
SLICE_ROWS = 256
FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column in UTF-8; null becomes empty."""
    index = batch.schema.get_field_index(name)
    return [v or b"" for v in batch.column(index).cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by five; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``most`` labelled rows outside the held-out fold.

    The rows are those with the smallest hash of the id, so the choice does not depend on order or partitions.  The
    ids are bounded by ``most`` and are broadcast; a document that is repeated comes once per row, and callers keep
    one row per id after reducing the text.  Ids that are null or carry no label take no part; of several labels the
    largest counts.
    """
    picked = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
