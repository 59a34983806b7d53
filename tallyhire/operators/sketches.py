"""Distinct counts and percentiles from sketches that are stored per day and merged.

A day's rows are read once.  What is kept of them per key is a row count, a HyperLogLog sketch per counted column and a
quantile sketch (KLL) per measured column, a few kilobytes whatever the day holds; any stretch of days is answered by merging.
Both kinds combine before the shuffle, so a hot key costs one sketch per task.

Bounds: a distinct count is off by less than ``distinct_error`` of itself and the rank of a percentile by less than
``RANK_ERROR``, each in about 99 of 100 cases.  Small sets are counted exactly.  Nulls are neither counted nor measured; a key
without any value has the count 0 and null percentiles.  Rows without a day form a "day" of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhire.operators.settle import settled

LG_K = 12
KLL_K = 400
RANK_ERROR = 0.01


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a HyperLogLog with 2**lg_k registers, merged or not."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def sketched(rows: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], measured: Mapping[str, str]) -> DataFrame:
    """Per key: ``rows``, ``<name>_hll`` for each counted column, ``<name>_kll`` and ``<name>_n`` for each measured one.

    Infinite and NaN measures are left out like nulls.
    """
    def finite(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[F.hll_sketch_agg(c, LG_K).alias(f"{n}_hll") for n, c in distinct.items()],
        *[e for n, c in measured.items() for e in (
            F.count(finite(c)).alias(f"{n}_n"), F.kll_sketch_agg_double(finite(c), KLL_K).alias(f"{n}_kll"))])


def _names(sketches: DataFrame, kind: str) -> list[str]:
    return [c.removesuffix(kind) for c in sketches.columns if c.endswith(kind)]


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of finer keys as sketches of coarser ones: over days, over sources, or over everything."""
    return sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        *[F.hll_union_agg(f"{n}_hll").alias(f"{n}_hll") for n in _names(sketches, "_hll")],
        *[e for n in _names(sketches, "_kll") for e in (
            F.sum(f"{n}_n").alias(f"{n}_n"), F.kll_merge_agg_double(f"{n}_kll").alias(f"{n}_kll"))])


def estimates(sketches: DataFrame, keys: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """The keys, ``rows``, one count per counted column and one value per measured column and percentile in ``at``."""
    return sketches.select(
        *keys, "rows", *[F.hll_sketch_estimate(f"{n}_hll").alias(n) for n in _names(sketches, "_hll")],
        *[F.when(F.col(f"{n}_n") > 0, F.kll_sketch_get_quantile_double(f"{n}_kll", F.lit(float(q)))).alias(f"{n}_{label}")
          for n in _names(sketches, "_kll") for label, q in at.items()])


class DailySketches:
    """Sketches per key and day in a shared folder; a day written again replaces what stood for it."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], distinct: Mapping[str, str],
                 measured: Mapping[str, str]) -> None:
        self.spark, self.folder, self.keys = spark, folder, list(keys)
        self.distinct, self.measured = distinct, measured

    def add(self, rows: DataFrame, time: str) -> None:
        """Sketch all days of ``rows``, each of which must be whole in them."""
        day = F.col(time).cast("date")
        daily = sketched(rows.withColumn("day", day), [*self.keys, "day"], self.distinct, self.measured)
        # a day holds one row per key: months share a folder, and a folder is written by one task per month
        placed = daily.withColumn("month", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")))
        held = self._held()
        if held is not None:
            months = placed.select("month").distinct()
            kept = held.join(F.broadcast(months), "month", "left_semi").join(
                placed.select(F.coalesce("day", F.lit("0001-01-01").cast("date")).alias("_d")).distinct(),
                F.coalesce("day", F.lit("0001-01-01").cast("date")) == F.col("_d"), "left_anti")
            placed = placed.unionByName(kept)
        settled(placed).hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "month").parquet(self.folder)

    def _held(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.folder).withColumn("month", F.col("month").cast("string")) if there else None

    def between(self, first: str | None = None, last: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
        """Merged sketches of the days from ``first`` to ``last``, both included; all days, undated rows too, without bounds."""
        days = self.spark.read.parquet(self.folder)
        if first is not None:
            days = days.filter((F.col("day") >= F.lit(first).cast("date")) & (F.col("month") >= first[:7]))
        if last is not None:
            days = days.filter((F.col("day") <= F.lit(last).cast("date")) & (F.col("month") <= last[:7]))
        return merged(days, self.keys if keys is None else list(keys))
