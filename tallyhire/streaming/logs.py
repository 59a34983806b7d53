"""Event-time windows over the spend and run logs, and upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def spend_by_window(spend: DataFrame, width: str = "7 days", late: str = "1 day", start: str = "4 days") -> DataFrame:
    """Spend per stage and window.  The epoch was a Thursday, so a 4-day offset starts weeks on Monday."""
    return (
        spend.withWatermark("at", late).groupBy(F.window("at", width, width, start), "stage")
        .agg(F.sum("estimated_usd").alias("usd"), F.count("*").alias("calls"))
        .select(F.col("window.start").alias("period_start"), "stage", "usd", "calls")
    )


def runs_by_window(runs: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Runs, failures and fetched rows per engine and day."""
    return (
        runs.withWatermark("started_at", late).groupBy(F.window("started_at", width), "engine")
        .agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("error", "rate_limited")).alias("failing"),
             F.sum("fetched").alias("fetched"))
        .select(F.col("window.start").alias("day"), "engine", "runs", "failing", "fetched")
    )


def run_sessions(runs: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Runs of an engine that follow each other within ``gap``, as one row once the watermark has passed their end.

    A run more than ``late`` behind the newest one is dropped if no open session takes it; ``run_to_files`` counts those.
    """
    return (
        runs.withWatermark("started_at", late).groupBy(F.session_window("started_at", gap).alias("span"), "engine")
        .agg(F.min("started_at").alias("first_run"), F.max("started_at").alias("last_run"), F.count("*").alias("runs"),
             F.count_if(F.col("status").isin("error", "rate_limited")).alias("failing"), F.sum("fetched").alias("fetched"))
        .select("engine", "first_run", "last_run", "runs", "failing", "fetched")
    )


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Drain what is there and stop; results go to files, never to the driver.

    Returns how many rows (partial aggregates, where Spark combines rows before the state) came too late, over the batches
    of this call whose progress Spark still holds (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    drained = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
               .outputMode(mode).trigger(availableNow=True).start())
    drained.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in drained.recentProgress for s in p.stateOperators)


def run_batches(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain in update mode: every touched window is written per micro-batch, open ones included.

    A reader keeps the newest value per window.  A replayed batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def upsert_each_batch(stream: DataFrame, checkpoint: str, read: Callable[[int], DataFrame],
                      write: Callable[[DataFrame, int], None],
                      merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Fold every micro-batch into a stored table: ``write(merge(read(batch_id), batch), batch_id)``.

    ``read`` gives the table as it stood before the batch and ``write`` receives the batch id, so a
    batch replayed after a lost executor or driver replaces its own output instead of applying twice.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        write(merge(read(batch_id), batch), batch_id)

    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def closed_before(windows: DataFrame, column: str, now: Column) -> DataFrame:
    return windows.filter(F.col(column) < now)


class VersionedTable:
    """A table in a shared folder that a stream replaces batch by batch.

    Every batch writes ``rows/v=<batch>`` and then a one-row ``current/v=<batch>`` that commits it.  The current version is
    the largest committed one, found in the folder and not remembered, so a driver that starts anew goes on from it.  A
    batch that is run again replaces its own version, reading the one before it.
    """

    def __init__(self, spark: SparkSession, folder: str, empty: DataFrame) -> None:
        self.spark, self.folder, self.empty = spark, folder, empty
        spark.createDataFrame([(-1,)], "version long").write.mode("overwrite").parquet(f"{folder}/current/v=-1")

    def _current(self, before: int | None = None) -> int:
        seen = self.spark.read.parquet(f"{self.folder}/current").select("version")
        return seen.filter("true" if before is None else F.col("version") < before).agg(F.max("version")).first()[0]

    def read(self, before: int | None = None) -> DataFrame:
        version = self._current(before)
        return self.empty if version < 0 else self.spark.read.schema(self.empty.schema).parquet(f"{self.folder}/rows/v={version}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/rows/v={batch_id}")
        self.spark.createDataFrame([(batch_id,)], "version long").write.mode("overwrite").parquet(
            f"{self.folder}/current/v={batch_id}")
