"""Cutting lineage: results that are costly to repeat are written to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    A session whose executors are threads of the driver (``local[…]``) may leave it unset and gets a private
    folder, once.  On a cluster an unset folder is an error: executors would each write to their own disk.
    """
    folder = spark.conf.get(SETTING, None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tallyhire-')}"
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows once and read them back; survives the loss of any executor.  ``codec`` is for texts, else the session's."""
    path = run_folder(df.sparkSession, "settled")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
