"""Writing tables and the tracker export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Tracker export columns, in order.
TRACKER_COLUMNS = (
    "company", "title", "location", "status", "ai_score", "submitted_at", "last_status_at", "days_since", "note",
    "apply_url",
)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a table hashed and sorted by key, so per-job joins read it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def tracker_lines(tracked: DataFrame) -> DataFrame:
    """Tracker rows as CSV text: quoted only when needed, quotes doubled."""
    def cell(name: str):
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[",\n\r]'), quoted).otherwise(c)

    return tracked.select(F.concat_ws(",", *[cell(c) for c in TRACKER_COLUMNS]).alias("line"))


def write_tracker_csv(tracked: DataFrame, path: str) -> None:
    """Header in every part file; quotes are doubled rather than backslash-escaped."""
    tracked.select(*TRACKER_COLUMNS).write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path)
