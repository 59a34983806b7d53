"""Application tracker views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.operators.lifecycle import AWAITING_REPLY, AWAITING_TRACKER, STALE_DAYS, with_staleness
from tallyhire.schemas import APPLICATION_STATUSES


def _with_jobs(apps: DataFrame, jobs: DataFrame) -> DataFrame:
    posting = jobs.select(
        F.col("id").alias("job_id"), "company", "title", F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("apply_url", F.lit("")).alias("apply_url"),
    )
    return apps.join(posting, "job_id")


def list_tracked(apps: DataFrame, jobs: DataFrame, scores: DataFrame, now: Column, status: str | None = None,
                 stale_after: int = STALE_DAYS) -> DataFrame:
    """Tracked applications, latest movement first; an unknown status lists everything."""
    if status in APPLICATION_STATUSES:
        apps = apps.filter(F.col("status") == status)
    rows = _with_jobs(apps, jobs).join(scores.select("job_id", "ai_score"), "job_id", "left")
    return with_staleness(rows, now, stale_after, AWAITING_TRACKER).orderBy(F.desc("last_status_at"), "job_id")


def status_counts(apps: DataFrame) -> DataFrame:
    return apps.groupBy("status").agg(F.count("*").alias("n"))


def tracker_counts(apps: DataFrame) -> DataFrame:
    """Applications per status in lifecycle order, zeros included."""
    every = apps.sparkSession.createDataFrame(list(enumerate(APPLICATION_STATUSES)), "position int, status string")
    return every.join(status_counts(apps), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"), "position"
    ).orderBy("position").drop("position")


def list_by_status(apps: DataFrame, jobs: DataFrame, status: str) -> DataFrame:
    return _with_jobs(apps.filter(F.col("status") == status), jobs).orderBy("last_status_at", "job_id")


def all_applications(apps: DataFrame, jobs: DataFrame) -> DataFrame:
    return _with_jobs(apps, jobs).orderBy(F.desc("last_status_at"), "job_id")


def stale_applications(apps: DataFrame, jobs: DataFrame, now: Column, after_days: int = STALE_DAYS) -> DataFrame:
    """Gone quiet, measured from the last status change; oldest first."""
    dated = apps.filter(F.col("status").isin(*AWAITING_REPLY) & F.col("last_status_at").isNotNull())
    rows = with_staleness(_with_jobs(dated, jobs), now, after_days, AWAITING_REPLY)
    return rows.filter("stale").orderBy("last_status_at", "job_id")


def list_answers(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Confirmed answers, most used first; ``limit`` gives the bank a draft draws on."""
    ordered = answers.select("question", "answer", "times_used").orderBy(F.desc("times_used"), "question")
    return ordered if limit is None else ordered.limit(limit)


def note_answer_used(answers: DataFrame, used: DataFrame) -> DataFrame:
    """Add one use per (question) row of ``used``."""
    counts = used.groupBy("question").agg(F.count("*").alias("_n"))
    return answers.join(counts, "question", "left").withColumn(
        "times_used", F.col("times_used") + F.coalesce("_n", F.lit(0))
    ).select(*answers.columns)
