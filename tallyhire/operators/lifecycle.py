"""Application lifecycle: what a log of status changes leaves behind.

Each transition rule is an aggregate over a job's events, so replaying a log of any
length is one grouped aggregation that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.dates import days_between
from tallyhire.functions.text import nonblank, strip
from tallyhire.operators.upsert import COALESCE_OLD_NEW, KEEP_OLD, TAKE_NEW, custom, upsert
from tallyhire.schemas import APPLICATION_STATUSES

# The two sets of "waiting on them" statuses, and the silence limit.
AWAITING_REPLY = ("submitted", "responded")
AWAITING_TRACKER = ("submitted", "responded", "interviewing")
STALE_DAYS = 14


def replay(events: DataFrame) -> DataFrame:
    """(job_id, seq, at, kind, status, note) -> applications rows plus ``moved``.

    ``kind`` is ``open`` (the posting was viewed), ``set`` (a status was chosen) or
    ``note``.  Opening only ever creates a row; setting moves it.  Submitted and
    prepared dates are stamped the first time only.  An unknown status is refused.
    """
    valid = events.filter((F.col("kind") != "set") | F.col("status").isin(*APPLICATION_STATUSES))
    moves = F.col("kind") == "set"
    order = F.struct("at", "seq")
    return valid.groupBy("job_id").agg(
        F.coalesce(F.max_by("status", F.when(moves, order)), F.lit("viewed")).alias("status"),
        F.min(F.when(moves & (F.col("status") == "prepared"), F.col("at"))).alias("prepared_at"),
        F.min(F.when(moves & (F.col("status") == "submitted"), F.col("at"))).alias("submitted_at"),
        F.coalesce(F.max(F.when(moves, F.col("at"))), F.min("at")).alias("last_status_at"),
        nonblank(strip(F.max_by("note", F.when(F.col("note").isNotNull(), order)))).alias("note"),
        (F.count_if(F.col("note").isNotNull()) > 0).alias("noted"),
        (F.count_if(moves) > 0).alias("moved"),
    )


def apply_updates(applications: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored applications after a batch of events."""
    folded = replay(updates).withColumn("_seq", F.lit(0))
    moved = custom(lambda t, s, c: F.when(s("moved"), s(c)).otherwise(t(c)))
    rules = {
        "status": moved, "last_status_at": moved, "prepared_at": COALESCE_OLD_NEW,
        "submitted_at": COALESCE_OLD_NEW,
        "note": custom(lambda t, s, c: F.when(s("noted"), s(c)).otherwise(t(c))),
    }
    return upsert(applications, folded, ["job_id"], rules, "_seq")


def mark_viewed(applications: DataFrame, viewed: DataFrame, now: Column) -> DataFrame:
    rows = viewed.select("job_id").distinct().select(
        "job_id", F.lit("viewed").alias("status"), now.alias("last_status_at"), F.lit(0).alias("_o")
    )
    return upsert(applications, rows, ["job_id"], {}, "_o")


def mark_prepared(applications: DataFrame, prepared: DataFrame, now: Column) -> DataFrame:
    """Create as prepared; an application that has moved on keeps its status."""
    rows = prepared.select("job_id").distinct().select(
        "job_id", F.lit("prepared").alias("status"), now.alias("prepared_at"), now.alias("last_status_at"),
        F.lit(0).alias("_o"),
    )
    return upsert(applications, rows, ["job_id"], {"prepared_at": COALESCE_OLD_NEW, "status": KEEP_OLD}, "_o")


def mirrored_review(status: Column) -> Column:
    """Review status a tracker status implies; NULL leaves it unchanged."""
    return (
        F.when(status.isin("rejected", "closed", "ghosted"), "rejected")
        .when(status == "viewed", F.lit(None)).otherwise("approved")
    )


def mirror_to_jobs(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    wanted = applications.select(F.col("job_id").alias("id"), mirrored_review(F.col("status")).alias("_review"))
    return jobs.join(wanted, "id", "left").withColumn(
        "review_status", F.coalesce("_review", "review_status")
    ).select(*jobs.columns)


def set_notes(applications: DataFrame, notes: DataFrame) -> DataFrame:
    """Trimmed notes; blank clears."""
    cleaned = notes.groupBy("job_id").agg(F.max("note").alias("note")).select(
        "job_id", nonblank(strip("note")).alias("note"), F.lit(0).alias("_o")
    )
    held = cleaned.join(applications.select("job_id"), "job_id", "left_semi")
    return upsert(applications, held, ["job_id"], {"note": TAKE_NEW}, "_o")


def untrack(applications: DataFrame, ids: DataFrame) -> DataFrame:
    return applications.join(ids.select("job_id").distinct(), "job_id", "left_anti")


def apply_decisions(jobs: DataFrame, applications: DataFrame, decisions: DataFrame, now: Column):
    """Persist a review session: (job_id, decision, note) in order; notes only survive on approved jobs.

    The last decision on a job wins; a NULL decision undoes it.
    """
    from tallyhire.operators.skew import latest_by

    final = latest_by(decisions, ["job_id"], ["seq"]).filter(F.col("decision").isNotNull())
    verdict = final.select(F.col("job_id").alias("id"), F.col("decision").alias("_d"))
    reviewed = jobs.join(verdict, "id", "left").withColumn(
        "review_status", F.coalesce("_d", "review_status")
    ).select(*jobs.columns)
    noted = final.filter((F.col("decision") == "approved") & (strip("note") != "")).select(
        "job_id", F.lit("prepared").alias("status"), now.alias("last_status_at"), strip("note").alias("note"),
        F.lit(0).alias("_o"),
    )
    return reviewed, upsert(applications, noted, ["job_id"], {"note": TAKE_NEW}, "_o")


def with_staleness(apps: DataFrame, now: Column, after_days: int = STALE_DAYS,
                   awaiting: tuple[str, ...] = AWAITING_TRACKER) -> DataFrame:
    """Add ``days_since`` the last movement and ``stale`` (waiting on them, and it has been a while)."""
    days = F.coalesce(days_between(now, "last_status_at"), F.lit(0))
    return apps.withColumn("days_since", days).withColumn(
        "stale", F.col("status").isin(*awaiting) & (F.col("days_since") >= after_days)
    )
