"""The application tracker as keyed state: groups of applications, and event-time timers for "they went silent".

A status log of any order is folded into the same state that ``lifecycle.replay`` finds in one aggregation: every field is a
minimum, a maximum or the entry of the last (time, seq), so it does not matter how the log is cut into micro-batches.  Each
task folds what it reads before the shuffle, so a job that holds most of the log sends one row per task and Arrow batch.

A call between Python and the state store costs as much as folding dozens of rows, so the applications of one of ``GROUPS``
hashes share a state and a timer, set to the first of theirs that is due.  A micro-batch reads and writes the groups it touches.
Spark turns what goes there and back into Python objects field by field, so a row's fold and a group's state travel as JSON.

Rows without a job or a time and unknown statuses are refused.  Of two entries at the same time and seq the larger text counts.
An event more than ``late`` behind the newest one of earlier batches is dropped by the watermark; ``run_to_files`` counts those.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyhire.functions.text import nonblank, strip
from tallyhire.operators.lifecycle import AWAITING_TRACKER, STALE_DAYS
from tallyhire.operators.skew import latest_by
from tallyhire.schemas import APPLICATION_STATUSES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000

#: States that the applications are dealt to; a stream that goes on from a checkpoint keeps their number.
GROUPS = 16_384

_FOLD = ("opened", "moved_at", "moved_seq", "moved", "prepared", "submitted", "noted_at", "noted_seq", "note", "events")
_FIELDS = (*_FOLD, "base_status", "base_prepared", "base_submitted", "base_at", "base_note", "timer")
_HELD = "applications string, timer long"
_OUT = ("job_id string, status string, prepared_us long, submitted_us long, last_us long, note string, events long, "
        "stale boolean, applies boolean")
_EMPTY = dict.fromkeys(_FIELDS) | {"events": 0}


def _first(a, b):
    return b if a is None else a if b is None else min(a, b)


def _last(state: dict, new: dict, at: str, seq: str, value: str) -> None:
    """Keep the entry of the greatest (time, seq, text)."""
    if new[at] is not None and (state[at] is None or (new[at], new[seq], new[value]) > (state[at], state[seq], state[value])):
        state |= {at: new[at], seq: new[seq], value: new[value]}


def _read(fold: str) -> dict:
    """A fold from JSON, which leaves nulls out."""
    return dict.fromkeys(_FOLD) | json.loads(fold)


def _fold(state: dict, new: dict) -> None:
    for column in ("opened", "prepared", "submitted"):
        state[column] = _first(state[column], new[column])
    _last(state, new, "moved_at", "moved_seq", "moved")
    _last(state, new, "noted_at", "noted_seq", "note")
    state["events"] += new["events"]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per job of an Arrow batch; jobs that occur once in it pass as they are."""
    for batch in batches:
        codes = batch.column("job_id").dictionary_encode().indices.to_numpy()
        repeated = np.bincount(codes)[codes] > 1
        yield batch.filter(pa.array(~repeated))
        jobs: dict[str, dict] = {}
        newest: dict[str, int] = {}
        for row in batch.filter(pa.array(repeated)).to_pylist():
            job = row["job_id"]
            if job in jobs:
                _fold(jobs[job], _read(row["fold"]))
                newest[job] = max(newest[job], row["newest"])
            else:
                jobs[job], newest[job] = _read(row["fold"]), row["newest"]
        if jobs:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(jobs), batch.schema.field("job_id").type), pa.array(list(newest.values()), pa.int64()),
                pa.array([json.dumps(s) for s in jobs.values()], batch.schema.field("fold").type)], schema=batch.schema)


class Tracker(StatefulProcessor):
    """Folds the log of a group of applications; emits an application's row when it changes and once more when it turns stale."""

    def __init__(self, stale_days: int, awaiting: tuple[str, ...]) -> None:
        self.stale_us, self.awaiting = stale_days * DAY_US, awaiting

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("applications", _HELD)

    def _get(self) -> tuple[dict[str, dict], int | None]:
        """The applications of the group by job, and its timer."""
        held = self.held.get()
        return ({job: dict(zip(_FIELDS, s)) for job, s in json.loads(held[0]).items()}, held[1]) if held is not None else ({}, None)

    def _where(self, s: dict) -> tuple[str, int | None]:
        """Status and the time of the last movement."""
        if s["moved_at"] is not None:
            return s["moved"], s["moved_at"]
        return (s["base_status"], s["base_at"]) if s["base_status"] is not None else ("viewed", s["opened"])

    def _settle(self, s: dict, watermark: int) -> bool:
        """Set the application's moment to where its status now puts it; true when that has passed."""
        status, at = self._where(s)
        due = -(-(at + self.stale_us) // 1000) if status in self.awaiting and at is not None else None
        stale = due is not None and due <= watermark
        s["timer"] = None if stale else due
        return stale

    def _put(self, applications: dict[str, dict], timer: int | None, watermark: int) -> None:
        """Write the group and move its timer to the first application that is due."""
        due = min((s["timer"] for s in applications.values() if s["timer"] is not None), default=None)
        if due != timer:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((json.dumps({job: [s[f] for f in _FIELDS] for job, s in applications.items()}), due))

    def _row(self, job: str, s: dict, stale: bool) -> Row:
        status, at = self._where(s)
        noted = s["noted_at"] is not None
        return Row(job_id=job, status=status, prepared_us=s["prepared"] if s["base_prepared"] is None else s["base_prepared"],
                   submitted_us=s["submitted"] if s["base_submitted"] is None else s["base_submitted"], last_us=at,
                   note=s["note"] if noted else s["base_note"], events=s["events"], stale=stale, applies=noted)

    def _turned(self, applications: dict[str, dict], timer: int | None, touched: set[str], watermark: int) -> Iterator[Row]:
        """The rows of what the batch touched and of what is now due."""
        rows = [self._row(job, s, self._settle(s, watermark)) for job, s in applications.items()
                if job in touched or s["timer"] is not None and s["timer"] <= watermark]
        self._put(applications, timer, watermark)
        return iter(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        applications, timer = self._get()
        touched = set()
        for r in rows:
            new = _read(r["fold"])
            touched.add(new["job_id"])
            _fold(applications.setdefault(new["job_id"], dict(_EMPTY)), new)
        return self._turned(applications, timer, touched, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        applications, timer = self._get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            return self._turned(applications, timer, set(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        watermark = timerValues.getCurrentWatermarkInMs()
        applications = {a["job_id"]: _EMPTY | {f"base_{c}": a[c] for c in ("status", "prepared", "submitted", "at", "note")}
                        for a in initialState["stored"]}
        for s in applications.values():
            self._settle(s, watermark)
        self._put(applications, None, watermark)


def _us(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _group() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(GROUPS)).cast("int").alias("group")


def track(events: DataFrame, late: str = "1 day", stale_days: int = STALE_DAYS, awaiting: tuple[str, ...] = AWAITING_TRACKER,
          stored: DataFrame | None = None) -> DataFrame:
    """A stream of (job_id, seq, at, kind, status, note) as a stream of application rows.

    A row comes out for every application that a micro-batch touched and for every one whose status has waited
    ``stale_days`` when the watermark gets there (``stale``).  ``stored`` are the applications the log goes on from: they
    keep their first stamps, and their status and note until the log has one.  ``events`` counts what the row is made
    of; ``newest`` picks the last row per application.
    """
    valid = events.filter("job_id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").filter(
        F.col("kind").isin("open", "note") | ((F.col("kind") == "set") & F.col("status").isin(*APPLICATION_STATUSES)))
    rows = valid.select("job_id", _us("at").alias("us"), F.col("seq").cast("long").alias("seq"), "kind", "status", "note")
    moved, noted = F.col("kind") == "set", F.col("note").isNotNull()

    def first(status: str) -> Column:
        return F.when(moved & (F.col("status") == status), F.col("us")).alias(status)

    single = rows.select("job_id", F.col("us").alias("newest"), F.to_json(F.struct(
        "job_id", F.col("us").alias("opened"), F.when(moved, F.col("us")).alias("moved_at"),
        F.when(moved, F.col("seq")).alias("moved_seq"), F.when(moved, F.col("status")).alias("moved"), first("prepared"),
        first("submitted"), F.when(noted, F.col("us")).alias("noted_at"), F.when(noted, F.col("seq")).alias("noted_seq"), "note",
        F.lit(1).alias("events"))).alias("fold"))
    folds = single.mapInArrow(_partial, "job_id string, newest long, fold string")
    timed = folds.select(_group(), F.timestamp_micros("newest").alias("at"), "fold").withWatermark("at", late)
    base = None if stored is None else latest_by(stored.filter("job_id IS NOT NULL"), ["job_id"], ["last_status_at", "status"]).groupBy(
        _group()).agg(F.collect_list(F.struct(
            "job_id", "status", _us("prepared_at").alias("prepared"), _us("submitted_at").alias("submitted"),
            _us("last_status_at").alias("at"), "note")).alias("stored")).groupBy("group")
    out = timed.groupBy("group").transformWithState(Tracker(stale_days, awaiting), _OUT, "append", "EventTime", base)
    return out.select(
        "job_id", "status", F.timestamp_micros("prepared_us").alias("prepared_at"),
        F.timestamp_micros("submitted_us").alias("submitted_at"), F.timestamp_micros("last_us").alias("last_status_at"),
        F.when(F.col("applies"), nonblank(strip("note"))).otherwise(F.col("note")).alias("note"), "events", "stale")


def newest(rows: DataFrame) -> DataFrame:
    """The last row of every application in what ``track`` has written so far."""
    return latest_by(rows, ["job_id"], ["events", "stale"])


def with_keyed_state(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; a session that names another one of its own keeps it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
