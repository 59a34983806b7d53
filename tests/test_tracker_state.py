"""The tracker as keyed state against the batch replay of the same log."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from tallyhire.operators import lifecycle as lc
from tallyhire.streaming import logs, tracker

LOG = "job_id string, seq long, at timestamp, kind string, status string, note string"
APPS = "job_id string, status string, prepared_at timestamp, submitted_at timestamp, last_status_at timestamp, note string"
START = dt.datetime(2024, 1, 1)
COLUMNS = ["job_id", "status", "prepared_at", "submitted_at", "last_status_at", "note"]


def a_log(seed, n=250):
    rnd = random.Random(seed)
    jobs = ["hot"] * 8 + [f"job-{k}" for k in range(12)]
    statuses = ["viewed", "prepared", "submitted", "responded", "interviewing", "offer", "rejected", "bogus"]
    out = []
    for i in range(n):
        kind = rnd.choice(["open", "set", "set", "note"])
        at = START + dt.timedelta(hours=6 * i + rnd.randint(-20, 20))
        out.append((rnd.choice(jobs), i, at, kind, rnd.choice(statuses) if kind == "set" else None,
                    rnd.choice(["  ", " said hi ", "call back"]) if kind == "note" else None))
    return out + out[:3]  # repeated rows


def drain(spark, folder, late="60 days", stored=None):
    tracker.with_keyed_state(spark)
    events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    return logs.run_to_files(tracker.track(events, late, stored=stored), f"{folder}/out", f"{folder}/cp")


def put(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def rows_of(df, *more):
    return sorted((tuple(r) for r in df.select(*COLUMNS, *more).collect()), key=str)


def stale_at(df, watermark):
    return df.withColumn("stale", F.col("status").isin(*lc.AWAITING_TRACKER) & (
        F.col("last_status_at") + F.expr("INTERVAL 14 DAYS") <= F.lit(watermark)))


def test_replay_in_micro_batches_with_a_restart_equals_the_batch(spark, tmp_path):
    log = a_log(1)
    cuts = [0, 70, 150, len(log)]
    for part, stop in ((0, 2), (2, 3)):  # the second half comes after the stream has stopped and started anew
        for a, b in list(zip(cuts, cuts[1:]))[part:stop]:
            put(spark, tmp_path, log[a:b])
        assert drain(spark, tmp_path) == 0
    got = tracker.newest(spark.read.parquet(f"{tmp_path}/out"))
    watermark = max(r[2] for r in log if r[4] != "bogus") - dt.timedelta(days=60)
    want = stale_at(lc.replay(spark.createDataFrame(log, LOG)), watermark)
    assert rows_of(got, "stale") == rows_of(want, "stale")
    assert got.agg(F.sum("events")).first()[0] == sum(r[4] != "bogus" for r in log)


def test_a_stored_application_goes_on_from_where_it_stood(spark, tmp_path):
    log = a_log(2, 60)
    put(spark, tmp_path, log)
    stored = spark.createDataFrame([
        ("hot", "submitted", START, START, START, "kept"), ("job-1", "viewed", None, None, START, "  raw "),
        ("quiet", "submitted", None, START, START, None), ("silent", "offer", None, None, START, None)], APPS)
    drain(spark, tmp_path, "1 hour", stored)
    got = tracker.newest(spark.read.parquet(f"{tmp_path}/out"))
    after = lc.apply_updates(stored, spark.createDataFrame(log, LOG))
    want = stale_at(after, max(r[2] for r in log if r[4] != "bogus") - dt.timedelta(hours=1)).filter("job_id <> 'silent'")
    # an application that neither moved nor turned stale has no row: "silent" stands as it was stored
    assert rows_of(got, "stale") == rows_of(want, "stale")
    assert got.filter("job_id = 'quiet'").first()["stale"] and got.filter("job_id = 'quiet'").first()["events"] == 0


def test_timer_fires_at_its_very_moment_once_and_moves_with_the_status(spark, tmp_path):
    day = dt.timedelta(days=1)
    put(spark, tmp_path, [("a", 1, START, "set", "submitted", None), ("b", 1, START, "set", "submitted", None),
                          ("c", 1, START, "set", "offer", None)])
    put_later = [[("b", 2, START + 10 * day, "set", "responded", None)], [("z", 3, START + 14 * day, "open", None, None)],
                 [("a", 4, START + 15 * day, "note", None, "still nothing")], [("a", 5, START + 16 * day, "set", "responded", None)]]
    seen = []
    for rows in [[], *put_later]:
        if rows:
            put(spark, tmp_path, rows)
        drain(spark, tmp_path, "0 seconds")
        now = tracker.newest(spark.read.parquet(f"{tmp_path}/out"))
        seen.append({r["job_id"] for r in now.filter("stale").collect()})
    assert seen == [set(), set(), {"a"}, {"a"}, set()]
    assert spark.read.parquet(f"{tmp_path}/out").filter("job_id = 'a' AND stale AND events = 1").count() == 1


def test_late_rows_are_counted_and_broken_rows_refused(spark, tmp_path):
    put(spark, tmp_path, [("a", 1, START + dt.timedelta(days=9), "open", None, None), (None, 1, START, "open", None, None),
                          ("n", 1, None, "open", None, None), ("u", 1, START, "set", None, None), ("k", 1, START, "gone", None, None)])
    assert drain(spark, tmp_path, "1 day") == 0
    put(spark, tmp_path, [("late", 1, START, "open", None, None)])
    assert drain(spark, tmp_path, "1 day") == 1
    assert [r["job_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a"]


class Calls:
    """A state store that keeps one value and notes what was asked of it."""

    def __init__(self):
        self.made, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.made.append("get")
        return self.value

    def update(self, value):
        self.made.append("update")
        self.value = value

    def registerTimer(self, at):
        self.made.append(f"timer {at}")

    def deleteTimer(self, at):
        self.made.append(f"no timer {at}")


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_applications_of_a_group_share_the_calls_to_the_state_store():
    store, day = Calls(), 86_400_000
    held = tracker.Tracker(14, lc.AWAITING_TRACKER)
    held.init(store)

    def submitted(k, at):
        return Row(fold=json.dumps({"job_id": f"j{k}", "opened": at, "moved_at": at, "moved_seq": k, "moved": "submitted",
                                    "submitted": at, "events": 1}))

    out = list(held.handleInputRows((1,), iter([submitted(k, k * day * 1000) for k in range(50)]), Times(0)))
    assert store.made == ["get", f"timer {14 * day}", "update"] and len(out) == 50 and not any(r.stale for r in out)
    store.made.clear()
    out = list(held.handleInputRows((1,), iter([submitted(3, 40 * day * 1000)]), Times(15 * day)))
    assert {r.job_id: r.stale for r in out} == {"j0": True, "j1": True, "j3": False}
    assert store.made == ["get", f"timer {16 * day}", "update"]


def test_a_batch_sends_one_row_per_job():
    rows = [{"job_id": j, "newest": n, "fold": json.dumps({"job_id": j, "opened": n, "events": 1, "note": 'a "b"\n'})}
            for j, n in (("hot", 4), ("x", 3), ("hot", 9), ("hot", 2))]
    got = [r for b in tracker._partial(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    folds = {r["job_id"]: (r["newest"], json.loads(r["fold"])) for r in got}
    assert len(got) == 2 and folds["hot"][0] == 9 and folds["hot"][1]["opened"] == 2 and folds["hot"][1]["events"] == 3
    assert folds["x"] == (3, {"job_id": "x", "opened": 3, "events": 1, "note": 'a "b"\n'})
