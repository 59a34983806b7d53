"""Queries over time and ranges: as-of joins, overlapping ranges, sessions of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhire.operators.settle import run_folder
from tallyhire.operators.temporal import Folded, asof_join, interval_join
from tallyhire.streaming import logs
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.sql import num, query, ts
from tallyhire.workload.state import _stream

#: Prices per model, each valid from its own time until the next one of the model.
PRICE_LIST = d.Derived("part", {
    "list_id": "p_partkey",
    "model": d.pick("p_partkey % 6", d.MODELS),
    "valid_from": "TIMESTAMP '2024-01-01 00:00:00' + (p_partkey * 7919 % 41760) * INTERVAL '1' MINUTE",
    "usd_in": "CAST(p_size AS DOUBLE)",
    "usd_out": "CAST(p_size * 4 AS DOUBLE)",
})
CHECKED_POSTINGS = d.Derived("orders", {
    "k": d.K,
    "engine": d.engine(d.K),
    "checked_at": f"TIMESTAMP '2024-01-01 00:00:00' + ({d.K} * 31 % 44640) * INTERVAL '1' MINUTE",
})
PAY_RANGES = d.Derived("orders", {
    "k": d.K, "currency": d.JOBS.columns["salary_currency"],
    "pay_from": d.JOBS.columns["salary_min"], "pay_to": d.JOBS.columns["salary_max"],
})
TARGET_BANDS = d.Derived("nation", {
    "band": "n_nationkey",
    "currency": d.pick("n_nationkey % 3", ("USD", "INR", "EUR")),
    "band_from": "CAST(n_nationkey * 4500 AS DOUBLE)",
    "band_to": "CAST(n_nationkey * 4500 + 500 * (1 + n_nationkey % 4 * n_nationkey) AS DOUBLE)",
})
#: What a run fetched stays fresh for one to six hours.
FRESHNESS = d.Derived("events", {
    "run": "event_id",
    "engine": d.engine("event_id"),
    "fresh_from": "ts",
    "fresh_until": "ts + (1 + event_id % 6) * INTERVAL '1' HOUR",
})
#: Crawls of a host, as many hosts as the table has users, so that sessions stay as long whatever the table's size.
CRAWLS = d.Derived("events", {**d.ENGINE_RUNS.columns, "engine": "'host-' || CAST(user_id AS STRING)"})
SESSION_GAP, SESSION_LATE = "12 hours", "1 hour"


@register("J17_spend_priced_as_of", query(f"""
    SELECT id, list_id, {num('coalesce(input_tokens, 0) * usd_in / 1e6 + coalesce(output_tokens, 0) * usd_out / 1e6', 'usd')}
    FROM calls c ASOF LEFT JOIN (
      SELECT model, valid_from, max(list_id) AS list_id, arg_max(usd_in, list_id) AS usd_in, arg_max(usd_out, list_id) AS usd_out
      FROM price_list GROUP BY ALL) p ON c.model = p.model AND c.called_at >= p.valid_from""", price_list=PRICE_LIST.sql()))
def _(w):
    """Every model call at the price that was valid when it was made."""
    priced = asof_join(w.calls, w.derived(PRICE_LIST), ["model"], "at", "valid_from", ["list_id"])
    none = F.lit(0).cast("bigint")
    usd = F.coalesce("input_tokens", none) * F.col("usd_in") / 1e6 + F.coalesce("output_tokens", none) * F.col("usd_out") / 1e6
    return priced.select("id", "list_id", usd.alias("usd"))


@register("J18_posting_last_run", query(f"""
    SELECT k, run, status, {ts('started_at')} FROM checked c ASOF LEFT JOIN (
      SELECT engine, started_at, max(id) AS run, arg_max(status, id) AS status FROM engine_runs GROUP BY ALL) r
    ON c.engine = r.engine AND c.checked_at >= r.started_at""",
    checked=CHECKED_POSTINGS.sql(), engine_runs=d.ENGINE_RUNS.sql()))
def _(w):
    """Every posting with the last run of its source before it was checked."""
    runs = w.engine_runs.select("engine", "started_at", F.col("id").alias("run"), "status")
    return asof_join(w.derived(CHECKED_POSTINGS), runs, ["engine"], "checked_at", "started_at", ["run"]).select(
        "k", "run", "status", "started_at")


@register("J19_pay_bands", query("""
    SELECT band, count(*) AS postings, min(k) AS first_posting FROM pay JOIN bands ON pay.currency = bands.currency
      AND pay_from <= band_to AND band_from <= pay_to GROUP BY band""", pay=PAY_RANGES.sql(), bands=TARGET_BANDS.sql()))
def _(w):
    """Postings whose pay range meets each target band of the same currency."""
    met = interval_join(w.derived(PAY_RANGES), w.derived(TARGET_BANDS), ("pay_from", "pay_to"), ("band_from", "band_to"), ["currency"])
    return met.groupBy("band").agg(F.count("*").alias("postings"), F.min("k").alias("first_posting"))


@register("J20_runs_while_fresh", query("""
    SELECT r.id, count(*) AS fresh, max(f.run) AS newest FROM engine_runs r JOIN freshness f ON r.engine = f.engine
      AND r.started_at <= f.fresh_until AND f.fresh_from <= r.finished_at AND r.id <> f.run
    GROUP BY r.id""", engine_runs=d.ENGINE_RUNS.sql(), freshness=FRESHNESS.sql()))
def _(w):
    """Runs of a source that began while what another run of it had fetched was still fresh."""
    runs = w.engine_runs.select("engine", "id", "started_at", "finished_at")
    return interval_join(runs, w.derived(FRESHNESS), ("started_at", "finished_at"), ("fresh_from", "fresh_until"), ["engine"],
                         folded=Folded("id", "run", "fresh", "newest"))


@register("T12_stream_run_sessions", query(f"""
    SELECT engine, {ts('first_run')}, {ts('last_run')}, runs, failing FROM (
      SELECT engine, session, min(started_at) AS first_run, max(started_at) AS last_run, count(*) AS runs,
        count(*) FILTER (status IN ('error', 'rate_limited')) AS failing
      FROM (SELECT *, sum(opens) OVER (PARTITION BY engine ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS session
        FROM (SELECT *, CASE WHEN started_at <= lag(started_at) OVER (PARTITION BY engine ORDER BY started_at, id)
          + INTERVAL '12' HOUR THEN 0 ELSE 1 END AS opens FROM crawls)) GROUP BY engine, session)
    WHERE last_run + INTERVAL '12' HOUR <= (SELECT date_trunc('milliseconds', max(started_at)) - INTERVAL '1' HOUR FROM crawls)""",
    crawls=CRAWLS.sql()))
def _(w):
    """Sessions of crawls per host that the watermark has closed."""
    runs = _stream(w, "events").selectExpr(*CRAWLS.exprs())
    out, cp = run_folder(w.spark, "run-sessions"), run_folder(w.spark, "run-sessions-cp")
    logs.run_to_files(logs.run_sessions(runs, SESSION_GAP, SESSION_LATE), out, cp)
    return w.spark.read.parquet(out).select("engine", "first_run", "last_run", "runs", "failing")
