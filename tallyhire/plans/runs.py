"""Source health, spend and budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.cost import PRICES, approximate_tokens, estimate_cost, format_usd
from tallyhire.functions.dates import period_start
from tallyhire.operators.lifecycle import STALE_DAYS
from tallyhire.operators.skew import latest_by
from tallyhire.plans.tracker import stale_applications, status_counts
from tallyhire.sources.feeds import SPECS



def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per engine; a tie on the time goes to the larger id."""
    return latest_by(runs.select("engine", "started_at", "id", "status", "fetched", "inserted", "error"),
                     ["engine"], ["started_at", "id"])


def last_recorded_runs(runs: DataFrame) -> DataFrame:
    """The run with the largest id per engine."""
    return latest_by(runs.select("engine", "id", "status", "error"), ["engine"], ["id"]).orderBy("engine")


def last_discovery_at(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("started_at").alias("at"))


def roster(spark, enabled: set[str] | None = None, blocked: dict[str, str] | None = None) -> DataFrame:
    """Every source with whether it is enabled and ready; ``blocked`` gives reasons."""
    blocked = blocked or {}
    on = set(SPECS) if enabled is None else enabled
    rows = [
        (i, s.id, s.family, s.id in on, s.id in on and s.id not in blocked, blocked.get(s.id) if s.id in on else None)
        for i, s in enumerate(SPECS.values())
    ]
    return spark.createDataFrame(
        rows, "position int, engine string, family string, enabled boolean, ready boolean, blocked_by string"
    )


def engine_health(sources: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Roster x latest run x stored postings, in roster order."""
    stored = jobs.groupBy("engine").agg(F.count("*").alias("jobs"))
    last = latest_runs(runs).select(
        "engine", F.col("status").alias("last_status"), F.col("started_at").alias("last_started_at"),
        F.col("fetched").alias("last_fetched"), F.col("inserted").alias("last_inserted"),
        F.col("error").alias("last_error"),
    )
    return (
        sources.join(last, "engine", "left").join(stored, "engine", "left")
        .withColumn("jobs", F.coalesce("jobs", F.lit(0))).orderBy("position")
    )


def pipeline_counts(jobs: DataFrame) -> DataFrame:
    """Postings per review status with the grand total (status NULL, is_total) in one pass."""
    return jobs.rollup("review_status").agg(
        F.count("*").alias("n"), F.grouping("review_status").cast("boolean").alias("is_total")
    ).select(F.col("review_status").alias("status"), "n", "is_total")


def engine_status_line(runs: DataFrame) -> DataFrame:
    """ok / failing / idle engines by their last recorded run."""
    last = last_recorded_runs(runs)
    ok = F.col("status") == "ok"
    bad = F.col("status").isin("error", "rate_limited")
    return last.agg(
        F.count_if(ok).alias("ok"), F.count_if(bad).alias("failing"), F.count_if(~ok & ~bad).alias("idle")
    )


def status_report(jobs: DataFrame, applications: DataFrame, runs: DataFrame, spend: DataFrame, answers: DataFrame,
                  now: Column, since: Column | None = None, stale_after: int = STALE_DAYS) -> DataFrame:
    """The report over all stored tables as rows (section, name, n, usd, note).

    Sections: pipeline (postings per review status, and all as ``seen``), applications (per status), stale (per gone-quiet
    application, *n* its days), engines (ok, idle and failing), failing (per failing engine, with its error), spend (total, per
    stage, and calls without a known price), answers.  A section with nothing to say has no rows.
    """
    def rows(df: DataFrame, section: str, name: Column, n: Column, usd: Column = F.lit(None), note: Column = F.lit(None)) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("bigint").alias("n"),
                         usd.cast("double").alias("usd"), note.cast("string").alias("note"))

    col = F.col
    line = engine_status_line(runs).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("name"), col(k).alias("n")) for k in ("ok", "idle", "failing")])))
    spent = spend_since(spend, since).filter(col("level").isin("total", "stage") & (col("calls") > 0))
    total = spent.filter("level = 'total' and unpriced > 0")
    parts = [
        rows(pipeline_counts(jobs), "pipeline", F.when(col("is_total"), "seen").otherwise(col("status")), col("n")),
        rows(status_counts(applications), "applications", col("status"), col("n")),
        rows(stale_applications(applications, jobs, now, stale_after), "stale", col("job_id"), col("days_since"),
             note=F.concat_ws(", ", "company", "title")),
        rows(line.filter("n > 0"), "engines", col("name"), col("n")),
        rows(last_recorded_runs(runs).filter(col("status").isin("error", "rate_limited")), "failing", col("engine"), F.lit(None),
             note=col("error")),
        rows(spent, "spend", F.when(col("level") == "total", "total").otherwise(col("name")), col("calls"), col("usd")),
        rows(total, "spend", F.lit("unpriced"), col("unpriced")),
        rows(answers.agg(F.count("*").alias("n")).filter("n > 0"), "answers", F.lit("confirmed"), col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- spend --------------------------------------------------------------------


def spend_since(spend: DataFrame, since: Column | None) -> DataFrame:
    """Total, per stage and per model in one pass: (level, name, usd, calls, unpriced)."""
    rows = spend if since is None else spend.filter(F.coalesce(F.col("at") >= since, F.lit(False)))
    unpriced = (F.col("estimated_usd") == 0) & (F.col("cost_source") == "derived")
    # Aggregate at the finest grain first: what is regrouped is (stage, model) pairs, not calls.
    fine = rows.groupBy("stage", "model").agg(
        F.sum("estimated_usd").alias("usd"), F.count("*").alias("calls"), F.count_if(unpriced).alias("unpriced")
    )
    both = fine.groupingSets([["stage"], ["model"], []], "stage", "model").agg(
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"), F.grouping_id("stage", "model").alias("_g"),
    )
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "stage").otherwise("model")
    return both.select(level.alias("level"), F.coalesce("stage", "model", F.lit("")).alias("name"), "usd", "calls",
                       "unpriced").orderBy("level", F.desc("usd"), "name")


def spend_total(spend: DataFrame, since: Column | None) -> DataFrame:
    rows = spend if since is None else spend.filter(F.coalesce(F.col("at") >= since, F.lit(False)))
    return rows.agg(F.coalesce(F.sum("estimated_usd"), F.lit(0.0)).alias("spent"))


def check_budget(spend: DataFrame, limit: float, period: str, projected: Column, now: Column) -> DataFrame:
    """May a stage of the projected cost run?  Exactly the remainder is permitted."""
    since = None if period == "none" else period_start(now, period)
    base = spend_total(spend, since).withColumns({"limit": F.lit(float(limit)), "projected": projected})
    if limit <= 0 or period == "none":
        return base.select(F.lit(True).alias("ok"), "spent", "limit", F.lit(float("inf")).alias("remaining"),
                           "projected", F.lit(None).cast("string").alias("reason"))
    left = F.greatest(F.lit(0.0), F.col("limit") - F.col("spent"))
    over = F.col("spent") >= F.col("limit")
    short = F.col("projected") > left
    cap = F.concat(format_usd(F.col("limit")), F.lit(f" {period} limit"))
    reason = F.when(over, F.concat(F.lit("Already spent "), format_usd(F.col("spent")), F.lit(" of your "), cap, F.lit("."))
                    ).when(short, F.concat(
                        F.lit("This stage is estimated at "), format_usd(F.col("projected")), F.lit(", but only "),
                        format_usd(left), F.lit(" of your "), cap, F.lit(" is left.")))
    return base.select((~over & ~short).alias("ok"), "spent", "limit", left.alias("remaining"), "projected",
                       reason.alias("reason"))


def stage_projection(jobs: DataFrame, model: str, prices=PRICES, prompt_chars: int | None = None) -> DataFrame:
    """Expected cost of judging these postings: calls, mean length of what is sent, projected dollars."""
    length = F.length(F.coalesce("description", F.lit("")))
    sent = length if prompt_chars is None else F.least(length, F.lit(prompt_chars))
    stats = jobs.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.ceil(F.avg(sent)), F.lit(0))
        .alias("average_chars"),
    )
    tokens = approximate_tokens(F.col("average_chars"))
    per_call = F.coalesce(estimate_cost(F.lit(model), tokens, F.ceil(tokens / 4), prices), F.lit(0.0))
    return stats.withColumn("projected_usd", per_call * F.col("calls"))


# -- boards -------------------------------------------------------------------


def active_boards(boards: DataFrame) -> DataFrame:
    return boards.filter("active").select("company", "ats", "token").orderBy("company", "ats", "token")


def boards_by_platform(boards: DataFrame) -> DataFrame:
    return boards.filter("active").groupBy("ats").agg(F.count("*").alias("boards")).orderBy("ats")
