"""Fan-in of sources, run outcomes, and the rows the stored tables take."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.dates import parse_posted_at
from tallyhire.functions.liveness import run_error, run_status
from tallyhire.functions.text import job_id, nonblank
from tallyhire.operators.extract import resolve_labels
from tallyhire.sources.feeds import SPECS
from tallyhire.sources.spec import SearchQuery, SourceSpec, payload_failure, read_source


def readiness(spec: SourceSpec, boards: int = 0, credentials: bool = False) -> tuple[bool, str | None]:
    """Can this source run at all?  Checked before reading, reported as ``skipped``."""
    if spec.needs_boards and boards == 0:
        return False, f"no {spec.label} boards known yet"
    if not spec.keyless and not credentials:
        return False, f"{spec.label} needs a credential or opt-in"
    return True, None


def failed_source(spec: SourceSpec, payloads: DataFrame) -> DataFrame:
    """One row: the error that sinks the whole source, or NULL.

    A failing board keeps the others; only when every response fails (or any, for
    sources that cannot go on) does the source itself fail, with its first error.
    """
    why = payload_failure(spec)
    relevant = payloads if spec.kind is None else payloads.filter(F.col("kind") == spec.kind)
    first = F.min_by(F.struct(why.alias("error"), "http_status"), F.when(why.isNotNull(), F.col("seq")))
    bad, total = F.count_if(why.isNotNull()), F.count("*")
    sunk = (bad > 0) if spec.fails_on_any_error else ((total > 0) & (bad == total))
    return relevant.agg(F.when(sunk, first).alias("failure"))


def run_source(spec: SourceSpec, payloads: DataFrame, query: SearchQuery, now: Column) -> DataFrame:
    """Ingest records of one source; none when the source failed."""
    sunk = failed_source(spec, payloads).select(F.col("failure").isNotNull()).scalar()
    return read_source(spec, payloads, query, now).filter(~sunk)


def run_outcome(spec: SourceSpec, payloads: DataFrame, query: SearchQuery, now: Column,
                ready: tuple[bool, str | None] = (True, None)) -> DataFrame:
    """One engine_runs row for a source."""
    ok, reason = ready
    if not ok:
        return payloads.limit(0).agg(F.count("*").alias("fetched")).select(
            F.lit(spec.id).alias("engine"), F.lit("skipped").alias("status"), "fetched", F.lit(reason).alias("error")
        )
    failure = failed_source(spec, payloads)
    counted = run_source(spec, payloads, query, now).agg(F.count("*").alias("fetched")).withColumn(
        "failure", failure.scalar()
    )
    status = run_status(F.lit(True), F.col("fetched"), F.col("failure.http_status"), F.col("failure.error"))
    return counted.select(
        F.lit(spec.id).alias("engine"), status.alias("status"), "fetched", run_error(F.col("failure.error")).alias("error")
    )


def own_boards(spec: SourceSpec, boards: DataFrame) -> DataFrame:
    """(board_token) of the active boards on this source's platform."""
    return boards.filter(F.col("active") & (F.col("ats") == spec.id)).select(F.col("token").alias("board_token")).distinct()


def of_own_boards(spec: SourceSpec, payloads: DataFrame, boards: DataFrame | None) -> DataFrame:
    """The responses of a source's own active boards; a source without boards, or no boards given, keeps all."""
    if boards is None or not spec.needs_boards:
        return payloads
    return payloads.join(own_boards(spec, boards), "board_token", "left_semi").select(*payloads.columns)


def run_sources(payloads: Mapping[str, DataFrame], query: SearchQuery, now: Column, boards: DataFrame | None = None) -> DataFrame:
    """Records of every requested source; a source that fails contributes nothing and harms no other."""
    parts = [run_source(SPECS[s], of_own_boards(SPECS[s], df, boards), query, now) for s, df in payloads.items() if s in SPECS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_outcomes(payloads: Mapping[str, DataFrame], query: SearchQuery, now: Column, boards: DataFrame | None = None) -> DataFrame:
    """One engine_runs row per source; with ``boards`` given, one that needs boards and has none of its own is skipped."""
    def outcome(spec: SourceSpec, df: DataFrame) -> DataFrame:
        out = run_outcome(spec, of_own_boards(spec, df, boards), query, now)
        if boards is None or not spec.needs_boards:
            return out
        none = own_boards(spec, boards).agg(F.count("*") == 0).scalar()
        return out.withColumns({"status": F.when(none, "skipped").otherwise(F.col("status")),
                                "error": F.when(none, readiness(spec)[1]).otherwise(F.col("error"))})

    return reduce(DataFrame.unionByName, [outcome(SPECS[s], df) for s, df in payloads.items() if s in SPECS])


def to_job_rows(raw: DataFrame, now: Column) -> DataFrame:
    """Ingest records -> upsert batch for jobs, with ``ordinal`` keeping batch order."""
    salary = F.col("salary")
    return raw.select(
        job_id(F.col("engine"), F.col("native_id"), F.col("apply_url")).alias("id"), "engine",
        nonblank("native_id").alias("native_id"), "company", "title", "location", "remote", "apply_url",
        "description", "description_complete", salary["min"].alias("salary_min"), salary["max"].alias("salary_max"),
        nonblank(salary["currency"]).alias("salary_currency"), salary["period"].alias("salary_period"),
        "employment_type", parse_posted_at("posted_at").alias("posted_at"), now.alias("first_seen"),
        now.alias("last_seen"), F.lit("new").alias("review_status"), "raw",
        F.struct("engine", "seq", "pos").alias("ordinal"),
    )


def to_skill_rows(raw: DataFrame, resolve_aliases: bool = True, learned: DataFrame | None = None) -> DataFrame:
    """Skills a source handed over -> job_skills rows, required by definition.

    ``resolve_aliases=False`` keeps the lower-cased label as the skill instead of its slug.
    """
    each = raw.select(
        job_id(F.col("engine"), F.col("native_id"), F.col("apply_url")).alias("job_id"), "seq", "pos",
        F.posexplode_outer("skills").alias("ordinal", "label"),
    ).filter(F.col("label").isNotNull())
    keyed = (
        resolve_labels(each, "label", learned, "skill") if resolve_aliases
        else each.withColumn("skill", nonblank(F.lower(F.trim("label"))))
    ).filter(F.col("skill").isNotNull())
    return keyed.select(
        "job_id", "skill", "label", F.lit("required").alias("requirement"), F.lit("engine").alias("source"),
        F.col("ordinal").cast("bigint").alias("ordinal"), "seq", "pos",
    )


def read_captured(spark, path: str) -> DataFrame:
    """Captured responses stored as JSON lines (one payload row per line), read with a fixed schema."""
    return spark.read.schema(
        "seq bigint, kind string, board_company string, board_token string, body string, http_status int, error string"
    ).json(path)
