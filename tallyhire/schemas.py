"""Table shapes: one DDL string per stored table, plus the ingest record.

Booleans that may be "not known" stay nullable on purpose; nothing in this
package coalesces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

SALARY = "struct<min: double, max: double, currency: string, period: string, state: string>"

RAW_JOB = (
    "native_id string, company string, title string, location string, apply_url string, "
    "description string, description_complete boolean, remote boolean, "
    f"salary {SALARY}, posted_at string, employment_type string, skills array<string>, raw string"
)

TABLES = {
    "jobs": (
        "id string, engine string, native_id string, company string, title string, location string, "
        "remote boolean, remote_restriction string, apply_url string, description string, "
        "description_complete boolean, salary_min double, salary_max double, salary_currency string, "
        "salary_period string, employment_type string, seniority string, posted_at timestamp, "
        "first_seen timestamp, last_seen timestamp, canonical_id string, review_status string, raw string, "
        "company_type string, liveness string, liveness_reason string, liveness_checked_at timestamp"
    ),
    "profile_skills": (
        "skill string, label string, category string, years double, level string, evidence string, "
        "source string, pinned boolean, updated_at timestamp"
    ),
    "job_skills": "job_id string, skill string, label string, requirement string, source string, ordinal bigint",
    "skill_aliases": "alias string, canonical string, source string",
    "matches": (
        "job_id string, matched_required bigint, total_required bigint, matched_preferred bigint, "
        "total_preferred bigint, coverage double, match_score double, matched array<string>, "
        "missing array<string>, bonus array<string>, matched_at timestamp, profile_fingerprint string"
    ),
    "scores": (
        "job_id string, ai_score int, reason string, concerns array<string>, model string, "
        "scored_at timestamp, profile_fingerprint string"
    ),
    "applications": (
        "job_id string, status string, prepared_at timestamp, submitted_at timestamp, "
        "last_status_at timestamp, note string"
    ),
    "boards": "company string, ats string, token string, verified_at timestamp, active boolean",
    "engine_runs": (
        "id bigint, engine string, started_at timestamp, finished_at timestamp, status string, "
        "fetched bigint, inserted bigint, error string"
    ),
    "answers": "question string, answer string, confirmed_at timestamp, times_used bigint",
    "signals": (
        "job_id string, salary_source string, salary_shape string, salary_vs_target string, wlb_score int, "
        "wlb_evidence array<struct<quote: string, polarity: string, note: string>>, red_flags array<string>, "
        "green_flags array<string>, remote_reality string, interview_stages int, repost_count bigint, "
        "computed_at timestamp"
    ),
    "company_notes": "company string, rating int, note string, avoid boolean",
    "ai_spend": (
        "id bigint, at timestamp, provider string, model string, stage string, input_tokens bigint, "
        "output_tokens bigint, estimated_usd double, cost_source string"
    ),
    "crawl_log": (
        "url string, host string, outcome string, status int, etag string, last_modified string, "
        "content_hash string, content_length bigint, fetched_at timestamp, error string"
    ),
    "robots_cache": "host string, body string, fetched_at timestamp, reachable boolean",
}

# Legal values of the enumerated columns.
DOMAINS = {
    ("jobs", "review_status"): ("new", "scored", "drafted", "approved", "rejected", "auto_skipped"),
    ("jobs", "company_type"): ("product", "service", "consultancy", "staffing", "agency", "nonprofit", "unknown"),
    ("jobs", "liveness"): ("open", "closed", "gone", "unreachable", "unknown"),
    ("profile_skills", "level"): ("exposure", "working", "strong", "expert"),
    ("job_skills", "requirement"): ("required", "preferred"),
    ("job_skills", "source"): ("engine", "scan", "ai"),
    ("applications", "status"): (
        "viewed", "prepared", "submitted", "responded", "interviewing", "offer", "rejected", "closed", "ghosted",
    ),
    ("engine_runs", "status"): ("running", "ok", "empty", "error", "rate_limited", "skipped"),
    ("signals", "salary_source"): ("disclosed", "parsed", "estimated", "absent"),
    ("signals", "salary_shape"): ("range", "single", "absent"),
    ("signals", "salary_vs_target"): ("above", "within", "below", "unknown"),
    ("signals", "remote_reality"): ("remote", "restricted", "hybrid-or-onsite", "unstated"),
    ("ai_spend", "cost_source"): ("reported", "derived", "free"),
}
# Bounded integer columns.
BOUNDS = {("scores", "ai_score"): (1, 5), ("signals", "wlb_score"): (1, 5), ("company_notes", "rating"): (1, 5)}

APPLICATION_STATUSES = DOMAINS[("applications", "status")]


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the table's columns, adding typed NULLs for absent ones."""
    fields = schema_of(table).fields
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking an enumeration or bound, with the offending column named (checks pass NULLs)."""
    broken = [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(c))
        for (t, c), allowed in DOMAINS.items() if t == table and c in df.columns
    ] + [
        F.when(F.col(c).isNotNull() & ~F.col(c).between(*rng), F.lit(c))
        for (t, c), rng in BOUNDS.items() if t == table and c in df.columns
    ]
    if not broken:
        return df.limit(0).withColumn("violated", F.array().cast("array<string>"))
    return df.withColumn("violated", F.array_compact(F.array(*broken))).filter(F.size("violated") > 0)
