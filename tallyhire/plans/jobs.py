"""Browsing postings: filters, orders, counts, facets, detail, dashboard."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhire.functions.dates import posted_within
from tallyhire.functions.pay import format_salary, from_structured
from tallyhire.functions.place import location_fit
from tallyhire.functions.text import contains_typed
from tallyhire.operators.match import attach_skill_lists, profile_fingerprint, ranking_freshness
from tallyhire.operators.skew import latest_by

Tables = Mapping[str, DataFrame]
SORTS = ("relevance", "score", "coverage", "posted", "company")
DEFAULT_PAGE = 100


@dataclass(frozen=True)
class JobFilters:
    q: str | None = None
    location: str | None = None
    company: str | None = None
    min_ai_score: float | None = None
    min_coverage: float | None = None
    remote_only: bool = False
    status: str | None = None
    company_type: str | None = None
    liveness: str | None = None
    posted_within_days: float | None = None
    sort: str | None = None
    prefer_locations: tuple[str, ...] = ()
    limit: int = DEFAULT_PAGE
    offset: int = 0

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> JobFilters:
        """Filters from text parameters; blank, non-numeric and unknown values are dropped."""
        def number(key: str) -> float | None:
            try:
                value = float(params.get(key, "").strip())
            except ValueError:
                return None
            return value if value == value and abs(value) != float("inf") else None

        def text(key: str) -> str | None:
            return params.get(key) or None

        limit, offset = number("limit"), number("offset")
        return cls(
            q=text("q"), location=text("location"), company=text("company"), min_ai_score=number("minAiScore"),
            min_coverage=number("minCoverage"), remote_only=params.get("remoteOnly") in ("1", "true"),
            status=text("status"), company_type=text("companyType"), liveness=text("liveness"),
            posted_within_days=number("postedWithinDays"),
            sort=params.get("sort") if params.get("sort") in SORTS else None,
            limit=int(limit) if limit is not None else DEFAULT_PAGE, offset=int(offset) if offset is not None else 0,
        )

    def page(self) -> tuple[int, int]:
        return max(self.limit, 1), max(self.offset, 0)


def _given(text: str | None) -> str | None:
    return text.strip() if text and text.strip() else None


def predicates(f: JobFilters, now: Column) -> list[Column]:
    """Row conditions over the joined summary; every condition drops NULL."""
    out: list[Column] = []
    if q := _given(f.q):
        out.append(contains_typed("company", q) | contains_typed("title", q) | contains_typed("location", q))
    if place := _given(f.location):
        out.append(contains_typed("location", place))
    if company := _given(f.company):
        out.append(F.col("company") == company)
    if f.min_ai_score is not None:
        out.append(F.col("ai_score") >= f.min_ai_score)
    if f.min_coverage is not None:
        out.append(F.coalesce("coverage", F.lit(0.0)) >= f.min_coverage)
    if f.remote_only:
        out.append(F.col("remote"))
    if f.posted_within_days is not None and f.posted_within_days > 0:
        out.append(posted_within("posted_at", now, f.posted_within_days))
    if live := _given(f.liveness):
        out.append(
            F.col("liveness").isNull() if live == "unchecked"
            else ~F.coalesce("liveness", F.lit("unknown")).isin("closed", "gone") if live == "open-or-unknown"
            else F.col("liveness") == live
        )
    if kind := _given(f.company_type):
        out.append(F.col("company_type").isNull() if kind == "unclassified" else F.col("company_type") == kind)
    if status := _given(f.status):
        stored = F.coalesce("review_status", F.lit("new"))
        out.append(~stored.isin("approved", "rejected") if status == "undecided" else stored == status)
    return out


def joined(t: Tables) -> DataFrame:
    """Non-duplicate postings with their (sparse) match, score and signals."""
    jobs = t["jobs"].filter(F.col("canonical_id").isNull())
    matches = t["matches"].select("job_id", "matched_required", "total_required", "coverage", "match_score")
    scores = t["scores"].select("job_id", "ai_score")
    signals = t["signals"].select("job_id", "wlb_score", "salary_vs_target")
    out = jobs.withColumn("job_id", F.col("id"))
    for side in (matches, scores, signals):
        out = out.join(side, "job_id", "left")
    return out


def order_by(f: JobFilters) -> list[Column]:
    score = [F.desc_nulls_last("ai_score"), F.desc_nulls_last("match_score")]
    if f.sort == "relevance":
        fit = location_fit(F.col("location"), F.col("remote"), list(f.prefer_locations))
        keys = ([fit.desc()] if fit is not None else []) + score
    else:
        keys = {
            "coverage": [F.desc_nulls_last("coverage"), F.desc_nulls_last("match_score")],
            "posted": [F.desc_nulls_last("posted_at")],
            "company": [F.lower("company").asc(), F.col("title").asc()],
        }.get(f.sort or "score", score)
    return [*keys, F.col("id").asc()]


SUMMARY = (
    "id", "company", "title", "location", "engine", "remote", "apply_url", "matched_required", "total_required",
    "coverage", "match_score", "ai_score", "wlb_score", "salary_vs_target", "review_status", "posted_at",
    "company_type", "liveness", "liveness_reason",
)


def summarised(df: DataFrame, *extra: str) -> DataFrame:
    """Summary columns with their defaults; scores and statuses stay NULL when unknown."""
    defaults = {"location": "", "apply_url": "", "matched_required": 0, "total_required": 0,
                "coverage": 0.0, "match_score": 0.0}
    return df.select(*[
        (F.coalesce(c, F.lit(defaults[c])) if c in defaults else F.col(c)).alias(c) for c in (*SUMMARY, *extra)
    ])


def filtered(t: Tables, f: JobFilters, now: Column) -> DataFrame:
    df = joined(t)
    for p in predicates(f, now):
        df = df.filter(p)
    return df


def list_jobs(t: Tables, f: JobFilters, now: Column) -> DataFrame:
    """One page of summaries: filter, order, offset, limit."""
    limit, offset = f.page()
    return summarised(filtered(t, f, now).orderBy(*order_by(f)).offset(offset).limit(limit))


def count_jobs(t: Tables, f: JobFilters, now: Column) -> DataFrame:
    return filtered(t, f, now).agg(F.count("*").alias("n"))


def get_job(t: Tables, job_id: str) -> DataFrame:
    """Summary, bodies and lists of one posting (no row when unknown); the id reaches every scan."""
    one = {k: (df.filter(F.col("id") == job_id) if k == "jobs" else
               df.filter(F.col("job_id") == job_id) if "job_id" in df.columns else df) for k, df in t.items()}
    base = summarised(joined(one), "description", "description_complete", "salary_min", "salary_max",
                      "salary_currency", "salary_period", "remote_restriction").withColumn("job_id", F.col("id"))
    base = attach_skill_lists(base, one["job_skills"], one["profile_skills"])
    empty = F.array().cast("array<string>")
    score = one["scores"].select("job_id", "reason", "concerns")
    signal = one["signals"].select("job_id", "red_flags", "green_flags", "interview_stages", "repost_count")
    out = base.join(score, "job_id", "left").join(signal, "job_id", "left").drop("job_id")
    return out.withColumns({
        "description": F.coalesce("description", F.lit("")),
        "description_complete": F.coalesce("description_complete", F.lit(False)),
        **{c: F.coalesce(c, empty) for c in ("concerns", "red_flags", "green_flags")},
    })


def facets(t: Tables, size: int | None = None) -> DataFrame:
    """Companies and locations by postings: (facet, value, n), one scan for both; the leading ``size`` of each if given."""
    base = t["jobs"].filter(F.col("canonical_id").isNull())
    pairs = base.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("company", "location")
    ]))).filter(F.col("value") != "")
    counted = pairs.groupBy("facet", "value").agg(F.count("*").alias("n"))
    if size is None:
        return counted
    # Only the leading rows of each task reach the per-facet ranking.
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")


def job_counters(t: Tables) -> DataFrame:
    """Every counter that comes from jobs alone, in one pass."""
    listed = F.col("canonical_id").isNull()
    undecided = ~F.coalesce("review_status", F.lit("new")).isin("approved", "rejected")
    live = {s: F.col("liveness") == s for s in ("open", "closed", "gone", "unreachable")}
    return t["jobs"].agg(
        F.count_if(listed).alias("jobs"),
        F.count_distinct("company").alias("companies"),
        *[F.count_if(listed & (F.col("review_status") == s)).alias(s) for s in ("approved", "rejected")],
        F.count_if(listed & undecided).alias("pending"),
        *[F.count_if(listed & c).alias(f"live_{s}") for s, c in live.items()],
        F.count_if(listed & F.col("liveness").isNull()).alias("live_unchecked"),
    )


def dashboard(t: Tables) -> DataFrame:
    """One row of counters; each other table contributes one scalar."""
    def rows(name: str) -> Column:
        return t[name].agg(F.count("*")).scalar()

    fresh = ranking_freshness(t["matches"], t["profile_skills"])
    base = job_counters(t).select(
        "*", rows("scores").alias("scored"), rows("signals").alias("signalled"),
        t["boards"].agg(F.count_if("active")).scalar().alias("boards"),
        t["ai_spend"].agg(F.coalesce(F.sum("estimated_usd"), F.lit(0.0))).scalar().alias("spend_total"),
        rows("profile_skills").alias("profile_skills"),
        profile_fingerprint(t["profile_skills"]).scalar().alias("profile_fingerprint"),
        fresh.select(F.struct("current", "stale", "unknown")).scalar().alias("_fresh"),
    )
    ranked = F.col("_fresh.current") + F.col("_fresh.stale") + F.col("_fresh.unknown")
    return base.select(
        "*", ranked.alias("ranked"),
        *[F.col(f"_fresh.{c}").alias(f"rankings_{c}") for c in ("current", "stale", "unknown")],
        F.coalesce(F.try_divide("scored", ranked), F.lit(0.0)).alias("score_coverage"),
    ).drop("_fresh")


def dashboard_engines(t: Tables) -> DataFrame:
    """Postings per engine with the status and time of its latest run."""
    per_engine = t["jobs"].groupBy("engine").agg(F.count("*").alias("jobs"))
    last = latest_by(t["engine_runs"].select("engine", "started_at", "id", "status"), ["engine"], ["started_at", "id"])
    return per_engine.join(last, "engine", "left").select(
        "engine", "jobs", F.coalesce("status", F.lit("unknown")).alias("status"), F.col("started_at").alias("last_run")
    ).orderBy(F.desc("jobs"), "engine")


def top_matches(t: Tables, limit: int = 20) -> DataFrame:
    """Best matches with their skill lists; duplicates are not filtered here."""
    ranked = (
        t["matches"].join(t["jobs"].select(F.col("id").alias("job_id"), "company", "title", "location", "engine"), "job_id")
        .select("job_id", "company", "title", "location", "engine", "matched_required", "total_required", "coverage",
                "match_score")
        .orderBy(F.desc("match_score"), F.desc("coverage"), "job_id").limit(limit)
    )
    return attach_skill_lists(ranked, t["job_skills"], t["profile_skills"])


def review_queue(t: Tables, threshold: float, everything: bool = False) -> DataFrame:
    """Undecided postings worth a look, best first, with a pay line."""
    pay = from_structured(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"))
    jobs = t["jobs"].filter(
        F.col("canonical_id").isNull() & F.col("review_status").isin("new", "scored", "drafted")
    ).withColumn("job_id", F.col("id"))
    floor = 0.0 if everything else threshold
    return (
        t["matches"].filter(F.col("match_score") >= floor).join(jobs, "job_id")
        .join(t["scores"].select("job_id", "ai_score", "reason"), "job_id", "left")
        .select(
            "id", "company", "title", "location", "engine", "remote", "remote_restriction", "matched_required",
            "total_required", "coverage", "match_score", "ai_score", "reason",
            (F.col("review_status") == "drafted").alias("has_draft"), format_salary(pay).alias("salary"),
        )
        .orderBy(F.desc("match_score"), "id")
    )


REVIEW_SORTS = {
    "match": ("match_score", "coverage"), "coverage": ("coverage", "match_score"),
    "score": ("ai_score", "match_score"), "company": ("company", "match_score"),
}


def resort_review(queue: DataFrame, sort: str = "match", search: str = "") -> DataFrame:
    """Search inside a review queue and re-order it; unscored postings sort last."""
    if search:
        q = search.lower()
        hit = F.lit(False)
        for c in ("company", "title", "location"):
            hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(q)
        queue = queue.filter(hit)
    first, second = REVIEW_SORTS.get(sort, REVIEW_SORTS["match"])
    lead = F.lower("company").asc() if first == "company" else F.coalesce(F.col(first), F.lit(-1)).desc()
    return queue.orderBy(lead, F.desc(second), "id")


def draft_candidates(t: Tables, threshold: float, limit: int | None = None) -> DataFrame:
    """Postings to draft for: above threshold, not yet decided, with a body; unscored counts as 3."""
    jobs = t["jobs"].filter(
        F.col("review_status").isin("new", "scored") & (F.col("description") != "")
    ).select(F.col("id").alias("job_id"), "company", "title")
    ranked = (
        t["matches"].filter(F.col("match_score") >= threshold).select("job_id", "match_score").join(jobs, "job_id")
        .join(t["scores"].select("job_id", "ai_score"), "job_id", "left")
        .withColumn("rank_score", F.coalesce("ai_score", F.lit(3)))
    )
    return ranked if limit is None else ranked.orderBy(F.desc("rank_score"), F.desc("match_score"), "job_id").limit(limit)


def liveness_candidates(t: Tables, now: Column, recheck_after_days: int | None = None,
                        older_than_days: int | None = None, include_closed: bool = False,
                        location: str | None = None, limit: int | None = None) -> DataFrame:
    """Postings worth asking about; undated and never-checked postings are included.

    A run's ``limit`` takes the best; without one all come, unsorted, so nothing is gathered.
    """
    cond = (F.coalesce("apply_url", F.lit("")) != "") & F.col("canonical_id").isNull()
    if not include_closed:
        cond = cond & ~F.coalesce("liveness", F.lit("unknown")).isin("closed", "gone")
    for column, days in (("liveness_checked_at", recheck_after_days), ("posted_at", older_than_days)):
        if days is not None:
            before = F.col(column) < now - F.make_interval(days=F.lit(days))
            cond = cond & F.coalesce(before, F.lit(True))
    if place := _given(location):
        cond = cond & contains_typed("location", place)
    jobs = t["jobs"].filter(cond).select(F.col("id").alias("job_id"), "company", "apply_url")
    known = jobs.join(t["matches"].select("job_id", "match_score"), "job_id", "left").join(
        t["scores"].select("job_id", "ai_score"), "job_id", "left")
    best = (F.desc_nulls_last("ai_score"), F.desc_nulls_last("match_score"), "job_id")
    return known if limit is None else known.orderBy(*best).limit(max(1, limit))


def approved_for_outbox(t: Tables) -> DataFrame:
    jobs = t["jobs"].filter(F.col("review_status") == "approved").select(
        F.col("id").alias("job_id"), "company", "title", "apply_url"
    )
    return jobs.join(t["applications"].select("job_id", "note"), "job_id", "left").orderBy("company", "job_id")


def score_report(t: Tables, limit: int = 8) -> DataFrame:
    jobs = t["jobs"].select(F.col("id").alias("job_id"), "company", "title")
    return (
        t["scores"].join(jobs, "job_id").orderBy(F.desc("ai_score"), F.desc("scored_at"), "job_id").limit(limit)
        .select("job_id", "company", "title", "ai_score", "reason")
    )


def signal_report(t: Tables, limit: int = 10) -> DataFrame:
    """Best work-life readings with display notes."""
    jobs = t["jobs"].select(F.col("id").alias("job_id"), "company", "title")
    flags = F.size(F.coalesce("red_flags", F.array().cast("array<string>")))
    notes = F.concat_ws(
        " · ",
        F.when(F.col("salary_vs_target") != "unknown", F.concat(F.lit("pay "), "salary_vs_target")),
        F.when(F.col("remote_reality") == "restricted", "remote restricted"),
        F.when(flags > 0, F.concat(flags.cast("string"), F.when(flags == 1, " red flag").otherwise(" red flags"))),
        F.when(F.col("repost_count") > 2, F.concat(F.lit("reposted "), F.col("repost_count").cast("string"), F.lit("x"))),
    )
    return (
        t["signals"].join(jobs, "job_id").orderBy(F.desc_nulls_last("wlb_score"), F.desc("computed_at"), "job_id")
        .limit(limit).select("job_id", "company", "title", "wlb_score", notes.alias("notes"))
    )


def resolve_reference(applications: DataFrame, jobs: DataFrame, reference: str) -> DataFrame:
    """Applications a typed reference may mean, with ``resolution``: exact, unique or ambiguous.

    An exact id wins alone; otherwise id prefix, company part or title part.  No row
    means unknown.
    """
    needle = reference.strip().lower()
    apps = applications.select("job_id", "status", "last_status_at").join(
        jobs.select(F.col("id").alias("job_id"), "company", "title"), "job_id"
    )
    ident = F.lower("job_id")
    hits = apps.filter(F.lit(needle != "") & (
        ident.startswith(needle) | F.lower("company").contains(needle) | F.lower("title").contains(needle)
    )).withColumn("exact", ident == needle)
    found = hits.agg(F.struct(F.max("exact").alias("any_exact"), F.count("*").alias("n"))).scalar()
    kept = hits.filter(F.col("exact") | ~F.coalesce(found["any_exact"], F.lit(False)))
    return kept.withColumn(
        "resolution", F.when(F.col("exact"), "exact").when(found["n"] == 1, "unique").otherwise("ambiguous")
    ).drop("exact")


def classify_unclassified(jobs: DataFrame) -> DataFrame:
    """Company type for postings that have none yet (duplicates excluded)."""
    from tallyhire.functions.company import classify_company

    pending = jobs.filter(F.col("company_type").isNull() & F.col("canonical_id").isNull())
    return pending.withColumn("_c", classify_company(F.col("company"), F.col("description"))).select(
        "id", F.col("_c.type").alias("company_type"), F.col("_c.reason").alias("reason"),
        F.col("_c.uncertain").alias("uncertain"),
    )
