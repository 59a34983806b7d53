"""Set arithmetic between postings and one profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire import vocab
from tallyhire.functions.pay import clamp01
from tallyhire.functions.text import nonblank
from tallyhire.operators.extract import extract_skills
from tallyhire.operators.skew import bounded_broadcast

# Smoothing that keeps thin postings from outscoring thorough ones.
SMOOTHING = 4


@dataclass(frozen=True)
class MatchWeights:
    required: float = 0.6
    preferred: float = 0.2
    seniority: float = 0.15
    domain: float = 0.05
    threshold: float = 0.35

    def __post_init__(self) -> None:
        if abs(self.required + self.preferred + self.seniority + self.domain - 1) >= 1e-6:
            raise ValueError("match weights must sum to 1.0 (threshold is separate)")


DOMAIN_SLUGS = tuple(s.slug for s in vocab.skills() if s.category == "domain")


def seniority_fit(yours: Column, theirs: Column) -> Column:
    """1 at or up to three years over, falling away on either side; 0.5 when either is unknown."""
    over = yours - theirs
    return (
        F.when(yours.isNull() | theirs.isNull(), 0.5)
        .when(over > 3, clamp01(1 - (over - 3) / 10))
        .when(over >= 0, 1.0)
        .otherwise(clamp01(1 + over / 5))
    )


def score_matches(job_skills: DataFrame, profile: DataFrame, weights: MatchWeights = MatchWeights(),
                  years: DataFrame | None = None, my_years: float | None = None) -> DataFrame:
    """One row per job: counts, coverage, score and its components.

    ``job_skills`` is unique per (job_id, skill).  All measures are counts, so they
    combine on the map side and a job with very many rows costs nothing extra;
    level weights are summed as whole hundredths, which makes the score independent
    of row order.  ``years`` (job_id, years) switches the seniority component on.
    """
    points = F.create_map(*[F.lit(x) for kv in vocab.LEVEL_POINTS.items() for x in kv])
    held = profile.select(
        "skill", F.element_at(points, F.col("level")).alias("_points"), (F.col("category") == "domain").alias("_dom")
    )
    rows = job_skills.select("job_id", "skill", (F.col("requirement") == "preferred").alias("_pref"))
    rows = rows.join(bounded_broadcast(held), "skill", "left")
    have = F.col("_points").isNotNull()
    pref = F.col("_pref")
    in_domain = F.col("skill").isin(*DOMAIN_SLUGS)
    counted = rows.groupBy("job_id").agg(
        F.count_if(~pref & have).alias("matched_required"),
        F.count_if(~pref).alias("total_required"),
        F.count_if(pref & have).alias("matched_preferred"),
        F.count_if(pref).alias("total_preferred"),
        F.sum(F.when(~pref, F.coalesce("_points", F.lit(0))).otherwise(0)).alias("_earned"),
        F.count_if(in_domain).alias("_domain"),
        F.count_if(in_domain & F.coalesce("_dom", F.lit(False))).alias("_domain_hits"),
    )
    if years is not None:
        counted = counted.join(years.select("job_id", F.col("years").alias("_years")), "job_id", "left")
        senior = seniority_fit(F.lit(my_years).cast("double"), F.col("_years"))
    else:
        senior = F.lit(0.5)
    any_domain = profile.agg(F.count_if(F.col("category") == "domain") > 0).scalar()
    req, pre = F.col("total_required"), F.col("total_preferred")
    scored = counted.select(
        "*",
        F.when(req > 0, clamp01(F.col("_earned") / 100 / (req + SMOOTHING))).otherwise(0.0).alias("weighted_required"),
        F.when(pre > 0, clamp01(F.col("matched_preferred") / (pre + SMOOTHING))).otherwise(0.5).alias("preferred"),
        senior.alias("seniority"),
        F.when(any_domain & (F.col("_domain") > 0), F.col("_domain_hits") / F.col("_domain")).otherwise(0.5)
        .alias("domain"),
        F.when(req > 0, F.col("matched_required") / req).otherwise(0.0).alias("coverage"),
    )
    total = (
        weights.required * F.col("weighted_required") + weights.preferred * F.col("preferred")
        + weights.seniority * F.col("seniority") + weights.domain * F.col("domain")
    )
    return scored.withColumn("match_score", clamp01(total)).drop("_earned", "_domain", "_domain_hits", "_years")


def match_skills(job_skills: DataFrame, profile: DataFrame) -> DataFrame:
    """Long form of the overlap: (job_id, skill, kind matched|missing, preferred, ordinal)."""
    held = bounded_broadcast(profile.select("skill", F.lit(True).alias("_held")))
    return job_skills.join(held, "skill", "left").select(
        "job_id", "skill",
        F.when(F.col("_held"), "matched").otherwise("missing").alias("kind"),
        (F.col("requirement") == "preferred").alias("preferred"), "ordinal",
    )


def strengths(profile: DataFrame) -> DataFrame:
    """One row: the skills held at strong or expert, in profile order."""
    row = F.struct("category", "skill")
    held = F.col("level").isin("strong", "expert")
    return profile.agg(F.transform(F.array_sort(F.collect_list(F.when(held, row))), lambda r: r["skill"]).alias("pool"))


def attach_skill_lists(ranked: DataFrame, job_skills: DataFrame, profile: DataFrame) -> DataFrame:
    """Add matched / missing / bonus arrays to a page of ranked jobs.

    Required before preferred, input order inside each.  Arrays are built for the
    given jobs only, so a page of results never gathers the lists of every posting.
    """
    page_skills = job_skills.join(ranked.select("job_id"), "job_id", "left_semi")
    row = F.struct("preferred", "ordinal", "skill")
    lists = match_skills(page_skills, profile).groupBy("job_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, row))), lambda r: r["skill"]).alias(k)
        for k in ("matched", "missing")
    ])
    empty = F.array().cast("array<string>")
    pool = strengths(profile).scalar()
    return ranked.join(lists, "job_id", "left").select(
        *ranked.columns,
        F.coalesce("matched", empty).alias("matched"), F.coalesce("missing", empty).alias("missing"),
        F.array_except(pool, F.coalesce("matched", empty)).alias("bonus"),
    )


def explain_match(matched_required: Column, total_required: Column, matched_preferred: Column,
                  total_preferred: Column, coverage: Column) -> Column:
    required = F.concat(
        matched_required.cast("string"), F.lit("/"), total_required.cast("string"), F.lit(" required ("),
        F.floor(coverage * 100 + 0.5).cast("string"), F.lit("%)"),
    )
    preferred = F.when(total_preferred > 0, F.concat(
        matched_preferred.cast("string"), F.lit("/"), total_preferred.cast("string"), F.lit(" preferred")))
    return F.when(total_required == 0, "no requirements listed").otherwise(F.concat_ws(" · ", required, preferred))


def profile_fingerprint(profile: DataFrame) -> DataFrame:
    """One row: a short hash of the sorted slug:level pairs, ``empty`` for no skills."""
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat("skill", F.lit(":"), "level"))), "|")
    return profile.agg(
        F.when(F.count("*") == 0, "empty").otherwise(F.substring(F.sha2(pairs, 256), 1, 16)).alias("fingerprint")
    )


def ranking_freshness(matches: DataFrame, profile: DataFrame) -> DataFrame:
    """How many rankings were computed against the profile as it stands."""
    stamp = F.col("profile_fingerprint")
    now = profile_fingerprint(profile).scalar()
    return matches.select((stamp == now).alias("_same")).agg(
        F.count_if("_same").alias("current"), F.count_if(~F.col("_same")).alias("stale"),
        F.count_if(F.col("_same").isNull()).alias("unknown"),
    )


@dataclass(frozen=True)
class Ranking:
    matches: DataFrame
    scanned_skills: DataFrame
    summary: DataFrame


def rank_all(jobs: DataFrame, job_skills: DataFrame, profile: DataFrame, now: Column,
             weights: MatchWeights = MatchWeights(), only_new_to: DataFrame | None = None) -> Ranking:
    """Score every posting that is not a duplicate [and not yet ranked].

    A description is scanned only for postings that have no recorded skills; postings
    that still have none are skipped rather than scored as perfect.
    """
    pending = jobs.filter(F.col("canonical_id").isNull()).select(
        F.col("id").alias("job_id"), "title", F.coalesce("description", F.lit("")).alias("description")
    )
    if only_new_to is not None:
        pending = pending.join(only_new_to.select("job_id").distinct(), "job_id", "left_anti")
    recorded = job_skills.select("job_id").distinct()
    bare = pending.join(recorded, "job_id", "left_anti").filter(nonblank("description").isNotNull())
    scanned = extract_skills(bare, "job_id", F.concat_ws("\n", "title", "description")).select(
        "job_id", F.col("slug").alias("skill"), "label", "requirement", F.lit("scan").alias("source"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )
    known = job_skills.select("job_id", "skill", "label", "requirement", "source", "ordinal").join(
        pending.select("job_id"), "job_id", "left_semi"
    )
    scored = score_matches(known.unionByName(scanned), profile, weights)
    matches = scored.withColumn("matched_at", now).withColumn(
        "profile_fingerprint", profile_fingerprint(profile).scalar()
    )
    counts = scored.agg(
        F.count("*").alias("ranked"), F.count("job_id").alias("_named"),
        F.count_if(F.col("match_score") >= weights.threshold).alias("above_threshold"),
    )
    considered = pending.agg(F.count("*").alias("considered"))
    # what is ranked without recorded skills was scanned; counting it in the scan would read all texts once more
    held = recorded.join(pending.select("job_id"), "job_id", "left_semi").agg(F.count("*").alias("held"))
    summary = counts.select(
        considered.scalar().alias("considered"), (F.col("_named") - held.scalar()).alias("extracted"), "ranked",
        "above_threshold",
    ).withColumn("skipped", F.col("considered") - F.col("ranked"))
    return Ranking(matches, scanned, summary)
