"""A person's skill profile: building it from text, keeping corrections, finding gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire import vocab
from tallyhire.functions.text import strip
from tallyhire.operators.extract import spelling_patterns, with_skills
from tallyhire.operators.skew import bounded_broadcast
from tallyhire.operators.upsert import COALESCE_OLD_NEW, KEEP_OLD, TAKE_NEW, upsert


def level_from_mentions(mentions: Column) -> Column:
    """Repeated description is stronger evidence; never claims expertise."""
    return F.when(mentions >= 4, "strong").when(mentions >= 2, "working").otherwise("exposure")


def profile_from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skill, label, category, mentions, level, evidence) for each text.

    Mentions are counted over every spelling, overlaps included.  Evidence is the
    longest line carrying the winning spelling, so nothing is claimed without proof.
    """
    found = with_skills(df.select(key, F.col(text).alias("_text")), F.col("_text"), flat=True, out="_skills")
    lines = F.split(F.col("_text"), "\n")

    def measure(s: Column) -> Column:
        mentions = F.aggregate(
            spelling_patterns(s["slug"]), F.lit(0), lambda n, p: n + F.regexp_count(F.col("_text"), p)
        )
        shown = F.concat(
            F.lit(r"(?i)(?<![a-z0-9])\Q"), s["evidence"], F.lit(r"\E(?![a-z0-9])")
        )
        with_term = F.filter(lines, lambda x: F.rlike(x, shown))
        longest = F.array_max(F.transform(with_term, lambda x: F.length(x)))
        line = F.get(F.filter(with_term, lambda x: F.length(x) == longest), F.lit(0))
        trimmed = strip(line)
        return F.struct(
            s["slug"].alias("skill"), s["label"].alias("label"), s["category"].alias("category"),
            mentions.alias("mentions"), F.when(trimmed != "", trimmed).alias("evidence"),
        )

    measured = found.select(key, F.inline_outer(F.transform("_skills", measure))).filter(F.col("skill").isNotNull())
    return measured.withColumn("level", level_from_mentions(F.col("mentions")))


def upsert_profile(current: DataFrame, built: DataFrame, now: Column, source: str = "resume") -> DataFrame:
    """Re-extraction overwrites everything except pinned rows; stated years stay."""
    incoming = built.select(
        "skill", "label", "category", F.lit(None).cast("double").alias("years"), "level", "evidence",
        F.lit(source).alias("source"), F.lit(False).alias("pinned"), now.alias("updated_at"),
    ).join(bounded_broadcast(current.filter("pinned").select("skill")), "skill", "left_anti")
    rules = {c: TAKE_NEW for c in ("label", "category", "level", "evidence", "source", "updated_at")}
    return upsert(current, incoming, ["skill"], {**rules, "years": KEEP_OLD, "pinned": KEEP_OLD}, "updated_at")


def set_skills(current: DataFrame, manual: DataFrame, now: Column) -> DataFrame:
    """Add or correct skills by hand (skill, level[, years, label]); always pinned."""
    from tallyhire.operators.extract import label_skills

    named = label_skills(manual.withColumnRenamed("label", "_given") if "label" in manual.columns
                         else manual.withColumn("_given", F.lit(None).cast("string")), "skill")
    incoming = named.select(
        "skill", F.coalesce("_given", "label").alias("label"), "category",
        (F.col("years") if "years" in manual.columns else F.lit(None)).cast("double").alias("years"), "level",
        F.lit(None).cast("string").alias("evidence"), F.lit("manual").alias("source"),
        F.lit(True).alias("pinned"), now.alias("updated_at"),
    )
    rules = {c: TAKE_NEW for c in ("label", "category", "years", "level", "source", "pinned", "updated_at")}
    return upsert(current, incoming, ["skill"], {**rules, "evidence": COALESCE_OLD_NEW}, "updated_at")


def remove_skill(current: DataFrame, slug: str) -> DataFrame:
    return current.filter(F.col("skill") != slug)


def skill_gaps(job_skills: DataFrame, profile: DataFrame, limit: int = 10) -> DataFrame:
    """Skills most often asked for that the profile lacks; ties by slug.

    ``job_skills`` is unique per (job_id, skill), so counting rows counts jobs and the
    whole aggregate combines before its shuffle.
    """
    return (
        job_skills.join(bounded_broadcast(profile.select("skill")), "skill", "left_anti")
        .groupBy(F.col("skill").alias("slug")).agg(F.min("label").alias("label"), F.count("*").alias("jobs"))
        .orderBy(F.desc("jobs"), "slug").limit(limit)
    )


def load_profile(profile: DataFrame) -> DataFrame:
    return profile.orderBy("category", "skill")


def profile_summary(profile: DataFrame) -> DataFrame:
    """One line per category in profile order: ``label (level, Ny)`` joined by commas."""
    years = F.when(
        F.coalesce("years", F.lit(0.0)) != 0,
        F.concat(F.lit(", "), F.regexp_replace(F.col("years").cast("string"), r"\.0$", ""), F.lit("y")),
    ).otherwise("")
    entry = F.concat("label", F.lit(" ("), "level", years, F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("skill", entry.alias("entry"))))
    return (
        profile.groupBy("category")
        .agg(F.array_join(F.transform(rows, lambda r: r["entry"]), ", ").alias("skills"), F.count("*").alias("n"))
        .orderBy("category")
    )


def profile_by_category(profile: DataFrame) -> DataFrame:
    """Skills grouped in display order of categories."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(vocab.CATEGORIES) for x in (c, i)])
    return profile.withColumn("category_order", F.element_at(order, F.col("category"))).orderBy(
        "category_order", "skill"
    )
