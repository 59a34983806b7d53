"""Insert-or-update as a join, driven by one conflict rule per column.

The batch is first folded to one row per key.  Each rule's fold is an aggregate that
equals applying the batch rows one after another, so it combines on the map side.
A batch whose size is checked to be small is broadcast and the target is never
shuffled; a larger one meets the target in a full outer join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SMALL_BATCH_ROWS = 100_000
Side = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    fold: Callable[[Column, Column], Column]
    merge: Callable[[Side, Side, str], Column]


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _first(c: Column, o: Column) -> Column:
    return F.min_by(c, o)


def _last(c: Column, o: Column) -> Column:
    return F.max_by(c, o)


KEEP_OLD = Rule(_first, lambda t, s, c: t(c))
TAKE_NEW = Rule(_last, lambda t, s, c: s(c))
COALESCE_OLD_NEW = Rule(
    lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)), lambda t, s, c: F.coalesce(t(c), s(c))
)
COALESCE_NEW_OLD = Rule(
    lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), lambda t, s, c: F.coalesce(s(c), t(c))
)
NEW_IF_NONBLANK = Rule(
    lambda c, o: F.coalesce(F.max_by(c, F.when(_filled(c), o)), _first(c, o)),
    lambda t, s, c: F.when(_filled(s(c)), s(c)).otherwise(t(c)),
)
NEW_IF_OLD_BLANK = Rule(
    lambda c, o: F.coalesce(F.min_by(c, F.when(_filled(c), o)), _last(c, o)),
    lambda t, s, c: F.when(_filled(t(c)), t(c)).otherwise(s(c)),
)
GREATEST = Rule(lambda c, o: F.max(c), lambda t, s, c: F.greatest(t(c), s(c)))


def custom(merge: Callable[[Side, Side, str], Column], fold=_last) -> Rule:
    return Rule(fold, merge)


def fold_batch(source: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], order: str) -> DataFrame:
    columns = [c for c in source.columns if c not in keys and c != order or c in rules]
    folds = [rules.get(c, KEEP_OLD).fold(F.col(c), F.col(order)).alias(c) for c in columns]
    return source.groupBy(*keys).agg(*folds, F.count("*").alias("_rows"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], order: str,
           small_batch_rows: int = SMALL_BATCH_ROWS) -> DataFrame:
    """Target after applying ``source``; columns without a rule keep their old value."""
    keys = list(keys)
    folded = fold_batch(source, keys, rules, order).drop("_rows")
    values = [c for c in target.columns if c not in keys]
    types = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    s_cols = [
        (F.col(v) if v in folded.columns else F.lit(None)).cast(types[v]).alias(f"_s_{v}") for v in values
    ] + [F.col(v).alias(f"_s_{v}") for v in folded.columns if v not in types]
    new = folded.select(*keys, *s_cols, F.lit(True).alias("_in_s"))
    old = target.select(*keys, *[F.col(v).alias(f"_t_{v}") for v in values], F.lit(True).alias("_in_t"))

    def t(name: str) -> Column:
        return F.col(f"_t_{name}")

    def s(name: str) -> Column:
        return F.col(f"_s_{name}")

    both = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull()
    merged = [
        F.when(both, rules.get(v, KEEP_OLD).merge(t, s, v)).when(F.col("_in_t").isNotNull(), t(v)).otherwise(s(v))
        .cast(types[v]).alias(v)
        for v in values
    ]
    small = new.limit(small_batch_rows + 1).count() <= small_batch_rows
    if not small:
        return old.join(new, keys, "full_outer").select(*keys, *merged).select(*target.columns)
    updated = old.join(F.broadcast(new), keys, "left").select(*keys, *merged)
    held = target.select(*keys).join(F.broadcast(new.select(*keys)), keys, "left_semi")
    fresh = new.join(F.broadcast(held), keys, "left_anti").select(*keys, *[s(v).alias(v) for v in values])
    return updated.unionByName(fresh).select(*target.columns)


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(inserted, updated): a key repeated inside the batch counts as updated after its first row."""
    per_key = source.groupBy(*keys).agg(F.count("*").alias("_rows"))
    fresh = per_key.join(target.select(*keys), list(keys), "left_anti")
    return per_key.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_all")).select(
        fresh.agg(F.count("*")).scalar().alias("inserted"), F.col("_all")
    ).select("inserted", (F.col("_all") - F.col("inserted")).alias("updated"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add rows whose key is new; the first row of a repeated key wins."""
    from tallyhire.operators.skew import first_by

    fresh = first_by(source, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


# -- rule tables of the stored tables -----------------------------------------

JOBS_RULES = {
    "last_seen": TAKE_NEW,
    "location": NEW_IF_NONBLANK,
    "posted_at": COALESCE_OLD_NEW,
    "apply_url": NEW_IF_OLD_BLANK,
    "description_complete": GREATEST,
    "description": custom(
        lambda t, s, c: F.when(
            ~F.coalesce(t("description_complete"), F.lit(False)) & s("description_complete"), s(c)
        ).otherwise(t(c)),
        # First complete body of the batch, else the first body.
        lambda c, o: F.coalesce(F.min_by(c, F.when(F.col("description_complete"), o)), F.min_by(c, o)),
    ),
}
SCORES_RULES = {c: TAKE_NEW for c in ("ai_score", "reason", "concerns", "scored_at", "profile_fingerprint")}
CRAWL_RULES = {
    **{c: TAKE_NEW for c in ("outcome", "status", "content_length", "fetched_at", "error")},
    **{c: COALESCE_NEW_OLD for c in ("etag", "last_modified", "content_hash")},
}
ROBOTS_RULES = {c: TAKE_NEW for c in ("body", "fetched_at", "reachable")}
ANSWERS_RULES = {"answer": TAKE_NEW, "confirmed_at": TAKE_NEW}
PREPARED_RULES = {"prepared_at": COALESCE_OLD_NEW}


def overwrite_rules(columns: Sequence[str], keys: Sequence[str]) -> dict[str, Rule]:
    return {c: TAKE_NEW for c in columns if c not in keys}


def upsert_jobs(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """Refresh what a source owns and fill gaps; triage, scores and titles survive re-discovery.

    ``batch`` has the jobs columns it knows plus ``ordinal``.
    """
    return upsert(jobs, batch, ["id"], JOBS_RULES, "ordinal")


def replace_ai_skills(job_skills: DataFrame, judged: DataFrame) -> DataFrame:
    """Drop every skill of a judged job and put the model's list in its place.

    ``judged`` rows are (job_id, skill, label, requirement, ordinal); a later repeat
    of a skill overwrites the requirement, and preferred rows come last.
    """
    from tallyhire.operators.skew import latest_by

    fresh = latest_by(
        judged.withColumn("_pref", F.col("requirement") == "preferred"), ["job_id", "skill"], ["_pref", "ordinal"]
    ).drop("_pref").withColumn("source", F.lit("ai"))
    kept = job_skills.join(judged.select("job_id").distinct(), "job_id", "left_anti")
    return kept.unionByName(fresh.select(*job_skills.columns))


def add_boards(boards: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Insert-or-ignore on (ats, token); new boards start active."""
    rows = found.withColumn("active", F.lit(True)).withColumn(
        "verified_at", F.when(F.col("verified"), now) if "verified" in found.columns else F.lit(None).cast("timestamp")
    )
    return insert_ignore(boards, rows.select(*boards.columns), ["ats", "token"], ["company"])


def verify_boards(boards: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Stamp boards that still resolve, deactivate those that do not; unchecked boards stay."""
    alive = checks.groupBy("ats", "token").agg(F.max("alive").alias("_alive"))
    return boards.join(alive, ["ats", "token"], "left").select(
        "company", "ats", "token",
        F.when(F.col("_alive"), now).otherwise(F.col("verified_at")).alias("verified_at"),
        (F.col("active") & F.coalesce("_alive", F.lit(True))).alias("active"),
    )


def delete_jobs(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove postings everywhere: per-job rows cascade, references to them as canonical become NULL."""
    gone = ids.select(F.col("id").alias("job_id")).distinct()
    out = {}
    for name, df in tables.items():
        if name == "jobs":
            kept = df.join(gone.withColumnRenamed("job_id", "id"), "id", "left_anti")
            lost = gone.select(F.col("job_id").alias("canonical_id"), F.lit(True).alias("_lost"))
            # most postings refer to none; only those that do are dealt out by the reference
            referring = kept.filter(F.col("canonical_id").isNotNull()).join(lost, "canonical_id", "left").withColumn(
                "canonical_id", F.when(F.col("_lost").isNull(), F.col("canonical_id")))
            out[name] = kept.filter(F.col("canonical_id").isNull()).select(*df.columns).unionByName(referring.select(*df.columns))
        else:
            out[name] = df.join(gone, "job_id", "left_anti") if "job_id" in df.columns else df
    return out
