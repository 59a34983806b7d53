"""Completing truncated postings from the employer's own board, and finding boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.text import candidate_tokens, company_key, names_agree, squashed_name, title_key
from tallyhire.operators.skew import bounded_broadcast, spread_join

MIN_BODY = 200


def enrich_candidates(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.coalesce("description_complete", F.lit(False)) & (F.col("company") != ""))


def board_bodies(boards: DataFrame, postings: DataFrame) -> DataFrame:
    """First usable body per (company key, title key): boards in company order, postings in feed order."""
    keyed = boards.filter("active").select(
        company_key("company").alias("_ck"), F.col("company").alias("_board"), "ats", "token"
    )
    pool = postings.join(bounded_broadcast(keyed), ["ats", "token"]).filter(F.length("description") > MIN_BODY)
    first = F.min(F.struct("_board", "ats", "token", "ordinal", "description"))
    return (
        pool.groupBy("_ck", title_key("title").alias("_tk")).agg(first.alias("_b"))
        .select("_ck", "_tk", F.col("_b.description").alias("_body"))
    )


def enrich_snippets(jobs: DataFrame, boards: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs with bodies completed where the employer's board lists the same title."""
    wanted = ~F.coalesce("description_complete", F.lit(False)) & (F.col("company") != "")
    staged = jobs.withColumns({
        "_ck": F.when(wanted, company_key("company")), "_tk": F.when(wanted, title_key("title")),
    })
    joined = spread_join(staged, board_bodies(boards, postings), ["_ck", "_tk"], ["id"])
    hit = F.col("_body").isNotNull()
    return joined.withColumns({
        "description": F.when(hit, F.col("_body")).otherwise(F.col("description")),
        "description_complete": F.col("description_complete") | hit,
    }).select(*jobs.columns)


def enrich_summary(jobs: DataFrame, boards: DataFrame, postings: DataFrame) -> DataFrame:
    """(candidates, enriched, unmatched, boards_queried); a board is queried once per company key."""
    cand = enrich_candidates(jobs).select(
        "id", company_key("company").alias("_ck"), title_key("title").alias("_tk")
    )
    hits = spread_join(cand, board_bodies(boards, postings), ["_ck", "_tk"], ["id"])
    keys = boards.filter("active").select(company_key("company").alias("_ck"))
    asked = keys.join(cand.select("_ck").distinct(), "_ck", "left_semi").agg(F.count("*"))
    return hits.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("_body").isNotNull()).alias("enriched"),
        F.count_if(F.col("_body").isNull()).alias("unmatched"),
    ).withColumn("boards_queried", asked.scalar())


def companies_without_boards(jobs: DataFrame, boards: DataFrame, limit: int = 25) -> DataFrame:
    """Employers with no known board by number of postings (ties by name)."""
    per_company = jobs.filter(F.col("company") != "").groupBy("company").agg(F.count("*").alias("n"))
    known = boards.select(squashed_name("company").alias("_k")).distinct()
    return (
        per_company.withColumn("_k", squashed_name("company")).join(known, "_k", "left_anti")
        .select("company", "n").orderBy(F.desc("n"), "company").limit(limit)
    )


def probe_companies(companies: DataFrame, responses: DataFrame) -> DataFrame:
    """Boards confirmed by captured probe responses (ats, token, jobs, name).

    A token counts only when it returned jobs and, where the board names its owner,
    the names agree.  The first platform and token in probing order win.
    """
    tokens = companies.select("company", F.posexplode_outer(candidate_tokens("company")).alias("token_order", "token"))
    order: Column = F.array_position(F.array(*[F.lit(a) for a in PROBE_ORDER]), F.col("ats"))
    hits = (
        tokens.join(responses.filter("jobs > 0"), "token")
        .filter(names_agree(F.col("company"), F.coalesce("name", F.lit(""))))
    )
    best = F.min(F.struct(order.alias("o"), "token_order", "ats", "token", "jobs"))
    return hits.groupBy("company").agg(best.alias("_b")).select(
        "company", F.col("_b.ats").alias("ats"), F.col("_b.token").alias("token"), F.col("_b.jobs").alias("jobs")
    )


# Platforms probed, in order.
PROBE_ORDER = ("greenhouse", "lever", "ashby", "recruitee")
