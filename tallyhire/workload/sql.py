"""Shared pieces of the check queries: each stored table as a common table expression."""

from __future__ import annotations

import re

from tallyhire.functions.cost import FREE_PROVIDERS, PRICES
from tallyhire.operators.match import DOMAIN_SLUGS
from tallyhire.workload import derive as d

NOW = f"TIMESTAMP '{d.NOW}'"


def ts(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"


def flag(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS INTEGER) AS {name or expr.split('.')[-1]}"


def num(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr.split('.')[-1]}"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _profile() -> str:
    pos = "CAST(p_partkey % 129 AS INT) + 1"
    part = {k: f"split_part('{'|'.join(v)}', '|', {pos})" for k, v in
            (("skill", d.SLUGS[:129]), ("label", d.SKILL_LABELS[:129]), ("category", d.SKILL_CATEGORIES))}
    cols = ", ".join(f"{e} AS {k}" for k, e in part.items())
    return f"""SELECT skill, label, category, {d.pick('total % 4', ('exposure', 'working', 'strong', 'expert'))} AS level,
      CASE WHEN total % 3 = 0 THEN CAST(total % 9 AS DOUBLE) END AS years, total % 5 = 0 AS pinned
    FROM (SELECT {cols}, avg(p_size) AS mean, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY ALL) WHERE mean > 24"""


def price(model: str, which: int) -> str:
    """Longest prefix of the price table."""
    arms = " ".join(
        f"WHEN starts_with(lower({model}), '{p}') THEN {PRICES[p][which]}" for p in sorted(PRICES, key=len, reverse=True)
    )
    return f"CASE {arms} END"


_CTES = {
    "jobs": d.JOBS.sql(),
    "job_skill_rows": d.JOB_SKILL_ROWS.sql(),
    "job_skills": """SELECT job_id, skill, label, requirement, source, ordinal FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id, skill ORDER BY ordinal, requirement, source) AS rn
        FROM job_skill_rows) WHERE rn = 1""",
    "profile": _profile(),
    "fingerprint": "SELECT substr(sha256(string_agg(skill || ':' || level, '|' ORDER BY skill || ':' || level)), 1, 16) "
                   "AS fp FROM profile",
    "match_counts": f"""SELECT s.job_id,
        count(*) FILTER (requirement = 'required' AND level IS NOT NULL) AS matched_required,
        count(*) FILTER (requirement = 'required') AS total_required,
        count(*) FILTER (requirement = 'preferred' AND level IS NOT NULL) AS matched_preferred,
        count(*) FILTER (requirement = 'preferred') AS total_preferred,
        coalesce(sum(CASE level WHEN 'exposure' THEN 0.55 WHEN 'working' THEN 0.8 WHEN 'strong' THEN 1 WHEN 'expert' THEN 1 END)
          FILTER (requirement = 'required'), 0)::DOUBLE AS earned,
        count(*) FILTER (s.skill IN ({quoted(DOMAIN_SLUGS)})) AS dom,
        count(*) FILTER (s.skill IN ({quoted(DOMAIN_SLUGS)}) AND category = 'domain') AS dom_hits
      FROM job_skills s LEFT JOIN profile p ON p.skill = s.skill GROUP BY s.job_id""",
    "match_parts": """SELECT *,
        CASE WHEN total_required > 0 THEN earned / (total_required + 4) ELSE 0 END AS weighted_required,
        CASE WHEN total_preferred > 0 THEN matched_preferred / (total_preferred + 4) ELSE 0.5 END AS preferred,
        0.5 AS seniority,
        CASE WHEN dom > 0 AND EXISTS (SELECT 1 FROM profile WHERE category = 'domain') THEN dom_hits / dom ELSE 0.5 END AS domain,
        CASE WHEN total_required > 0 THEN matched_required / total_required ELSE 0 END AS coverage
      FROM match_counts""",
    "matches": """SELECT *, 0.6 * weighted_required + 0.2 * preferred + 0.15 * seniority + 0.05 * domain AS match_score,
        CASE WHEN right(job_id, 1) BETWEEN '0' AND '3' THEN NULL WHEN right(job_id, 1) BETWEEN '4' AND '7' THEN 'older'
          ELSE (SELECT fp FROM fingerprint) END AS profile_fingerprint
      FROM match_parts""",
    "scores": d.SCORES.sql(),
    "signals": d.SIGNALS.sql(),
    "applications": d.APPLICATIONS.sql(),
    "status_events": d.STATUS_EVENTS.sql(),
    "engine_runs": d.ENGINE_RUNS.sql(),
    "calls": d.CALLS.sql(),
    "ai_spend": f"""SELECT id, called_at, provider, model, stage, input_tokens, output_tokens,
        CASE WHEN provider IN ({quoted(FREE_PROVIDERS)}) THEN 0 ELSE coalesce(reported_usd,
          coalesce(input_tokens, 0) / 1000000.0 * ({price('model', 0)}) + coalesce(output_tokens, 0) / 1000000.0 * ({price('model', 1)}),
          0) END AS estimated_usd,
        CASE WHEN provider IN ({quoted(FREE_PROVIDERS)}) THEN 'free' WHEN reported_usd IS NOT NULL THEN 'reported'
          ELSE 'derived' END AS cost_source
      FROM calls""",
    "boards": d.BOARDS.sql(),
    "board_postings": d.BOARD_POSTINGS.sql(),
    "captures": d.CAPTURES.sql(),
    "texts": d.TEXTS.sql(),
    "answers": """SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a
      JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
      WHERE a.role = 'user' AND b.role = 'assistant'""",
    "summary": """SELECT j.*, m.matched_required, m.total_required, m.coverage, m.match_score, s.ai_score, g.wlb_score,
        g.salary_vs_target
      FROM jobs j LEFT JOIN matches m ON m.job_id = j.id LEFT JOIN scores s ON s.job_id = j.id
      LEFT JOIN signals g ON g.job_id = j.id WHERE j.canonical_id IS NULL""",
}


def query(body: str, **extra: str) -> str:
    """``body`` with the tables it names (and those they name) defined in front of it."""
    pool = {**_CTES, **extra}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in pool:
            if name not in order and name not in stack and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                stack.append(name)
                visit(pool[name])
                stack.pop()
                order.append(name)

    stack: list[str] = []
    visit(body)
    head = ",\n".join(f"{n} AS ({pool[n]})" for n in order)
    return f"WITH {head}\n{body}" if order else body


SUMMARY_COLUMNS = ", ".join((
    "id", "company", "title", "coalesce(location, '') AS location", "engine", flag("remote"),
    "coalesce(apply_url, '') AS apply_url", "coalesce(matched_required, 0) AS matched_required",
    "coalesce(total_required, 0) AS total_required", num("coalesce(coverage, 0)", "coverage"),
    num("coalesce(match_score, 0)", "match_score"), "ai_score", "wlb_score", "salary_vs_target", "review_status",
    ts("posted_at"), "company_type", "liveness", "liveness_reason",
))
SCORE_ORDER = "summary.ai_score DESC NULLS LAST, summary.match_score DESC NULLS LAST"
