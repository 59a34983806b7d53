"""Stages around an opaque judge (a model call).

The judge is a function from a DataFrame of requests (job_id, prompt) to a DataFrame of
answers (job_id, answer, error).  Everything else is relational: choosing candidates,
parsing and checking answers, and folding them into the stored tables.  A row whose
answer fails a check is reported, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions import pay, place
from tallyhire.functions.text import contains_typed, model_json
from tallyhire.operators.dedupe import repost_counts
from tallyhire.operators.extract import label_skills, resolve_labels
from tallyhire.operators.match import attach_skill_lists
from tallyhire.operators.profile import profile_summary
from tallyhire.operators.settle import settled
from tallyhire.operators.upsert import SCORES_RULES, overwrite_rules, replace_ai_skills, upsert
from tallyhire.plans.jobs import draft_candidates
from tallyhire.plans.tracker import list_answers

Judge = Callable[[DataFrame], DataFrame]
ANSWERS = "job_id string, answer string, error string"


def batch_judge(call: Callable[[str], str]) -> Judge:
    """A judge that sends each prompt through ``call`` inside the tasks; failures stay with their row."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            answers, errors = [], []
            for prompt in b["prompt"]:
                try:
                    answers.append(call(prompt))
                    errors.append(None)
                except Exception as exc:  # a failed row must not lose the batch
                    answers.append(None)
                    errors.append(str(exc))
            yield pd.DataFrame({"job_id": b["job_id"], "answer": answers, "error": errors})

    return lambda requests: requests.select("job_id", "prompt").mapInPandas(run, ANSWERS)


def parsed(answers: DataFrame, ddl: str, valid: Callable[[Column], Column]) -> DataFrame:
    """Answers with ``r`` (the parsed struct, NULL when invalid) and ``problem``.

    The outcome is written out: it feeds several outputs and the judge must be asked once.
    """
    df = answers.withColumn("_json", model_json("answer")).withColumn("_r", F.from_json("_json", ddl))
    ok = F.col("_json").isNotNull() & F.coalesce(valid(F.col("_r")), F.lit(False))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_json").isNull(), "not JSON").when(~ok, "does not fit the schema")
    )
    return settled(df.select("job_id", F.when(problem.isNull(), F.col("_r")).alias("r"), problem.alias("problem")))


def stage_summary(results: DataFrame) -> DataFrame:
    """(considered, succeeded, failed, errors): the first three problems are kept."""
    failed = F.col("problem").isNotNull()
    shown = results.filter(failed).orderBy("job_id").limit(3).select(
        F.concat("job_id", F.lit(": "), "problem").alias("error")
    ).agg(F.sort_array(F.collect_list("error")))
    return results.agg(
        F.count("*").alias("considered"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
    ).withColumn("errors", shown.scalar())


def _enum(c: Column, *allowed: str) -> Column:
    return c.isin(*allowed)


def _short(c: Column, longest: int) -> Column:
    return c.isNull() | (F.length(c) <= longest)


def _texts(c: Column, most: int, longest: int, shortest: int = 0) -> Column:
    return c.isNotNull() & (F.size(c) <= most) & F.forall(c, lambda x: F.length(x).between(shortest, longest))


# -- normalise ----------------------------------------------------------------


def _shown(c: str, prompt_chars: int | None) -> Column:
    """The body a judge reads: all of it, unless a window is asked for."""
    body = F.coalesce(c, F.lit(""))
    return body if prompt_chars is None else F.substring(body, 1, prompt_chars)


def _first(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The leading rows; with no limit every row, unsorted, so nothing is gathered."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def normalise_candidates(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(jobs.filter(
        F.col("seniority").isNull() & (F.col("description") != "") & F.col("canonical_id").isNull()
    ), limit, "id")


NORMALISED = (
    "seniority string, yearsRequired int, employmentType string, remote string, remoteRestriction string, "
    "salaryMin double, salaryMax double, salaryCurrency string, salaryPeriod string"
)


def _valid_normalised(r: Column) -> Column:
    return (
        _enum(r["seniority"], "intern", "junior", "mid", "senior", "staff", "principal", "lead", "unknown")
        & (r["yearsRequired"].isNull() | r["yearsRequired"].between(0, 40))
        & _enum(r["employmentType"], "full-time", "part-time", "contract", "internship", "unknown")
        & _enum(r["remote"], "remote", "remote-restricted", "hybrid", "onsite", "unknown")
        & _short(r["remoteRestriction"], 120) & _short(r["salaryCurrency"], 8)
        & (r["salaryMin"].isNull() | (r["salaryMin"] >= 0)) & (r["salaryMax"].isNull() | (r["salaryMax"] >= 0))
        & (r["salaryPeriod"].isNull() | _enum(r["salaryPeriod"], "annual", "monthly", "hourly"))
    )


def normalise_jobs(jobs: DataFrame, judge: Judge, limit: int | None = None, prompt_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs with the judge's reading folded in, and the per-row results."""
    picked = normalise_candidates(jobs, limit)
    prompt = F.concat("title", F.lit("\n"), F.coalesce("location", F.lit("")), F.lit("\n\n"),
                      _shown("description", prompt_chars))
    results = parsed(judge(picked.select(F.col("id").alias("job_id"), prompt.alias("prompt"))), NORMALISED,
                     _valid_normalised)
    good = results.filter(F.col("r").isNotNull()).select(F.col("job_id").alias("id"), "r")
    r = F.col("r")
    remote = F.when(r["remote"].isin("remote", "remote-restricted"), True).when(r["remote"] != "unknown", False)
    hit = r.isNotNull()
    out = jobs.join(good, "id", "left").withColumns({
        "seniority": F.when(hit, r["seniority"]).otherwise(F.col("seniority")),
        "employment_type": F.when(hit, r["employmentType"]).otherwise(F.col("employment_type")),
        "remote": F.when(hit, remote).otherwise(F.col("remote")),
        "remote_restriction": F.when(hit, r["remoteRestriction"]).otherwise(F.col("remote_restriction")),
        **{f"salary_{c.lower()}": F.coalesce(r[f"salary{c}"], F.col(f"salary_{c.lower()}"))
           for c in ("Min", "Max", "Currency", "Period")},
    })
    return out.select(*jobs.columns), results


# -- skills -------------------------------------------------------------------


def skill_candidates(jobs: DataFrame, job_skills: DataFrame, limit: int | None = None) -> DataFrame:
    """Postings whose skills a judge has not read yet; one that came back empty is asked again."""
    done = job_skills.filter(F.col("source") == "ai").select(F.col("job_id").alias("id")).distinct()
    unread = jobs.filter((F.col("description") != "") & F.col("canonical_id").isNull()).join(done, "id", "left_anti")
    return _first(unread, limit, "id")


def _valid_skills(r: Column) -> Column:
    return _texts(r["required"], 40, 60, 1) & _texts(r["preferred"], 40, 60, 1)


def extract_judged_skills(jobs: DataFrame, job_skills: DataFrame, judge: Judge, limit: int | None = None,
                          learned: DataFrame | None = None, prompt_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    picked = skill_candidates(jobs, job_skills, limit)
    prompt = F.concat("title", F.lit("\n\n"), _shown("description", prompt_chars))
    results = parsed(judge(picked.select(F.col("id").alias("job_id"), prompt.alias("prompt"))),
                     "required array<string>, preferred array<string>", _valid_skills)
    def listed(need: str, base: int) -> Column:
        return F.transform(F.col(f"r.{need}"), lambda label, i: F.struct(
            label.alias("label"), F.lit(need).alias("requirement"), (i + base).cast("bigint").alias("ordinal")))

    both = F.concat(listed("required", 0), listed("preferred", 40))
    rows = results.filter(F.col("r").isNotNull()).select("job_id", F.inline_outer(both)).filter(F.col("label").isNotNull())
    resolved = resolve_labels(rows, "label", learned, "skill").filter(F.col("skill").isNotNull()).drop("label")
    return replace_ai_skills(job_skills, label_skills(resolved, "skill").drop("category")), results


# -- score --------------------------------------------------------------------


def above_threshold(jobs: DataFrame, matches: DataFrame, done: DataFrame, threshold: float, limit: int | None = None,
                    location: str | None = None) -> DataFrame:
    """Best matches not judged yet, [in one place], duplicates excluded."""
    listed = jobs.filter(F.col("canonical_id").isNull())
    if location and location.strip():
        listed = listed.filter(contains_typed("location", location.strip()))
    good = matches.filter(F.col("match_score") >= threshold).select("job_id", "match_score", "coverage")
    open_ = good.join(done.select("job_id"), "job_id", "left_anti").join(listed.withColumnRenamed("id", "job_id"), "job_id")
    return _first(open_, limit, F.desc("match_score"), "job_id")


def capped_score(score: Column, role: Column) -> Column:
    """A different kind of work caps at 2, an adjacent one at 4."""
    return F.when(role == "different", F.least(score, F.lit(2))).when(
        role == "adjacent", F.least(score, F.lit(4))).otherwise(score)


def capped_concerns(score: Column, role: Column, concerns: Column) -> Column:
    note = F.concat(F.lit("Different kind of role ("), role, F.lit(")"))
    return F.when(capped_score(score, role) != score, F.concat(F.array(note), concerns)).otherwise(concerns)


def _valid_score(r: Column) -> Column:
    return (
        r["score"].between(1, 5) & F.length(r["reason"]).between(1, 300) & _texts(r["concerns"], 6, 160)
        & _enum(r["roleTypeMatch"], "same", "adjacent", "different")
    )


def score_jobs(jobs: DataFrame, matches: DataFrame, scores: DataFrame, judge: Judge, threshold: float, now: Column,
               model: str, limit: int | None = None, location: str | None = None,
               fingerprint: Column | None = None, prompt_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    picked = above_threshold(jobs, matches, scores, threshold, limit, location)
    prompt = F.concat(F.lit("POSTING: "), "title", F.lit(" at "), "company", F.lit("\n\n"),
                      _shown("description", prompt_chars))
    results = parsed(judge(picked.select("job_id", prompt.alias("prompt"))),
                     "score int, reason string, concerns array<string>, roleTypeMatch string", _valid_score)
    r = F.col("r")
    rows = results.filter(r.isNotNull()).select(
        "job_id", capped_score(r["score"], r["roleTypeMatch"]).alias("ai_score"), r["reason"].alias("reason"),
        capped_concerns(r["score"], r["roleTypeMatch"], r["concerns"]).alias("concerns"),
        F.lit(model).alias("model"), now.alias("scored_at"),
        (fingerprint if fingerprint is not None else F.lit(None)).cast("string").alias("profile_fingerprint"),
        F.lit(0).alias("_o"),
    )
    return upsert(scores, rows, ["job_id"], SCORES_RULES, "_o"), results


# -- signals ------------------------------------------------------------------


def arithmetic_signals(jobs: DataFrame, target_min: float | None, target_currency: str,
                       target_period: str = "annual", only: DataFrame | None = None) -> DataFrame:
    """(job_id, salary_source, salary_shape, salary_vs_target, remote_reality, repost_count): stated facts only.

    ``only`` holds the rows of ``jobs`` to answer for.
    """
    lo, hi = F.col("salary_min"), F.col("salary_max")
    rows = jobs if only is None else only
    return rows.join(repost_counts(jobs, only), "id").select(
        F.col("id").alias("job_id"),
        F.when(lo.isNull() & hi.isNull(), "absent").otherwise("disclosed").alias("salary_source"),
        pay.salary_shape(lo, hi).alias("salary_shape"),
        pay.salary_vs_target(lo, hi, F.col("salary_currency"), F.col("salary_period"), target_min, target_currency,
                             target_period).alias("salary_vs_target"),
        place.remote_reality(F.col("remote"), F.col("remote_restriction")).alias("remote_reality"),
        "repost_count",
    )


SIGNALS = (
    "wlbScore int, evidence array<struct<quote: string, polarity: string, note: string>>, redFlags array<string>, "
    "greenFlags array<string>, interviewStages int"
)


def _valid_signals(r: Column) -> Column:
    return (
        r["wlbScore"].between(1, 5) & (F.size(r["evidence"]) <= 8)
        & F.forall(r["evidence"], lambda e: (F.length(e["quote"]) <= 200) & (F.length(e["note"]) <= 120)
                   & e["polarity"].isin("positive", "negative"))
        & _texts(r["redFlags"], 6, 140) & _texts(r["greenFlags"], 6, 140)
        & (r["interviewStages"].isNull() | r["interviewStages"].between(0, 12))
    )


def compute_signals(jobs: DataFrame, matches: DataFrame, signals: DataFrame, judge: Judge, threshold: float,
                    target_min: float | None, target_currency: str, now: Column, limit: int | None = None,
                    location: str | None = None, prompt_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Arithmetic for every candidate; a failed judgement costs the tone reading, not the row."""
    picked = settled(above_threshold(jobs, matches, signals, threshold, limit, location))
    prompt = F.concat(F.lit("POSTING: "), "title", F.lit("\n\n"),
                      _shown("description", prompt_chars))
    results = parsed(judge(picked.select("job_id", prompt.alias("prompt"))), SIGNALS, _valid_signals)
    facts = arithmetic_signals(jobs, target_min, target_currency, only=picked.withColumnRenamed("job_id", "id"))
    r = F.col("r")
    none = F.array().cast("array<string>")
    rows = facts.join(results, "job_id", "left").select(
        *facts.columns, r["wlbScore"].alias("wlb_score"),
        F.coalesce(r["evidence"], F.array().cast("array<struct<quote: string, polarity: string, note: string>>"))
        .alias("wlb_evidence"),
        F.coalesce(r["redFlags"], none).alias("red_flags"), F.coalesce(r["greenFlags"], none).alias("green_flags"),
        r["interviewStages"].alias("interview_stages"), now.alias("computed_at"), F.lit(0).alias("_o"),
    )
    return upsert(signals, rows, ["job_id"], overwrite_rules(signals.columns, ["job_id"]), "_o"), results


# -- draft --------------------------------------------------------------------

DRAFT = (
    "coverLetter string, resumeNotes array<string>, answers array<struct<question: string, answer: string>>, "
    "missingInformation array<string>"
)


def _valid_draft(r: Column) -> Column:
    return (
        (F.length(r["coverLetter"]) >= 80) & _texts(r["resumeNotes"], 8, 240) & (F.size(r["answers"]) <= 10)
        & F.forall(r["answers"], lambda a: (F.length(a["question"]) <= 300) & (F.length(a["answer"]) <= 1500))
        & _texts(r["missingInformation"], 6, 200)
    )


def _in_lines(rows: DataFrame, order: Column, text: Column) -> Column:
    """The texts of a few rows under each other."""
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n")).scalar()


def draft_requests(t: Mapping[str, DataFrame], answers: DataFrame, threshold: float, limit: int | None = None, bank: int = 20,
                   prompt_chars: int | None = None) -> DataFrame:
    """(job_id, prompt) per posting to draft for: profile, the ``bank`` most used answers, skill lists and the posting.

    The profile has at most a row per vocabulary entry and the bank ``bank`` rows; both go into each prompt as one text.
    """
    picked = settled(draft_candidates(t, threshold, limit))
    listed = attach_skill_lists(picked, t["job_skills"], t["profile_skills"])
    bodies = t["jobs"].select(F.col("id").alias("job_id"), "description")
    profile = _in_lines(profile_summary(t["profile_skills"]), F.col("category"), F.concat("category", F.lit(": "), "skills"))
    known = _in_lines(list_answers(answers, bank), F.struct(-F.col("times_used"), "question"),
                      F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer"))
    prompt = F.concat_ws(
        "\n", F.lit("PROFILE"), profile, F.lit("CONFIRMED ANSWERS"), known,
        F.concat(F.lit("POSTING: "), "title", F.lit(" at "), "company"),
        F.concat(F.lit("Matched skills: "), F.array_join("matched", ", ")),
        F.concat(F.lit("Strengths not asked for: "), F.array_join("bonus", ", ")), _shown("description", prompt_chars))
    return listed.join(bodies, "job_id").select("job_id", prompt.alias("prompt"))


def draft_jobs(t: Mapping[str, DataFrame], answers: DataFrame, judge: Judge, threshold: float, limit: int | None = None,
               bank: int = 20, prompt_chars: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, drafts, results): postings whose draft fits become ``drafted``; the others stay as they are."""
    results = parsed(judge(draft_requests(t, answers, threshold, limit, bank, prompt_chars)), DRAFT, _valid_draft)
    drafts = results.filter(F.col("r").isNotNull()).select(
        "job_id", F.col("r.coverLetter").alias("cover_letter"), F.col("r.resumeNotes").alias("resume_notes"),
        F.col("r.answers").alias("answers"), F.col("r.missingInformation").alias("missing_information"))
    done = drafts.select(F.col("job_id").alias("id"), F.lit("drafted").alias("_drafted"))
    jobs = t["jobs"].join(done, "id", "left").withColumn("review_status", F.coalesce("_drafted", "review_status"))
    return jobs.select(*t["jobs"].columns), drafts, results


# -- routing ------------------------------------------------------------------


def route(tier: str, overrides: dict[str, tuple[str, str | None]], chain: list[str], available: set[str],
          default_models: dict[str, str], model: str | None = None) -> tuple[str, str | None]:
    """(provider, model) for a tier: its override when usable, else the first available in the chain."""
    if tier in overrides and overrides[tier][0] in available:
        provider, own = overrides[tier]
        return provider, own or default_models.get(provider)
    for provider in chain:
        if provider in available:
            return provider, model or default_models.get(provider)
    return "none", None
