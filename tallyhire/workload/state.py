"""State queries: upserts, dedupe, enrichment, lifecycle, judge stages, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhire.operators import dedupe as dd
from tallyhire.operators import enrich as en
from tallyhire.operators import lifecycle as lc
from tallyhire.operators import profile as pf
from tallyhire.operators import upsert as up
from tallyhire.operators.settle import run_folder
from tallyhire.operators.similar import PROBES, SIMILAR
from tallyhire.plans import judge as jg
from tallyhire.streaming import logs, tracker
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.scalars import rx, sql_collapse
from tallyhire.workload.skills import VOCAB_VALUES
from tallyhire.workload.sql import NOW, flag, num, query, quoted, ts
from tallyhire import vocab

# -- jobs upsert: a batch with repeats, one posting in five new ---------------

BATCH = d.Derived("lineitem", {
    "k": "l_orderkey",
    "id": d.job_id("l_orderkey"),
    "location": "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Loc ' || CAST(l_suppkey AS STRING) END",
    "posted_at": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_shipdate END",
    "apply_url": "CASE WHEN l_partkey % 5 < 3 THEN '' ELSE 'https://b/' || CAST(l_partkey AS STRING) END",
    "title": "'batch ' || CAST(l_partkey AS STRING)",
    "description": "'line ' || CAST(l_partkey AS STRING)",
    "description_complete": "l_partkey % 2 = 0",
    "ordinal": "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey",
})
_BATCHES = {
    "batch": BATCH.sql(),
    "held": "SELECT * FROM jobs WHERE k % 5 <> 0",
    "folded": """SELECT id, coalesce(arg_max(location, ordinal) FILTER (location <> ''), '') AS location,
        arg_min(posted_at, ordinal) FILTER (posted_at IS NOT NULL) AS posted_at,
        coalesce(arg_min(apply_url, ordinal) FILTER (apply_url <> ''), '') AS apply_url, arg_min(title, ordinal) AS title,
        arg_min(description, ordinal) FILTER (description_complete) AS whole, arg_min(description, ordinal) AS first_body,
        bool_or(description_complete) AS description_complete, count(*) AS rows_in_batch FROM batch GROUP BY id""",
}


def _held_and_batch(w):
    cols = ("id", "title", "location", "posted_at", "apply_url", "description", "description_complete", "review_status", "last_seen")
    held = w.jobs.filter("k % 5 <> 0").select(*cols)
    return held, w.derived(BATCH).withColumns({"last_seen": w.now, "review_status": F.lit("new")}).drop("k")


@register("K01_jobs_upsert", query(f"""
    SELECT coalesce(h.id, f.id) AS id, coalesce(h.title, f.title) AS title,
      CASE WHEN h.id IS NULL THEN f.location WHEN f.location <> '' THEN f.location ELSE h.location END AS location,
      {ts('coalesce(h.posted_at, f.posted_at)', 'posted_at')},
      CASE WHEN h.id IS NOT NULL AND (coalesce(h.apply_url, '') <> '' OR f.id IS NULL) THEN h.apply_url ELSE f.apply_url END AS apply_url,
      CASE WHEN h.id IS NULL THEN coalesce(f.whole, f.first_body) WHEN NOT h.description_complete AND f.description_complete THEN f.whole
        ELSE h.description END AS description,
      CAST(coalesce(h.description_complete, false) OR coalesce(f.description_complete, false) AS INTEGER) AS description_complete,
      CASE WHEN h.id IS NULL THEN 'new' ELSE h.review_status END AS review_status,
      {ts(f"CASE WHEN f.id IS NOT NULL THEN {NOW} ELSE h.last_seen END", 'last_seen')}
    FROM held h FULL JOIN folded f ON f.id = h.id""", **_BATCHES))
def _(w):
    held, batch = _held_and_batch(w)
    return up.upsert_jobs(held, batch)


@register("K01_upsert_counts", query("""
    SELECT count(*) FILTER (id NOT IN (SELECT id FROM held)) AS inserted,
      CAST(sum(rows_in_batch) AS BIGINT) - count(*) FILTER (id NOT IN (SELECT id FROM held)) AS updated FROM folded""", **_BATCHES))
def _(w):
    held, batch = _held_and_batch(w)
    return up.upsert_counts(held, batch, ["id"])


@register("K02_job_skills_insert", query("""
    SELECT job_id, skill, requirement, source FROM (SELECT *, row_number() OVER (PARTITION BY job_id, skill ORDER BY stored DESC, ordinal, requirement, source) AS rn
      FROM (SELECT job_id, skill, requirement, source, ordinal, source = 'ai' AS stored FROM job_skills WHERE source = 'ai'
        UNION ALL SELECT job_id, skill, requirement, source, ordinal, false FROM job_skill_rows WHERE source = 'engine')) WHERE rn = 1"""))
def _(w):
    stored = w.job_skills.filter("source = 'ai'").select("job_id", "skill", "requirement", "source", "ordinal")
    fresh = w.derived(d.JOB_SKILL_ROWS).filter("source = 'engine'").drop("label")
    return up.insert_ignore(stored, fresh, ["job_id", "skill"], ["ordinal", "requirement", "source"]).drop("ordinal")


@register("K04_scores_upsert", query("""
    SELECT job_id, CASE WHEN ai_score >= 3 THEN 1 ELSE ai_score END AS ai_score, CASE WHEN ai_score >= 3 THEN 'again' ELSE reason END AS reason, model FROM scores"""))
def _(w):
    old = w.scores.select("job_id", "ai_score", "reason", "model", "scored_at")
    new = old.filter("ai_score >= 3").select(
        "job_id", F.lit(1).alias("ai_score"), F.lit("again").alias("reason"), F.lit("judge-b").alias("model"),
        w.now.alias("scored_at"), F.lit(0).alias("o"))
    return up.upsert(old, new, ["job_id"], up.SCORES_RULES, "o").drop("scored_at")


@register("K06_profile_upsert", query("""
    SELECT skill, CASE WHEN pinned THEN level ELSE 'strong' END AS level, years, CASE WHEN pinned THEN 'resume' ELSE 'rebuilt' END AS source,
      CAST(pinned AS INTEGER) AS pinned FROM profile"""))
def _(w):
    built = w.profile.withColumns({"level": F.lit("strong"), "evidence": F.lit("line")})
    return pf.upsert_profile(w.profile, built, w.now, "rebuilt").select("skill", "level", "years", "source", "pinned")


@register("K07_manual_skill", query("""
    SELECT skill, CASE WHEN level = 'exposure' THEN 'expert' ELSE level END AS level, CASE WHEN level = 'exposure' THEN 'manual' ELSE 'resume' END AS source,
      CAST(pinned OR level = 'exposure' AS INTEGER) AS pinned FROM profile"""))
def _(w):
    manual = w.profile.filter("level = 'exposure'").select("skill", F.lit("expert").alias("level"))
    return pf.set_skills(w.profile, manual, w.now).select("skill", "level", "source", "pinned")


@register("K08_replace_ai_skills", query("""
    SELECT job_id, skill, requirement, source FROM job_skills WHERE job_id NOT IN (SELECT job_id FROM job_skill_rows WHERE source = 'ai')
    UNION ALL SELECT job_id, skill, CASE WHEN bool_or(requirement = 'preferred') THEN 'preferred' ELSE 'required' END, 'ai' FROM job_skill_rows
      WHERE source = 'ai' GROUP BY job_id, skill"""))
def _(w):
    judged = w.derived(d.JOB_SKILL_ROWS).filter("source = 'ai'").drop("source")
    return up.replace_ai_skills(w.job_skills, judged).select("job_id", "skill", "requirement", "source")


@register("K09_mark_prepared", query(f"""
    SELECT coalesce(a.job_id, s.job_id) AS job_id, coalesce(a.status, 'prepared') AS status,
      {ts(f"coalesce(a.prepared_at, CASE WHEN s.job_id IS NOT NULL THEN {NOW} END)", 'prepared_at')}, {ts(f"coalesce(a.last_status_at, {NOW})", 'last_status_at')}
    FROM applications a FULL JOIN scores s ON s.job_id = a.job_id"""))
def _(w):
    return lc.mark_prepared(w.applications, w.scores, w.now).select("job_id", "status", "prepared_at", "last_status_at")


@register("K10_answers_upsert", query("""
    SELECT question, arg_max(answer, conv_id * 1000 + turn) AS answer, 0::BIGINT AS times_used FROM (SELECT conv_id, turn, trim(question, ' ' || chr(10)) AS question,
      trim(answer, ' ' || chr(10)) AS answer FROM answers) GROUP BY question"""))
def _(w):
    from tallyhire.functions.text import strip

    rows = w.answers.select(strip("question").alias("question"), strip("answer").alias("answer"), w.now.alias("confirmed_at"),
                            F.lit(0).cast("bigint").alias("times_used"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    bank = rows.filter("o % 2 = 0").groupBy("question").agg(
        *[F.max_by(c, "o").alias(c) for c in ("answer", "confirmed_at", "times_used")])
    return up.upsert(bank, rows, ["question"], up.ANSWERS_RULES, "o").drop("confirmed_at")


@register("K13_add_and_verify_boards", query("""
    SELECT company, ats, token, CAST(active AND CAST(substr(token, 4) AS BIGINT) % 7 <> 0 AS INTEGER) AS active FROM boards
    UNION ALL SELECT 'New ' || s_suppkey, 'workable', 'tok' || s_suppkey, 1 FROM supplier WHERE s_suppkey % 3 = 0"""))
def _(w):
    found = w.raw("supplier").selectExpr("'New ' || s_suppkey AS company", "CASE WHEN s_suppkey % 3 = 0 THEN 'workable' ELSE "
                                         + d.BOARDS.columns["ats"] + " END AS ats", "'tok' || s_suppkey AS token")
    boards = up.add_boards(w.boards, found, w.now)
    checks = w.boards.select("ats", "token", (F.substring("token", 4, 20).cast("bigint") % 7 != 0).alias("alive"))
    return up.verify_boards(boards, checks, w.now).select("company", "ats", "token", "active")


@register("K14_append_logs", query("SELECT engine, count(*) AS runs, CAST(sum(fetched) AS BIGINT) AS fetched FROM engine_runs GROUP BY engine"))
def _(w):
    from tallyhire.sources.sinks import append_log

    path = run_folder(w.spark, "engine-runs")
    append_log(w.engine_runs.filter("id % 2 = 0"), path)
    append_log(w.engine_runs.filter("id % 2 = 1"), path)
    return w.spark.read.parquet(path).groupBy("engine").agg(F.count("*").alias("runs"), F.sum("fetched").alias("fetched"))


@register("K03_matches_snapshot", query("""
    SELECT CAST(floor(round(match_score, 9) * 10) AS BIGINT) AS bucket, count(*) AS n FROM matches GROUP BY 1"""))
def _(w):
    from tallyhire.schemas import conform

    rows = conform(w.matches, "matches").withColumn("o", F.lit(0))
    held = conform(w.matches.filter("total_required > 2"), "matches").withColumn("match_score", F.lit(0.0))
    out = up.upsert(held, rows, ["job_id"], up.overwrite_rules(held.columns, ["job_id"]), "o")
    return out.groupBy(F.floor(F.round("match_score", 9) * 10).alias("bucket")).agg(F.count("*").alias("n"))


@register("T05_delete_jobs", query("""
    SELECT (SELECT count(*) FROM jobs WHERE k % 4 <> 0) AS jobs, (SELECT count(*) FROM scores WHERE job_id IN (SELECT id FROM jobs WHERE k % 4 <> 0)) AS scores,
      (SELECT count(*) FROM job_skills WHERE job_id IN (SELECT id FROM jobs WHERE k % 4 <> 0)) AS job_skills"""))
def _(w):
    kept = up.delete_jobs({"jobs": w.jobs, "scores": w.scores, "job_skills": w.job_skills}, w.jobs.filter("k % 4 = 0").select("id"))
    return kept["jobs"].agg(F.count("*").alias("jobs")).select(
        "jobs", *[kept[n].agg(F.count("*")).scalar().alias(n) for n in ("scores", "job_skills")])


# -- duplicates ---------------------------------------------------------------

_CK = rx(rx(rx("lower(company)", "[.,]", " "), r"\b(" + "|".join(vocab.COMPANY_SUFFIXES + vocab.COMPANY_KEY_EXTRA_SUFFIXES) + r")\b", " "), "[^a-z0-9]+", "")
_TK = f"""trim({rx(rx("lower(title)", r"[(].*?[)]", " "), "[^a-z0-9]+", " ")})"""


def _opening(column: str) -> str:
    return f"""trim({rx(f"lower(coalesce({column}, ''))", "[^\\p{L}\\p{N}]+", " ")})"""


def _dedupe(table: str) -> dict[str, str]:
    """Tables named openings -> grouped (id, node, root, best): exact similarity of all texts of an opening."""
    return {
        "openings": f"""SELECT *, ck || chr(10) || tk || chr(10) || lk AS block FROM (
            SELECT id, {_CK} AS ck, {_opening("title")} AS tk, {_opening("description")} AS bk, lower({sql_collapse("coalesce(location, '')")}) AS lk,
              coalesce(description_complete, false) AS complete, length(coalesce(description, '')) AS chars FROM {table})
            WHERE ck <> '' AND tk <> '' AND bk <> ''""",
        "texts_of": """SELECT block, bk, row_number() OVER (ORDER BY block, bk) AS node, bool_or(complete) AS complete
            FROM openings GROUP BY block, bk""",
        "shingles": """SELECT DISTINCT block, node, complete, array_to_string(ws[i:i + 4], ' ') AS s FROM (
            SELECT block, node, complete, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM (
              SELECT *, string_split(bk, ' ') AS ws FROM texts_of))""",
        "sized": "SELECT *, count(*) OVER (PARTITION BY node) AS size FROM shingles",
        "pairs": f"""SELECT u, v FROM (SELECT a.node AS u, b.node AS v, count(*) AS common, any_value(a.size) AS sa, any_value(b.size) AS sb,
              any_value(a.complete) AS ca, any_value(b.complete) AS cb
            FROM sized a JOIN sized b ON a.block = b.block AND a.s = b.s AND a.node <> b.node GROUP BY a.node, b.node)
          WHERE 100 * common >= {SIMILAR} * (sa + sb - common)
            OR (NOT ca AND cb AND sa < sb AND sa >= {PROBES} AND 100 * common >= {SIMILAR} * sa)
            OR (NOT cb AND ca AND sb < sa AND sb >= {PROBES} AND 100 * common >= {SIMILAR} * sb)""",
        "roots": """SELECT node, min(root) AS root FROM (
            WITH RECURSIVE walk(node, root) AS (SELECT node, node FROM texts_of UNION SELECT p.v, w.root FROM walk w JOIN pairs p ON p.u = w.node)
            SELECT node, root FROM walk) GROUP BY node""",
        "grouped": """SELECT o.id, t.node, r.root, count(*) OVER (PARTITION BY r.root) AS copies,
              first_value(o.id) OVER (PARTITION BY r.root ORDER BY o.complete DESC, o.chars DESC, o.id) AS best
            FROM openings o JOIN texts_of t ON t.block = o.block AND t.bk = o.bk JOIN roots r ON r.node = t.node""",
    }


def _marked(table: str) -> str:
    return query(f"SELECT t.id, CASE WHEN g.best <> t.id THEN g.best END AS canonical_id FROM {table} t LEFT JOIN grouped g ON g.id = t.id",
                 **_dedupe(table))


@register("D01_dedupe_jobs", _marked("jobs"))
def _(w):
    return dd.assign_canonical(w.jobs).select("id", "canonical_id")


@register("D02_dedupe_documents", _marked("texts"))
def _(w):
    texts = w.derived(d.TEXTS).withColumn("canonical_id", F.lit(None).cast("string"))
    return dd.assign_canonical(texts).select("id", "canonical_id")


@register("D03_canonical_picks", query("""
    SELECT any_value(best) AS canonical, count(*) AS copies, count(DISTINCT node) AS texts FROM grouped GROUP BY root HAVING count(*) > 1""",
    **_dedupe("jobs")))
def _(w):
    return dd.canonical_picks(w.jobs)


@register("A12_repost_counts", query(
    "SELECT id, count(*) OVER (PARTITION BY coalesce(company, ''), coalesce(title, '')) AS repost_count FROM jobs"))
def _(w):
    return dd.repost_counts(w.jobs)


# -- enrichment ---------------------------------------------------------------

ENRICH = {
    "wanting": f"SELECT id, {_CK} AS ck, {_TK} AS tk FROM jobs WHERE NOT description_complete AND company <> ''",
    "keyed_boards": f"SELECT *, {_CK} AS ck FROM boards WHERE active",
    "keyed_posts": f"SELECT *, {_TK} AS tk FROM board_postings WHERE length(description) > 200",
    "bodies": """SELECT ck, tk, description AS body FROM (SELECT b.ck, p.tk, p.description, row_number() OVER (PARTITION BY b.ck, p.tk
        ORDER BY b.company, b.ats, b.token, p.ordinal) AS rn FROM keyed_boards b JOIN keyed_posts p ON p.ats = b.ats AND p.token = b.token) WHERE rn = 1""",
}


@register("J13_enrich_snippets", query("""
    SELECT j.id, md5(coalesce(b.body, j.description)) AS digest, CAST(j.description_complete OR b.body IS NOT NULL AS INTEGER) AS description_complete
    FROM jobs j LEFT JOIN wanting w ON w.id = j.id LEFT JOIN bodies b ON b.ck = w.ck AND b.tk = w.tk""", **ENRICH))
def _(w):
    out = en.enrich_snippets(w.jobs, w.boards, w.board_postings)
    return out.select("id", F.md5("description").alias("digest"), "description_complete")


@register("M09_enrich_summary", query("""
    SELECT count(*) AS candidates, count(b.body) AS enriched, count(*) - count(b.body) AS unmatched,
      (SELECT count(*) FROM keyed_boards WHERE ck IN (SELECT ck FROM wanting)) AS boards_queried
    FROM wanting w LEFT JOIN bodies b ON b.ck = w.ck AND b.tk = w.tk""", **ENRICH))
def _(w):
    return en.enrich_summary(w.jobs, w.boards, w.board_postings)


@register("A11_probe_companies", query(f"""
    SELECT company, 'ashby' AS ats, token, 1 + length(token) AS jobs FROM (SELECT DISTINCT company, array_to_string(list_filter(regexp_split_to_array(
      {rx(rx("lower(company)", "[.,''’]", ""), r"\b(" + "|".join(vocab.COMPANY_SUFFIXES) + r")\b", " ")}, '[^a-z0-9]+'), lambda x: x <> ''), '') AS token FROM boards)
    WHERE length(token) % 2 = 0"""))
def _(w):
    from tallyhire.functions.text import candidate_tokens

    names = w.boards.select("company").distinct()
    tokens = names.select("company", F.get(candidate_tokens("company"), F.lit(0)).alias("token"))
    answers = tokens.select(
        F.explode(F.array(F.lit("recruitee"), F.lit("ashby"))).alias("ats"), "token", F.col("company").alias("name"),
        F.when(F.length("token") % 2 == 0, 1 + F.length("token")).otherwise(0).cast("bigint").alias("jobs"))
    return en.probe_companies(names, answers)


# -- lifecycle ----------------------------------------------------------------


def _events(w):
    return w.derived(d.STATUS_EVENTS).withColumnRenamed("happened_at", "at")


_REPLAYED = f"""SELECT job_id, coalesce(arg_max(status, (happened_at, seq)) FILTER (kind = 'set'), 'viewed') AS status,
      min(happened_at) FILTER (kind = 'set' AND status = 'prepared') AS prepared_at, min(happened_at) FILTER (kind = 'set' AND status = 'submitted') AS submitted_at,
      coalesce(max(happened_at) FILTER (kind = 'set'), min(happened_at)) AS last_status_at,
      nullif(trim(arg_max(note, (happened_at, seq)) FILTER (note IS NOT NULL)), '') AS note, count(*) FILTER (note IS NOT NULL) > 0 AS noted,
      count(*) FILTER (kind = 'set') > 0 AS moved
    FROM status_events WHERE kind <> 'set' OR status IN ({quoted(d.APPLICATION_STATUSES)}) GROUP BY job_id"""
_APP_COLS = f"job_id, status, {ts('prepared_at')}, {ts('submitted_at')}, {ts('last_status_at')}, note"


@register("T02_replay_status_log", query(f"SELECT {_APP_COLS} FROM replayed", replayed=_REPLAYED))
def _(w):
    return lc.replay(_events(w)).drop("moved", "noted")


@register("T03_apply_updates", query(f"""
    SELECT coalesce(a.job_id, r.job_id) AS job_id, CASE WHEN a.job_id IS NULL OR r.moved THEN r.status ELSE a.status END AS status,
      {ts('coalesce(a.prepared_at, r.prepared_at)', 'prepared_at')}, {ts('coalesce(a.submitted_at, r.submitted_at)', 'submitted_at')},
      {ts('CASE WHEN a.job_id IS NULL OR r.moved THEN r.last_status_at ELSE a.last_status_at END', 'last_status_at')},
      CASE WHEN a.job_id IS NULL OR r.noted THEN r.note ELSE a.note END AS note
    FROM applications a FULL JOIN replayed r ON r.job_id = a.job_id""", replayed=_REPLAYED))
def _(w):
    return lc.apply_updates(w.applications, _events(w))


@register("T01_mark_viewed", query(f"""
    SELECT status, count(*) AS n FROM (SELECT coalesce(a.status, 'viewed') AS status FROM applications a FULL JOIN (SELECT id FROM jobs) j ON j.id = a.job_id)
    GROUP BY status"""))
def _(w):
    out = lc.mark_viewed(w.applications, w.jobs.select(F.col("id").alias("job_id")), w.now)
    return out.groupBy("status").agg(F.count("*").alias("n"))


@register("T04_mirror_to_jobs", query("""
    SELECT coalesce(CASE WHEN a.status IN ('rejected', 'closed', 'ghosted') THEN 'rejected' WHEN a.status = 'viewed' THEN NULL WHEN a.status IS NOT NULL THEN 'approved' END,
      j.review_status) AS review_status, count(*) AS n FROM jobs j LEFT JOIN applications a ON a.job_id = j.id GROUP BY 1"""))
def _(w):
    return lc.mirror_to_jobs(w.jobs, w.applications).groupBy("review_status").agg(F.count("*").alias("n"))


@register("T05_notes_and_untrack", query("""
    SELECT job_id, CASE WHEN ascii(right(job_id, 1)) % 2 = 0 THEN nullif(trim(note), '') ELSE note END AS note FROM (
      SELECT job_id, CASE WHEN ascii(right(job_id, 1)) % 2 = 0 THEN CASE WHEN ascii(right(job_id, 1)) % 4 = 0 THEN '   ' ELSE ' call ' || job_id || ' ' END ELSE note END AS note
      FROM applications WHERE status <> 'closed')"""))
def _(w):
    last = F.ascii(F.right(F.col("job_id"), F.lit(1)))
    notes = w.applications.filter(last % 2 == 0).select(
        "job_id", F.when(last % 4 == 0, "   ").otherwise(F.concat(F.lit(" call "), "job_id", F.lit(" "))).alias("note"))
    noted = lc.set_notes(w.applications, notes)
    return lc.untrack(noted, w.applications.filter("status = 'closed'")).select("job_id", "note")


@register("M18_apply_decisions", query(f"""
    SELECT review_status, count(*) AS n FROM (SELECT coalesce(f.decision, j.review_status) AS review_status FROM jobs j LEFT JOIN (
      SELECT job_id, arg_max(coalesce(decision, '~'), seq) AS decision FROM (SELECT job_id, seq, CASE CAST(seq % 3 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END AS decision
        FROM status_events) GROUP BY job_id HAVING arg_max(coalesce(decision, '~'), seq) <> '~') f ON f.job_id = j.id) GROUP BY review_status"""))
def _(w):
    decisions = _events(w).selectExpr("job_id", "seq", "CASE CAST(seq % 3 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END AS decision", "note")
    reviewed, _ = lc.apply_decisions(w.jobs, w.applications, decisions, w.now)
    return reviewed.groupBy("review_status").agg(F.count("*").alias("n"))


# -- judge stages -------------------------------------------------------------
# The judge here answers by arithmetic on the job id, so every stage can be checked.

_R = "ascii(right(job_id, 1)) % 5"


def _stub(answer: str):
    def judge(requests: DataFrame) -> DataFrame:
        return requests.selectExpr("job_id", f"CASE WHEN {_R} = 4 THEN 'no idea' ELSE {answer} END AS answer", "CAST(NULL AS STRING) AS error")

    return judge


_NORMALISED = ("""'{"seniority":"senior","yearsRequired":4,"employmentType":"contract","remote":"' || split_part('remote|remote-restricted|hybrid|unknown', '|', """
               f"CAST({_R} AS INT) + 1) || " + """'","remoteRestriction":null,"salaryMin":1000,"salaryMax":null,"salaryCurrency":"EUR","salaryPeriod":"monthly"}'""")


@register("G01_normalise_jobs", query(f"""
    SELECT seniority, employment_type, CAST(remote AS INTEGER) AS remote, salary_min, salary_currency, salary_period, count(*) AS n FROM (
      SELECT CASE WHEN hit THEN 'senior' ELSE seniority END AS seniority, CASE WHEN hit THEN 'contract' ELSE employment_type END AS employment_type,
        CASE WHEN hit THEN [true, true, false, NULL][r + 1] ELSE remote END AS remote, CASE WHEN hit THEN 1000 ELSE salary_min END AS salary_min,
        CASE WHEN hit THEN 'EUR' ELSE salary_currency END AS salary_currency, CASE WHEN hit THEN 'monthly' ELSE salary_period END AS salary_period
      FROM (SELECT *, ascii(right(id, 1)) % 5 AS r, id IN (SELECT id FROM jobs WHERE seniority IS NULL AND description <> '' AND canonical_id IS NULL)
        AND ascii(right(id, 1)) % 5 <> 4 AS hit FROM jobs)) GROUP BY ALL"""))
def _(w):
    out, _ = jg.normalise_jobs(w.jobs, _stub(_NORMALISED), limit=None)
    keys = ("seniority", "employment_type", "remote", "salary_min", "salary_currency", "salary_period")
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@register("G02_extract_judged_skills", query("""
    SELECT source, skill, requirement, count(*) AS n FROM (
      SELECT s.source, s.skill, s.requirement FROM job_skills s WHERE job_id NOT IN (SELECT id FROM asked WHERE r <> 4)
      UNION ALL SELECT 'ai', unnest(['kafka', 'go', 'cobol']), unnest(['required', 'preferred', 'preferred']) FROM asked WHERE r <> 4) GROUP BY ALL""",
    asked="""SELECT id, ascii(right(id, 1)) % 5 AS r FROM jobs WHERE description <> '' AND canonical_id IS NULL
        AND id NOT IN (SELECT job_id FROM job_skills WHERE source = 'ai')"""))
def _(w):
    answer = """'{"required":["Apache Kafka","golang"],"preferred":["Go","COBOL"]}'"""
    out, _ = jg.extract_judged_skills(w.jobs, w.job_skills, _stub(answer), limit=None)
    return out.groupBy("source", "skill", "requirement").agg(F.count("*").alias("n"))


_SCORED = """'{"score":' || CAST(1 + """ + _R + """ AS STRING) || ',"reason":"fits","concerns":["scope"],"roleTypeMatch":"different"}'"""


@register("G03_score_jobs", query("""
    SELECT ai_score, reason, model, count(*) AS n FROM (SELECT ai_score, CASE WHEN starts_with(reason, 'fit ') THEN 'earlier' END AS reason, model FROM scores
      UNION ALL SELECT CAST(least(1 + r, 2) AS INTEGER), 'fits', 'judge-b' FROM (SELECT ascii(right(m.job_id, 1)) % 5 AS r FROM matches m JOIN jobs j ON j.id = m.job_id
        WHERE m.match_score >= 0.3 AND j.canonical_id IS NULL AND m.job_id NOT IN (SELECT job_id FROM scores)) WHERE r <> 4) GROUP BY ALL"""))
def _(w):
    out, _ = jg.score_jobs(w.jobs, w.matches, w.scores, _stub(_SCORED), 0.3, w.now, "judge-b", limit=None)
    reason = F.when(F.col("reason").startswith("fit "), "earlier").otherwise(F.col("reason"))
    return out.groupBy("ai_score", reason.alias("reason"), "model").agg(F.count("*").alias("n"))


_TONE = """'{"wlbScore":3,"evidence":[],"redFlags":["on call"],"greenFlags":[],"interviewStages":2}'"""


@register("G04_compute_signals", query(f"""
    SELECT wlb_score, salary_vs_target, repost_count, count(*) AS n FROM (SELECT wlb_score, salary_vs_target, repost_count FROM signals
      UNION ALL SELECT CASE WHEN ascii(right(j.id, 1)) % 5 <> 4 THEN 3 END, CASE WHEN stated IS NULL OR given <> 'USD' THEN 'unknown' WHEN stated > 102000 THEN 'above'
        WHEN stated >= 98000 THEN 'within' ELSE 'below' END, reposts
      FROM (SELECT *, CAST(round(coalesce(salary_max, salary_min) * CASE lower(coalesce(salary_period, 'annual')) WHEN 'annual' THEN 1 WHEN 'monthly' THEN 12
          WHEN 'hourly' THEN 2080 END) AS BIGINT) AS stated, upper(trim(coalesce(salary_currency, ''))) AS given,
          count(*) OVER (PARTITION BY company, title) AS reposts FROM jobs) j JOIN matches m ON m.job_id = j.id
      WHERE m.match_score >= 0.3 AND j.canonical_id IS NULL AND j.id NOT IN (SELECT job_id FROM signals)) GROUP BY ALL"""))
def _(w):
    signals = w.signals.withColumn("wlb_evidence", F.array().cast("array<struct<quote: string, polarity: string, note: string>>"))
    out, _ = jg.compute_signals(w.jobs, w.matches, signals, _stub(_TONE), 0.3, 100_000, "USD", w.now, limit=None)
    return out.groupBy("wlb_score", "salary_vs_target", "repost_count").agg(F.count("*").alias("n"))


_DRAFTED = """'{"coverLetter":"' || repeat('Dear all, ', 9) || '","resumeNotes":["lead with pay"],"answers":[],"missingInformation":["notice period"]}'"""


@register("G05_draft_jobs", query("""
    SELECT j.id, CASE WHEN j.review_status IN ('new', 'scored') AND j.description <> '' AND m.match_score >= 0.3 AND ascii(right(j.id, 1)) % 5 <> 4
      THEN 'drafted' ELSE j.review_status END AS review_status FROM jobs j LEFT JOIN matches m ON m.job_id = j.id"""))
def _(w):
    bank = w.answers.groupBy("question").agg(F.max("answer").alias("answer"), F.count("*").alias("times_used"))
    jobs, _, _ = jg.draft_jobs(w.tables, bank, _stub(_DRAFTED), 0.3)
    return jobs.select("id", "review_status")


@register("X48_schema_validation", query("""
    SELECT count(*) AS considered, count(*) FILTER (user_id % 10 BETWEEN 1 AND 5) AS succeeded, count(*) FILTER (user_id % 10 NOT BETWEEN 1 AND 5) AS failed FROM events"""))
def _(w):
    answers = w.raw("events").selectExpr(
        "CAST(event_id AS STRING) AS job_id", "'{\"score\":' || user_id % 10 || ',\"reason\":\"r\",\"concerns\":[],\"roleTypeMatch\":\"same\"}' AS answer",
        "CAST(NULL AS STRING) AS error")
    results = jg.parsed(answers, "score int, reason string, concerns array<string>, roleTypeMatch string", jg._valid_score)
    return jg.stage_summary(results).drop("errors")


@register("F16_above_threshold", query(f"""
    SELECT job_id, {num('match_score')} FROM (SELECT m.job_id, m.match_score FROM matches m JOIN jobs j ON j.id = m.job_id
      WHERE m.match_score >= 0.3 AND j.canonical_id IS NULL AND j.location ILIKE '%india%' AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_id = m.job_id))"""))
def _(w):
    return jg.above_threshold(w.jobs, w.matches, w.scores, 0.3, location="India").select("job_id", "match_score")


# -- streams ------------------------------------------------------------------


def _stream(w, name: str) -> DataFrame:
    """A given table as a file stream."""
    batch = w.raw(name)
    stream = w.spark.readStream.schema(w.spark.read.parquet(f"{w.folder}/{name}.parquet").schema)
    df = stream.option("pathGlobFilter", f"{name}.parquet").parquet(w.folder)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in batch.schema.fields])


@register("T10_stream_weekly_spend", query(f"""
    SELECT {ts("date_trunc('week', called_at)", 'period_start')}, stage, count(*) AS calls FROM calls GROUP BY ALL"""))
def _(w):
    spend = _stream(w, "events").selectExpr(*d.CALLS.exprs()).withColumnRenamed("called_at", "at").withColumn(
        "estimated_usd", F.coalesce("reported_usd", F.lit(0.0)))
    out, cp = run_folder(w.spark, "weekly-spend"), run_folder(w.spark, "weekly-spend-cp")
    logs.run_batches(logs.spend_by_window(spend), out, cp)
    return w.spark.read.parquet(out).groupBy("period_start", "stage").agg(F.max("calls").alias("calls"))


@register("T11_stream_tracker_upsert", query(f"SELECT status, count(*) AS n FROM replayed GROUP BY status", replayed=_REPLAYED))
def _(w):
    events = _stream(w, "lineitem").selectExpr(*d.STATUS_EVENTS.exprs()).withColumnRenamed("happened_at", "at")
    base, cp = run_folder(w.spark, "tracker"), run_folder(w.spark, "tracker-cp")
    table = logs.VersionedTable(w.spark, base, w.applications.limit(0))
    logs.upsert_each_batch(events, cp, table.read, table.write, lc.apply_updates)
    return table.read().groupBy("status").agg(F.count("*").alias("n"))


_SILENT = f"""status IN ('submitted', 'responded', 'interviewing') AND last_status_at + INTERVAL '14' DAY <= (SELECT max(happened_at)
    - INTERVAL '1' DAY FROM status_events WHERE kind <> 'set' OR status IN ({quoted(d.APPLICATION_STATUSES)}))"""


@register("T13_stream_tracker_state", query(f"SELECT {_APP_COLS}, {flag(_SILENT, 'stale')} FROM replayed", replayed=_REPLAYED))
def _(w):
    """The tracker as keyed state of groups of applications, with timers that fire when nobody has answered for two weeks."""
    events = _stream(w, "lineitem").selectExpr(*d.STATUS_EVENTS.exprs()).withColumnRenamed("happened_at", "at")
    out, cp = run_folder(w.spark, "tracked"), run_folder(w.spark, "tracked-cp")
    tracker.with_keyed_state(w.spark)
    logs.run_to_files(tracker.track(events), out, cp)
    return tracker.newest(w.spark.read.parquet(out)).drop("events")
