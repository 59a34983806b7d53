"""Skill queries: extraction, resolution, profile, matching, ranking."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyhire import vocab
from tallyhire.operators import extract as ex
from tallyhire.operators import match as mt
from tallyhire.operators import profile as pf
from tallyhire.operators.skew import fill_cores
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.scalars import WRITTEN, sql_skill_text, sql_slug
from tallyhire.workload.sql import num, query, quoted


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ALIAS_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(a)}, {_q(s)})" for a, s in vocab.alias_to_slug().items()) + ") AS v(alias, canonical)"
VOCAB_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(s.slug)}, {_q(s.label)}, {_q(s.category)})" for s in vocab.skills()) + ") AS v(slug, label, category)"


def _context(term: str) -> str:
    t = re.escape(term)
    verb = rf"(?i)\b{t}[\s-]+(?:{'|'.join(vocab.VERB_CONTINUATIONS)})\b"
    yes = (
        rf"(?i)(?:[,/|•·:]\s*{t}\b)|(?:\b{t}\s*[,/|])",
        rf"(?i)\b(?:{'|'.join(vocab.ADJACENT_CUES)})\s+(?:the\s+)?{t}\b",
        rf"(?i)\b(?:{'|'.join(vocab.STRONG_CUES)})\b[^.!?\n]{{0,18}}\b{t}\b",
        rf"(?i)\b{t}\s+(?:{'|'.join(vocab.TECH_NOUNS)})\b",
    )
    return f"(NOT regexp_matches(orig, '{verb}') AND ({' OR '.join(f'regexp_matches(orig, {_q(p)})' for p in yes)}))"


_AMBIGUOUS = [t.term for t in vocab.search_terms() if t.ambiguous]
TERM_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"({t.rank}, {_q(t.term)}, {_q(t.slug)}, {_q('(^|[^a-z0-9])' + re.escape(t.term) + '([^a-z0-9]|$)')}, {str(t.ambiguous).lower()})"
    for t in vocab.search_terms()) + ") AS v(rank, term, slug, pattern, ambiguous)"


def _last(cues) -> str:
    pattern = f"(?s)^(.*)(?:{'|'.join(re.escape(c) for c in cues)})"
    return f"CASE WHEN regexp_matches(before, {_q(pattern)}) THEN length(regexp_extract(before, {_q(pattern)}, 1)) ELSE -1 END"


def extraction(source: str) -> dict[str, str]:
    """Tables named scan_texts (key, t) -> scan_found (key, slug, term, requirement, ordinal)."""
    gate = " ".join(f"WHEN '{t}' THEN {_context(t)}" for t in _AMBIGUOUS)
    return {
        "scan_texts": source,
        "scan_terms": TERM_VALUES,
        "scan_norm": f"SELECT key, {sql_skill_text('t')} AS norm, lower(t) AS orig FROM scan_texts",
        "scan_hits": f"""SELECT key, norm, rank, term, slug FROM scan_norm JOIN scan_terms ON contains(norm, term)
            WHERE regexp_matches(norm, pattern) AND (NOT ambiguous OR CASE term {gate} END)""",
        "scan_first": """SELECT * FROM scan_hits QUALIFY row_number() OVER (PARTITION BY key, slug ORDER BY rank) = 1""",
        "scan_before": """SELECT key, slug, term, rank, substr(norm, 1, instr(norm, term) - 1) AS before
            FROM scan_first""",
        "scan_found": f"""SELECT key, slug, term, CASE WHEN {_last(vocab.PREFERRED_CUES)} > {_last(vocab.REQUIRED_CUES)} THEN 'preferred' ELSE 'required' END
            AS requirement, CAST(row_number() OVER (PARTITION BY key ORDER BY rank) - 1 AS INTEGER) AS ordinal FROM scan_before""",
    }


JOB_TEXTS = "SELECT id AS key, title || chr(10) || description AS t FROM jobs"
SCAN_SQL = "SELECT key, f.slug, v.label, v.category, requirement, term AS evidence, ordinal FROM scan_found f JOIN vocabulary v ON v.slug = f.slug"


@register("M01_extract_skills_jobs", query(SCAN_SQL, vocabulary=VOCAB_VALUES, **extraction(JOB_TEXTS)))
def _(w):
    texts = w.job_texts.select(F.col("id").alias("key"), "title", "description")
    return ex.extract_skills(texts, "key", F.concat_ws("\n", "title", "description"))


@register("M01_extract_skills_documents", query(SCAN_SQL, vocabulary=VOCAB_VALUES,
                                                **extraction("SELECT doc_id AS key, text AS t FROM documents")))
def _(w):
    return ex.extract_skills(fill_cores(w.raw("documents").select(F.col("doc_id").alias("key"), "text")), "key", F.col("text"))


@register("M02_ambiguous_context", query(f"""
    SELECT {', '.join(f'count(*) FILTER ({_context(t)}) AS "{t}"' for t in _AMBIGUOUS)} FROM
      (SELECT lower(title || chr(10) || description) AS orig FROM jobs)"""))
def _(w):
    orig = F.lower(F.concat_ws("\n", "title", "description"))
    return w.job_texts.select(orig.alias("orig")).agg(*[
        F.count_if(ex.has_skill_context(F.col("orig"), t)).alias(t) for t in _AMBIGUOUS])


@register("M03_requirement_split", query(
    "SELECT requirement, slug, count(*) AS n FROM scan_found GROUP BY requirement, slug", **extraction(JOB_TEXTS)))
def _(w):
    found = ex.extract_skills(w.job_texts.select("id", "title", "description"), "id", F.concat_ws("\n", "title", "description"))
    return found.groupBy("requirement", "slug").agg(F.count("*").alias("n"))


RESOLVED = {
    **WRITTEN, "aliases": ALIAS_VALUES,
    "resolved": f"""SELECT p_partkey, label, CASE WHEN n = '' THEN NULL WHEN a.canonical IS NOT NULL THEN a.canonical
        WHEN length(n) < 2 OR s = '' THEN NULL ELSE coalesce(b.canonical, s) END AS slug
      FROM (SELECT p_partkey, label, {sql_skill_text('label')} AS n, {sql_slug('label')} AS s FROM written) w
      LEFT JOIN aliases a ON a.alias = w.n LEFT JOIN aliases b ON b.alias = w.s""",
}


@register("X08_resolve_alias", query("SELECT p_partkey, label, slug FROM resolved", **RESOLVED))
def _(w):
    return ex.resolve_labels(w.derived(d.WRITTEN), "label")


@register("X09_learn_alias", query(f"""
    SELECT alias, min(slug) AS canonical FROM (SELECT {sql_skill_text('p_name')} AS alias, 'part-' || p_size AS slug FROM part)
    WHERE alias <> '' AND alias NOT IN (SELECT alias FROM aliases) AND alias NOT IN ('red widget')
    GROUP BY alias UNION ALL SELECT 'red widget', 'taken'""", aliases=ALIAS_VALUES))
def _(w):
    parts = w.raw("part")
    learned = parts.filter("p_name = 'red widget'").select(F.col("p_name").alias("alias"), F.lit("taken").alias("canonical")).distinct()
    proposed = parts.select(F.col("p_name").alias("alias"), F.concat(F.lit("part-"), F.col("p_size").cast("string")).alias("canonical"))
    return ex.learn_alias(w.spark, learned, proposed)


@register("X10_label_and_category", query("""
    SELECT skill, coalesce(v.label, skill) AS label, coalesce(category, 'other') AS category, n
    FROM (SELECT skill, count(*) AS n FROM job_skills GROUP BY skill) s LEFT JOIN vocabulary v ON v.slug = s.skill""", vocabulary=VOCAB_VALUES))
def _(w):
    counted = w.job_skills.groupBy("skill").agg(F.count("*").alias("n"))
    return ex.label_skills(counted, "skill")


# Three spellings per part; the second and third often name the skill of the first.
LISTED = "SELECT p_partkey, label, ordinal FROM (SELECT p_partkey, unnest([label, upper(label), 'K8s']) AS label, unnest([0, 1, 2]) AS ordinal FROM written)"


@register("M04_normalise_skill_list", query(f"""
    SELECT r.p_partkey, r.slug, coalesce(v.label, r.slug) AS label, coalesce(v.category, 'other') AS category, r.evidence, 'required' AS requirement FROM (
      SELECT p_partkey, slug, label AS evidence FROM (SELECT w.p_partkey, w.label, w.ordinal, CASE WHEN n = '' THEN NULL WHEN a.canonical IS NOT NULL THEN a.canonical
          WHEN length(n) < 2 OR s = '' THEN NULL ELSE coalesce(b.canonical, s) END AS slug
        FROM (SELECT *, {sql_skill_text('label')} AS n, {sql_slug('label')} AS s FROM listed) w
        LEFT JOIN aliases a ON a.alias = w.n LEFT JOIN aliases b ON b.alias = w.s) WHERE slug IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY p_partkey, slug ORDER BY ordinal) = 1) r
    LEFT JOIN vocabulary v ON v.slug = r.slug""", vocabulary=VOCAB_VALUES, listed=LISTED, aliases=ALIAS_VALUES, **WRITTEN))
def _(w):
    lists = w.derived(d.WRITTEN).select("p_partkey", F.array("label", F.upper("label"), F.lit("K8s")).alias("labels"))
    return ex.normalise_skill_list(lists, "p_partkey", "labels").drop("ordinal")


def _twice(s: str) -> str:
    return "".join(ch if ch.isascii() and ch.isalnum() else ch * 2 for ch in s)


# Separators are doubled so that neighbouring mentions do not share one.
SPELLINGS = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(s.slug)}, {_q('[^a-z0-9]' + re.escape(_twice(sp)) + '[^a-z0-9]')})" for s in vocab.skills() for sp in s.spellings()
) + ") AS v(slug, pattern)"


@register("M05_build_profile", query(r"""
    SELECT f.key, f.slug AS skill, v.label, v.category, m.mentions,
      CASE WHEN mentions >= 4 THEN 'strong' WHEN mentions >= 2 THEN 'working' ELSE 'exposure' END AS level,
      nullif(trim(list_filter(ls, lambda x: length(x) = longest)[1], ' ' || chr(9) || chr(10) || chr(13)), '') AS evidence
    FROM (SELECT key, slug, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)')) AS ls,
        list_max(list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)')), lambda x: length(x))) AS longest
      FROM scan_found JOIN scan_texts USING (key)) f
    JOIN (SELECT key, slug, CAST(sum(len(regexp_extract_all(doubled, pattern))) AS INTEGER) AS mentions FROM (
        SELECT f.key, f.slug, p.pattern, '  ' || regexp_replace(lower(t), '([^a-z0-9])', '\1\1', 'g') || '  ' AS doubled
        FROM scan_found f JOIN scan_texts USING (key) JOIN spellings p ON p.slug = f.slug) GROUP BY key, slug) m ON m.key = f.key AND m.slug = f.slug
    JOIN vocabulary v ON v.slug = f.slug""", vocabulary=VOCAB_VALUES, spellings=SPELLINGS,
    **extraction("SELECT doc_id AS key, text AS t FROM documents")))
def _(w):
    return pf.profile_from_text(fill_cores(w.raw("documents").select(F.col("doc_id").alias("key"), "text")), "key", "text")


@register("X43_level_from_mentions", query("""
    SELECT level, count(*) AS n FROM (SELECT CASE WHEN n >= 4 THEN 'strong' WHEN n >= 2 THEN 'working' ELSE 'exposure' END AS level
      FROM (SELECT l_suppkey % 5 AS n FROM lineitem)) GROUP BY level"""))
def _(w):
    level = pf.level_from_mentions(F.col("l_suppkey") % 5)
    return w.raw("lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


MATCH_SQL = f"""SELECT job_id, matched_required, total_required, matched_preferred, total_preferred, {num('weighted_required')}, {num('preferred')},
    {num('seniority')}, {num('domain')}, {num('coverage')}, {num('match_score')} FROM matches"""


@register("M06_match_jobs", query(MATCH_SQL))
def _(w):
    return mt.score_matches(w.job_skills, w.profile)


_YEARS = "CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE k % 17 END AS DOUBLE)"


@register("M06_seniority_fit", query(f"""
    SELECT job_id, {num('fit', 'seniority')}, round(0.6 * weighted_required + 0.2 * preferred + 0.15 * fit + 0.05 * domain, 6) AS match_score FROM (
      SELECT m.*, CASE WHEN y IS NULL THEN 0.5 WHEN y <= 6 THEN CASE WHEN 6 - y <= 3 THEN 1.0 ELSE greatest(0, 1 - (6 - y - 3) / 10.0) END
        ELSE greatest(0, 1 - (y - 6) / 5.0) END AS fit
      FROM matches m LEFT JOIN (SELECT id, {_YEARS} AS y FROM jobs) j ON j.id = m.job_id)"""))
def _(w):
    years = w.jobs.select(F.col("id").alias("job_id"), F.expr(_YEARS).alias("years"))
    return mt.score_matches(w.job_skills, w.profile, years=years, my_years=6).select("job_id", "seniority", "match_score")


@register("J11_match_skills", query("""
    SELECT CASE WHEN level IS NULL THEN 'missing' ELSE 'matched' END AS kind, CAST(requirement = 'preferred' AS INTEGER) AS preferred, s.skill, count(*) AS n
    FROM job_skills s LEFT JOIN profile p ON p.skill = s.skill GROUP BY ALL"""))
def _(w):
    return mt.match_skills(w.job_skills, w.profile).groupBy("kind", "preferred", "skill").agg(F.count("*").alias("n"))


# Ranking reads the skill rows without those of one posting in sixteen, so that there are postings to scan.
# Postings without recorded skills are scanned; their rows join the recorded ones.
RECORDED = "substr(job_id, -1) <> '7'"


def _recorded(w):
    return w.job_skills.filter(RECORDED)


RANK_CTES = {
    **extraction("""SELECT id AS key, title || chr(10) || description AS t FROM jobs WHERE canonical_id IS NULL AND description <> ''
        AND id NOT IN (SELECT job_id FROM job_skills)"""),
    "job_skills_all": """SELECT job_id, skill, requirement FROM job_skills WHERE job_id IN (SELECT id FROM jobs WHERE canonical_id IS NULL)
        UNION ALL SELECT key, slug, requirement FROM scan_found""",
}


def _ranked(body: str) -> str:
    from tallyhire.workload.sql import _CTES

    extra = {"job_skills": f"SELECT * FROM ({_CTES['job_skills']}) AS recorded WHERE {RECORDED}", **RANK_CTES}
    for name in ("match_counts", "match_parts", "matches"):
        sql = _CTES[name].replace("FROM job_skills s", "FROM job_skills_all s")
        for other in ("match_counts", "match_parts"):
            sql = sql.replace(f"FROM {other}", f"FROM all_{other}")
        extra[f"all_{name}"] = sql
    return query(body, **extra)


@register("M07_rank_all", _ranked(f"""SELECT job_id, matched_required, total_required, {num('coverage')}, {num('match_score')},
    (SELECT fp FROM fingerprint) AS profile_fingerprint FROM all_matches"""))
def _(w):
    r = mt.rank_all(w.jobs, _recorded(w), w.profile, w.now)
    return r.matches.select("job_id", "matched_required", "total_required", "coverage", "match_score", "profile_fingerprint")


@register("A17_rank_summary", _ranked("""SELECT (SELECT count(*) FROM jobs WHERE canonical_id IS NULL) AS considered,
    (SELECT count(DISTINCT key) FROM scan_found) AS extracted, count(*) AS ranked,
    count(*) FILTER (match_score >= 0.35) AS above_threshold, (SELECT count(*) FROM jobs WHERE canonical_id IS NULL) - count(*) AS skipped FROM all_matches"""))
def _(w):
    return mt.rank_all(w.jobs, _recorded(w), w.profile, w.now).summary


@register("J05_rank_only_new", query("""
    SELECT count(*) AS considered FROM jobs WHERE canonical_id IS NULL AND id NOT IN (SELECT job_id FROM matches WHERE profile_fingerprint IS NOT NULL)"""))
def _(w):
    ranked = w.matches.filter("profile_fingerprint IS NOT NULL")
    return mt.rank_all(w.jobs, w.job_skills, w.profile, w.now, only_new_to=ranked).summary.select("considered")


@register("V23_rerank_all", _ranked("""
    SELECT CAST(floor(match_score * 20) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT round(match_score, 9) AS match_score FROM all_matches) GROUP BY 1"""))
def _(w):
    m = mt.rank_all(w.jobs, _recorded(w), w.profile, w.now).matches
    return m.groupBy(F.floor(F.round("match_score", 9) * 20).alias("bucket")).agg(F.count("*").alias("n"))


@register("M08_ranking_freshness", query("""
    SELECT count(*) FILTER (profile_fingerprint = (SELECT fp FROM fingerprint)) AS current,
      count(*) FILTER (profile_fingerprint <> (SELECT fp FROM fingerprint)) AS stale, count(*) FILTER (profile_fingerprint IS NULL) AS unknown
    FROM matches"""))
def _(w):
    return mt.ranking_freshness(w.matches, w.profile)


@register("V08_skill_gaps", query("""
    SELECT skill AS slug, min(label) AS label, count(DISTINCT job_id) AS jobs FROM job_skills WHERE skill NOT IN (SELECT skill FROM profile)
    GROUP BY skill ORDER BY jobs DESC, slug LIMIT 20"""))
def _(w):
    return pf.skill_gaps(w.job_skills, w.profile, 20)


@register("V20_load_profile", query(f"""SELECT skill, label, category, level, years, CAST(pinned AS INTEGER) AS pinned FROM profile"""))
def _(w):
    return pf.load_profile(w.profile).select("skill", "label", "category", "level", "years", "pinned")


@register("V20_profile_by_category", query(f"""
    SELECT category, CAST(list_position([{quoted(vocab.CATEGORIES)}], category) - 1 AS INTEGER) AS category_order, count(*) AS n FROM profile GROUP BY category"""))
def _(w):
    return pf.profile_by_category(w.profile).groupBy("category", "category_order").agg(F.count("*").alias("n"))


@register("A16_profile_summary", query("""
    SELECT category, count(*) AS n, string_agg(label || ' (' || level || CASE WHEN coalesce(years, 0) <> 0 THEN ', ' || CAST(years AS BIGINT) || 'y' ELSE '' END || ')',
      ', ' ORDER BY skill) AS skills FROM profile GROUP BY category"""))
def _(w):
    return pf.profile_summary(w.profile)
