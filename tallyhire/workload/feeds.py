"""Source queries: responses built from the orders, read by each source, checked against the fields they were built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.text import job_id, once
from tallyhire.sources import ingest as ig
from tallyhire.sources.feeds import SPECS
from tallyhire.sources.spec import SearchQuery
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.sql import query

K = "o_orderkey"
BASE = d.Derived("orders", {
    "k": K,
    "sid": d.text(K),
    "title": d.title(K),
    "co": f"{d.pick('o_custkey % 7', d.STEMS)} || ' ' || {d.text('o_custkey')}",
    "loc": d.pick(f"{K} % 5", ("Chennai, India", "Remote", "London", "Hybrid - Berlin", "Pune")),
    "snippet": f"'Know ' || {d.pick(f'{K} % 10', d.ASKS)} || ' well'",
    "html": f"'<div><p>We build ' || {d.pick(f'{K} % 6', d.EXTRAS)} || ' &amp; more.</p><ul><li>Know ' || {d.pick(f'{K} % 10', d.ASKS)} || '</li></ul>Bye&nbsp;now</div>'",
    "plain": f"'We build ' || {d.pick(f'{K} % 6', d.EXTRAS)} || ' & more.' || chr(10) || '• Know ' || {d.pick(f'{K} % 10', d.ASKS)} || chr(10) || 'Bye now'",
    "url": f"'https://x.example/' || {d.text(K)}",
    "tag": d.pick(f"{K} % 4", ("java", "data", "go", "sales")),
    "lo": "CAST(floor(o_totalprice / 10) AS DOUBLE)",
    "hi": "CAST(floor(o_totalprice / 5) AS DOUBLE)",
    "posted": "o_orderdate",
}, costly=True)
FAILED = "k % 17 = 0"
QUERY = SearchQuery(terms=("data engineer", "payments"), max_age_days=1500)
_WORDS = "list_has_any(regexp_split_to_array(lower({0}), '[^a-z0-9+#.]+'), ['data', 'engineer', 'payments'])"
_YOUNG = f"(epoch_ms(TIMESTAMP '{d.NOW}') - epoch_ms(posted)) / 86400000.0 <= 1500"
_LOOKS = """CASE WHEN regexp_matches(lower({0} || ' ' || title), '\\b(remote|work from home|wfh|anywhere|distributed)\\b') THEN 1
      WHEN regexp_matches(lower({0} || ' ' || title), '\\b(on-?site|in-?office|hybrid)\\b') THEN 0 END"""
_DAY = "strftime(posted, '%Y-%m-%d')"

def iso() -> Column:
    return F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch() -> Column:
    return F.unix_seconds("posted")


def millis() -> Column:
    return F.unix_millis("posted")


def s(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items()])


def one(record: Column) -> Column:
    return F.array(record)


def payloads(w, body: Column, kind: str | None = None, failing: bool = False) -> DataFrame:
    """One response per order; some fail when asked to."""
    base = once(w.derived(BASE), body=F.to_json(body))
    return base.select(
        F.col("k").alias("seq"), F.lit(kind).cast("string").alias("kind"), F.col("co").alias("board_company"),
        F.concat(F.lit("tok"), "sid").alias("board_token"), "body", F.lit(None).cast("int").alias("http_status"),
        (F.when(F.expr(FAILED), "HTTP 500") if failing else F.lit(None)).cast("string").alias("error"),
    )


def shown(df: DataFrame) -> DataFrame:
    from tallyhire.functions.dates import parse_posted_at

    return df.select(
        job_id(F.col("engine"), F.col("native_id"), F.col("apply_url")).alias("id"), "company", "title", "location", "apply_url",
        "description", "description_complete", "remote", F.col("salary.min").alias("salary_min"),
        F.col("salary.max").alias("salary_max"), F.col("salary.currency").alias("currency"), F.col("salary.period").alias("period"),
        F.col("salary.state").alias("salary_state"), F.date_format(parse_posted_at("posted_at"), "yyyy-MM-dd").alias("posted"),
        "employment_type", "skills",
    )


def source(name: str, body, where: str = "true", kind: str | None = None, failing: bool = False, native: str = "sid",
           more=None, query_: SearchQuery = QUERY, **expected: str) -> None:
    """Register one source.  ``body`` builds a response from the base columns; ``expected`` overrides the columns its records should have."""
    columns = {
        "company": "co", "title": "title", "location": "loc", "apply_url": "url", "description": "plain",
        "description_complete": "1", "remote": _LOOKS.format("loc"), "salary_min": "NULL::DOUBLE", "salary_max": "NULL::DOUBLE",
        "currency": "''", "period": "'annual'", "salary_state": "'absent'", "posted": _DAY, "employment_type": "NULL::VARCHAR",
        "skills": "''", **expected,
    }
    ident = f"'{name}-' || sha1('{name}:' || {native}) AS id"
    sql = query(f"SELECT {ident}, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM base WHERE {where}", base=BASE.sql())

    def run(w):
        frames = payloads(w, body(), kind, failing)
        if more is not None:
            frames = frames.unionByName(more(w))
        return shown(ig.run_source(SPECS[name], frames, query_, w.now))

    register(f"S_{name}", sql)(run)


_PAID = {"salary_min": "lo", "salary_max": "hi", "salary_state": "'disclosed'"}
_KEPT = f"NOT ({FAILED})"
_TAGGED = f"{_WORDS.format('title || chr(32) || tag')} AND {_YOUNG}"

def _esc() -> Column:
    return F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


source("greenhouse", lambda: s(jobs=one(s(id="k", title="title", absolute_url="url", company_name=F.when(F.col("k") % 2 == 0, F.col("co")),
                                  location=s(name="loc"), updated_at=iso(), content=_esc()))), _KEPT, failing=True)
source("lever", lambda: one(s(id="sid", text="title", hostedUrl="url", description="html", additionalPlain="snippet", createdAt=millis(),
                      categories=s(location="loc", commitment=F.lit(" Full-time ")))),
       description="plain || chr(10) || chr(10) || snippet", employment_type="'Full-time'")
source("ashby", lambda: s(jobs=one(s(id="sid", title="title", location="loc", secondaryLocations=F.array(s(location=F.lit("Goa")), s(location="loc")),
                             isRemote=F.when(F.col("k") % 3 == 0, F.lit(False)), isListed=F.col("k") % 7 != 0, publishedAt=iso(),
                             descriptionHtml="html"))), f"k % 7 <> 0 AND {_KEPT}", failing=True, location="loc || '; Goa'",
       apply_url="'https://jobs.ashbyhq.com/tok' || sid || '/' || sid",
       remote=f"CASE WHEN k % 3 = 0 THEN 0 ELSE {_LOOKS.format('loc')} END")
source("recruitee", lambda: s(offers=one(s(id="k", title="title", city="loc", careers_url="url", description="html", requirements="snippet",
                                   published_at=F.date_format("posted", "yyyy-MM-dd HH:mm:ss 'UTC'"), company_name="co",
                                   tags=F.array("tag", F.lit(" ")), remote=F.lit(True), hybrid=F.col("k") % 2 == 0))),
       description="plain || chr(10) || chr(10) || snippet", remote="CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END", skills="tag")
source("workable", lambda: s(name="co", jobs=one(s(shortcode="sid", title="title", description="html", benefits="snippet", url="url",
                                          published_on=iso(), telecommuting=F.when(F.col("k") % 2 == 0, True),
                                          location=F.when(F.col("k") % 3 == 0, s(city="loc", country=F.lit("IN"))), city="tag"))),
       location="CASE WHEN k % 3 = 0 THEN loc || ', IN' ELSE tag END", description="plain || chr(10) || chr(10) || snippet",
       remote=f"CASE WHEN k % 2 = 0 THEN 1 ELSE {_LOOKS.format('CASE WHEN k % 3 = 0 THEN loc ELSE tag END')} END")
source("smartrecruiters", lambda: s(content=one(s(id="sid", name="title", releasedDate=iso(), company=s(name="co"), location=s(city="loc")))),
       kind="list", more=lambda w: payloads(w, s(id="sid", jobAd=s(sections=F.create_map(
           F.lit("a"), s(title=F.lit("t"), text=F.col("html")), F.lit("b"), s(title=F.lit("t"), text=F.lit("<p></p>")),
           F.lit("c"), s(title=F.lit("t"), text=F.col("snippet"))))), "detail", failing=True),
       apply_url="'https://jobs.smartrecruiters.com/tok' || sid || '/' || sid",
       description=f"CASE WHEN {FAILED} THEN '' ELSE plain || chr(10) || chr(10) || snippet END",
       description_complete=f"CASE WHEN {FAILED} THEN 0 ELSE 1 END")
source("remoteok", lambda: F.array(s(legal=F.when(F.col("k") % 9 == 0, "terms"), id="sid", position="title", company="co", description="html",
                             url="url", epoch=epoch(), tags=F.array("tag"), salary_min="lo", salary_max=F.lit(0))),
       f"k % 9 <> 0 AND {_TAGGED}", location="'Remote'", remote="1", salary_min="lo", currency="'USD'", salary_state="'disclosed'", skills="tag")
source("arbeitnow", lambda: s(data=one(s(slug="sid", company_name="co", title="title", description="html", url="url", location="loc",
                                 tags=F.array("tag"), job_types=F.array(F.lit("contract")), created_at=epoch()))), _TAGGED,
       employment_type="'contract'", skills="tag")
source("themuse", lambda: s(results=F.array(*[s(id="sid", name="title", contents="html", publication_date=iso(), locations=F.array(s(name="loc"), s(name="tag")),
                                        categories=F.array(s(name="tag")), company=s(name="co"), refs=s(landing_page="url"))] * 2)),
       _TAGGED, location="loc || ' · ' || tag", remote=_LOOKS.format("loc || ' · ' || tag"), skills="tag")
source("remotive", lambda: s(jobs=one(s(id="k", url="url", title="title", company_name="co", tags=F.array("tag"), job_type=F.lit("full_time"),
                                publication_date=iso(), candidate_required_location=F.when(F.col("k") % 2 == 0, "USA"), description="html"))),
       _TAGGED, location="CASE WHEN k % 2 = 0 THEN 'USA' ELSE 'Remote' END", remote="1", employment_type="'full_time'", skills="tag")
source("himalayas", lambda: s(jobs=one(s(title="title", companyName="co", minSalary="lo", maxSalary="hi", salaryPeriod=F.lit("monthly"),
                                 locationRestrictions=F.when(F.col("k") % 2 == 0, F.array("tag", F.lit("IN"))), categories=F.array(F.lit("data-eng")),
                                 excerpt="html", pubDate=epoch(), guid="url"))), _YOUNG, native="url",
       location="CASE WHEN k % 2 = 0 THEN 'Remote (' || tag || ', IN)' ELSE 'Remote (worldwide)' END", remote="1", currency="'USD'",
       period="'monthly'", skills="'data eng'", **_PAID)
source("jobicy", lambda: s(jobs=one(s(id="k", url="url", jobTitle="title", companyName="co", jobIndustry=F.array("tag"), jobType=F.array(F.lit("ft")),
                              jobGeo=F.when(F.col("k") % 2 == 0, "anywhere").otherwise(F.col("loc")), jobDescription="html", pubDate=iso()))),
       _TAGGED, location="CASE WHEN k % 2 = 0 THEN 'Remote (worldwide)' ELSE 'Remote (' || loc || ')' END", remote="1",
       employment_type="'ft'", skills="tag")

def _hn() -> Column:
    return F.concat("co", F.lit(" | "), F.replace("title", F.lit(" (Remote)"), F.lit("")), F.lit(" | "), F.lit("ONSITE "), "loc", F.lit(" | $120k<p>Salary: $100,000 - $120,000</p>"), "html")


source("hackernews", lambda: s(hits=one(s(objectID="sid", parent_id=F.when(F.col("k") % 3 == 0, F.lit(77)).otherwise(F.col("k")), created_at=iso(), comment_text=_hn()))),
       f"(k % 3 = 0 OR k = 77) AND {_WORDS.format('title || chr(32) || co')}", kind="comments",
       more=lambda w: payloads(w, s(hits=F.array(s(objectID=F.lit("76"), title=F.lit("Ask HN: Who wants to be hired? Who is hiring")),
                                                 s(objectID=F.lit("77"), title=F.lit("Ask HN: Who is hiring?")))), "stories"),
       location="'ONSITE ' || loc", apply_url="'https://news.ycombinator.com/item?id=' || sid",
       title="replace(title, ' (Remote)', '')", description="co || ' | ' || replace(title, ' (Remote)', '') || ' | ONSITE ' || loc || ' | $120kSalary: $100,000 - $120,000' || chr(10) || plain",
       remote=_LOOKS.format("'ONSITE ' || loc").replace("' ' || title", "' '"), salary_min="100000::DOUBLE", salary_max="120000::DOUBLE", currency="'USD'", salary_state="'parsed'")
source("foundit", lambda: s(jobSearchResponse=s(data=F.array(*[s(jobId="k", title="title", companyName="co", locations="loc", redirectUrl=F.lit(""),
                                                        seoJdUrl=F.concat(F.lit("job/"), "sid"), createdAt=millis(), skills=F.concat("tag", F.lit(", sql")),
                                                        minimumSalary=s(currency=F.lit(None).cast("string"), absoluteValue="lo"), maximumSalary=s(absoluteValue=F.lit(0)),
                                                        hideSalary=F.col("k") % 2 == 0)] * 2))),
       apply_url="'https://www.foundit.in/job/' || sid", description="''", description_complete="0", skills="tag || '|sql'",
       salary_min="CASE WHEN k % 2 = 1 THEN lo END", currency="CASE WHEN k % 2 = 1 THEN 'INR' ELSE '' END",
       salary_state="CASE WHEN k % 2 = 1 THEN 'disclosed' ELSE 'absent' END")
source("instahyre", lambda: s(objects=one(s(id="k", candidate_title="title", locations=F.concat("tag", F.lit(",Pune, ")), keywords=F.array("tag"),
                                    public_url="url", employer=s(company_name="co")))),
       location="tag || ', Pune'", description="''", description_complete="0", remote=_LOOKS.format("tag"), posted="NULL::VARCHAR", skills="tag")
source("adzuna", lambda: s(results=one(s(id="sid", title="title", description="snippet", redirect_url="url", created=iso(), salary_min="lo", salary_max="hi",
                                 salary_is_predicted=F.when(F.col("k") % 2 == 0, "1").otherwise("0"), company=s(display_name="co"),
                                 location=s(display_name="loc"), category=s(label="tag")))), _TAGGED, description="trim(snippet)",
       description_complete="0", remote="NULL::INTEGER", salary_min="lo", salary_max="hi", currency="'INR'",
       salary_state="CASE WHEN k % 2 = 0 THEN 'estimated' ELSE 'disclosed' END")

def _from() -> Column:
    return F.concat(F.lit("₹"), (F.col("k") % 9 + 10).cast("string"), F.lit(",00,000 - ₹30,00,000 per year"))


source("careerjet", lambda: s(jobs=F.array(*[s(title="title", description="snippet", company="co", locations="loc", url="url", salary=_from(),
                                       date=F.date_format("posted", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))] * 2)), _WORDS.format("title"), native="url",
       description="trim(snippet)", description_complete="0", salary_min="((k % 9 + 10) * 100000)::DOUBLE", salary_max="3000000::DOUBLE",
       currency="'INR'", salary_state="'parsed'")
source("jooble", lambda: s(jobs=one(s(id="k", title="title", location="loc", snippet="snippet", salary=F.lit("$40 - $50 per hour"), type=F.lit("Contract"),
                              link="url", company="co", updated=iso()))), _WORDS.format("title"), description="trim(snippet)", description_complete="0",
       salary_min="40::DOUBLE", salary_max="50::DOUBLE", currency="'USD'", period="'hourly'", salary_state="'parsed'", employment_type="'Contract'")
source("jobspy", lambda: s(jobs=one(s(id="sid", site=F.lit("indeed"), title="title", company="co", location="loc", job_url="url", description="snippet",
                              date_posted=F.date_format("posted", "yyyy-MM-dd"), is_remote=F.col("k") % 2 == 0, min_amount="lo", max_amount="hi",
                              interval=F.lit("yearly"))), errors=F.create_map(F.lit("google"), F.lit("blocked"))), native="'indeed:' || sid",
       description="trim(snippet)", remote=f"CASE WHEN k % 2 = 0 THEN 1 ELSE {_LOOKS.format('loc')} END", currency="'INR'", **_PAID)


# -- fan-in and outcomes ------------------------------------------------------

def _several(w) -> dict[str, DataFrame]:
    greenhouse = payloads(w, s(jobs=one(s(id="k", title="title", absolute_url="url", company_name="co", content="html"))), failing=True)
    jooble = payloads(w, s(jobs=one(s(id="k", title="title", link="url", company="co", snippet="snippet"))))
    careerjet = payloads(w, s(jobs=one(s(title="title", url="url", company="co")), error=F.when(F.col("k") % 100 == 0, "bad affid")))
    lever = payloads(w, s(message=F.lit("not found")))
    workable = payloads(w, s(jobs=F.array())).withColumn("error", F.lit("request timed out")).withColumn("http_status", F.lit(429))
    return {"greenhouse": greenhouse, "jooble": jooble, "careerjet": careerjet, "lever": lever, "workable": workable}


ANY = SearchQuery(max_age_days=1e9)


@register("S0a_run_sources", query(f"""
    SELECT engine, count(*) AS n FROM (SELECT 'greenhouse' AS engine FROM base WHERE {_KEPT} UNION ALL SELECT 'jooble' FROM base) GROUP BY engine""",
    base=BASE.sql()))
def _(w):
    return ig.run_sources(_several(w), ANY, w.now).groupBy("engine").agg(F.count("*").alias("n"))


@register("S0c_run_outcomes", query(f"""
    SELECT 'greenhouse' AS engine, 'ok' AS status, count(*) AS fetched, NULL::VARCHAR AS error FROM base WHERE {_KEPT}
    UNION ALL SELECT 'jooble', 'ok', count(*), NULL FROM base UNION ALL SELECT 'careerjet', 'error', 0, 'bad affid'
    UNION ALL SELECT 'lever', 'empty', 0, NULL UNION ALL SELECT 'workable', 'rate_limited', 0, 'timed out'""", base=BASE.sql()))
def _(w):
    return ig.run_outcomes(_several(w), ANY, w.now)


_TOKENS = "SELECT 'tok' || CAST(s_suppkey AS VARCHAR) AS token FROM supplier WHERE s_suppkey % 5 <> 1 AND s_suppkey % 4 = {0}"


@register("J14_source_boards", query(f"""
    SELECT 'greenhouse' AS engine, CAST(sid AS VARCHAR) AS native_id FROM base WHERE {_KEPT} AND 'tok' || sid IN ({_TOKENS.format(0)})
    UNION ALL SELECT 'jooble', CAST(sid AS VARCHAR) FROM base""", base=BASE.sql()))
def _(w):
    return ig.run_sources(_several(w), ANY, w.now, w.boards).select("engine", "native_id")


@register("J14_board_outcomes", query(f"""
    SELECT 'greenhouse' AS engine, 'ok' AS status, count(*) AS fetched, NULL::VARCHAR AS error FROM base WHERE {_KEPT} AND 'tok' || sid IN ({_TOKENS.format(0)})
    UNION ALL SELECT 'jooble', 'ok', count(*), NULL FROM base UNION ALL SELECT 'careerjet', 'error', 0, 'bad affid'
    UNION ALL SELECT 'lever', 'empty', 0, NULL UNION ALL SELECT 'workable', 'skipped', 0, 'no Workable boards known yet'""", base=BASE.sql()))
def _(w):
    return ig.run_outcomes(_several(w), ANY, w.now, w.boards)


@register("S0h_first_seen", query("""
    SELECT o_custkey AS native_id, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey"""))
def _(w):
    from tallyhire.sources.spec import first_seen

    rows = w.raw("orders").select(F.col("o_custkey").alias("native_id"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("pos"))
    return first_seen(rows).select("native_id", "seq")


@register("K01_ingest_to_jobs", query("""
    SELECT 'jooble-' || sha1('jooble:' || sid) AS id, sid AS native_id, co AS company, title, 'new' AS review_status FROM base""",
    base=BASE.sql()))
def _(w):
    raw = ig.run_source(SPECS["jooble"], _several(w)["jooble"], ANY, w.now)
    return ig.to_job_rows(raw, w.now).select("id", "native_id", "company", "title", "review_status")


@register("K02_ingest_skills", query(f"""
    SELECT skill, count(*) AS n FROM (SELECT CASE k % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'data' WHEN 2 THEN 'go' ELSE 'sales' END AS skill FROM base
      UNION ALL SELECT 'kubernetes' FROM base) GROUP BY skill""", base=BASE.sql()))
def _(w):
    frames = payloads(w, s(offers=one(s(id="k", title="title", tags=F.array("tag", F.lit("K8s"))))))
    raw = ig.run_source(SPECS["recruitee"], frames, ANY, w.now)
    return ig.to_skill_rows(raw).groupBy("skill").agg(F.count("*").alias("n"))
