"""Crawl queries: permissions, outcomes, liveness, crawl log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhire.functions import liveness as lv
from tallyhire.functions.text import host_of
from tallyhire.operators import robots as rb
from tallyhire.operators.upsert import CRAWL_RULES, ROBOTS_RULES, upsert
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.sql import NOW, flag, query, ts

# One robots file per host, in three shapes; the rules of each shape are known.
_BODIES = (
    "'User-agent: *' || chr(10) || 'Disallow: /en # private' || chr(10) || 'Allow: /en/1' || chr(10) || 'Crawl-delay: 2' || chr(10) || 'Sitemap: https://x/map.xml'",
    "'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: other' || chr(10) || 'User-agent: TallyBot' || chr(13) || chr(10) || 'Disallow: /*?page=' "
    "|| chr(10) || 'Allow: /fr' || chr(10) || 'Disallow: /fr' || chr(10) || 'Crawl-delay: 5' || chr(10) || 'crawl-delay: 3'",
    "'# nothing' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /*$'",
)
_SHAPE = "length(host) % 4"
_BODY = f"CASE {_SHAPE} WHEN 0 THEN {_BODIES[0]} WHEN 1 THEN {_BODIES[1]} WHEN 2 THEN {_BODIES[2]} ELSE '' END"
_REACHABLE = "length(host) % 9 <> 4"
_ALLOWED = f"""CASE WHEN NOT ({_REACHABLE}) THEN false
      WHEN {_SHAPE} = 0 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en')
      WHEN {_SHAPE} = 1 THEN CASE WHEN contains(path, '?page=') THEN false ELSE true END
      WHEN {_SHAPE} = 2 THEN false ELSE true END"""
_PATH = """CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END
      || regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*(\\?[^#]+)', 1)"""
HOSTS = {"hosts": "SELECT DISTINCT nullif(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '') AS host FROM pages",
         "visits": f"SELECT page_id, url, lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)) AS host, {_PATH} AS path FROM pages"}


def _cache(w):
    hosts = w.raw("pages").select(host_of("url").alias("host")).filter("host IS NOT NULL").distinct()
    return hosts.select("host", F.expr(_BODY).alias("body"), F.expr(_REACHABLE).alias("reachable"),
                        F.lit("2001-08-31").cast("timestamp").alias("fetched_at"))


@register("M14_robots_policies", query(f"""
    SELECT host, CAST(CASE WHEN NOT ({_REACHABLE}) THEN 1 ELSE [2, 3, 1, 0][{_SHAPE} + 1] END AS INTEGER) AS rules,
      CASE WHEN {_REACHABLE} THEN [2.0, 3.0, NULL, NULL][{_SHAPE} + 1]::DOUBLE END AS crawl_delay,
      CASE WHEN {_REACHABLE} AND {_SHAPE} = 0 THEN 'https://x/map.xml' ELSE '' END AS sitemaps FROM hosts""", **HOSTS))
def _(w):
    return rb.policies(_cache(w), d.AGENT).select("host", F.size("rules").alias("rules"), "crawl_delay", "sitemaps")


@register("J15_robots_permission", query(
    f"SELECT page_id, url, host, CAST({_ALLOWED} AS INTEGER) AS allowed FROM visits", **HOSTS))
def _(w):
    urls = w.raw("pages").select("page_id", "url")
    return rb.with_permission(urls, "url", rb.policies(_cache(w), d.AGENT))


_OUTCOME = """CASE WHEN page_id % 10 = 3 THEN 'disallowed' WHEN error IS NOT NULL THEN 'error' WHEN http_status = 304 THEN 'not_modified'
      WHEN http_status IN (429, 503) THEN 'blocked' WHEN http_status = 404 THEN 'not_found' WHEN http_status = 410 THEN 'gone'
      WHEN http_status NOT BETWEEN 200 AND 299 THEN 'error' ELSE 'ok' END"""


def _outcomes(w):
    allowed = F.col("page_id") % 10 != 3
    return w.captures.withColumn("outcome", lv.crawl_outcome(F.col("http_status"), F.col("error"), allowed))


@register("M15_crawl_outcome", query(f"SELECT outcome, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome FROM captures) GROUP BY outcome"))
def _(w):
    return _outcomes(w).groupBy("outcome").agg(F.count("*").alias("n"))


def _host(e: str) -> str:
    return f"coalesce(lower(regexp_extract({e}, '(?i)^https?://([^/?#]+)', 1)), '')"


_PHRASE = " OR ".join(f"regexp_matches(body, '{p}')" for p in lv.CLOSED_PHRASES)
LIVENESS_SQL = f"""SELECT page_id, CASE
      WHEN outcome IN ('disallowed', 'blocked', 'error') THEN 'unreachable|' || CASE outcome WHEN 'disallowed' THEN 'robots.txt disallows this path'
        WHEN 'blocked' THEN 'rate limited' ELSE CASE WHEN http_status = 403 THEN '403 — the site blocks us' ELSE 'could not fetch (HTTP ' || http_status || ')' END END
      WHEN outcome = 'gone' THEN 'gone|HTTP 410 — removed for good' WHEN outcome = 'not_found' THEN 'closed|HTTP 404'
      WHEN outcome = 'not_modified' THEN 'open|unchanged since the last check'
      WHEN contains(h, 'greenhouse.io') THEN CASE WHEN contains(f, 'error=true') THEN 'closed|Greenhouse redirected to the board' ELSE 'open|still on its own page' END
      WHEN contains(h, 'ashbyhq.com') THEN CASE WHEN page_id % 8 = 1 THEN 'open|posting title present' ELSE 'closed|Ashby page has no posting title' END
      WHEN contains(h, 'recruitee.com') THEN CASE WHEN {_host('f')} IN ('recruitee.com', 'www.recruitee.com') THEN 'closed|board no longer exists'
        ELSE 'open|still on its board' END
      WHEN {_host('f')} <> '' AND h <> '' AND {_host('f')} <> h THEN 'closed|redirected to ' || {_host('f')}
      WHEN {_PHRASE} THEN 'closed|the page says applications are closed' ELSE 'open|no sign it has been taken down' END AS verdict
    FROM (SELECT *, {_OUTCOME} AS outcome, coalesce(final_url, url) AS f, {_host('url')} AS h FROM captures)"""


def _assessed(w):
    return _outcomes(w).withColumn("v", lv.assess_liveness(*[
        F.col(c) for c in ("url", "outcome", "http_status", "final_url", "body")]))


@register("X41_assess_liveness", query(
    f"SELECT page_id, string_split(verdict, '|')[1] AS state, string_split(verdict, '|')[2] AS reason FROM ({LIVENESS_SQL})"))
def _(w):
    return _assessed(w).select("page_id", F.col("v.state").alias("state"), F.col("v.reason").alias("reason"))


@register("V21_check_summary", query(f"""
    SELECT state, count(*) AS n, count(*) FILTER (state IN ('closed', 'gone')) AS hidden FROM
      (SELECT string_split(verdict, '|')[1] AS state FROM ({LIVENESS_SQL})) GROUP BY state"""))
def _(w):
    state = _assessed(w).select(F.col("v.state").alias("state"))
    return state.groupBy("state").agg(F.count("*").alias("n"), F.count_if(lv.hides_from_shortlist(F.col("state"))).alias("hidden"))


# Two visits to most pages: the later one replaces the outcome but not validators it lacks.
_SEEN = f"TIMESTAMP '{d.NOW}' - INTERVAL '1' DAY"


@register("K11_crawl_log", query(f"""
    SELECT 'u' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE {_OUTCOME} END AS outcome,
      CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'new-' || page_id WHEN page_id % 4 < 3 THEN 'etag-' || page_id END AS etag,
      CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 4 < 3 THEN length(url) END ELSE length(body) END AS content_length
    FROM captures WHERE page_id % 3 <> 0 OR page_id % 4 < 3"""))
def _(w):
    old = w.captures.filter("page_id % 4 < 3").selectExpr(
        "'u' || page_id AS url", "'old' AS outcome", "'etag-' || page_id AS etag", "CAST(length(url) AS BIGINT) AS content_length")
    new = _outcomes(w).filter("page_id % 3 <> 0").selectExpr(
        "'u' || page_id AS url", "outcome", "CASE WHEN page_id % 2 = 0 THEN 'new-' || page_id END AS etag",
        "CAST(length(body) AS BIGINT) AS content_length", "1 AS visit")
    return upsert(old, new, ["url"], {k: v for k, v in CRAWL_RULES.items() if k in old.columns}, "visit")


@register("K12_robots_cache", query("""
    SELECT host, CASE WHEN length(host) % 2 = 0 THEN 'fresh' ELSE 'stale' END AS body, CAST(length(host) % 2 <> 0 OR length(host) % 5 <> 0 AS INTEGER) AS reachable
    FROM hosts""", **HOSTS))
def _(w):
    hosts = _cache(w).select("host")
    old = hosts.select("host", F.lit("stale").alias("body"), F.lit(True).alias("reachable"))
    new = hosts.filter("length(host) % 2 = 0").selectExpr("host", "'fresh' AS body", "length(host) % 5 <> 0 AS reachable", "1 AS visit")
    return upsert(old, new, ["host"], {k: ROBOTS_RULES[k] for k in ("body", "reachable")}, "visit")


@register("M15_needs_fetch", query(f"""
    SELECT cached, count(*) AS n FROM (SELECT CAST(coalesce(page_id % 5 < 3 AND page_id % 12 < 6, false) AS INTEGER) AS cached FROM pages) GROUP BY cached"""))
def _(w):
    urls = w.raw("pages").selectExpr("page_id", "'u' || page_id AS url")
    log = urls.filter("page_id % 5 < 3").select("url", (w.now - F.make_interval(hours=(F.col("page_id") % 12).cast("int"))).alias("fetched_at"))
    return rb.needs_fetch(urls, "url", log, w.now).groupBy("cached").agg(F.count("*").alias("n"))


@register("M15_stale_robots", query(f"SELECT host FROM hosts WHERE length(host) % 3 = 0", **HOSTS))
def _(w):
    cache = _cache(w).withColumn("fetched_at", w.now - F.make_interval(hours=F.when(F.length("host") % 3 == 0, 24).otherwise(23)))
    return rb.stale_robots(cache, w.now).select("host")
