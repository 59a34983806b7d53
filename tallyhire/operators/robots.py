"""robots.txt: policies per host, and whether a path may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions.text import host_of, path_of
from tallyhire.operators.skew import spread_join

TTL_HOURS = 24
FRESH_HOURS = 6


#: Stand before and behind an agent's name, and before any other line, while a file is cut into groups.
AGENT_OPEN, AGENT_CLOSE, LINE = "\u0001", "\u0002", "\u0003"


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """(host, body) -> (host, rules, crawl_delay, sitemaps) for one user agent, inside the row: nothing is shuffled.

    Consecutive user-agent lines open a group together; a group naming the agent wins over the wildcard wherever it
    stands.  The control characters that mark lines meanwhile are not part of a body.
    """
    body = F.translate(F.coalesce("body", F.lit("")), AGENT_OPEN + AGENT_CLOSE + LINE, "")
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#[\s\S]*", "")))
    named = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("field"),
        F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    sitemaps = F.transform(
        F.filter("_fields", lambda x: (x["field"] == "sitemap") & (x["value"] != "")), lambda x: x["value"])
    marked = F.transform(
        F.filter("_fields", lambda x: x["field"] != "sitemap"),
        lambda x: F.when(x["field"] == "user-agent", F.concat(F.lit(AGENT_OPEN), F.lower(x["value"]), F.lit(AGENT_CLOSE)))
        .otherwise(F.concat(F.lit(LINE), x["field"], F.lit(":"), x["value"])))
    # a group begins at an agent that does not follow another one; what stands before the first belongs to none
    groups = F.filter(F.split(F.array_join(marked, ""), f"(?<!{AGENT_CLOSE})(?={AGENT_OPEN})"),
                      lambda g: g.startswith(AGENT_OPEN))
    me = agent.lower()
    name = me.split("/")[0]

    def about(group: Column) -> Column:
        agents = F.split(F.translate(F.substring_index(group, LINE, 1), AGENT_OPEN, ""), AGENT_CLOSE)
        agents = F.slice(agents, 1, F.size(agents) - 1)
        rest = F.split(group, LINE)
        rest = F.transform(F.slice(rest, 2, F.size(rest)), lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("field"), F.regexp_replace(x, r"^[^:]*:", "").alias("value")))
        rules = F.filter(rest, lambda x: x["field"].isin("allow", "disallow") & (x["value"] != ""))
        delays = F.transform(F.filter(rest, lambda x: x["field"] == "crawl-delay"), lambda x: x["value"].try_cast("double"))
        return F.struct(
            F.exists(agents, lambda x: (x != "*") & (F.lit(me).startswith(x) | x.startswith(name))).alias("specific"),
            F.array_contains(agents, "*").alias("wildcard"),
            F.transform(rules, lambda x: F.struct((x["field"] == "allow").alias("allow"), x["value"].alias("pattern"))).alias("rules"),
            F.try_element_at(F.filter(delays, lambda x: x >= 0), F.lit(-1)).alias("delay"))

    read = files.select("host", named.alias("_fields")).select("host", sitemaps.alias("sitemaps"), F.transform(groups, about).alias("_groups"))
    chosen = F.when(F.exists("_groups", lambda g: g["specific"]), F.filter("_groups", lambda g: g["specific"])).otherwise(
        F.filter("_groups", lambda g: g["wildcard"]))
    return read.select("host", "sitemaps", chosen.alias("_chosen")).select(
        "host", F.flatten(F.transform("_chosen", lambda g: g["rules"])).alias("rules"),
        F.array_max(F.transform("_chosen", lambda g: g["delay"])).alias("crawl_delay"), "sitemaps")


def policies(cache: DataFrame, agent: str) -> DataFrame:
    """Policies of a robots cache; a host that could not be asked is left alone entirely."""
    deny = F.array(F.struct(F.lit(False).alias("allow"), F.lit("/").alias("pattern")))
    read = parse_robots(cache.filter("reachable"), agent)
    shut = cache.filter(~F.col("reachable")).select(
        "host", deny.alias("rules"), F.lit(None).cast("double").alias("crawl_delay"),
        F.array().cast("array<string>").alias("sitemaps"),
    )
    return read.unionByName(shut)


def _regex(pattern: Column) -> Column:
    literal = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"))


def is_allowed(rules: Column, path: Column) -> Column:
    """Longest matching pattern wins, allow wins ties, no match allows."""
    hits = F.filter(rules, lambda r: F.rlike(path, _regex(r["pattern"])))
    weighed = F.transform(hits, lambda r: F.struct(
        F.length(F.regexp_replace(F.regexp_replace(r["pattern"], r"\*", ""), r"\$\z", "")).alias("len"),
        r["allow"].alias("allow"),
    ))
    return F.coalesce(F.array_max(weighed)["allow"], F.lit(True))


def with_permission(urls: DataFrame, url: str, host_policies: DataFrame) -> DataFrame:
    """Add ``allowed``.  Rules travel once per host as an array, and a host with many URLs is spread."""
    staged = urls.withColumn("host", host_of(url))
    joined = spread_join(staged, host_policies.select("host", "rules"), ["host"], [url])
    return joined.withColumn("allowed", is_allowed(F.col("rules"), path_of(url))).drop("rules")


def needs_fetch(urls: DataFrame, url: str, crawl_log: DataFrame, now: Column) -> DataFrame:
    """Add ``cached``: fetched less than six hours ago, so not asked again."""
    seen = crawl_log.select(F.col("url").alias(url), F.col("fetched_at").alias("_at"))
    fresh = F.unix_millis(now) - F.unix_millis(F.col("_at")) < FRESH_HOURS * 3_600_000
    return urls.join(seen, url, "left").withColumn("cached", F.coalesce(fresh, F.lit(False))).drop("_at")


def stale_robots(cache: DataFrame, now: Column) -> DataFrame:
    """Cached robots files old enough to be asked for again."""
    return cache.filter(F.unix_millis(now) - F.unix_millis("fetched_at") >= TTL_HOURS * 3_600_000)
