"""Is a posting still open, judged from a captured response."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyhire.functions.text import has_og_title, host_of

# Phrases that mean closed wherever they appear.
CLOSED_PHRASES = (
    r"(?i)no longer accepting applications",
    r"(?i)this (?:job|position|posting|role) (?:is|has been) (?:no longer|closed|filled|removed)",
    r"(?i)position has been filled",
    r"(?i)applications? (?:are )?(?:now )?closed",
    r"(?i)this (?:job|posting) is no longer available",
    r"(?i)vacancy (?:is )?(?:closed|expired)",
)


def _v(state: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(state).alias("state"), reason.alias("reason"))


def assess_liveness(url: Column, outcome: Column, status: Column, final_url: Column, body: Column) -> Column:
    """State and reason: fetch outcome first, then per-host rules, then redirects and phrases."""
    host = F.coalesce(host_of(url), F.lit(""))
    final = F.coalesce(final_url, url)
    final_host = F.coalesce(host_of(final), F.lit(""))
    body = F.coalesce(body, F.lit(""))
    greenhouse, ashby, recruitee = (host.contains(h) for h in ("greenhouse.io", "ashbyhq.com", "recruitee.com"))
    could_not = F.concat(
        F.lit("could not fetch"),
        F.when(F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")")))
        .otherwise(""),
    )
    closed_phrase = reduce(lambda a, b: a | b, [body.rlike(p) for p in CLOSED_PHRASES])
    return (
        F.when(outcome == "disallowed", _v("unreachable", "robots.txt disallows this path"))
        .when(outcome == "blocked", _v("unreachable", "rate limited"))
        .when((outcome == "error") & (status == 403), _v("unreachable", "403 — the site blocks us"))
        .when(outcome == "error", _v("unreachable", could_not))
        .when(outcome == "gone", _v("gone", "HTTP 410 — removed for good"))
        .when(outcome == "not_found", _v("closed", "HTTP 404"))
        .when(outcome == "not_modified", _v("open", "unchanged since the last check"))
        .when(outcome != "ok", _v("unknown", F.concat(F.lit("outcome "), outcome)))
        .when(greenhouse & final.contains("error=true"), _v("closed", "Greenhouse redirected to the board"))
        .when(greenhouse, _v("open", "still on its own page"))
        .when(ashby & ~has_og_title(body), _v("closed", "Ashby page has no posting title"))
        .when(ashby, _v("open", "posting title present"))
        .when(recruitee & final_host.isin("recruitee.com", "www.recruitee.com"),
              _v("closed", "board no longer exists"))
        .when(recruitee, _v("open", "still on its board"))
        .when((final_host != "") & (host != "") & (final_host != host),
              _v("closed", F.concat(F.lit("redirected to "), final_host)))
        .when(closed_phrase, _v("closed", "the page says applications are closed"))
        .otherwise(_v("open", "no sign it has been taken down"))
    )


def hides_from_shortlist(state: Column) -> Column:
    return F.coalesce(state.isin("closed", "gone"), F.lit(False))


def crawl_outcome(status: Column, error: Column, allowed: Column) -> Column:
    """Classify a captured response: robots first, then failure, then status."""
    return (
        F.when(~F.coalesce(allowed, F.lit(True)), "disallowed")
        .when(error.isNotNull() | status.isNull(), "error")
        .when(status == 304, "not_modified")
        .when(status.isin(429, 503), "blocked")
        .when(status == 404, "not_found")
        .when(status == 410, "gone")
        .when(~status.between(200, 299), "error")
        .otherwise("ok")
    )


def run_status(ready: Column, rows: Column, http_status: Column, error: Column) -> Column:
    """Outcome of one source run: skipped, rate_limited, error, empty or ok."""
    return (
        F.when(~ready, "skipped")
        .when(http_status == 429, "rate_limited")
        .when(error.isNotNull(), "error")
        .when(rows > 0, "ok")
        .otherwise("empty")
    )


def run_error(error: Column) -> Column:
    """Timeouts are reported with one wording."""
    return F.when(error.rlike("(?i)timed? ?out"), "timed out").otherwise(error)
