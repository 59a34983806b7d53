"""Dates.  ``now`` is always an argument, and the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_posted_at(c: Column | str) -> Column:
    """Any date a source sends, as a timestamp; NULL when it cannot be read."""
    text = F.trim(_col(c))
    undayed = F.regexp_replace(text, r"^[A-Za-z]{3,9},? +(?=\d{1,2} )", "")
    # Each shape is recognised first, so a parser is tried only where it fits.
    return (
        F.when(text.rlike(r"^\d{4}"), F.try_to_timestamp(text))
        .when(undayed.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d\d:\d\d [A-Za-z]"),
              F.try_to_timestamp(undayed, F.lit("d MMM yyyy HH:mm:ss z")))
        .when(undayed.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d\d:\d\d [+-]\d"),
              F.try_to_timestamp(undayed, F.lit("d MMM yyyy HH:mm:ss Z")))
        .when(undayed.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_timestamp(undayed, F.lit("d MMM yyyy")))
        .when(text.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.try_to_timestamp(text, F.lit("MMM d, yyyy")))
        .when(text.rlike(r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$"), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")))
    )


def epoch_to_timestamp(c: Column | str) -> Column:
    """Seconds (below 1e11) or milliseconds since the epoch; zero, negative and junk give NULL."""
    n = _col(c).try_cast("double")
    millis = F.when(n < 1e11, n * 1000).otherwise(n)
    return F.when((n > 0) & ~F.isnan(n), F.timestamp_millis(millis.try_cast("bigint")))


def iso(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def days_between(now: Column, then: Column | str) -> Column:
    """Whole days elapsed, floored; not calendar days."""
    return F.floor((F.unix_millis(now) - F.unix_millis(_col(then))) / DAY_MS)


def within_age(posted_at: Column | str, now: Column, max_days: float) -> Column:
    """Age at most ``max_days``; an unknown date is kept."""
    age = (F.unix_millis(now) - F.unix_millis(_col(posted_at))) / DAY_MS
    return F.coalesce(age <= max_days, F.lit(True))


def posted_within(posted_at: Column | str, now: Column, days: float) -> Column:
    """Posted in the last ``floor(days)`` days; an unknown date is dropped."""
    return F.coalesce(_col(posted_at) >= now - F.make_interval(days=F.lit(int(days))), F.lit(False))


def period_start(now: Column, period: str, tz: str = "UTC") -> Column:
    """Inclusive start of the budget period: Monday, the 1st, or NULL for no period."""
    if period == "none":
        return F.lit(None).cast("timestamp")
    unit = {"weekly": "week", "monthly": "month"}[period]
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(now, tz)), tz)


def period_resets(now: Column, period: str, tz: str = "UTC") -> Column:
    if period == "none":
        return F.lit(None).cast("timestamp")
    step = F.make_interval(months=F.lit(1)) if period == "monthly" else F.make_interval(days=F.lit(7))
    local = F.from_utc_timestamp(period_start(now, period, tz), tz)
    return F.to_utc_timestamp(local + step, tz)
