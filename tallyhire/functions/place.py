"""Remote status and location fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


# Location tiers and the region words behind them.
FIT = {"preferred": 3, "remote_open": 2, "unstated": 1, "elsewhere": 0}
OPEN_REGIONS = ("india", "apac", "asia", "anywhere", "worldwide", "global")
RESTRICTED_REGIONS = (
    "united states", "usa", "u.s.", "(us)", "(us ", " us)", "- us", ", us", "us only", "us-only",
    "north america", "americas", "canada", "mexico", "latam", "brazil",
    "united kingdom", "(uk)", "- uk", ", uk", "uk only",
    "europe", "emea", "(eu)", "- eu", ", eu",
    "germany", "france", "spain", "portugal", "netherlands", "ireland", "poland",
    "australia", "new zealand", "singapore", "japan", "philippines", "israel",
)
UNSTATED_PLACES = ("", "n/a", "na", "-", "not specified", "unknown", "tbd")
REMOTE_WORDS = r"\b(remote|work from home|wfh|anywhere|distributed)\b"
ONSITE_WORDS = r"\b(on-?site|in-?office|hybrid)\b"


def looks_remote(location: Column, title: Column | None = None) -> Column:
    """True, False, or NULL when the text says nothing; remote words win over on-site words."""
    text = F.lower(F.concat(F.coalesce(location, F.lit("")), F.lit(" "), title if title is not None else F.lit("")))
    return F.when(text.rlike(REMOTE_WORDS), True).when(text.rlike(ONSITE_WORDS), False)


def remote_from(explicit: Column, location: Column, title: Column | None = None) -> Column:
    """What the source said, including an explicit no, before what the text implies."""
    return F.coalesce(explicit, looks_remote(location, title))


def remote_reality(remote: Column, restriction: Column) -> Column:
    unrestricted = F.trim(F.coalesce(restriction, F.lit(""))) == ""
    return (
        F.when(remote.isNull(), "unstated").when(~remote, "hybrid-or-onsite")
        .when(unrestricted, "remote").otherwise("restricted")
    )


def location_fit(location: Column, remote: Column, preferred: list[str]) -> Column | None:
    """Tier 3..0 for the places a person can work; None when no place is preferred."""
    places = list(dict.fromkeys(p.strip() for p in preferred if p.strip()))
    if not places:
        return None
    loc = F.lower(F.coalesce(location, F.lit("")))

    def any_of(markers) -> Column:
        return reduce(lambda a, b: a | b, [loc.contains(m) for m in markers])

    remoteish = F.coalesce(remote, F.lit(False)) | loc.contains("remote")
    return (
        F.when(any_of([p.lower() for p in places]), FIT["preferred"])
        .when(remoteish & (any_of(OPEN_REGIONS) | ~any_of(RESTRICTED_REGIONS)), FIT["remote_open"])
        .when(F.trim(loc).isin(*UNSTATED_PLACES), FIT["unstated"])
        .otherwise(FIT["elsewhere"])
    )
