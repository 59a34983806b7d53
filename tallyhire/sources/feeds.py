"""The nineteen sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhire.functions import place
from tallyhire.functions.dates import epoch_to_timestamp, iso
from tallyhire.functions.pay import from_structured, parse_salary
from tallyhire.functions.text import clean, html_to_text, join_nonblank, let, nonblank, once, parse_header, strip
from tallyhire.sources.spec import SourceSpec

HTML_JOIN = "\n\n"


def _or(*options: Column) -> Column:
    """First non-blank option, '' when all are blank (blank and missing alike)."""
    return F.coalesce(*[nonblank(o) for o in options], F.lit(""))


def _null_if_blank(c: Column) -> Column:
    return nonblank(clean(c))


def _texts(c: Column) -> Column:
    """Array field -> cleaned non-blank strings."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda t: t != "")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _period(c: Column) -> Column:
    return F.when(c.isin("monthly", "hourly"), c).otherwise("annual")


def _epoch(c: Column) -> Column:
    return iso(epoch_to_timestamp(c))


def greenhouse(r, q):
    location, title = clean(r("location.name")), clean(r("title"))
    return {
        "native_id": r("id"), "company": _or(clean(r("company_name")), F.col("board_company")), "title": title,
        "location": location, "apply_url": clean(r("absolute_url")),
        # The body is escaped HTML, so it is decoded twice.
        "description": html_to_text(html_to_text(r("content"))),
        "remote": place.looks_remote(location, title), "posted_at": F.coalesce(r("first_published"), r("updated_at")),
    }


def lever(r, q):
    location, title = clean(r("categories.location")), clean(r("text"))
    body = F.coalesce(r("descriptionPlain"), html_to_text(r("description")))
    return {
        "native_id": r("id"), "company": F.col("board_company"), "title": title, "location": location,
        "apply_url": clean(F.coalesce(r("applyUrl"), r("hostedUrl"))),
        "description": strip(join_nonblank(HTML_JOIN, body, r("additionalPlain"))),
        "remote": place.looks_remote(location, title), "employment_type": _null_if_blank(r("categories.commitment")),
        "posted_at": iso(F.timestamp_millis(F.when(r("createdAt") != 0, r("createdAt")))),
    }


def ashby(r, q):
    elsewhere = F.transform(r("secondaryLocations"), lambda s: clean(s["location"]))
    places = F.concat(F.array(clean(r("location"))), F.coalesce(elsewhere, F.array().cast("array<string>")))
    location = F.array_join(F.array_distinct(F.filter(places, lambda p: p != "")), "; ")
    title = clean(r("title"))
    plain = r("descriptionPlain")
    return {
        "native_id": r("id"), "company": F.col("board_company"), "title": title, "location": location,
        "apply_url": _or(clean(r("jobUrl")), F.concat(
            F.lit("https://jobs.ashbyhq.com/"), F.col("board_token"), F.lit("/"), r("id"))),
        "description": F.when(clean(plain) != "", strip(plain)).otherwise(html_to_text(r("descriptionHtml"))),
        "remote": place.remote_from(r("isRemote"), location, title),
        "employment_type": _null_if_blank(r("employmentType")), "posted_at": r("publishedAt"),
        "keep": nonblank(r("id")).isNotNull() & F.coalesce(r("isListed"), F.lit(True)),
    }


def recruitee(r, q):
    location, title = _or(clean(r("location")), clean(r("city"))), clean(r("title"))
    pinned = F.coalesce(r("on_site"), F.lit(False)) | F.coalesce(r("hybrid"), F.lit(False))
    return {
        "native_id": r("id"), "company": _or(clean(r("company_name")), F.col("board_company")), "title": title,
        "location": location, "apply_url": clean(F.coalesce(r("careers_apply_url"), r("careers_url"))),
        "description": strip(join_nonblank(HTML_JOIN, html_to_text(r("description")), html_to_text(r("requirements")))),
        "remote": F.when(pinned, False).otherwise(place.remote_from(r("remote"), location, title)),
        "employment_type": _null_if_blank(r("employment_type_code")), "posted_at": r("published_at"),
        "skills": _texts(r("tags")),
    }


def _joined_place(*parts: Column) -> Column:
    return join_nonblank(", ", *[clean(p) for p in parts])


def workable(r, q):
    nested = _joined_place(r("location.city"), r("location.region"), r("location.country"))
    location = F.when(r("location").isNotNull(), nested).otherwise(_joined_place(r("city"), r("state"), r("country")))
    title, native = clean(r("title")), clean(F.coalesce(r("shortcode"), r("id")))
    remote = F.coalesce(r("telecommuting"), r("location.telecommuting"))
    return {
        "native_id": native, "company": _or(clean(F.col("envelope_name")), F.col("board_company")), "title": title,
        "location": location, "apply_url": clean(F.coalesce(r("application_url"), r("url"))),
        "description": strip(join_nonblank(
            HTML_JOIN, *[html_to_text(r(c)) for c in ("description", "requirements", "benefits")])),
        "remote": place.remote_from(remote, location, title), "employment_type": _null_if_blank(r("employment_type")),
        "posted_at": F.coalesce(r("published_on"), r("created_at")), "keep": native != "",
    }


def _with_details(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Attach the detail response of each posting; a failed detail leaves an empty body."""
    schema = "struct<id: string, jobAd: struct<sections: map<string, struct<title: string, text: string>>>>"
    texts = F.transform(F.map_values("d.jobAd.sections"), lambda s: html_to_text(s["text"]))
    answered = payloads.filter((F.col("kind") == "detail") & F.col("error").isNull()
                               & (F.coalesce(F.col("http_status"), F.lit(200)) < 400))
    details = (
        once(answered, d=F.from_json("body", schema))
        .select("board_token", F.col("d.id").alias("_id"),
                strip(F.array_join(F.filter(texts, lambda t: t != ""), HTML_JOIN)).alias("_body"))
        .groupBy("board_token", "_id").agg(F.min("_body").alias("detail_body"))
    )
    return rows.withColumn("_id", F.col("rec.id")).join(details, ["board_token", "_id"], "left")


def smartrecruiters(r, q):
    location = _joined_place(r("location.city"), r("location.region"), r("location.country"))
    title = clean(r("name"))
    return {
        "native_id": r("id"), "company": _or(clean(r("company.name")), F.col("board_company")), "title": title,
        "location": location,
        "apply_url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("board_token"), F.lit("/"), r("id")),
        "description": F.coalesce("detail_body", F.lit("")),
        "remote": place.remote_from(r("location.remote"), location, title),
        "employment_type": _null_if_blank(r("typeOfEmployment.label")), "posted_at": r("releasedDate"),
    }


def remoteok(r, q):
    tags = _texts(r("tags"))
    return {
        "native_id": F.coalesce(r("id"), r("slug"), F.lit("")), "company": clean(r("company")),
        "title": clean(r("position")), "location": _or(clean(r("location")), F.lit("Remote")),
        "apply_url": clean(F.coalesce(r("apply_url"), r("url"))), "description": html_to_text(r("description")),
        # The whole board is remote; zero pay means not disclosed.
        "remote": F.lit(True),
        "salary": from_structured(_positive(r("salary_min")), _positive(r("salary_max")), F.lit("USD")),
        "posted_at": F.coalesce(_null_if_blank(r("date")), _epoch(r("epoch"))), "skills": tags, "tags": tags,
        "keep": r("legal").isNull() & nonblank(r("position")).isNotNull(),
    }


def arbeitnow(r, q):
    location, title, tags, slug = clean(r("location")), clean(r("title")), _texts(r("tags")), clean(r("slug"))
    return {
        "native_id": slug, "company": clean(r("company_name")), "title": title, "location": location,
        "apply_url": clean(r("url")), "description": html_to_text(r("description")),
        "remote": place.remote_from(r("remote"), location, title),
        "employment_type": F.when(F.size(r("job_types")) > 0, clean(F.get(r("job_types"), F.lit(0)))),
        "posted_at": _epoch(r("created_at")), "skills": tags, "tags": tags, "keep": slug != "",
    }


def themuse(r, q):
    tags = F.concat(_texts(r("categories.name")), _texts(r("tags.name")))
    location, title = F.array_join(_texts(r("locations.name")), " · "), clean(r("name"))
    native, url = F.coalesce(r("id"), r("short_name"), F.lit("")), clean(r("refs.landing_page"))
    return {
        "native_id": native, "company": clean(r("company.name")), "title": title, "location": location,
        "apply_url": url, "description": html_to_text(r("contents")), "remote": place.looks_remote(location, title),
        "posted_at": r("publication_date"), "skills": tags, "tags": tags, "keep": (native != "") & (url != ""),
    }


def remotive(r, q):
    tags = _texts(r("tags"))
    return {
        "native_id": F.coalesce(r("id"), F.lit("")), "company": clean(r("company_name")), "title": clean(r("title")),
        # Kept as written: "USA only" here is the restriction.
        "location": _or(clean(r("candidate_required_location")), F.lit("Remote")), "apply_url": clean(r("url")),
        "description": html_to_text(r("description")), "remote": F.lit(True),
        "employment_type": _null_if_blank(r("job_type")), "posted_at": r("publication_date"),
        "skills": tags, "tags": tags, "keep": F.coalesce(r("id"), F.lit("")) != "",
    }


def himalayas(r, q):
    limits = F.array_join(_texts(r("locationRestrictions")), ", ")
    tags = F.transform(F.coalesce(r("categories"), F.array().cast("array<string>")),
                       lambda c: F.replace(clean(c), F.lit("-"), F.lit(" ")))
    link = clean(F.coalesce(r("applicationLink"), r("guid")))
    return {
        "native_id": link, "company": clean(r("companyName")), "title": clean(r("title")),
        "location": F.when(limits == "", "Remote (worldwide)").otherwise(
            F.concat(F.lit("Remote ("), limits, F.lit(")"))),
        "apply_url": link, "description": html_to_text(F.coalesce(r("description"), r("excerpt"))),
        "remote": F.lit(True),
        "salary": from_structured(r("minSalary"), r("maxSalary"), _or(clean(r("currency")), F.lit("USD")),
                                  _period(r("salaryPeriod"))),
        "employment_type": _null_if_blank(r("employmentType")), "posted_at": _epoch(r("pubDate")),
        "skills": tags, "tags": tags, "keep": link != "",
    }


def jobicy(r, q):
    geo, tags = clean(r("jobGeo")), _texts(r("jobIndustry"))
    native = F.coalesce(r("id"), r("jobSlug"), F.lit(""))
    return {
        "native_id": native, "company": clean(r("companyName")), "title": clean(r("jobTitle")),
        "location": F.when((geo == "") | (F.lower(geo) == "anywhere"), "Remote (worldwide)").otherwise(
            F.concat(F.lit("Remote ("), geo, F.lit(")"))),
        "apply_url": clean(r("url")), "description": html_to_text(F.coalesce(r("jobDescription"), r("jobExcerpt"))),
        "remote": F.lit(True),
        "employment_type": F.when(F.size(r("jobType")) > 0, clean(F.get(r("jobType"), F.lit(0)))),
        "posted_at": r("pubDate"), "skills": tags, "tags": tags, "keep": native != "",
    }


def _hiring_thread(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Keep direct replies to the newest hiring thread; replies to replies are conversation."""
    hit = F.from_json("raw", "objectID string, title string")
    stories = (
        payloads.filter(F.col("kind") == "stories")
        .select("seq", F.posexplode(F.from_json("body", "hits array<string>")["hits"]).alias("pos", "raw"))
        .select(F.struct("seq", "pos").alias("o"), hit.alias("s"))
        .filter(F.lower("s.title").contains("who is hiring") & ~F.lower("s.title").contains("wants to be hired"))
        .agg(F.min_by("s.objectID", "o").cast("bigint").alias("thread"))
    )
    return rows.filter(F.col("rec.parent_id") == stories.scalar())


def _read_comment(rows: DataFrame) -> DataFrame:
    return once(once(rows, text=html_to_text("rec.comment_text")), head=parse_header("text"))


def hackernews(r, q):
    text, head = F.col("text"), F.col("head")
    return {
        "native_id": r("objectID"), "company": head["company"], "title": head["title"], "location": head["location"],
        "apply_url": F.concat(F.lit("https://news.ycombinator.com/item?id="), r("objectID")),
        "description": text, "description_complete": F.lit(True),
        "remote": place.looks_remote(head["location"], head["title"]), "salary": parse_salary(text),
        "posted_at": r("created_at"), "match_title": F.concat(head["title"], F.lit(" "), head["company"]),
        "keep": F.length(text) >= 40,
    }


def foundit_url(r) -> Column:
    relative = _or(clean(r("seoJdUrl")), clean(r("jdUrl")))
    base = F.lit("https://www.foundit.in")
    resolved = (
        F.when(relative == "", "").when(relative.rlike("(?i)^https?://"), relative)
        .when(relative.startswith("/"), F.concat(base, relative)).otherwise(F.concat(base, F.lit("/"), relative))
    )
    return _or(clean(r("applyUrl")), clean(r("redirectUrl")), resolved)


def foundit(r, q):
    location, title = clean(r("locations")), clean(r("title"))
    named = _texts(r("skillsWithSynonyms.value"))
    listed = F.filter(F.transform(F.split(clean(r("skills")), ","), clean), lambda s: s != "")
    lo, hi = _positive(r("minimumSalary.absoluteValue")), _positive(r("maximumSalary.absoluteValue"))
    currency = _or(clean(F.coalesce(r("minimumSalary.currency"), r("currencyCode"))), F.lit("INR"))
    shown = ~F.coalesce(r("hideSalary"), F.lit(False))
    native = F.coalesce(r("jobId"), r("id"), F.lit(""))
    return {
        "native_id": native, "company": clean(r("companyName")), "title": title, "location": location,
        # This source carries no body; saying so marks the posting for completion.
        "apply_url": foundit_url(r), "description": F.lit(""), "description_complete": F.lit(False),
        "remote": place.looks_remote(location, title),
        "salary": from_structured(F.when(shown, lo), F.when(shown, hi), currency),
        "employment_type": F.when(F.size(r("employmentTypes")) > 0, clean(F.get(r("employmentTypes"), F.lit(0)))),
        "posted_at": iso(F.timestamp_millis(F.when(r("createdAt") != 0, r("createdAt")))),
        "skills": F.when(F.size(named) > 0, named).otherwise(listed), "keep": native != "",
    }


def instahyre(r, q):
    places = F.filter(F.transform(F.split(clean(r("locations")), ","), clean), lambda p: p != "")
    location, title = F.array_join(places, ", "), clean(F.coalesce(r("title"), r("candidate_title")))
    native, url = F.coalesce(r("id"), F.lit("")), clean(r("public_url"))
    return {
        "native_id": native, "company": clean(r("employer.company_name")), "title": title, "location": location,
        "apply_url": url, "description": F.lit(""), "description_complete": F.lit(False),
        "remote": place.looks_remote(location, title), "skills": _texts(r("keywords")),
        "keep": (native != "") & (url != ""),
    }


def adzuna(r, q):
    native = clean(r("id"))
    currency = "INR" if q.country() == "in" else "USD"
    return {
        "native_id": native, "company": clean(r("company.display_name")), "title": clean(r("title")),
        "location": clean(r("location.display_name")), "apply_url": clean(r("redirect_url")),
        # Always a snippet; a predicted figure is an estimate.
        "description": clean(r("description")), "description_complete": F.lit(False),
        "salary": from_structured(r("salary_min"), r("salary_max"), F.lit(currency),
                                  predicted=r("salary_is_predicted").isin("true", "1")),
        "employment_type": _null_if_blank(r("contract_time")), "posted_at": r("created"),
        "tags": F.array(clean(r("category.label"))), "keep": native != "",
    }


def _text_pay(c: Column, currency: str) -> Column:
    from tallyhire.functions.pay import absent

    return F.when(nonblank(c).isNotNull(), parse_salary(F.concat(F.lit("salary "), c), currency)).otherwise(absent())


def careerjet(r, q):
    location, title, url = clean(r("locations")), clean(r("title")), clean(r("url"))
    return {
        "native_id": url, "company": clean(r("company")), "title": title, "location": location, "apply_url": url,
        "description": clean(r("description")), "description_complete": F.lit(False),
        "remote": place.looks_remote(location, title), "salary": _text_pay(r("salary"), "INR"),
        "posted_at": r("date"), "keep": url != "",
    }


def jooble(r, q):
    location, title, link = clean(r("location")), clean(r("title")), clean(r("link"))
    native = F.coalesce(r("id"), link)
    return {
        "native_id": native, "company": clean(r("company")), "title": title, "location": location, "apply_url": link,
        "description": clean(r("snippet")), "description_complete": F.lit(False),
        "remote": place.looks_remote(location, title), "salary": _text_pay(r("salary"), ""),
        "employment_type": _null_if_blank(r("type")), "posted_at": r("updated"),
        "keep": (native != "") & (link != ""),
    }


def jobspy(r, q):
    location, title, url = clean(r("location")), clean(r("title")), clean(r("job_url"))
    own = _or(clean(r("id")), url)
    return {
        # The site prefix keeps ids of different sites apart.
        "native_id": F.concat(_or(clean(r("site")), F.lit("spy")), F.lit(":"), own),
        "company": clean(r("company")), "title": title, "location": location, "apply_url": url,
        "description": clean(r("description")),
        "remote": F.when(r("is_remote"), True).otherwise(place.looks_remote(location, title)),
        "salary": from_structured(r("min_amount"), r("max_amount"), _or(clean(r("currency")), F.lit("INR")),
                                  _period(r("interval"))),
        "employment_type": _null_if_blank(r("job_type")), "posted_at": _null_if_blank(r("date_posted")),
        "keep": own != "",
    }


def _body_error() -> Column:
    return nonblank(F.get_json_object("body", "$.error"))


def _jobspy_error() -> Column:
    """Fails on a bridge error, or when every site failed."""
    failed = F.from_json(F.get_json_object("body", "$.errors"), "map<string, string>")
    each = F.transform(F.map_entries(failed), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.coalesce(_body_error(), let(each, lambda e: F.when(F.size(e) == JOBSPY_SITES, F.array_join(e, "; "))))


# Fixed value: sites the scraper asks (indeed, linkedin, naukri, google).
JOBSPY_SITES = 4

_JOBS = ("jobs array<string>", "jobs")
SPECS = {s.id: s for s in (
    SourceSpec("greenhouse", "ats", "Greenhouse", "full", *_JOBS,
               "id string, title string, absolute_url string, company_name string, location struct<name: string>, "
               "first_published string, updated_at string, content string", greenhouse, needs_boards=True),
    SourceSpec("lever", "ats", "Lever", "full", "array<string>", None,
               "id string, text string, hostedUrl string, applyUrl string, descriptionPlain string, "
               "description string, additionalPlain string, createdAt bigint, "
               "categories struct<location: string, commitment: string>", lever, needs_boards=True),
    SourceSpec("ashby", "ats", "Ashby", "full", *_JOBS,
               "id string, title string, location string, secondaryLocations array<struct<location: string>>, "
               "isRemote boolean, isListed boolean, employmentType string, publishedAt string, "
               "descriptionPlain string, descriptionHtml string, jobUrl string", ashby, needs_boards=True),
    SourceSpec("recruitee", "ats", "Recruitee", "full", "offers array<string>", "offers",
               "id string, title string, location string, city string, careers_apply_url string, careers_url string, "
               "description string, requirements string, employment_type_code string, published_at string, "
               "company_name string, tags array<string>, remote boolean, hybrid boolean, on_site boolean",
               recruitee, needs_boards=True),
    SourceSpec("workable", "ats", "Workable", "full", "name string, jobs array<string>", "jobs",
               "shortcode string, id string, title string, description string, requirements string, benefits string, "
               "url string, application_url string, employment_type string, published_on string, created_at string, "
               "telecommuting boolean, city string, state string, country string, "
               "location struct<city: string, region: string, country: string, telecommuting: boolean>",
               workable, needs_boards=True),
    SourceSpec("smartrecruiters", "ats", "SmartRecruiters", "full", "content array<string>", "content",
               "id string, name string, releasedDate string, company struct<name: string>, "
               "location struct<city: string, region: string, country: string, remote: boolean>, "
               "typeOfEmployment struct<label: string>", smartrecruiters, needs_boards=True,
               kind="list", join=_with_details, fails_on_any_error=True),
    SourceSpec("remoteok", "board", "RemoteOK", "full", "array<string>", None,
               "legal string, id string, slug string, position string, company string, location string, "
               "description string, apply_url string, url string, date string, epoch string, tags array<string>, "
               "salary_min double, salary_max double", remoteok, filter_terms=True, filter_age=True),
    SourceSpec("arbeitnow", "board", "Arbeitnow", "full", "data array<string>", "data",
               "slug string, company_name string, title string, description string, remote boolean, url string, "
               "tags array<string>, job_types array<string>, location string, created_at string",
               arbeitnow, filter_terms=True, filter_age=True),
    SourceSpec("themuse", "board", "The Muse", "full", "results array<string>", "results",
               "id string, short_name string, name string, contents string, publication_date string, "
               "locations array<struct<name: string>>, categories array<struct<name: string>>, "
               "tags array<struct<name: string>>, company struct<name: string>, refs struct<landing_page: string>",
               themuse, filter_terms=True, filter_age=True, unique="after"),
    SourceSpec("remotive", "board", "Remotive", "full", *_JOBS,
               "id string, url string, title string, company_name string, tags array<string>, job_type string, "
               "publication_date string, candidate_required_location string, description string",
               remotive, filter_terms=True, filter_age=True, unique="after"),
    SourceSpec("himalayas", "board", "Himalayas", "full", *_JOBS,
               "title string, companyName string, employmentType string, minSalary double, maxSalary double, "
               "currency string, salaryPeriod string, locationRestrictions array<string>, categories array<string>, "
               "description string, excerpt string, pubDate string, applicationLink string, guid string",
               himalayas, filter_terms=True, filter_age=True),
    SourceSpec("jobicy", "board", "Jobicy", "full", *_JOBS,
               "id string, jobSlug string, url string, jobTitle string, companyName string, "
               "jobIndustry array<string>, jobType array<string>, jobGeo string, jobDescription string, "
               "jobExcerpt string, pubDate string", jobicy, filter_terms=True, filter_age=True),
    SourceSpec("hackernews", "board", "Hacker News", "full", "hits array<string>", "hits",
               "objectID string, parent_id bigint, story_id bigint, created_at string, comment_text string",
               hackernews, filter_terms=True, kind="comments", join=_hiring_thread, stage=_read_comment),
    SourceSpec("foundit", "india", "Foundit", "none", "jobSearchResponse struct<data: array<string>>",
               "jobSearchResponse.data",
               "jobId string, id string, title string, companyName string, locations string, applyUrl string, "
               "redirectUrl string, seoJdUrl string, jdUrl string, createdAt bigint, skills string, "
               "skillsWithSynonyms array<struct<value: string>>, employmentTypes array<string>, "
               "minimumSalary struct<currency: string, absoluteValue: double>, "
               "maximumSalary struct<currency: string, absoluteValue: double>, currencyCode string, "
               "hideSalary boolean", foundit, unique="before"),
    SourceSpec("instahyre", "india", "Instahyre", "none", "objects array<string>", "objects",
               "id string, title string, candidate_title string, locations string, keywords array<string>, "
               "public_url string, employer struct<company_name: string>", instahyre),
    SourceSpec("adzuna", "aggregator", "Adzuna", "snippet", "results array<string>", "results",
               "id string, title string, description string, redirect_url string, created string, salary_min double, "
               "salary_max double, salary_is_predicted string, contract_time string, "
               "company struct<display_name: string>, location struct<display_name: string>, "
               "category struct<label: string>", adzuna, keyless=False, filter_terms=True, filter_age=True,
               unique="after"),
    SourceSpec("careerjet", "aggregator", "Careerjet", "snippet", *_JOBS,
               "title string, description string, company string, locations string, url string, salary string, "
               "date string", careerjet, keyless=False, filter_terms=True, unique="after",
               payload_error=_body_error, fails_on_any_error=True),
    SourceSpec("jooble", "aggregator", "Jooble", "snippet", *_JOBS,
               "id string, title string, location string, snippet string, salary string, type string, link string, "
               "company string, updated string", jooble, keyless=False, filter_terms=True, unique="after"),
    SourceSpec("jobspy", "scraper", "JobSpy", "full", *_JOBS,
               "id string, site string, title string, company string, location string, job_url string, "
               "description string, date_posted string, job_type string, is_remote boolean, min_amount double, "
               "max_amount double, currency string, interval string", jobspy, keyless=False,
               payload_error=_jobspy_error, fails_on_any_error=True),
)}
SOURCE_IDS = tuple(SPECS)
