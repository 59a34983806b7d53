"""Column rules, as tables of input and expected value."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhire.functions import company, cost, dates, liveness, pay, place
from tallyhire.functions import text as tx


@pytest.mark.parametrize("given, expected", [
    (None, ""), ("null", ""), ("nan", ""), ("  a  \n b ", "a b"), ("nullable", "nullable"),
])
def test_clean(one, given, expected):
    assert one(tx.clean, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("<p>A &amp;#65; &#8377;5 &#x41;</p><ul><li>x</li></ul><script>bad()</script>", "A A ₹5 A\n• x"),
    ("a<br/>b<br>c", "a\nb\nc"), ("&lt;b&gt;", "<b>"), (None, ""), ("a\n\n\n\nb   c", "a\n\nb c"),
    ("&#38;#65;", "&#65;"), ("&#65601;", "A"), ("&#xD800;", "�"),
])
def test_html_to_text(one, given, expected):
    assert one(tx.html_to_text, given) == expected


@pytest.mark.parametrize("place_, expected", [
    ("Remote, India", True), ("Hybrid", False), ("On-site", False), ("Chennai", None), ("Remote or hybrid", True),
    ("Remotely", None),
])
def test_looks_remote(one, place_, expected):
    assert one(place.looks_remote, place_) is expected


def test_explicit_no_beats_the_text(one):
    assert one(place.remote_from, False, "Remote", types=["boolean", "string"]) is False


def test_job_id_is_stable_and_falls_back_to_the_url(one):
    a = one(tx.job_id, "lever", "1", "u")
    assert a == one(tx.job_id, "lever", "1", "other") != one(tx.job_id, "ashby", "1", "u")
    assert one(tx.job_id, "lever", "", "u") != one(tx.job_id, "lever", "", "v")
    assert len(a) == len("lever-") + 12


@pytest.mark.parametrize("text, lo, hi, currency, period", [
    ("salary $61,500 - $74,250 per year", 61500, 74250, "USD", "annual"),
    ("pay $88,010 – $91,990", 88010, 91990, "USD", "annual"),
    ("compensation 71 - 83k", 71000, 83000, "", "annual"),
    ("base between $66,000 and $67,500", 66000, 67500, "USD", "annual"),
    ("pay $31 - $38 per hour", 31, 38, "USD", "hourly"),
    ("salary up to £52,300", 52300, 52300, "GBP", "annual"),
    ("CTC: 14 - 19 LPA", 1.4e6, 1.9e6, "INR", "annual"),
    ("₹14,00,000 - ₹19,00,000", 1.4e6, 1.9e6, "INR", "annual"),
])
def test_parse_salary(one, text, lo, hi, currency, period):
    s = one(pay.parse_salary, text)
    assert (s["min"], s["max"], s["currency"], s["period"], s["state"]) == (lo, hi, currency, period, "parsed")


@pytest.mark.parametrize("text", [
    "", "sold 7,300,000 tickets and took $41,000,000 last winter", "our seed round was $3,700,000", "salary 3 - 800000",
    "salary $93,000 - $71,000",
])
def test_salary_absent(one, text):
    assert one(pay.parse_salary, text)["state"] == "absent"


@pytest.mark.parametrize("lo, hi, currency, period, expected", [
    (None, 98_000, "USD", "annual", "within"), (None, 97_999, "USD", "annual", "below"), (90_000, 102_001, "usd ", None, "above"),
    (60, None, "USD", "hourly", "above"), (1e9, 1e9, "EUR", "annual", "unknown"), (1e9, 1e9, "", "annual", "unknown"),
    (9000, None, "USD", "weekly", "unknown"),
])
def test_salary_vs_target(one, lo, hi, currency, period, expected):
    got = one(lambda a, b, c, p: pay.salary_vs_target(a, b, c, p, 100_000, "USD"), lo, hi, currency, period,
              types=["double", "double", "string", "string"])
    assert got == expected


@pytest.mark.parametrize("typed, amount", [("12,00,000", 1200000), ("$120k", 120000), ("80 000", 80000), ("12 LPA", 1200000), ("abc", None), ("", None)])
def test_parse_user_amount(one, typed, amount):
    assert one(pay.parse_user_amount, typed) == amount


def plain_fit(where, remote, preferred):
    """The rule of the place tiers, restated."""
    low = (where or "").lower()
    if any(p.strip().lower() in low for p in preferred if p.strip()):
        return 3
    away = remote is True or "remote" in low
    if away and (any(r in low for r in place.OPEN_REGIONS) or not any(r in low for r in place.RESTRICTED_REGIONS)):
        return 2
    return 1 if low.strip(" ") in place.UNSTATED_PLACES else 0


def test_location_fit_over_a_grid(spark):
    towns = ["Oslo", "Hilo, Hawaii", "A%B quay", "A_B quay", "AxB quay", "O'Brien point", "back\\slash bay", ""]
    frames = ["{}", "Remote {}", "{} (remote, usa)", "{} or anywhere, us only", "  {}  ", "{} / Germany"]
    wheres = [f.format(t) for t in towns for f in frames] + list(place.UNSTATED_PLACES) + [None]
    rows = [(k, w, r) for k, (w, r) in enumerate((w, r) for w in wheres for r in (True, False, None))]
    df = spark.createDataFrame(rows, "k int, w string, r boolean")
    for preferred in (["oslo"], ["A%B", " hilo "], ["a_b"], ["O'Brien"], ["k\\s"], ["", "nowhere else"]):
        got = {x.k: x.tier for x in df.select("k", place.location_fit(F.col("w"), F.col("r"), preferred).alias("tier")).collect()}
        assert got == {k: plain_fit(w, r, preferred) for k, w, r in rows}, preferred


@pytest.mark.parametrize("count", range(3))
def test_blank_preferences_set_no_tier(count):
    assert place.location_fit(F.lit("Oslo"), F.lit(True), [" " * n for n in range(count)]) is None


@pytest.mark.parametrize("name, body, kind, uncertain", [
    ("X", "Our client is hiring", "staffing", False), ("X", "non-profit work", "nonprofit", False), ("X", "ngo", "unknown", True),
    ("Acme Technologies", "", "service", True), ("Acme Consulting", "our platform", "product", False), ("Acme", "", "unknown", True),
])
def test_company_type(one, name, body, kind, uncertain):
    c = one(company.classify_company, name, body)
    assert (c["type"], c["uncertain"]) == (kind, uncertain)


@pytest.mark.parametrize("url, outcome, status, final, body, state", [
    ("https://a.io/1", "error", 403, None, None, "unreachable"), ("https://a.io/1", "gone", 410, None, None, "gone"),
    ("https://boards.greenhouse.io/a/1", "ok", 200, "https://boards.greenhouse.io/a?error=true", "", "closed"),
    ("https://jobs.ashbyhq.com/a/1", "ok", 200, None, "<meta property=\"og:title\" content=\"Dev\">", "open"),
    ("https://jobs.ashbyhq.com/a/1", "ok", 200, None, "<meta property=\"og:title\" content=\" \">", "closed"),
    ("https://a.recruitee.com/o/1", "ok", 200, "https://recruitee.com/", "", "closed"),
    ("https://a.io/1", "ok", 200, "https://b.io/", "", "closed"), ("https://a.io/1", "ok", 200, None, "This position has been filled", "closed"),
    ("https://a.io/1", "ok", 200, None, "hello", "open"), ("https://a.io/1", "odd", 200, None, "", "unknown"),
])
def test_liveness(one, url, outcome, status, final, body, state):
    v = one(liveness.assess_liveness, url, outcome, status, final, body, types=["string", "string", "int", "string", "string"])
    assert v["state"] == state and v["reason"]


@pytest.mark.parametrize("text, expected", [
    ("2026-08-05 10:10:39 UTC", dt.datetime(2026, 8, 5, 10, 10, 39)), ("2026-08-05", dt.datetime(2026, 8, 5)),
    ("Wed, 05 Aug 2026 10:10:39 GMT", dt.datetime(2026, 8, 5, 10, 10, 39)), ("2026-08-05T10:10:39.500Z", dt.datetime(2026, 8, 5, 10, 10, 39, 500000)),
    ("soon", None), ("", None), (None, None),
])
def test_posted_at(one, text, expected):
    assert one(dates.parse_posted_at, text) == expected


def test_age_keeps_unknown_and_window_drops_it(one):
    now = F.lit("2026-01-31").cast("timestamp")
    assert one(lambda t: dates.within_age(t, now, 30), None, types=["timestamp"]) is True
    assert one(lambda t: dates.posted_within(t, now, 30), None, types=["timestamp"]) is False


@pytest.mark.parametrize("model, price", [("GPT-4.1-mini-x", 0.4), ("gpt-4.1", 2.0), ("mystery", None)])
def test_longest_prefix_price(one, model, price):
    got = one(cost.price_of, model)
    assert (got["input"] if got else None) == price


@pytest.mark.parametrize("text, key", [
    ("Here: {\"a\": 1} ok", '{"a": 1}'), ("```json\n{\"a\": 2}\n```", '{"a": 2}'), ("{\"a\": 3}", '{"a": 3}'), ("none", None), ("", None),
])
def test_model_json(one, text, key):
    got = one(tx.model_json, text)
    assert (got.strip() if got else None) == key


def test_header(one):
    h = one(tx.parse_header, "\n Acme | Backend Dev | $120k | REMOTE (EU) \nmore")
    assert (h["company"], h["title"], h["location"]) == ("Acme", "Backend Dev", "REMOTE (EU)")
    assert one(tx.parse_header, "just text")["title"] == "just text"
    assert one(tx.parse_header, "")["company"] == ""


@pytest.mark.parametrize("text, lo, hi", [
    ("We pay well. " + "word " * 200 + "The salary is $61,000 - $72,000", 61000, 72000),  # a later cue has the figure
    ("offers of all sorts " + "word " * 5000 + "pay £54,000", 54000, 54000),
    ("x" * 900 + " $61,000 - $72,000 " + "y" * 900, 61000, 72000),  # no cue at all
    ("salary 3 - 800000 " + "word " * 200 + "pay $61,000", None, None),  # a rejected range decides
    ("We pay well. " + "word " * 200, None, None), ("pay " * 3000, None, None),
])
def test_parse_salary_reads_the_whole_text(one, text, lo, hi):
    s = one(pay.parse_salary, text)
    assert (s["min"], s["max"]) == (lo, hi)


@pytest.mark.parametrize("text, lo, hi, period", [
    ("We pay well. " + "word " * 90 + "Range $100,000 - $120,000", 100000, 120000, "annual"),  # far from every cue
    ("We offer work for people with 3-5 years. " + "word " * 100 + "Salary: $100,000 - $120,000", 100000, 120000, "annual"),
    ("We offer 3-5 years of growth and $100,000 - $120,000", 100000, 120000, "annual"),  # both near one cue
    ("We offer a bonus of $7 and " + "word " * 100 + "salary $61,000", 61000, 61000, "annual"),
    *[("salary " + "x" * n + " $100,000 - $120,000 a year", 100000, 120000, "annual") for n in (375, 380, 385, 390, 395, 398)],
    ("pay per hour: $9,000 - $12,000", None, None, "annual"), ("Hourly: $31 - $38", 31, 38, "hourly"),
])
def test_parse_salary_tries_every_cue_and_range(one, text, lo, hi, period):
    s = one(pay.parse_salary, text)
    assert (s["min"], s["max"], s["period"]) == (lo, hi, period)
