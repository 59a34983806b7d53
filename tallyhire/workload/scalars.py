"""Queries over the column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhire import vocab
from tallyhire.functions import company as cmp
from tallyhire.functions import cost, dates, liveness, pay, place
from tallyhire.functions import text as tx
from tallyhire.operators.lifecycle import mirrored_review
from tallyhire.operators.match import explain_match, profile_fingerprint
from tallyhire.plans.judge import capped_concerns, capped_score
from tallyhire.workload import derive as d
from tallyhire.workload.registry import register
from tallyhire.workload.sql import NOW, flag, num, query, quoted, ts
from tallyhire.workload.views import PAY_COLUMNS, SALARY_LINE

# Whitespace of the rules, for an engine whose \s is ASCII only.
SP = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def rx(expr: str, pattern: str, repl: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{repl}', '{flags}')"


def sql_collapse(e: str) -> str:
    return f"trim({rx(e, SP + '+', ' ')})"


def sql_skill_text(e: str) -> str:
    e = rx(f"lower({e})", r"[（(\[{].*?[）)\]}]", " ")
    return sql_collapse(rx(e, r"[^a-z0-9+#./\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}-]", " "))


def sql_slug(e: str) -> str:
    return rx(rx(rx(sql_skill_text(e), r"[./\s]+", "-"), "-+", "-"), r"^-|-$", "")


def sql_html(e: str) -> str:
    for pattern, repl, flags in (
        (r"<script[\s\S]*?</script>", "", "gi"), (r"<style[\s\S]*?</style>", "", "gi"),
    ):
        e = rx(e, pattern, repl, flags)
    e = f"regexp_replace({e}, '<br{SP}*/?>', chr(10), 'gi')"
    e = f"regexp_replace({e}, '</(p|div|li|h[1-6]|tr)>', chr(10), 'gi')"
    e = rx(e, "<li[^>]*>", "• ", "gi")
    e = rx(e, "<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8377;", "₹"),
                 ("&#x41;", "A"), ("&#38;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    e = rx(e, r"[ \t]{2,}", " ")
    return rx(e, f"^{SP}+|{SP}+$", "")


@register("X01_clean", query(f"""
    SELECT doc_id, md5(CASE WHEN t IN ('null', 'undefined', 'nan') OR t IS NULL THEN '' ELSE {sql_collapse('t')} END) AS digest
    FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN NULL ELSE text END AS t FROM documents)"""))
def _(w):
    t = F.expr("CASE doc_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN NULL ELSE text END")
    return w.raw("documents").select("doc_id", F.md5(tx.clean(t)).alias("digest"))


@register("X02_html_to_text", query(
    f"SELECT page_id, md5(t) AS digest, length(t) AS chars FROM (SELECT page_id, {sql_html('h')} AS t FROM "
    "(SELECT page_id, html || '<p>&#8377;5 &#x41;&#38;#65;</p>' AS h FROM pages))"))
def _(w):
    t = tx.html_to_text(F.concat("html", F.lit("<p>&#8377;5 &#x41;&#38;#65;</p>")))
    return w.raw("pages").withColumn("t", t).select(
        "page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"))


@register("X03_looks_remote", query(f"""
    SELECT id, CASE WHEN regexp_matches(t, '\\b(remote|work from home|wfh|anywhere|distributed)\\b') THEN 1
      WHEN regexp_matches(t, '\\b(on-?site|in-?office|hybrid)\\b') THEN 0 END AS remote
    FROM (SELECT id, lower(coalesce(location, '') || ' ' || title) AS t FROM jobs)"""))
def _(w):
    return w.jobs.select("id", place.looks_remote(F.col("location"), F.col("title")).alias("remote"))


@register("X04_remote_from", query(f"""
    SELECT id, CAST(coalesce(remote, CASE WHEN regexp_matches(t, '\\b(remote|work from home|wfh|anywhere|distributed)\\b') THEN true
      WHEN regexp_matches(t, '\\b(on-?site|in-?office|hybrid)\\b') THEN false END) AS INTEGER) AS remote
    FROM (SELECT id, remote, lower(coalesce(location, '') || ' ') AS t FROM jobs)"""))
def _(w):
    return w.jobs.select("id", place.remote_from(F.col("remote"), F.col("location")).alias("remote"))


@register("X05_job_id", query("SELECT k, id, engine || '-' || substr(id, length(engine) + 2, 12) AS short_id FROM jobs"))
def _(w):
    url = F.concat(F.lit("https://jobs.example.com/"), F.col("k").cast("string"))
    ident = tx.job_id(F.col("engine"), F.col("native_id"), url)
    return w.jobs.select("k", ident.alias("id"), tx.short_id(ident).alias("short_id"))


@register("X06_normalise_skill_text", query(f"SELECT doc_id, md5({sql_skill_text('text')}) AS digest FROM documents"))
def _(w):
    return w.raw("documents").select("doc_id", F.md5(tx.normalise_skill_text("text")).alias("digest"))


WRITTEN = {"written": d.WRITTEN.sql()}


@register("X07_slugify_skill", query(f"SELECT p_partkey, {sql_slug('label')} AS slug FROM written", **WRITTEN))
def _(w):
    return w.derived(d.WRITTEN).select("p_partkey", tx.slugify_skill("label").alias("slug"))


@register("X11_company_key", query(f"""
    SELECT id, {rx(rx(rx("lower(company)", "[.,]", " "), r"\b(" + "|".join(vocab.COMPANY_SUFFIXES + vocab.COMPANY_KEY_EXTRA_SUFFIXES) + r")\b", " "), "[^a-z0-9]+", "")}
      AS company_key FROM jobs"""))
def _(w):
    return w.jobs.select("id", tx.company_key("company").alias("company_key"))


@register("X12_title_key", query(
    f"""SELECT id, trim({rx(rx("lower(title)", r"[(].*?[)]", " "), "[^a-z0-9]+", " ")}) AS title_key FROM jobs"""))
def _(w):
    return w.jobs.select("id", tx.title_key("title").alias("title_key"))


_TOKEN_BASE = rx(rx("lower(company)", "[.,''’]", ""), r"\b(" + "|".join(vocab.COMPANY_SUFFIXES) + r")\b", " ")


@register("X13_candidate_tokens", query(f"""
    SELECT company, array_to_string(list_filter(list_distinct_sorted, lambda t: length(t) >= 2), '|') AS tokens FROM (
      SELECT company, CASE WHEN j = h THEN [j] ELSE [j, h] END AS list_distinct_sorted FROM (
        SELECT company, array_to_string(ws, '') AS j, array_to_string(ws, '-') AS h FROM (
          SELECT company, list_filter(regexp_split_to_array({_TOKEN_BASE}, '[^a-z0-9]+'), lambda x: x <> '') AS ws
          FROM (SELECT DISTINCT company FROM jobs))))"""))
def _(w):
    return w.jobs.select("company").distinct().select("company", tx.candidate_tokens("company").alias("tokens"))


@register("X14_names_agree", query(f"""
    SELECT agree, count(*) AS n FROM (SELECT CAST(x = '' OR y = '' OR contains(x, y) OR contains(y, x) AS INTEGER) AS agree FROM (
      SELECT {rx('lower(j.company)', '[^a-z0-9]', '')} AS x, {rx('lower(b.company)', '[^a-z0-9]', '')} AS y
      FROM jobs j JOIN boards b ON j.k % (SELECT max(CAST(substr(token, 4) AS BIGINT)) + 1 FROM boards) = CAST(substr(b.token, 4) AS BIGINT))) GROUP BY agree"""))
def _(w):
    b = w.boards.select(F.col("company").alias("other"), F.substring("token", 4, 20).cast("bigint").alias("n"))
    boards = b.agg(F.max("n") + 1).scalar()
    pairs = w.jobs.select("company", (F.col("k") % boards).alias("n")).join(b, "n")
    return pairs.select(tx.names_agree(F.col("company"), F.col("other")).alias("agree")).groupBy("agree").agg(
        F.count("*").alias("n"))


@register("X15_squashed_name", query(
    "SELECT lower(replace(company, ' ', '')) AS squashed, count(*) AS n FROM jobs GROUP BY 1"))
def _(w):
    return w.jobs.groupBy(tx.squashed_name("company").alias("squashed")).agg(F.count("*").alias("n"))


_HEAD = "CASE WHEN k % 17 = 0 THEN chr(10) || '  ' ELSE '' END || CASE WHEN k % 19 = 0 THEN title ELSE company || ' | ' || title || " \
        "CASE WHEN k % 3 = 0 THEN ' | $120k - $150k' ELSE '' END || ' | ' || coalesce(location, '') END || chr(10) || 'Join us | now'"


@register("X16_parse_header", query(f"""
    SELECT id, coalesce(ps[1], '') AS company, coalesce(
        list_filter(rest, lambda p: p <> loc AND NOT regexp_matches(p, '[$£€₹]\\s?\\d'))[1], ps[1]) AS title, loc AS location
    FROM (SELECT *, coalesce(list_filter(rest, lambda p: regexp_matches(p, '(?i)\\b(remote|onsite|on-site|hybrid)\\b'))[1], '') AS loc
      FROM (SELECT *, ps[2:] AS rest FROM (SELECT id, list_filter(list_transform(string_split(line, '|'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))),
          lambda p: p <> '') AS ps
        FROM (SELECT id, list_filter(string_split(head, chr(10)), lambda x: trim(x) <> '')[1] AS line FROM (SELECT id, {_HEAD} AS head FROM jobs)))))"""))
def _(w):
    return w.jobs.select("id", tx.parse_header(F.expr(_HEAD)).alias("h")).select("id", "h.*")


@register("X17_resume_text", query(f"""
    SELECT doc_id, md5(t) AS digest, CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words,
      CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) < 60 AS INTEGER) AS suspect
    FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'),
      ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)"""))
def _(w):
    return w.raw("documents").withColumn("t", tx.tidy("text")).select(
        "doc_id", F.md5("t").alias("digest"), tx.word_count("t").alias("words"), tx.suspect_extraction("t").alias("suspect"))


@register("X18_string_list", query("""
    SELECT location, array_to_string(list_distinct_in_order, '|') AS places, n FROM (
      SELECT location, list_filter(list_transform(string_split(coalesce(location, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS list_distinct_in_order,
        count(*) AS n FROM jobs GROUP BY location)"""))
def _(w):
    grouped = w.jobs.groupBy("location").agg(F.count("*").alias("n"))
    return grouped.select("location", tx.string_list(F.coalesce("location", F.lit(""))).alias("places"), "n")


@register("X19_host_and_path", query("""
    SELECT page_id, nullif(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '') AS host,
      CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END
      || regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*(\\?[^#]+)', 1) AS path FROM pages"""))
def _(w):
    return w.raw("pages").select("page_id", tx.host_of("url").alias("host"), tx.path_of("url").alias("path"))


@register("X20_has_og_title", query(r"""
    SELECT page_id, CAST(trim(coalesce(nullif(regexp_extract(body, '(?i)<meta[^>]+property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1), ''),
      regexp_extract(body, '(?i)<meta[^>]+content=["'']([^"'']*)["''][^>]+property=["'']og:title["'']', 1))) <> '' AS INTEGER) AS titled FROM captures"""))
def _(w):
    return w.captures.select("page_id", tx.has_og_title("body").alias("titled"))


@register("X21_escaped_like", query("SELECT count(*) FILTER (contains(html, '%%%')) AS percents, count(*) FILTER (contains(html, 'a_b')) AS under FROM pages"))
def _(w):
    html = F.col("html")
    has = [F.count_if(html.like(f"%{tx.escape_like(t)}%")).alias(n) for t, n in (("%%%", "percents"), ("a_b", "under"))]
    return w.raw("pages").agg(*has)


_FILE = "p_name || split_part('.PDF|.docx|.tar.md|.exe||.txt', '|', CAST(p_partkey % 6 AS INT) + 1)"


@register("X22_file_extension", query(
    "SELECT p_partkey, split_part('pdf|docx|md|~|~|txt', '|', CAST(p_partkey % 6 AS INT) + 1) AS ext FROM part"))
def _(w):
    return w.raw("part").select("p_partkey", F.coalesce(tx.file_extension(F.expr(_FILE)), F.lit("~")).alias("ext"))


@register("X23_parse_posted_at", query(f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS posted_at FROM orders"""))
def _(w):
    at = F.col("o_orderdate")
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss 'UTC'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MMM d, yyyy")
    written = F
    for i, form in enumerate(forms):
        written = written.when(F.col("o_orderkey") % 6 == i, F.date_format(at, form))
    return w.raw("orders").select("o_orderkey", dates.parse_posted_at(written.otherwise("last week")).alias("posted_at"))


@register("X24_epoch", query(f"""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at_text FROM events"""))
def _(w):
    n = F.col("event_id") % 5
    raw = F.when(n == 0, "0").when(n == 1, "soon").when(n == 2, F.unix_millis("ts").cast("string")).otherwise(
        F.unix_seconds("ts").cast("string"))
    return w.raw("events").select("event_id", dates.epoch_to_timestamp(raw).alias("at_text"))


@register("X25_budget_periods", query(f"""
    SELECT {ts("date_trunc('week', ts)", 'week_start')}, {ts("date_trunc('month', ts)", 'month_start')},
      {ts("date_trunc('week', ts) + INTERVAL 7 DAY", 'week_resets')}, {ts("date_trunc('month', ts) + INTERVAL 1 MONTH", 'month_resets')},
      count(*) AS n FROM events GROUP BY ALL"""))
def _(w):
    at = F.col("ts")
    return w.raw("events").groupBy(
        dates.period_start(at, "weekly").alias("week_start"), dates.period_start(at, "monthly").alias("month_start"),
        dates.period_resets(at, "weekly").alias("week_resets"), dates.period_resets(at, "monthly").alias("month_resets"),
    ).agg(F.count("*").alias("n"))


@register("X27_days_since", query(f"""
    SELECT id, CAST(floor((epoch_ms({NOW}) - epoch_ms(posted_at)) / 86400000.0) AS BIGINT) AS days FROM jobs"""))
def _(w):
    return w.jobs.select("id", dates.days_between(w.now, "posted_at").alias("days"))


_B = "(60 + k % 90)"
PARSED = f"""SELECT id, k, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 7 = 0 THEN {_B} * 1000 WHEN k % 7 = 1 THEN (10 + k % 20) * 100000
        WHEN k % 7 = 2 THEN {_B} * 1000 WHEN k % 7 = 3 THEN {_B} * 1000 + 500 WHEN k % 7 = 5 THEN 20 + k % 50 END AS lo,
      CASE WHEN k % 23 = 0 THEN NULL WHEN k % 7 = 0 THEN ({_B} + 40) * 1000 WHEN k % 7 = 1 THEN (31 + k % 20) * 100000
        WHEN k % 7 = 2 THEN ({_B} + 9) * 1000 WHEN k % 7 = 3 THEN {_B} * 1000 + 500 WHEN k % 7 = 5 THEN 80 + k % 50 END AS hi,
      CASE WHEN k % 23 = 0 THEN '' ELSE CASE k % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 3 THEN 'GBP' WHEN 5 THEN 'USD' ELSE '' END END AS currency,
      CASE WHEN k % 7 = 5 AND k % 23 <> 0 THEN 'hourly' ELSE 'annual' END AS period FROM jobs"""


@register("X28_parse_salary", query(f"""
    SELECT id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, currency, period, CASE WHEN lo IS NULL THEN 'absent' ELSE 'parsed' END AS state
    FROM parsed""", parsed=PARSED))
def _(w):
    s = w.jobs.select("id", pay.parse_salary(F.col("description")).alias("s"))
    return s.select("id", F.col("s.min").alias("lo"), F.col("s.max").alias("hi"), F.col("s.currency").alias("currency"),
                    F.col("s.period").alias("period"), F.col("s.state").alias("state"))


def _structured(w):
    return w.jobs.withColumn("s", pay.from_structured(
        F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"), F.col("k") % 2 == 0))


@register("X29_from_structured", query(f"""
    SELECT id, lo, hi, CASE WHEN lo IS NULL AND hi IS NULL THEN '' ELSE cur END AS currency,
      CASE WHEN lo IS NULL AND hi IS NULL THEN 'annual' ELSE per END AS period,
      CASE WHEN lo IS NULL AND hi IS NULL THEN 'absent' WHEN k % 2 = 0 THEN 'estimated' ELSE 'disclosed' END AS state
    FROM (SELECT id, k, {PAY_COLUMNS} FROM jobs)"""))
def _(w):
    return _structured(w).select("id", F.col("s.min").alias("lo"), F.col("s.max").alias("hi"),
                                 F.col("s.currency").alias("currency"), F.col("s.period").alias("period"),
                                 F.col("s.state").alias("state"))


@register("X30_compare_to_target", query(f"""
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN lo IS NULL AND hi IS NULL THEN 'unknown' WHEN per <> 'annual' THEN 'unknown'
      WHEN cur <> '' AND cur <> 'USD' THEN 'unknown' WHEN coalesce(hi, lo) < 60000 THEN 'below' WHEN coalesce(lo, hi) > 90000 THEN 'above'
      ELSE 'within' END AS verdict FROM (SELECT {PAY_COLUMNS} FROM jobs)) GROUP BY verdict"""))
def _(w):
    v = pay.compare_to_target(F.col("s"), 60000, 90000, "USD", "annual")
    return _structured(w).select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@register("X31_format_salary", query(f"""
    SELECT id, {SALARY_LINE} || CASE WHEN lo IS NULL AND hi IS NULL THEN '' WHEN k % 2 = 0 THEN ' (estimated)' ELSE '' END AS line
    FROM (SELECT id, k, {PAY_COLUMNS} FROM jobs)"""))
def _(w):
    return _structured(w).select("id", pay.format_salary(F.col("s")).alias("line"))


_PER = "CASE lower(coalesce(salary_period, 'annual')) WHEN 'annual' THEN 1 WHEN 'monthly' THEN 12 WHEN 'hourly' THEN 2080 END"
_VS = f"""CASE WHEN stated IS NULL OR given = '' OR given <> 'USD' THEN 'unknown' WHEN stated > 100000 + 2000 THEN 'above'
      WHEN stated >= 100000 - 2000 THEN 'within' ELSE 'below' END"""
_VS_FROM = f"""(SELECT *, CAST(round(coalesce(salary_max, salary_min) * {_PER}) AS BIGINT) AS stated,
      upper(trim(coalesce(salary_currency, ''))) AS given FROM jobs)"""


@register("X34_salary_vs_target", query(f"""
    SELECT id, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_min <> salary_max THEN 'range'
      WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN 'single' ELSE 'absent' END AS shape, stated AS annual, {_VS} AS verdict FROM {_VS_FROM}"""))
def _(w):
    lo, hi, cur, per = (F.col(f"salary_{c}") for c in ("min", "max", "currency", "period"))
    return w.jobs.select(
        "id", pay.salary_shape(lo, hi).alias("shape"), pay.to_annual(F.coalesce(hi, lo), per).alias("annual"),
        pay.salary_vs_target(lo, hi, cur, per, 100_000, "USD").alias("verdict"))


@register("X35_remote_reality", query("""
    SELECT CASE WHEN remote IS NULL THEN 'unstated' WHEN NOT remote THEN 'hybrid-or-onsite'
      WHEN trim(coalesce(remote_restriction, '')) = '' THEN 'remote' ELSE 'restricted' END AS reality, count(*) AS n FROM jobs GROUP BY 1"""))
def _(w):
    r = place.remote_reality(F.col("remote"), F.col("remote_restriction"))
    return w.jobs.groupBy(r.alias("reality")).agg(F.count("*").alias("n"))


@register("X36_describe_salary", query(f"""
    SELECT id, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN 'pay not stated' ELSE trim(coalesce(salary_currency, '') || ' ' ||
      CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_min <> salary_max
        THEN format('{{:,}}', CAST(salary_min AS BIGINT)) || '–' || format('{{:,}}', CAST(salary_max AS BIGINT))
        ELSE format('{{:,}}', CAST(coalesce(salary_min, salary_max) AS BIGINT)) END
      || CASE WHEN salary_period IS NOT NULL AND salary_period <> 'annual' THEN '/' || salary_period ELSE '' END
      || CASE WHEN {_VS} = 'unknown' THEN '' ELSE ' (' || {_VS} || ' target)' END) END AS line FROM {_VS_FROM}"""))
def _(w):
    lo, hi, cur, per = (F.col(f"salary_{c}") for c in ("min", "max", "currency", "period"))
    verdict = pay.salary_vs_target(lo, hi, cur, per, 100_000, "USD")
    return w.jobs.withColumn("v", verdict).select("id", pay.describe_salary(lo, hi, cur, per, F.col("v")).alias("line"))


_TYPED = "split_part('12,00,000|$120k|80 000| 12 LPA |none||1.5m', '|', CAST(o_orderkey % 7 AS INT) + 1)"


@register("X37_parse_user_amount", query("""
    SELECT amount, number, count(*) AS n FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 1200000 WHEN 1 THEN 120000 WHEN 2 THEN 80000
      WHEN 3 THEN 1200000 WHEN 6 THEN 1500000 END::BIGINT AS amount, CASE o_orderkey % 7 WHEN 0 THEN 1200000 WHEN 2 THEN 80000 END::DOUBLE AS number
      FROM orders) GROUP BY ALL"""))
def _(w):
    typed = F.expr(_TYPED)
    return w.raw("orders").groupBy(
        pay.parse_user_amount(typed).alias("amount"), pay.optional_number(typed).alias("number")).agg(F.count("*").alias("n"))


@register("X38_call_cost", query("""
    SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CASE WHEN usd = 0 THEN '$0.00' WHEN usd < 0.01 THEN '<$0.01'
      ELSE '$' || CAST(CAST(round(usd, 2) AS DECIMAL(20,2)) AS VARCHAR) END AS usd
    FROM (SELECT *, ceil(length(text) / 4) / 1000000.0 * 2 + ceil(length(text) / 4) / 1000000.0 * 8 AS usd FROM documents)"""))
def _(w):
    tokens = cost.approximate_tokens(F.length("text"))
    usd = cost.estimate_cost(F.lit("gpt-4.1-2025"), F.col("tokens"), F.col("tokens"))
    return w.raw("documents").withColumn("tokens", tokens).select("doc_id", "tokens", cost.format_usd(usd).alias("usd"))


@register("X39_clamp01", query(
    "SELECT o_orderkey, round(least(1, greatest(0, (o_totalprice - 200000) / 150000)), 6) AS share FROM orders"))
def _(w):
    return w.raw("orders").select("o_orderkey", pay.clamp01((F.col("o_totalprice") - 200000) / 150000).alias("share"))


def _esc(p: str) -> str:
    return p.replace("'", "''")


def _classify() -> str:
    arms = []
    for kind, patterns in cmp.DESCRIPTION_CUES:
        for p, words in patterns:
            arms.append(f"WHEN regexp_matches(t, '{_esc(p)}') THEN '{kind}|posting says {_esc(words)}|0'")
    for kind, p in cmp.NAME_CUES:
        arms.append(f"WHEN regexp_matches(company, '{_esc(p)}') THEN '{kind}|name suggests {kind}|{int(kind == 'service')}'")
    return f"CASE {' '.join(arms)} ELSE 'unknown|nothing decisive in the name or text|1' END"


@register("X40_classify_company", query(f"""
    SELECT id, string_split(v, '|')[1] AS company_type, array_to_string(string_split(v, '|')[2:-2], '|') AS reason,
      CAST(string_split(v, '|')[-1] AS INTEGER) AS uncertain
    FROM (SELECT id, {_classify()} AS v FROM (SELECT id, company, coalesce(description, '') AS t FROM jobs))"""))
def _(w):
    c = cmp.classify_company(F.col("company"), F.col("description"))
    return w.jobs.withColumn("c", c).select("id", F.col("c.type").alias("company_type"), F.col("c.reason").alias("reason"),
                                            F.col("c.uncertain").alias("uncertain"))


@register("V22_classify_unclassified", query(f"""
    SELECT company_type, count(*) AS n FROM (SELECT string_split({_classify()}, '|')[1] AS company_type
      FROM (SELECT company, coalesce(description, '') AS t FROM jobs WHERE company_type IS NULL AND canonical_id IS NULL)) GROUP BY company_type"""))
def _(w):
    from tallyhire.plans.jobs import classify_unclassified

    return classify_unclassified(w.jobs).groupBy("company_type").agg(F.count("*").alias("n"))


@register("X44_capped_score", query("""
    SELECT job_id, CASE role WHEN 'different' THEN least(ai_score, 2) WHEN 'adjacent' THEN least(ai_score, 4) ELSE ai_score END AS ai_score,
      CASE WHEN (role = 'different' AND ai_score > 2) OR (role = 'adjacent' AND ai_score > 4) THEN 'Different kind of role (' || role || ')|' ELSE '' END
      || 'scope' AS concerns
    FROM (SELECT job_id, ai_score, split_part('same|adjacent|different', '|', CAST(ascii(right(job_id, 1)) % 3 AS INT) + 1) AS role FROM scores)"""))
def _(w):
    role = F.expr("split_part('same|adjacent|different', '|', CAST(ascii(right(job_id, 1)) % 3 AS INT) + 1)")
    s = w.scores.withColumn("role", role)
    return s.select("job_id", capped_score(F.col("ai_score"), F.col("role")).alias("ai_score"),
                    capped_concerns(F.col("ai_score"), F.col("role"), F.array(F.lit("scope"))).alias("concerns"))


@register("X45_explain_match", query("""
    SELECT job_id, CASE WHEN total_required = 0 THEN 'no requirements listed' ELSE matched_required || '/' || total_required || ' required ('
      || CAST(floor(coverage * 100 + 0.5) AS BIGINT) || '%)' || CASE WHEN total_preferred > 0 THEN ' · ' || matched_preferred || '/' || total_preferred
      || ' preferred' ELSE '' END END AS line FROM matches"""))
def _(w):
    parts = ("matched_required", "total_required", "matched_preferred", "total_preferred", "coverage")
    return w.matches.select("job_id", explain_match(*[F.col(c) for c in parts]).alias("line"))


_JSON = "CASE event_id % 5 WHEN 0 THEN '[\"' || event_type || '\",\"b\"]' WHEN 1 THEN props WHEN 2 THEN NULL WHEN 3 THEN '[\"broken' ELSE '[]' END"


@register("X46_json_array", query(
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || '|b' ELSE '' END AS items FROM events"))
def _(w):
    return w.raw("events").select("event_id", tx.json_array(F.expr(_JSON)).alias("items"))


_ANSWER = ("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' "
           "WHEN 2 THEN 'I think ' || props || ' fits' WHEN 3 THEN 'no answer' ELSE '' END")


@register("X47_model_json", query("""
    SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events"""))
def _(w):
    return w.raw("events").select("event_id", F.from_json(tx.model_json(F.expr(_ANSWER)), "k int")["k"].alias("k"))


@register("X49_fingerprint", query("SELECT fp AS fingerprint FROM fingerprint"))
def _(w):
    return profile_fingerprint(w.profile)


@register("T04_mirrored_review", query("""
    SELECT status, CASE WHEN status IN ('rejected', 'closed', 'ghosted') THEN 'rejected' WHEN status = 'viewed' THEN NULL ELSE 'approved' END AS review,
      count(*) AS n FROM applications GROUP BY status"""))
def _(w):
    return w.applications.groupBy("status", mirrored_review(F.col("status")).alias("review")).agg(F.count("*").alias("n"))


TERMS = ["senior data engineer", "payments", "Go"]


def _word_list(e: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9+#.]+'), lambda x: length(x) > 1 AND x NOT IN ({quoted(vocab.STOPWORDS)}))")


@register("F01_matches_terms", query(
    f"SELECT id, title FROM jobs WHERE list_has_any({_word_list('title')}, ['data', 'engineer', 'payments', 'go'])"))
def _(w):
    return w.jobs.filter(tx.matches_terms(TERMS, F.col("title"))).select("id", "title")


@register("F02_within_age", query(f"""
    SELECT id, {ts('posted_at')} FROM jobs WHERE posted_at IS NULL OR (epoch_ms({NOW}) - epoch_ms(posted_at)) / 86400000.0 <= 200.5"""))
def _(w):
    return w.jobs.filter(dates.within_age("posted_at", w.now, 200.5)).select("id", "posted_at")


@register("F13_not_duplicate", query("SELECT engine, count(*) AS n FROM jobs WHERE canonical_id IS NULL GROUP BY engine"))
def _(w):
    return w.jobs.filter("canonical_id IS NULL").groupBy("engine").agg(F.count("*").alias("n"))


@register("F17_normalise_candidates", query("""
    SELECT id, title FROM jobs WHERE seniority IS NULL AND description <> '' AND canonical_id IS NULL"""))
def _(w):
    from tallyhire.plans.judge import normalise_candidates

    return normalise_candidates(w.jobs).select("id", "title")


@register("F20_enrich_candidates", query(
    "SELECT company, count(*) AS n FROM jobs WHERE NOT description_complete AND company <> '' GROUP BY company"))
def _(w):
    from tallyhire.operators.enrich import enrich_candidates

    return enrich_candidates(w.jobs).groupBy("company").agg(F.count("*").alias("n"))


@register("S0b_run_status", query("""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_type = 'signup' THEN 'rate_limited'
      WHEN event_type = 'error' THEN 'error' WHEN floor(value) > 0 THEN 'ok' ELSE 'empty' END AS status FROM events) GROUP BY status"""))
def _(w):
    e = w.raw("events")
    status = liveness.run_status(
        F.col("event_id") % 13 != 0, F.floor("value"), F.when(F.col("event_type") == "signup", 429),
        F.when(F.col("event_type").isin("error", "signup"), "boom"))
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
