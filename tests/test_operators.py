"""Operators against hand-worked cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhire import schemas
from tallyhire.operators import dedupe, enrich, extract, graph, lifecycle, match, profile, robots, skew, upsert

SECTIONS = "Requirements: strong Go, PostgreSQL and C++.\nNice to have: Kafka, Terraform"


def found(spark, text, flat=False):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return {r["slug"]: r["requirement"] for r in extract.extract_skills(df, "id", F.col("t"), flat).collect()}


def test_sections_decide_requirement(spark):
    got = found(spark, SECTIONS)
    assert {k: got[k] for k in ("go", "postgresql", "cpp", "kafka", "terraform")} == {
        "go": "required", "postgresql": "required", "cpp": "required", "kafka": "preferred", "terraform": "preferred"}
    assert set(found(spark, SECTIONS, flat=True).values()) == {"required"}


@pytest.mark.parametrize("text, has", [
    ("Go beyond code", False), ("own go-to-market", False), ("participate in projects", False), ("Java, Go, Python", True),
    ("written in Go", True), ("proficiency in Go", True), ("Go developer", True), ("golang", True), ("let's go", False),
])
def test_ambiguous_names_need_context(spark, text, has):
    assert ("go" in found(spark, text)) is has


def test_extraction_matches_a_plain_scan(spark):
    import re

    from tallyhire import vocab

    rnd = random.Random(7)
    words = [t.term for t in vocab.search_terms() if not t.ambiguous] + ["xjava", "c++x", "boot", "-", "/", ",", "the", "sqlish"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in extract.extract_skills(df, "id", F.col("t"), flat=True).collect():
        got.setdefault(r["id"], {})[r["slug"]] = r["evidence"]
    for i, text in enumerate(texts):
        norm, want = vocab.plain(text), {}
        for t in vocab.search_terms():
            if t.ambiguous or t.slug in want:
                continue
            if re.search(rf"(?<![a-z0-9]){re.escape(t.term)}(?![a-z0-9])", norm):
                want[t.slug] = t.term
        assert {k: v for k, v in got.get(i, {}).items() if v != k or k not in vocab.AMBIGUOUS_SLUGS} == want


def skills_frame(spark, rows):
    return spark.createDataFrame(rows, "job_id string, skill string, label string, requirement string, source string, ordinal bigint")


def profile_frame(spark, rows):
    return spark.createDataFrame(rows, "skill string, label string, category string, level string")


def test_match_arithmetic(spark):
    rows = [("a", s, s, "required", "scan", i) for i, s in enumerate(["java", "kafka", "sql"])] + [("a", "go", "go", "preferred", "scan", 3)]
    rows += [("b", "java", "java", "required", "scan", 0)]
    prof = profile_frame(spark, [("java", "Java", "language", "expert"), ("sql", "SQL", "language", "exposure"), ("rust", "Rust", "language", "strong")])
    m = {r["job_id"]: r for r in match.score_matches(skills_frame(spark, rows), prof).collect()}
    assert (m["a"]["matched_required"], m["a"]["total_required"], m["a"]["total_preferred"]) == (2, 3, 1)
    expected = 0.6 * (1.55 / 7) + 0.2 * 0 + 0.15 * 0.5 + 0.05 * 0.5
    assert m["a"]["match_score"] == pytest.approx(expected) and m["a"]["coverage"] == pytest.approx(2 / 3)
    assert m["b"]["match_score"] < 0.35
    ranked = spark.createDataFrame([("a",)], "job_id string")
    lists = match.attach_skill_lists(ranked, skills_frame(spark, rows), prof).first()
    assert (lists["matched"], lists["missing"], lists["bonus"]) == (["java", "sql"], ["kafka", "go"], ["rust"])


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        match.MatchWeights(required=0.9)


def test_resolution(spark):
    df = spark.createDataFrame([("Postgres",), ("C++",), ("C",), ("x",), ("Spring Boot (3 yrs)",), ("Cobol 85!",), ("",), ("spring-boot",)], "label string")
    got = {r["label"]: r["slug"] for r in extract.resolve_labels(df, "label").collect()}
    assert got == {"Postgres": "postgresql", "C++": "cpp", "C": "c", "x": None, "Spring Boot (3 yrs)": "spring-boot", "Cobol 85!": "cobol-85", "": None, "spring-boot": "spring-boot"}


def test_profile_mentions_and_evidence(spark):
    text = "Skills: Kafka, payments\nBuilt payment systems on Kafka handling payments and payment processing"
    rows = {r["skill"]: r for r in profile.profile_from_text(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert rows["payments"]["mentions"] == 4 and rows["payments"]["level"] == "strong"
    assert rows["kafka"]["level"] == "working" and rows["kafka"]["evidence"].startswith("Built")


@pytest.mark.parametrize("small", [0, 1000])
def test_upsert_equals_sequential_application(spark, small):
    rnd = random.Random(3)
    target = [(f"j{i}", rnd.choice(["", "X"]), rnd.choice(["", "u"]), f"old{i}", rnd.random() < 0.5) for i in range(30)]
    batch = [(f"j{rnd.randint(0, 45)}", rnd.choice(["", f"L{i}"]), rnd.choice(["", f"u{i}"]), f"d{i}", rnd.random() < 0.4, i) for i in range(120)]
    cols = "id string, location string, apply_url string, description string, description_complete boolean"
    state = {r[0]: list(r[1:]) for r in target}
    for key, loc, url, desc, full, _ in batch:
        if key not in state:
            state[key] = [loc, url, desc, full]
            continue
        old = state[key]
        state[key] = [loc or old[0], old[1] or url, desc if (full and not old[3]) else old[2], old[3] or full]
    out = upsert.upsert(spark.createDataFrame(target, cols), spark.createDataFrame(batch, cols + ", ordinal int"), ["id"], upsert.JOBS_RULES,
                        "ordinal", small_batch_rows=small)
    assert {r["id"]: [r["location"], r["apply_url"], r["description"], r["description_complete"]] for r in out.collect()} == state
    again = upsert.upsert(out, spark.createDataFrame(batch, cols + ", ordinal int"), ["id"], upsert.JOBS_RULES, "ordinal")
    assert again.count() == len(state)


def test_spread_join_equals_plain_left_join_on_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 400}"), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, id int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 400, 2)], "k string, v int")
    plain = sorted((r["id"], r["v"]) for r in left.join(right, "k", "left").collect())
    assert sorted((r["id"], r["v"]) for r in skew.spread_join(left, right, ["k"], ["id"]).collect()) == plain


def test_dedupe_keeps_levels_and_places_apart(spark):
    body = "We run a fleet of ferries and mend what breaks."
    rows = [("a", "Acme Inc.", "Engineer II", "Pune", body, False), ("b", "ACME", "engineer ii", " pune ", body.upper() + "!", True),
            ("c", "Acme", "Engineer III", "Pune", body, True), ("d", "Acme", "Engineer II", "Goa", body, True),
            ("e", "", "Engineer II", "Pune", body, True), ("f", "Acme", "Engineer II (Harbour team)", "Pune", body, True),
            ("g", "Acme", "Engineer II (Dock team)", "Pune", body, True), ("h", "Acme", "Engineer II", "Pune", "Another text altogether.", True),
            ("i", "Acme", "Nurse", "Pune", "", True), ("j", "Acme", "Nurse", "Pune", None, True)]
    jobs = spark.createDataFrame(rows, "id string, company string, title string, location string, description string, description_complete boolean")
    jobs = jobs.withColumn("canonical_id", F.lit(None).cast("string"))
    assert {r["id"]: r["canonical_id"] for r in dedupe.assign_canonical(jobs).collect()} == {
        r[0]: "b" if r[0] == "a" else None for r in rows}


def plain_groups(rows):
    """canonical id of every posting by comparing all texts of an opening."""
    import re

    def words(t):
        return re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()

    sets = {}
    for i, company, title, place, body, complete in rows:
        w = words(body)
        runs = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        sets[i] = ((company.lower(), title.lower(), place.lower()), runs, bool(complete), len(body or ""))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (block_i, a, full_a, _) in sets.items():
        for j, (block_j, b, full_b, _) in sets.items():
            if i < j and block_i == block_j and a and b:
                common = len(a & b)
                near = 100 * common >= 80 * len(a | b)
                for x, fx, y, fy in ((a, full_a, b, full_b), (b, full_b, a, full_a)):
                    near |= not fx and fy and 8 <= len(x) < len(y) and 100 * common >= 80 * len(x)
                if near:
                    root[find(i)] = find(j)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    best = {r: min(g, key=lambda i: (not sets[i][2], -sets[i][3], i)) for r, g in groups.items()}
    return {i: None if best[find(i)] == i else best[find(i)] for i in sets}


def test_dedupe_equals_comparing_all_texts(spark):
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "ka lo mi ru se to va".split() for b in "ne pi dor gal xu".split()]

    def edited(text, share):
        return " ".join(rnd.choice(words) if rnd.random() < share else w for w in text.split())

    rows = []
    for opening in (("Acme", "Nurse", "Pune"), ("Acme", "Nurse", "Goa"), ("Globex", "Cook (Night)", "")):
        for base in (" ".join(rnd.choices(words, k=n)) for n in (60, 150, 400)):
            texts = [base, base.upper()] + [edited(base, share) for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.2) for _ in range(4)]
            chain = [base]
            for _ in range(6):
                chain.append(edited(chain[-1], 0.015))
            for t in texts + chain:
                rows.append((f"j{len(rows):04d}", *opening, t, rnd.random() < 0.7))
            for cut in (4, 11, 13, 30, 50):
                rows.append((f"j{len(rows):04d}", *opening, " ".join(base.split()[5:5 + cut]), False))
    rows += [(f"j{len(rows) + k:04d}", "Acme", "Nurse", "Pune", t, k % 2 == 0) for k, t in enumerate([None, "", "one two", "One, two!", "..."])]
    jobs = spark.createDataFrame(rows, "id string, company string, title string, location string, description string, description_complete boolean")
    jobs = jobs.withColumn("canonical_id", F.lit("old")).withColumn("node", F.lit(1)).repartition(5)
    want = plain_groups(rows)
    assert {r["id"]: r["canonical_id"] for r in dedupe.assign_canonical(jobs).collect()} == want
    picks = {r["canonical"]: r["copies"] for r in dedupe.canonical_picks(jobs).collect()}
    sizes = {}
    for i, c in want.items():
        if c is not None:
            sizes[c] = sizes.get(c, 1) + 1
    assert picks == sizes and max(sizes.values()) > 20
    assert dedupe.assign_canonical(jobs.limit(0)).count() == 0


@pytest.mark.parametrize("links", [[(1, 1)], [(k, k + 1) for k in range(20)], [(0, k) for k in range(1, 50)] + [(90, 91), (95, 91)]])
def test_connected_rows_know_their_smallest(spark, links):
    root = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in root:
        for u, v in links:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    df = spark.createDataFrame(links, "u long, v long")
    assert {r["node"]: r["root"] for r in graph.connected(df).collect()} == root


@pytest.mark.parametrize("lookback", [None, 25])
def test_cue_index_equals_searching_the_prefix(spark, lookback):
    from tallyhire import vocab

    rnd = random.Random(5)
    cues = vocab.PREFERRED_CUES + vocab.REQUIRED_CUES
    texts = ["", "a plus", "plusplus a plus", "required", "must have nice to have", "x" * 40]
    texts += [rnd.choice(["", " ", "."]).join(rnd.choices(cues + ("kafka", "a", "requir", "nice to"), k=rnd.randint(1, 12))) for _ in range(80)]
    texts.append(" ".join(rnd.choices(cues + ("kafka", "word", "more"), k=6000)))
    rows = [(k, t, p) for k, t in enumerate(texts) for p in {1, *(rnd.randint(1, len(t) + 1) for _ in range(8))}]
    df = spark.createDataFrame(rows, "k int, t string, p int")
    got = df.select("k", "p", extract.requirement_at(extract.cue_index(F.col("t")), F.col("p"), lookback).alias("need")).collect()

    def last(before, kind):
        return max((s for c in kind for s in range(max(0, len(before) - 400), len(before)) if before.startswith(c, s)), default=-1)

    for r in got:
        before = texts[r["k"]][max(0, r["p"] - 1 - (lookback or r["p"])):r["p"] - 1]
        preferred, required = last(before, vocab.PREFERRED_CUES), last(before, vocab.REQUIRED_CUES)
        assert r["need"] == ("preferred" if preferred > required else "required"), (texts[r["k"]][:200], r["p"])


def test_enrich_takes_first_long_body(spark):
    jobs = spark.createDataFrame([("1", "Acme, Inc.", "Dev (Go)", "", False), ("2", "Acme", "Ops", "", False), ("3", "Acme", "Dev", "own", True)],
                                 "id string, company string, title string, description string, description_complete boolean")
    boards = spark.createDataFrame([("Acme", "lever", "a", True)], "company string, ats string, token string, active boolean")
    posts = spark.createDataFrame([("lever", "a", 0, "Dev", "x"), ("lever", "a", 1, "dev!", "y" * 201), ("lever", "a", 2, "Dev", "z" * 300)],
                                  "ats string, token string, ordinal bigint, title string, description string")
    got = {r["id"]: r["description"][:1] for r in enrich.enrich_snippets(jobs, boards, posts).collect()}
    assert got == {"1": "y", "2": "", "3": "o"}
    assert enrich.enrich_summary(jobs, boards, posts).first().asDict() == {"candidates": 2, "enriched": 1, "unmatched": 1, "boards_queried": 1}


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: TallyBot\nUser-agent: x\nDisallow: /jobs/ # no\nAllow: /jobs/public/\nDisallow: /*.pdf$\nCrawl-delay: 2\n"


@pytest.mark.parametrize("path, allowed", [("/", True), ("/jobs/1", False), ("/jobs/public/1", True), ("/a.pdf", False), ("/a.pdf?x", True)])
def test_robots(spark, path, allowed):
    cache = spark.createDataFrame([("h.io", ROBOTS, True), ("down.io", "", False)], "host string, body string, reachable boolean")
    pol = robots.policies(cache, "tallybot/1.0")
    urls = spark.createDataFrame([(f"https://h.io{path}",), ("https://down.io/x",), ("https://new.io/",)], "url string")
    got = {r["url"]: r["allowed"] for r in robots.with_permission(urls, "url", pol).collect()}
    assert got == {f"https://h.io{path}": allowed, "https://down.io/x": False, "https://new.io/": True}
    assert pol.filter("host = 'h.io'").first()["crawl_delay"] == 2.0


def test_lifecycle_rules(spark):
    rows = [("a", 1, "2026-01-01", "open", None, None), ("a", 2, "2026-01-02", "set", "submitted", None), ("a", 3, "2026-01-05", "set", "responded", None),
            ("a", 4, "2026-01-06", "set", "submitted", None), ("a", 5, "2026-01-09", "open", None, None), ("b", 1, "2026-01-01", "set", "bogus", None),
            ("c", 1, "2026-01-01", "note", None, "  ")]
    ev = spark.createDataFrame(rows, "job_id string, seq int, at string, kind string, status string, note string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["job_id"]: r for r in lifecycle.replay(ev).collect()}
    assert set(got) == {"a", "c"} and got["a"]["status"] == "submitted" and got["c"]["status"] == "viewed" and got["c"]["note"] is None
    assert str(got["a"]["submitted_at"])[:10] == "2026-01-02" and str(got["a"]["last_status_at"])[:10] == "2026-01-06"
    apps = spark.createDataFrame([("a", "offer")], "job_id string, status string")
    full = schemas.conform(apps, "applications")
    assert lifecycle.apply_updates(full, ev.filter("kind = 'open'")).filter("job_id = 'a'").first()["status"] == "offer"


def test_violations_name_the_column(spark):
    df = spark.createDataFrame([("a", 7), ("b", 3), ("c", None)], "job_id string, ai_score int")
    assert [(r["job_id"], r["violated"]) for r in schemas.violations(df, "scores").collect()] == [("a", ["ai_score"])]


def test_a_backslash_in_a_search_box_is_a_character(spark):
    from tallyhire.functions.text import contains_typed

    rows = spark.createDataFrame([("x\\y co",), ("xy co",), ("100% co",)], "c string")
    def hits(typed):
        return [r["c"] for r in rows.filter(contains_typed("c", typed)).collect()]
    assert hits("X\\y") == hits("x\\") == ["x\\y co"] and hits("x_y") == ["x\\y co"] and len(hits("%co")) == 3


def test_signals_past_the_old_windows_count(spark):
    from tallyhire.functions.company import classify_company

    far = "plain words " * 60_000
    row = spark.createDataFrame([("Acme", far + " our client is hiring")], "c string, d string")
    assert row.select(classify_company(F.col("c"), F.col("d"))["type"].alias("t")).first()["t"] == "staffing"
    files = spark.createDataFrame([("h.io", "User-agent: *\n" + "# filler line\n" * 50_000 + "Disallow: /secret")], "host string, body string")
    assert [r["pattern"] for r in robots.parse_robots(files, "bot").first()["rules"]] == ["/secret"]
    assert set(found(spark, "Nice to have:\n" + "words and more " * 100 + "\nKafka").values()) == {"preferred"}


def test_a_stream_goes_on_from_the_version_in_its_folder(spark, tmp_path):
    from tallyhire.streaming.logs import VersionedTable

    empty = spark.createDataFrame([], "k int")
    first = VersionedTable(spark, f"file://{tmp_path}/t", empty)
    assert first.read().count() == 0
    for batch in (0, 1):
        first.write(first.read(batch).union(spark.createDataFrame([(batch,)], "k int")), batch)
    again = VersionedTable(spark, f"file://{tmp_path}/t", empty)  # as a new driver
    assert sorted(r["k"] for r in again.read().collect()) == [0, 1]
    again.write(again.read(1).union(spark.createDataFrame([(1,)], "k int")), 1)  # a batch that is replayed
    assert sorted(r["k"] for r in again.read().collect()) == [0, 1]


def test_every_facet_value_unless_a_size_is_given(spark):
    from tallyhire.plans.jobs import facets

    jobs = spark.createDataFrame([(f"c{i}", "here", None) for i in range(60)], "company string, location string, canonical_id string")
    assert facets({"jobs": jobs}).count() == 61 and facets({"jobs": jobs}, 5).count() == 6


def test_robots_groups_delays_and_odd_bodies(spark):
    body = ("Disallow: /early\nUser-agent: zed\nUser-agent: *\nDisallow: /star # note\nCrawl-delay: 2\nCrawl-delay: -1\n\n"
            "Sitemap: https://s/a.xml\nuser-agent: Bot/2\nhost: x\nALLOW: /a:b\nCrawl-delay: 7\r\nUser-agent: other\nUser-agent: bot\nDisallow:\nDisallow: /late\n")
    many = "User-agent: *\n" + "".join(f"Disallow: /p{i}\n" for i in range(20_000))
    rows = [("a", body), ("b", None), ("c", "no colon"), ("d", many), ("e", "User-agent: *\nDisallow: /\u0003x\u0001\n"), (None, body)]
    got = {r["host"]: r for r in robots.parse_robots(spark.createDataFrame(rows, "host string, body string"), "bot").collect()}
    assert [(r["allow"], r["pattern"]) for r in got["a"]["rules"]] == [(True, "/a:b"), (False, "/late")]
    assert got["a"]["crawl_delay"] == 7 and got["a"]["sitemaps"] == ["https://s/a.xml"] and got[None]["rules"] == got["a"]["rules"]
    assert got["b"]["rules"] == got["c"]["rules"] == [] and got["b"]["crawl_delay"] is None
    assert len(got["d"]["rules"]) == 20_000 and got["d"]["rules"][-1]["pattern"] == "/p19999"
    assert [r["pattern"] for r in got["e"]["rules"]] == ["/x"]
    other = robots.parse_robots(spark.createDataFrame(rows[:1], "host string, body string"), "none").first()
    assert [r["pattern"] for r in other["rules"]] == ["/star"] and other["crawl_delay"] == 2
    plan = robots.parse_robots(spark.createDataFrame(rows, "host string, body string"), "bot")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_equally_hot_keys_stay_even(spark):
    from pyspark.sql import functions as F

    left = spark.range(20_000).selectExpr("id", "concat('k', id % 200) AS k")
    right = spark.range(200).selectExpr("concat('k', id) AS k", "id AS v")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = skew.spread_join(left, right, ["k"], ["id"])
        assert joined.filter("v = cast(substr(k, 2) AS bigint)").count() == 20_000
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_boards_reach_only_their_own_source(spark):
    from pyspark.sql import functions as F

    from tallyhire.sources import ingest
    from tallyhire.sources.feeds import SPECS
    from tallyhire.sources.spec import SearchQuery

    shape = "seq bigint, kind string, board_company string, board_token string, body string, http_status int, error string"
    sent = spark.createDataFrame([(i, None, "c", t, '{"jobs":[{"id":%d,"title":"t","absolute_url":"u"}]}' % i, None, None)
                                  for i, t in enumerate(["mine", "off", "theirs", None])], shape)
    boards = spark.createDataFrame([("c", "greenhouse", "mine", True), ("c", "greenhouse", "mine", True), ("c", "greenhouse", "off", False),
                                    ("c", "lever", "theirs", True)], "company string, ats string, token string, active boolean")
    kept = ingest.of_own_boards(SPECS["greenhouse"], sent, boards)
    assert [r["board_token"] for r in kept.collect()] == ["mine"]
    assert ingest.of_own_boards(SPECS["greenhouse"], sent, None).count() == 4
    now = F.lit("2024-01-01").cast("timestamp")
    out = {r["engine"]: r["status"] for r in ingest.run_outcomes({"greenhouse": sent, "ashby": sent}, SearchQuery(max_age_days=1e9), now, boards).collect()}
    assert out == {"greenhouse": "ok", "ashby": "skipped"}


def test_draft_prompt_and_fold(spark):
    from tallyhire.plans import judge

    jobs = spark.createDataFrame([("j1", "Co", "Dev", "whole body", "new"), ("j2", "Co", "Ops", "b", "new"), ("j3", "Co", "Old", "b", "approved")],
                                 "id string, company string, title string, description string, review_status string")
    t = {"jobs": jobs,
         "matches": spark.createDataFrame([("j1", 0.9), ("j2", 0.9), ("j3", 0.9)], "job_id string, match_score double"),
         "scores": spark.createDataFrame([], "job_id string, ai_score int"),
         "job_skills": spark.createDataFrame([("j1", "java", "Java", "required", 0)], "job_id string, skill string, label string, requirement string, ordinal bigint"),
         "profile_skills": spark.createDataFrame([("java", "Java", "language", "strong", 3.0), ("go", "Go", "language", "expert", None)],
                                                 "skill string, label string, category string, level string, years double")}
    answers = spark.createDataFrame([("visa?", "none", 3), ("notice?", "a month", 5)], "question string, answer string, times_used bigint")
    asked = {r["job_id"]: r["prompt"] for r in judge.draft_requests(t, answers, 0.5).collect()}
    assert set(asked) == {"j1", "j2"} and "Matched skills: java\nStrengths not asked for: go\nwhole body" in asked["j1"]
    assert asked["j1"].index("notice?") < asked["j1"].index("visa?")
    answer = """concat('{"coverLetter":"', repeat('x', if(job_id = 'j1', 80, 79)), '","resumeNotes":[],"answers":[],"missingInformation":[]}')"""
    out, drafts, _ = judge.draft_jobs(t, answers, lambda q: q.selectExpr("job_id", f"{answer} AS answer", "CAST(NULL AS STRING) AS error"), 0.5)
    assert {r["id"]: r["review_status"] for r in out.collect()} == {"j1": "drafted", "j2": "new", "j3": "approved"}
    assert [r["job_id"] for r in drafts.collect()] == ["j1"]
