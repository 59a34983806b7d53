"""Registered queries, their check SQL, sources without a check, and plan shapes."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import __spark_entry__ as entry_points  # noqa: E402
from check import TABLES, compare  # noqa: E402
from tallyhire.plans.jobs import JobFilters  # noqa: E402
from tallyhire.plans.judge import batch_judge, parsed, route, stage_summary  # noqa: E402
from tallyhire.sources.feeds import SPECS  # noqa: E402
from tallyhire.sources.ingest import readiness, run_outcome, run_source  # noqa: E402
from tallyhire.sources.spec import SearchQuery  # noqa: E402
from tallyhire.workload.world import World  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("V01_list_jobs_relevance", "V04_dashboard", "V06_top_matches", "M01_extract_skills_documents", "K01_jobs_upsert", "D01_dedupe_jobs",
          "J13_enrich_snippets", "T03_apply_updates", "X41_assess_liveness", "S_smartrecruiters", "T10_stream_weekly_spend",
          "J17_spend_priced_as_of", "J19_pay_bands", "J20_runs_while_fresh", "T12_stream_run_sessions")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_check(spark, con, name):
    ok, note = compare(entry_points.queries()[name](spark, SMALL), con, entry_points.oracle_sql()[name])
    assert ok, note


def test_every_query_of_the_library_has_a_check():
    from tallyhire.workload import registry

    assert set(registry.QUERIES) == set(registry.CHECKS) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).count() == 50


def test_empty_responses_give_no_rows(spark):
    empty = {"lever": "[]", "remoteok": "[]"}
    for name, spec in SPECS.items():
        body = empty.get(name, "{}")
        rows = spark.createDataFrame([(1, spec.kind, "c", "t", body, None, None)],
                                     "seq bigint, kind string, board_company string, board_token string, body string, http_status int, error string")
        assert run_source(spec, rows, SearchQuery(), F.current_timestamp()).count() == 0, name


def test_one_failing_board_keeps_the_others(spark):
    ddl = "seq bigint, kind string, board_company string, board_token string, body string, http_status int, error string"
    good = '[{"id": "1", "text": "Dev", "hostedUrl": "https://x/1", "descriptionPlain": "d", "createdAt": 1700000000000}]'
    rows = [(1, None, "A", "a", None, 500, None), (2, None, "B", "b", good, 200, None)]
    now = F.current_timestamp()
    out = run_outcome(SPECS["lever"], spark.createDataFrame(rows, ddl), SearchQuery(), now).first()
    assert (out["status"], out["fetched"]) == ("ok", 1)
    out = run_outcome(SPECS["lever"], spark.createDataFrame(rows[:1], ddl), SearchQuery(), now).first()
    assert (out["status"], out["error"]) == ("error", "HTTP 500")
    assert readiness(SPECS["lever"])[0] is False and readiness(SPECS["remotive"])[0] is True


def test_filters_are_parsed_and_no_page_is_cut():
    f = JobFilters.parse({"minAiScore": "x", "minCoverage": "0.5", "sort": "nope", "limit": "99999", "offset": "-2", "q": ""})
    assert (f.min_ai_score, f.min_coverage, f.sort, f.q, f.page()) == (None, 0.5, None, None, (99999, 0))


def test_judge_failures_stay_with_their_row(spark):
    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("boom")
        return '{"score": 3}'

    req = spark.createDataFrame([("a", "ok"), ("b", "bad")], "job_id string, prompt string")
    s = stage_summary(parsed(batch_judge(call)(req), "score int", lambda r: r["score"].between(1, 5))).first()
    assert (s["considered"], s["succeeded"], s["failed"], s["errors"]) == (2, 1, 1, ["b: boom"])
    assert route("judge", {"judge": ("p", None)}, ["q"], {"q"}, {"q": "m"}) == ("q", "m")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    w = World(spark, SMALL)
    q = entry_points.queries()
    for name in ("V01_list_jobs_score", "M06_match_jobs", "D01_dedupe_jobs", "J13_enrich_snippets", "K01_jobs_upsert"):
        text = plan(q[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert "TakeOrderedAndProject" in plan(q["V06_top_matches"](spark, SMALL))
    listing = plan(q["V01_list_jobs_score"](spark, SMALL))
    assert "o_totalprice" not in listing.split("ReadSchema")[1][:200]
    scan = plan(w.raw("orders").filter("o_orderkey = 5").select("o_orderstatus"))
    assert "EqualTo(o_orderkey,5)" in scan


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from tallyhire.sources.sinks import write_bucketed

    spark.sql(f"CREATE DATABASE IF NOT EXISTS hire LOCATION '{tmp_path}/db'")
    w = World(spark, SMALL)
    write_bucketed(w.scores.select("job_id", "ai_score"), "hire.scores_b", "job_id", 4)
    write_bucketed(w.signals.select("job_id", "wlb_score"), "hire.signals_b", "job_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("hire.scores_b").join(spark.table("hire.signals_b"), "job_id", "left")
        assert "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE hire CASCADE")
