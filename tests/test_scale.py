"""What a query works out per row, and how its rows are dealt out, on tables that the tests build."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhire.functions import pay
from tallyhire.operators import dedupe, match as mt, settle, similar
from tallyhire.operators.search import SearchStore
from tallyhire.operators.similar import cut_pairs
from tallyhire.operators.skew import first_by, latest_by, sifted, spread_join
from tallyhire.sources.feeds import SPECS
from tallyhire.sources.ingest import run_source
from tallyhire.sources.spec import SearchQuery
from tallyhire.workload import derive as d, world

PAYLOAD = "seq bigint, kind string, board_company string, board_token string, body string, http_status int, error string"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(SPECS))
def test_a_record_is_parsed_once(spark, tmp_path, name):
    """A filter that was pushed below the projection held a copy of the parser per field it reads."""
    spark.createDataFrame([], PAYLOAD).write.parquet(f"{tmp_path}/p")
    plan = optimized(run_source(SPECS[name], spark.read.parquet(f"{tmp_path}/p"), SearchQuery(("data",), max_age_days=9), F.current_timestamp()))
    other = name in ("hackernews", "smartrecruiters")  # which also read the ids of threads and of detail responses
    assert plan.count(f"from_json(StructField({SPECS[name].record.split()[0]},") == 1 + other


def test_records_that_are_dropped_or_repeated_have_no_pay_worked_out(spark, tmp_path):
    spark.createDataFrame([], PAYLOAD).write.parquet(f"{tmp_path}/p")
    plan = optimized(run_source(SPECS["careerjet"], spark.read.parquet(f"{tmp_path}/p"), SearchQuery(("data",)), F.current_timestamp()))
    assert "remuneration" in plan.split("Window [")[0] and "remuneration" not in plan.split("Window [")[1]


def test_groups_of_a_figure_are_read_once():
    """The chains over scales and currencies mention the suffix some twenty times."""
    text = str(pay.parse_salary(F.col("t"))._jc)
    assert text.count("regexp_extract(") < 40


def test_first_record_of_a_native_id_stands_after_the_filters(spark):
    body = '{"jobs":[{"title":"%s","url":"u","salary":"%s","company":"c"}]}'
    rows = spark.createDataFrame([
        (1, None, "c", "t", body % ("Cook", "$10,000 - $20,000"), None, None), (2, None, "c", "t", body % ("Data cook", "$30 - $40 per hour"), None, None),
        (3, None, "c", "t", body % ("Data chef", "$50,000"), None, None)], PAYLOAD)
    got = run_source(SPECS["careerjet"], rows, SearchQuery(("data",)), F.current_timestamp()).select("seq", "native_id", "title", "salary.*").collect()
    assert [tuple(r) for r in got] == [(2, "u", "Data cook", 30.0, 40.0, "USD", "hourly", "parsed")]


def test_costly_rows_are_dealt_out_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(world, "ROWS_PER_TASK", 100)
    spark.range(2000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spec = d.Derived("part", {"k": "p_partkey"}, costly=True)
    tasks = world.World(spark, str(tmp_path)).derived(spec).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 20 and max(r["count"] for r in tasks) <= 120
    assert world.World(spark, str(tmp_path)).derived(d.Derived("part", {"k": "p_partkey"})).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_column_that_orders_travels_once(spark):
    rows = spark.createDataFrame([(1, 5, "b", "x"), (1, 5, "a", "y"), (1, 7, None, "z"), (None, 2, "a", "n"), (None, 2, "a", "m")],
                                 "k int, at int, kind string, note string")
    first, last = first_by(rows, ["k"], ["at", "kind"]), latest_by(rows, ["k"], ["at", "kind"])
    assert first.columns == last.columns == ["k", "at", "kind", "note"]
    assert {tuple(r) for r in first.collect()} == {(1, 5, "a", "y"), (None, 2, "a", "m")}
    assert {tuple(r) for r in last.collect()} == {(1, 7, None, "z"), (None, 2, "a", "n")}
    aggregate = next(line for line in optimized(first).splitlines() if "Aggregate" in line)
    assert aggregate.count(", at#") == 1 and aggregate.count(", kind#") == 1


def test_rows_without_a_key_are_dealt_over_all_tasks(spark):
    """The salt of the right side was a literal, so the rows went by their keys alone: all without one to the same task."""
    left = spark.range(4000).selectExpr("id", "IF(id < 3000, NULL, id) AS k")
    right = spark.range(2000, 4000).selectExpr("id AS k", "id * 2 AS twice")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = spread_join(left, right, ["k"], ["id"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["id"], r["twice"]) for r in out} == {(i, None if i < 3000 else 2 * i) for i in range(4000)}
    parts = [r["part"] for r in out if r["k"] is None]
    assert max(parts.count(p) for p in set(parts)) < 1000


def test_a_ranking_scans_texts_once(spark):
    jobs = spark.createDataFrame([("a", "Engineer", "Requirements: Python and Kafka", None), ("b", "Cook", "Requirements: Python", None),
                                  ("c", "Cook", "soup", None), ("d", "Cook", "Python", "a")], "id string, title string, description string, canonical_id string")
    skills = spark.createDataFrame([("b", "python", "Python", "required", "engine", 1), ("d", "python", "Python", "required", "engine", 1),
                                    ("z", "python", "Python", "required", "engine", 1)],
                                   "job_id string, skill string, label string, requirement string, source string, ordinal bigint")
    profile = spark.createDataFrame([("python", "strong", "language")], "skill string, level string, category string")
    ranked = mt.rank_all(jobs, skills, profile, F.current_timestamp())
    assert ranked.summary.select("considered", "extracted", "ranked", "skipped").first() == (3, 1, 2, 1)
    assert optimized(ranked.summary).count("Generate") == optimized(ranked.matches).count("Generate") > 0


def test_a_quoted_passage_makes_no_pairs(spark):
    def text(*hashes):
        return list(hashes)

    short = text(*range(10))
    rows = [("cut", 1, (False, short)), ("whole", 1, (True, text(*range(40)))), ("quotes", 1, (True, text(0, 1, *range(50, 90)))),
            ("close", 1, (True, text(*range(8), *range(50, 90))))]
    texts = spark.createDataFrame(rows, "node string, block bigint, text struct<complete: boolean, hashes: array<bigint>>")
    assert {tuple(r) for r in cut_pairs(texts).collect()} == {("cut", "whole"), ("cut", "close")}


def test_a_passage_that_is_half_of_a_cut_text_makes_no_pairs(spark):
    rows = [("cut", 1, (False, list(range(24)))), ("whole", 1, (True, list(range(30)))), ("far", 2, (True, list(range(30))))]
    rows += [(f"quotes{k}", 1, (True, [*range(14), *range(100 * k + 100, 100 * k + 150)])) for k in range(30)]
    texts = spark.createDataFrame(rows, "node string, block bigint, text struct<complete: boolean, hashes: array<bigint>>")
    assert {tuple(r) for r in cut_pairs(texts).collect()} == {("cut", "whole")}


JOB = "id string, company string, title string, location string, description string, description_complete boolean"


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))


def marked(spark, texts):
    rows = [(f"j{k:03d}", "Acme", "Nurse", "Pune", t, True) for k, t in enumerate(texts)]
    jobs = spark.createDataFrame(rows, JOB).withColumn("canonical_id", F.lit(None).cast("string"))
    return {r["id"]: r["canonical_id"] for r in dedupe.assign_canonical(jobs).collect() if r["canonical_id"]}


def test_texts_are_stored_once_and_their_sets_not_at_all(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    texts = [prose(rnd, 400) for _ in range(120)]
    texts += [f"{texts[0]} and so on", texts[1].upper()]
    monkeypatch.setattr(settle, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert marked(spark, texts) == {"j000": "j120", "j121": "j001"}
    # words as they are take as much as the texts, their sets half as much again
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*.parquet")) < sum(map(len, texts))


def test_short_texts_around_one_passage_are_not_all_paired(spark, monkeypatch):
    rnd = random.Random(4)
    passage = prose(rnd, 14)
    texts = [f"{passage} {prose(rnd, 10)}" for _ in range(60)]
    texts += [f"{texts[7]} end", f"{texts[8]} end"]
    pairs, verified = [], similar.verified

    def counted(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(similar, "verified", counted)
    assert marked(spark, texts) == {"j007": "j060", "j008": "j061"}
    assert sum(pairs) < 5 * len(texts)


def test_a_sieve_loses_no_wanted_row(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("x"))
    wanted = spark.range(0, 20_000, 50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("x"))
    kept = sifted(rows, wanted, ["k", "x"])
    assert kept.columns == rows.columns and kept.count() < 420
    assert kept.join(wanted, ["k", "x"]).count() == 400
    assert sifted(rows, wanted.limit(0), ["k", "x"]).count() == 0


def test_the_search_index_holds_no_ids(spark, tmp_path):
    rows = spark.createDataFrame([("an id", "Acme", "Cook", "Oslo")], "id string, company string, title string, location string")
    SearchStore(spark, str(tmp_path), shards=4, buckets=4).build(rows)
    kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{tmp_path}/grams").schema}
    assert "id" not in kinds and kinds["key"] == "bigint"
