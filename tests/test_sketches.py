"""Stored, merged sketches against exact counts and ranks."""

import datetime as dt

from pyspark.sql import functions as F

from tallyhire.operators.sketches import RANK_ERROR, DailySketches, distinct_error, estimates, sketched

DAYS = 70


def postings(spark):
    """70 days over three months, two thirds of them of one source."""
    i = F.col("id")
    return spark.range(60_000).select(
        F.when(i % 3 == 0, "small").otherwise("hot").alias("engine"), F.concat(F.lit("c"), (i * 7919 % 9000)).alias("company"),
        F.when(i % 5 != 0, (i * 31 % 10007).cast("double")).alias("pay"),
        F.date_add(F.lit("2024-01-15").cast("date"), (i % DAYS).cast("int")).cast("timestamp").alias("at"))


def test_merged_days_stay_within_the_bounds_and_a_day_can_be_replaced(spark, tmp_path):
    rows = postings(spark)
    store = DailySketches(spark, str(tmp_path / "s"), ["engine"], {"company": "company"}, {"pay": "pay"})
    store.add(rows, "at")
    march = rows.filter("at >= '2024-03-01'")
    for _ in range(2):  # days that come again count once, other days of their month stay
        store.add(march.filter("at < '2024-03-05'"), "at")
    for frame, sketches in ((rows, store.between()), (march, store.between("2024-03-01", "2024-04-30")),
                            (rows.filter("at BETWEEN '2024-01-31' AND '2024-02-02'"), store.between("2024-01-31", "2024-02-02"))):
        got = {r["engine"]: r for r in estimates(sketches, ["engine"], {"low": 0.1, "mid": 0.5}).collect()}
        for want in frame.groupBy("engine").agg(F.count("*").alias("n"), F.count_distinct("company").alias("c"),
                                                F.sort_array(F.collect_list("pay")).alias("pay")).collect():
            r = got.pop(want["engine"])
            assert r["rows"] == want["n"]
            assert abs(r["company"] - want["c"]) <= distinct_error() * want["c"]
            for q, v in ((0.1, r["pay_low"]), (0.5, r["pay_mid"])):
                n = len(want["pay"])
                assert sum(p < v for p in want["pay"]) <= n * (q + RANK_ERROR) + 1
                assert sum(p <= v for p in want["pay"]) >= n * (q - RANK_ERROR) - 1
        assert not got
    total = estimates(store.between(keys=[]), [], {"mid": 0.5}).first()
    assert total["rows"] == 60_000 and abs(total["company"] - 9000) <= distinct_error() * 9000


def test_nulls_empty_tables_and_undated_rows(spark, tmp_path):
    ddl = "engine string, company string, pay double, at timestamp"
    rows = spark.createDataFrame([("a", None, None, None), ("a", None, float("nan"), dt.datetime(2024, 1, 1)), (None, "x", 5.0, None),
                                  (None, "x", float("inf"), None)], ddl)
    store = DailySketches(spark, str(tmp_path / "s"), ["engine"], {"company": "company"}, {"pay": "pay"})
    for _ in range(2):
        store.add(rows, "at")
        got = {r["engine"]: tuple(r) for r in estimates(store.between(), ["engine"], {"mid": 0.5}).collect()}
        assert got == {"a": ("a", 2, 0, None), None: (None, 2, 1, 5.0)}
    assert estimates(store.between("2024-01-01"), ["engine"], {"mid": 0.5}).collect()[0]["rows"] == 1
    assert sketched(rows.limit(0), ["engine"], {"company": "company"}, {"pay": "pay"}).count() == 0
