"""As-of and interval joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhire.operators import temporal
from tallyhire.operators.temporal import Folded, asof_join, interval_join


def asof_by_hand(left, right):
    out = []
    for i, k, t in left:
        before = [(rt, tie, v) for rk, rt, tie, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        out.append((i, k, t, *(max(before) if before else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_asof_join_equals_brute_force(spark, parts):
    rnd = random.Random(parts)
    keys = ["hot"] * 30 + ["a", "b", "c", None]
    left = [(i, rnd.choice(keys), rnd.choice([None, *range(60)])) for i in range(300)]
    left += left[:5]  # repeated rows
    right = [(rnd.choice(keys), rnd.choice([None, *range(0, 60, 4)]), rnd.randint(0, 3), f"v{i}") for i in range(40)]
    got = asof_join(spark.createDataFrame(left, "i int, k string, t int"),
                    spark.createDataFrame(right, "k string, rt int, tie int, v string"), ["k"], "t", "rt", ["tie"], parts)
    assert got.columns == ["i", "k", "t", "rt", "tie", "v"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == asof_by_hand(left, right)


def test_asof_value_is_carried_over_many_partitions(spark):
    left = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([("hot", 3, "x"), ("zzz", 0, "y")], "k string, rt long, v string")
    got = asof_join(left, right, ["k"], "t", "rt", parts=12)
    assert got.groupBy("v").count().orderBy("v").collect() == [(None, 3), ("x", 1997)]
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000


def test_asof_join_of_empty_tables_and_clashing_names(spark):
    left = spark.createDataFrame([("a", 1)], "k string, t int")
    none = spark.createDataFrame([], "k string, rt int")
    assert [tuple(r) for r in asof_join(left, none, ["k"], "t", "rt").collect()] == [("a", 1, None)]
    assert asof_join(left.limit(0), none, ["k"], "t", "rt").count() == 0
    with pytest.raises(ValueError, match="rename"):
        asof_join(left, left, ["k"], "t", "t")


@pytest.mark.parametrize("touching", [True, False])
def test_interval_join_equals_brute_force(spark, touching):
    rnd = random.Random(11)

    def spans(n, name):
        rows = []
        for i in range(n):
            start = rnd.choice([None, rnd.uniform(-1e3, 1e3), float(rnd.randint(-50, 50)), float(rnd.randint(-50, 50))])
            width = rnd.choice([0.0, 0.5, 1.0, 3.0, 17.0, 400.0, 1e7, -1.0, float("inf"), float("nan")])
            rows.append((f"{name}{i}", rnd.choice(["x", "x", "x", "y", None]), start, None if start is None else start + width))
        return rows

    left, right = spans(120, "l"), spans(90, "r")
    left.append(left[3])
    got = interval_join(spark.createDataFrame(left, "i string, k string, a double, b double"),
                        spark.createDataFrame(right, "j string, k string, c double, d double"), ("a", "b"), ("c", "d"), ["k"], touching)
    want = []
    for i, k, a, b in left:
        for j, rk, c, d in right:
            if None in (k, rk, a, c) or k != rk or not a <= b or not c <= d:
                continue
            if (a <= d and c <= b) if touching else (a < d and c < b):
                want.append((i, j))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want) != []


def test_interval_join_has_no_nested_loop_and_takes_times(spark):
    runs = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 00:00:50"), (2, "2024-01-01 00:00:50", "2024-01-03 00:00:00"),
                                  (3, "2024-01-02 00:00:00", "2024-01-02 00:00:00")], "i int, a string, b string").select(
        "i", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    other = runs.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    got = interval_join(runs, other, ("a", "b"), ("c", "d"))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
    assert interval_join(runs, other.limit(0), ("a", "b"), ("c", "d")).count() == 0


FOLDED = Folded("i", "j", "met", "largest")


@pytest.mark.parametrize("piece_rows, kind", [(200_000, "long"), (5, "long"), (2, "double"), (7, "timestamp")])
def test_folded_interval_join_equals_its_pairs(spark, monkeypatch, piece_rows, kind):
    monkeypatch.setattr(temporal, "PIECE_ROWS", piece_rows)
    rnd = random.Random(piece_rows)

    def spans(n, names, ids):
        rows = []
        for _ in range(n):
            start = rnd.choice([None, *range(-40, 40), *range(5)])
            width = rnd.choice([0, 0, 1, 2, 5, 17, 200, -1])
            rows.append((rnd.choice(ids), rnd.choice(["x", "x", "x", "y", "z", None]), start, None if start is None else start + width))
        i, a, b = names
        cast = [F.col(c).cast(kind).alias(c) for c in (a, b)]
        return spark.createDataFrame(rows + rows[:4], f"{i} int, k string, {a} long, {b} long").select(i, "k", *cast)

    # repeated and null numbers on both sides
    left = spans(260, ("i", "a", "b"), [None, *range(60)])
    right = spans(240, ("j", "c", "d"), [None, *range(-3, 50)])
    pairs = interval_join(left, right, ("a", "b"), ("c", "d"), ["k"]).filter("i <> j")
    want = pairs.groupBy("i").agg(F.count("*").alias("met"), F.max("j").alias("largest"))
    got = interval_join(left, right, ("a", "b"), ("c", "d"), ["k"], folded=FOLDED)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    bare = interval_join(left.drop("k"), right.drop("k"), ("a", "b"), ("c", "d")).filter("i <> j").groupBy("i").agg(F.count("*"), F.max("j"))
    got = interval_join(left.drop("k"), right.drop("k"), ("a", "b"), ("c", "d"), folded=FOLDED)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bare.collect()))
    assert interval_join(left, right.limit(0), ("a", "b"), ("c", "d"), ["k"], folded=FOLDED).count() == 0
    assert interval_join(left.limit(0), right, ("a", "b"), ("c", "d"), ["k"], folded=FOLDED).count() == 0


def test_folded_interval_join_of_many_pairs_makes_none(spark, monkeypatch):
    """Forty thousand rows that all meet: 1.6 billion pairs."""
    monkeypatch.setattr(temporal, "PIECE_ROWS", 10_000)
    n = 40_000
    left = spark.range(n).selectExpr("id AS i", "id AS a", f"id + {n} AS b")
    right = spark.range(n).selectExpr("id AS j", "id AS c", f"id + {n} AS d")
    got = interval_join(left, right, ("a", "b"), ("c", "d"), folded=FOLDED)
    assert [tuple(r) for r in got.groupBy("met", "largest").count().orderBy("largest").collect()] == [
        (n - 1, n - 2, 1), (n - 1, n - 1, n - 1)]


def test_folded_interval_join_refuses_what_it_cannot_compare(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "i int, a string, b string")
    other = rows.toDF("j", "c", "d")
    with pytest.raises(ValueError, match="kinds"):
        interval_join(rows, other, ("a", "b"), ("c", "d"), folded=FOLDED)
    with pytest.raises(ValueError, match="whole"):
        interval_join(rows.selectExpr("a AS i", "i AS a", "i AS b"), other.selectExpr("j", "j AS c", "j AS d"), ("a", "b"), ("c", "d"), folded=FOLDED)
    with pytest.raises(ValueError, match="share one bound"):
        interval_join(rows, other, ("a", "b"), ("c", "d"), touching=False, folded=FOLDED)


def test_sessions_close_by_watermark_and_late_runs_are_counted(spark, tmp_path):
    from tallyhire.streaming import logs

    ddl = "engine string, started_at timestamp, status string, fetched bigint"
    batches = [[("lever", "10:00", "ok"), ("lever", "11:30", "error"), ("ashby", "10:10", "ok")],
               [("lever", "19:00", "ok"), ("ashby", "11:00", "ok")],  # ashby's run still meets its open session
               [("lever", "09:00", "ok"), ("lever", "23:59", "ok")]]  # the first is behind the watermark and alone
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(e, f"2024-01-01 {t}:00", s, 1) for e, t, s in rows],
                                      ddl.replace("started_at timestamp", "started_at string"))
        frame.withColumn("started_at", F.col("started_at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in/*")
        late = logs.run_to_files(logs.run_sessions(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert late == (1 if n == 2 else 0)
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("engine", "date_format(first_run, 'HH:mm')", "runs", "failing")
    assert sorted(tuple(r) for r in got.collect()) == [("ashby", "10:10", 2, 0), ("lever", "10:00", 2, 1), ("lever", "19:00", 1, 0)]
