"""The stored tables of one scale directory, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyhire.functions.cost import price_call
from tallyhire.operators.match import profile_fingerprint, score_matches
from tallyhire.operators.settle import settled
from tallyhire.operators.skew import first_by
from tallyhire.workload import derive as d


#: Rows of a text-like derived table that one task takes: some tens of seconds of the costliest rules.
ROWS_PER_TASK = 100_000
_PARTS: dict[tuple[str, str], tuple[int, int]] = {}


def parts_for(spark: SparkSession, folder: str, name: str, costly: bool) -> int | None:
    """Into how many parts this scan is spread first; None leaves it as it is.  Looked up once per file.

    A scan with fewer tasks than there are cores is spread over the cores.  Before costly work rows count and not bytes:
    files cut by size, and the largest row group at that, put ever more rows into one task.
    """
    key, cores = (folder, name), spark.sparkContext.defaultParallelism
    if key not in _PARTS:
        scan = spark.read.parquet(f"{folder}/{name}.parquet")
        _PARTS[key] = scan.rdd.getNumPartitions(), scan.count()
    tasks, rows = _PARTS[key]
    if costly:
        return max(cores, -(-rows // ROWS_PER_TASK))
    return cores if tasks < cores else None


class World:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def derived(self, spec: d.Derived) -> DataFrame:
        """A derived table.  A given file is spread first if it is too small to occupy the cores or the rules are costly."""
        base = self.raw(spec.source)
        parts = parts_for(self.spark, self.folder, spec.source, spec.costly)
        if parts is not None:
            base = base.repartition(parts)
        return base.filter(spec.where).selectExpr(*spec.exprs())

    @property
    def now(self) -> Column:
        return F.lit(d.NOW).cast("timestamp")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.derived(d.JOBS)

    @cached_property
    def job_texts(self) -> DataFrame:
        """The postings for rules that read their whole text."""
        return self.derived(replace(d.JOBS, costly=True))

    @cached_property
    def job_skills(self) -> DataFrame:
        """Insert-or-ignore on (job_id, skill): the first row by ordinal stays."""
        rows = self.derived(d.JOB_SKILL_ROWS)
        return first_by(rows, ["job_id", "skill"], ["ordinal", "requirement", "source"])

    @cached_property
    def profile(self) -> DataFrame:
        """Skills held: those whose parts are large on average; at most one row per vocabulary entry.

        Every view reads this table several times, so it is stored once, as the original stores it.
        """
        position = "CAST(p_partkey % 129 AS INT) + 1"
        lists = {"skill": d.SLUGS[:129], "label": d.SKILL_LABELS[:129], "category": d.SKILL_CATEGORIES}
        named = self.raw("part").selectExpr("p_size", *[
            f"split_part('{'|'.join(v)}', '|', {position}) AS {k}" for k, v in lists.items()
        ])
        held = named.groupBy(*lists).agg(F.avg("p_size").alias("mean"), F.sum("p_size").alias("total"))
        return settled(held.filter("mean > 24").select(
            *lists, F.expr(d.pick("total % 4", ("exposure", "working", "strong", "expert"))).alias("level"),
            F.expr("CASE WHEN total % 3 = 0 THEN CAST(total % 9 AS DOUBLE) END").alias("years"),
            F.lit(None).cast("string").alias("evidence"), F.lit("resume").alias("source"),
            F.expr("total % 5 = 0").alias("pinned"), F.lit("2001-01-01").cast("timestamp").alias("updated_at"),
        ).coalesce(1))

    @cached_property
    def matches(self) -> DataFrame:
        """Every posting with skills, scored; the stamp of some rows is missing or from an older profile."""
        last = F.substring("job_id", -1, 1)
        stamp = F.when(last.between("0", "3"), None).when(last.between("4", "7"), "older").otherwise(
            profile_fingerprint(self.profile).scalar())
        return score_matches(self.job_skills, self.profile).withColumn("profile_fingerprint", stamp)

    @cached_property
    def scores(self) -> DataFrame:
        return self.derived(d.SCORES).withColumns({
            "concerns": F.array().cast("array<string>"), "profile_fingerprint": F.lit(None).cast("string"),
        })

    @cached_property
    def signals(self) -> DataFrame:
        none = F.array().cast("array<string>")
        return self.derived(d.SIGNALS).withColumns({
            "red_flags": F.array_repeat(F.lit("flag"), F.col("flags")), "green_flags": none,
            "interview_stages": F.lit(None).cast("int"),
        })

    @cached_property
    def applications(self) -> DataFrame:
        return self.derived(d.APPLICATIONS)

    @cached_property
    def engine_runs(self) -> DataFrame:
        return self.derived(d.ENGINE_RUNS)

    @cached_property
    def calls(self) -> DataFrame:
        return self.derived(d.CALLS).withColumnRenamed("called_at", "at")

    @cached_property
    def ai_spend(self) -> DataFrame:
        priced = price_call(*[F.col(c) for c in ("provider", "model", "input_tokens", "output_tokens", "reported_usd")])
        return self.calls.withColumn("_p", priced).select(
            "id", "at", "provider", "model", "stage", "input_tokens", "output_tokens",
            F.col("_p.usd").alias("estimated_usd"), F.col("_p.source").alias("cost_source"),
        )

    @cached_property
    def boards(self) -> DataFrame:
        return self.derived(d.BOARDS).withColumn("verified_at", F.lit(None).cast("timestamp")).select(
            "company", "ats", "token", "verified_at", "active")

    @cached_property
    def board_postings(self) -> DataFrame:
        return self.derived(d.BOARD_POSTINGS)

    @cached_property
    def captures(self) -> DataFrame:
        return self.derived(d.CAPTURES)

    @cached_property
    def answers(self) -> DataFrame:
        """User turns answered by the next turn of the same conversation."""
        turns = self.derived(d.ANSWER_TURNS)
        asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("answer"))
        return asked.join(said, ["conv_id", "turn"])

    @property
    def tables(self) -> dict[str, DataFrame]:
        names = ("jobs", "job_skills", "matches", "scores", "signals", "applications", "engine_runs", "ai_spend", "boards")
        return _Lazy({"profile_skills": lambda: self.profile, **{n: (lambda n=n: getattr(self, n)) for n in names}})


class _Lazy(dict):
    """Tables built only when a view asks for them."""

    def __init__(self, makers):
        super().__init__(makers)

    def __getitem__(self, name):
        return super().__getitem__(name)()

    def items(self):
        return [(n, self[n]) for n in self]


def flat(df: DataFrame) -> DataFrame:
    """Plain comparable columns: booleans as 0/1, times as text, doubles to six places, lists joined."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])
