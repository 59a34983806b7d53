"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
#: Keys answered by broadcast: one per shuffle partition, and these many at least.
LEAST_HOT_KEYS = 128
SPREAD = 1024
#: A sieve has 2**18 cells of 64 marks; a cell is one broadcast row of two numbers.
CELL_BITS = 18


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after checking the row count; larger sides join by shuffle."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def sifted(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys may stand in ``wanted``; nearly all others drop out where they are read, before any shuffle.

    Every wanted key sets one of 2**24 marks, whatever their number, so what is broadcast is bounded.  No row with a wanted
    key is lost.  A row without one may stay, in a share of wanted keys to marks at most, so an exact join has to follow.
    """
    def cell(k: Column) -> Column:
        return F.shiftrightunsigned(k, 64 - CELL_BITS)

    def mark(k: Column) -> Column:
        place = F.shiftrightunsigned(k, 58 - CELL_BITS).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    k = F.col("_k")
    marks = wanted.select(F.xxhash64(*keys).alias("_k")).groupBy(cell(k).alias("_cell")).agg(F.bit_or(mark(k)).alias("_marks"))
    met = rows.withColumn("_k", F.xxhash64(*keys)).join(F.broadcast(marks), cell(k) == F.col("_cell"))
    return met.where(F.col("_marks").bitwiseAND(mark(k)) != 0).select(*rows.columns)


def fill_cores(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer tasks than the cluster has cores, before costly per-row work.

    For narrow plans over files only.  An input large enough to fill the cluster is left
    alone, so nothing is shuffled when it would cost something.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_on: Sequence[str],
                weight: str | None = None) -> DataFrame:
    """Left join to a side that is unique per key, without sending a heavy key to one task.

    The heaviest keys of the left side, one per shuffle partition, are answered by a broadcast
    of at most that many right rows.  Their left rows then carry a salt that matches nothing
    on the right, so the shuffle join scatters them; every other key has salt 0.  A key
    outside the broadcast holds at most one partition's even share of the rows.  ``weight`` names a
    right column that already counts the left rows of the key, which saves counting them.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    hot_keys = max(LEAST_HOT_KEYS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if weight is not None:
        hot = right.orderBy(F.desc(weight), *keys).limit(hot_keys)
    else:
        heavy = (
            left.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("_n"))
            .orderBy(F.desc("_n"), *keys).limit(hot_keys).select(*keys)
        )
        hot = right.join(F.broadcast(heavy), keys, "left_semi")
    hot = hot.select(*keys, F.struct(*values).alias("_hot"))
    # always 0, but no literal: Spark would fold that into the condition and deal the rows by the keys alone
    zero = F.least(F.lit(0), F.pmod(F.xxhash64(*keys), F.lit(2)).cast("int"))
    cold = right.select(*keys, zero.alias("_salt"), F.struct(*values).alias("_cold"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull() | no_key, 1 + F.pmod(F.xxhash64(*spread_on), F.lit(SPREAD)).cast("int"))
        .otherwise(0),
    )
    joined = salted.join(cold, [*keys, "_salt"], "left").withColumn("_hit", F.coalesce("_hot", "_cold"))
    return joined.select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def _best_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One row per key.  A column that orders the rows travels in its place there and not once more beside it."""
    rest = [c for c in df.columns if c not in keys]
    placed = {o: f"_o{i}" for i, o in reversed([*enumerate(order)])}
    best = pick(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[c for c in rest if c not in placed]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{placed.get(c, c)}").alias(c) for c in rest])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order`` (an explicit, total tie-break), partially aggregated before the shuffle."""
    return _best_by(df, keys, order, F.max)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _best_by(df, keys, order, F.min)
