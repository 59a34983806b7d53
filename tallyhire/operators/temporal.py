"""Joins on time and on ranges: the last row at or before a time, and ranges that overlap."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from tallyhire.operators.settle import settled

#: Places beyond this are treated as equal to it when bins are chosen; the ranges themselves are compared as given.
FARTHEST = 1 << 60
#: A folded join cuts the line of a key into pieces of some that many rows, and into that many pieces at most.
PIECE_ROWS, PIECES = 200_000, 64


class Folded(NamedTuple):
    """What a folded join returns per left ``own``: how many pairs have another ``value``, and the largest such value."""

    own: str
    value: str
    count: str
    largest: str


def _orderable(df: DataFrame, names: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [n for n in names if "map<" not in kinds[n] and "variant" not in kinds[n]]


def _no_clash(left: DataFrame, names: Sequence[str]) -> None:
    shared = sorted(set(left.columns) & set(names))
    if shared:
        raise ValueError(f"both sides have the columns {shared}; rename them on one side")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              ties: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Every left row with the last right row of its key at or before its time.

    Both sides are laid out together by key and time over range partitions, cut by their number and not by key, so a key that
    holds most rows lies in many of them.  Inside a partition the last right row seen is a running value; the last one of the
    partitions before it, one row per partition, is carried in where none was seen yet.

    The layout is written once.  Of right rows with the same key and time the largest by ``ties``, then by all columns, counts.
    A left row without a match, with a null key or a null time keeps nulls; right rows with a null key or time match nothing.
    Repeated left rows stay repeated.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    _no_clash(left, values)
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_key{i}" for i in range(len(keys))]
    known = right.filter(F.col(f"`{right_time}`").isNotNull()).dropna(subset=keys)
    match = F.struct(*[F.col(f"`{c}`") for c in values])
    rank = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate((*ties, *_orderable(right, values)))])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])

    def side(df: DataFrame, at: str, number: int, *rest: Column) -> DataFrame:
        return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named)], F.col(f"`{at}`").alias("_at"),
                         F.lit(number).alias("_side"), *rest)

    seen = side(known, right_time, 0, rank.alias("_rank"), F.lit(0).cast("long").alias("_spread"), match.alias("_match"))
    kinds = {f.name: f.dataType for f in seen.schema.fields}
    asking = side(left, left_time, 1, F.lit(None).cast(kinds["_rank"]).alias("_rank"),
                  F.xxhash64(*[F.col(f"`{c}`") for c in _orderable(left, left.columns)]).alias("_spread"),
                  F.lit(None).cast(kinds["_match"]).alias("_match"), row.alias("_left"))
    both = seen.unionByName(asking, allowMissingColumns=True)
    order = ["_at", "_side", "_rank", "_spread"]
    laid = settled(both.repartitionByRange(parts, *named, *order).withColumn("_part", F.spark_partition_id()))

    # the last right row of every partition, and of all those before it: as many rows as there are partitions
    place = F.when(F.col("_side") == 0, F.struct(*named, "_at", "_rank"))
    ends = laid.groupBy("_part").agg(F.max_by(F.struct(*named, "_match"), place).alias("_end"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))

    running = W.partitionBy("_part", *named).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = laid.withColumn("_here", F.last("_match", ignorenulls=True).over(running)).filter("_side = 1")
    same = F.lit(True)
    for n in named:
        same = same & (F.col(f"_before.{n}") == F.col(n))
    hit = F.coalesce("_here", F.when(same, F.col("_before._match")))
    return here.join(carried, "_part", "left").withColumn("_hit", hit).select(
        *[F.col(f"_left.`{c}`").alias(c) for c in left.columns], *[F.col(f"_hit.`{c}`").alias(c) for c in values])


def _place(df: DataFrame, name: str) -> Column:
    """A bound as a whole number, in the same order."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return F.floor(F.least(F.greatest(c, F.lit(-FARTHEST)), F.lit(FARTHEST))).cast("long")


def _ranged(df: DataFrame, span: tuple[str, str], keys: Sequence[str], side: str) -> DataFrame:
    """The row as a struct, its bounds, and the level whose bins are wider than the range, so that it meets two at most."""
    start, end = (F.col(f"`{s}`") for s in span)
    real = (start <= end)
    for s in span:
        if isinstance(df.schema[s].dataType, (T.DoubleType, T.FloatType)):
            real = real & ~F.isnan(f"`{s}`")
    out = df.filter(real).dropna(subset=list(keys)).select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), start.alias(f"{side}_start"), end.alias(f"{side}_end"),
        _place(df, span[0]).alias(f"{side}_from"), _place(df, span[1]).alias(f"{side}_to"))
    bits = F.length(F.bin(F.col(f"{side}_to") - F.col(f"{side}_from")))
    return out.withColumn(f"{side}_level", F.floor((bits + 1) / 2).cast("int"))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  keys: Sequence[str] = (), touching: bool = True, salts: int = 4, folded: Folded | None = None) -> DataFrame:
    """All pairs whose ranges overlap and whose ``keys`` are equal, as an equality join on bins.

    A range has a level: bins of 4**level are wider than it, so it lies in one bin or two.  A pair meets at the higher of its
    two levels: the wider side stands there in its own bins, the narrower in those of its level and of every level above it that
    the other side uses (31 at most).  Narrow ranges never meet each other in wide bins, and a wide range is not spread over
    many narrow ones.  A pair that shares two bins counts in the one that holds the later start; the bounds are then compared.

    ``touching`` lets ranges meet that share one bound only.  ``salts`` spreads the left rows of a bin over that many groups, to
    each of which the right rows go; let the right be the smaller side.  Rows with a null key, a null or NaN bound, or an end
    before the start meet nothing.  Equal rows pair one by one.

    ``folded`` gives the pairs folded by a column of the left instead, without making them: see ``_fold``.
    """
    values = [c for c in right.columns if c not in keys]
    _no_clash(left, values)
    if folded:
        if not touching:
            raise ValueError("a folded join takes ranges that share one bound as overlapping")
        return _fold(left, right, left_span, right_span, list(keys), folded)
    named = [f"_key{i}" for i in range(len(keys))]
    a, b = _ranged(left, left_span, keys, "_a"), _ranged(right, right_span, keys, "_b")
    used = {"_a": a.agg(F.collect_set("_a_level")).scalar(), "_b": b.agg(F.collect_set("_b_level")).scalar()}

    def bins(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.expr(
            f"sequence(shiftright({side}_from, 2 * _level), shiftright({side}_to, 2 * _level))")))

    def own(df: DataFrame, side: str, wide: str) -> DataFrame:
        return bins(df.withColumns({"_wide": F.lit(wide), "_level": F.col(f"{side}_level")}), side)

    def above(df: DataFrame, side: str, other: str, equal: bool) -> DataFrame:
        found = df.withColumns({"_wide": F.lit(other), "_level": F.explode(used[other])})
        return bins(found.filter(f"_level {'>=' if equal else '>'} {side}_level"), side)

    # equal levels count as the left being the wider, once
    lefts = own(a, "_a", "_a").union(above(a, "_a", "_b", False))
    rights = above(b, "_b", "_a", True).union(own(b, "_b", "_b"))
    varied = [F.col(f"_a.`{c}`") for c in _orderable(left, left.columns)]
    lefts = lefts.withColumn("_salt", F.pmod(F.xxhash64(*varied), F.lit(salts)).cast("int"))
    rights = rights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    later = F.expr("_bin = shiftright(greatest(_a_from, _b_from), 2 * _level)")
    a0, a1, b0, b1 = (F.col(c) for c in ("_a_start", "_a_end", "_b_start", "_b_end"))
    overlap = ((a0 <= b1) & (b0 <= a1)) if touching else ((a0 < b1) & (b0 < a1))
    return lefts.join(rights, [*named, "_wide", "_level", "_bin", "_salt"]).filter(later & overlap).select(
        *[F.col(f"_a.`{c}`").alias(c) for c in left.columns], *[F.col(f"_b.`{c}`").alias(c) for c in values])


def _fold(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[str],
          folded: Folded) -> DataFrame:
    """(own, count, largest) over all overlapping pairs of equal keys whose ``value`` is not ``own``; none, no row.

    A pair belongs to the place where its later range starts.  The line of a key with many rows is cut at quantiles of the
    bounds, a row goes to all pieces that its range meets (``PIECES`` at most), and a piece counts the pairs whose place lies in
    it (``_folded_piece``).  So work and shuffle follow the rows and not the pairs.  Rows of one key and one bound are not cut.

    Own and value are whole numbers; null ones are in no pair.  Bounds are times, dates or numbers.
    """
    kinds = {t.simpleString() for df, names in ((left, left_span), (right, right_span)) for t in (df.schema[n].dataType for n in names)}
    place = "double" if kinds & {"double", "float"} else "long"
    if not kinds <= {"timestamp"} and not kinds <= {"date"} and not kinds <= {"double", "float", "bigint", "int", "smallint", "tinyint"}:
        raise ValueError(f"bounds of the kinds {sorted(kinds)} can't be compared here")
    if not all(isinstance(t, T.IntegralType) for t in (left.schema[folded.own].dataType, right.schema[folded.value].dataType)):
        raise ValueError(f"{folded.own} and {folded.value} must be whole numbers")
    named = [f"_key{i}" for i in range(len(keys) or 1)]

    def side(df: DataFrame, span: tuple[str, str], value: str, number: int) -> DataFrame:
        start, end = ((F.unix_micros(f"`{n}`") if kinds == {"timestamp"} else F.unix_date(f"`{n}`") if kinds == {"date"}
                       else F.col(f"`{n}`")).cast(place) for n in span)
        out = df.select(*[k.alias(n) for k, n in zip([F.col(f"`{k}`") for k in keys] or [F.lit(0)], named)],
                        F.lit(number).alias("_side"), F.col(f"`{value}`").cast("long").alias("_value"),
                        start.alias("_from"), end.alias("_to")).dropna()
        return out.filter("_from <= _to" if place == "long" else "_from <= _to AND NOT isnan(_from) AND NOT isnan(_to)")

    rows = side(left, left_span, folded.own, 0).union(side(right, right_span, folded.value, 1))
    # only keys with more rows than a piece have cuts, so these are few
    bounds = rows.select(*named, F.explode(F.array("_from", "_to")).alias("_at"))
    cuts = bounds.groupBy(*named).agg(
        (F.count("*") / 2).alias("_n"), F.percentile_approx("_at", [i / PIECES for i in range(1, PIECES)]).alias("_all")
    ).filter(F.col("_n") > PIECE_ROWS).withColumn(
        "_every", F.floor(PIECES / F.least(F.lit(PIECES), F.ceil(F.col("_n") / PIECE_ROWS)))).select(
        *named, F.expr("sort_array(array_distinct(filter(_all, (x, i) -> (i + 1) % _every = 0)))").alias("_cuts"))

    def piece(at: str) -> str:
        """How many cuts are not above a bound, by halving."""
        steps = ", ".join(str(1 << i) for i in reversed(range(PIECES.bit_length())))
        return (f"coalesce(aggregate(array({steps}), 0, (p, s) -> if(p + s <= size(_cuts) AND get(_cuts, p + s - 1) <= {at},"
                " p + s, p)), 0)")

    met = rows.join(F.broadcast(cuts), named, "left").withColumn("_first", F.expr(piece("_from"))).withColumn(
        "_piece", F.explode(F.sequence("_first", F.expr(piece("_to"))))).withColumn("_first", F.expr("_first = _piece"))
    counted = met.groupBy(*named, "_piece").applyInArrow(_folded_piece, "own bigint, n bigint, largest bigint")
    own, value = left.schema[folded.own].dataType, right.schema[folded.value].dataType
    return counted.groupBy(F.col("own").cast(own).alias(folded.own)).agg(
        F.sum("n").alias(folded.count), F.max("largest").cast(value).alias(folded.largest))


def _folded_piece(table: pa.Table) -> pa.Table:
    """(own, n, largest) of every left row that has pairs in this piece of the line.

    Two kinds of pairs: the right row holds the left start, for left rows that start here; or it starts later within the left
    row, for right rows that start here.  Numbers come from sorted bounds, the two largest values of a stretch from a binary
    tree over sorted starts, so that one is left where the other is the left row's own.
    """
    side, value, start, end, first = (
        table.column(c).to_numpy() for c in ("_side", "_value", "_from", "_to", "_first"))
    l, r = side == 0, side == 1
    ranked, rank = np.unique(value[r], return_inverse=True)
    rank = rank + 1  # 0 for none
    own, a0, a1, opens = value[l], start[l], end[l], first[l]
    b0, b1, here = start[r], end[r], first[r]
    place = np.searchsorted(ranked, own)
    same = place < len(ranked)
    same[same] = ranked[place[same]] == own[same]
    mine = np.where(same, place + 1, 0)

    def others(times: np.ndarray, ranks: np.ndarray, asked: np.ndarray, at: np.ndarray, how: str) -> np.ndarray:
        """How many times are not above (``right``) or below (``left``) a place, without those of the left row's own rank."""
        grid, where = np.unique(times, return_inverse=True)
        width = len(grid) + 1
        both = np.sort(ranks * width + where)
        upto = np.searchsorted(grid, at, how)
        equal = np.searchsorted(both, asked * width + upto) - np.searchsorted(both, asked * width)
        return np.searchsorted(np.sort(times), at, how) - equal

    n = np.zeros(len(own), np.int64)
    best = np.zeros(len(own), np.int64)
    if opens.any() and len(b0):
        at, asked = a0[opens], mine[opens]
        n[opens] += others(b0, rank, asked, at, "right") - others(b1, rank, asked, at, "left")
        points, where = np.unique(at, return_inverse=True)
        one, two = _held(np.searchsorted(points, b0, "left"), np.searchsorted(points, b1, "right"), rank, len(points))
        best[opens] = np.where(one[where] == asked, two[where], one[where])
    if here.any() and len(own):
        times, ranks = b0[here], rank[here]
        n += others(times, ranks, mine, a1, "right") - others(times, ranks, mine, a0, "right")
        order = np.argsort(times, kind="stable")
        times, ranks = times[order], ranks[order]
        one, two = _largest(ranks, np.searchsorted(times, a0, "right"), np.searchsorted(times, a1, "right"))
        best = np.maximum(best, np.where(one == mine, two, one))
    kept = n > 0
    return pa.table({"own": own[kept], "n": n[kept], "largest": ranked[best[kept] - 1] if kept.any() else own[kept]})


def _merge(one: np.ndarray, two: np.ndarray, one2: np.ndarray, two2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two largest different values of two such pairs."""
    low = np.where(one == one2, 0, np.minimum(one, one2))
    return np.maximum(one, one2), np.maximum(low, np.maximum(two, two2))


def _largest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two largest different values of every stretch [lo, hi)."""
    size = 1 << max(len(values) - 1, 0).bit_length()
    one, two = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
    one[size:size + len(values)] = values
    level = size
    while level > 1:
        a, b = np.s_[level:2 * level:2], np.s_[level + 1:2 * level:2]
        one[level // 2:level], two[level // 2:level] = _merge(one[a], two[a], one[b], two[b])
        level //= 2
    out, out2 = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    asked = np.flatnonzero(lo < hi)
    lo, hi = lo[asked] + size, hi[asked] + size
    while len(asked):
        for odd, node in (((lo & 1) == 1, lo), ((hi & 1) == 1, hi - 1)):
            to, node = asked[odd], node[odd]
            out[to], out2[to] = _merge(out[to], out2[to], one[node], two[node])
        lo, hi = (lo + 1) >> 1, hi >> 1
        more = lo < hi
        asked, lo, hi = asked[more], lo[more], hi[more]
    return out, out2


def _held(lo: np.ndarray, hi: np.ndarray, values: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The two largest different values of the stretches [lo, hi) that hold a place, for every place."""
    size = 1 << max(places - 1, 0).bit_length()
    one, two = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
    more = lo < hi
    lo, hi, values = lo[more] + size, hi[more] + size, values[more]
    while len(values):
        left, right = (lo & 1) == 1, (hi & 1) == 1
        node, value = np.concatenate([lo[left], hi[right] - 1]), np.concatenate([values[left], values[right]])
        np.maximum.at(one, node, value)
        below = value < one[node]
        np.maximum.at(two, node[below], value[below])
        lo, hi = (lo + 1) >> 1, hi >> 1
        more = lo < hi
        lo, hi, values = lo[more], hi[more], values[more]
    level = 1
    while level < size:
        under, over = np.s_[2 * level:4 * level], np.s_[level:2 * level]
        one[under], two[under] = _merge(one[under], two[under], np.repeat(one[over], 2), np.repeat(two[over], 2))
        level *= 2
    return one[size:size + places], two[size:size + places]
