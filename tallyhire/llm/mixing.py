"""Mixing sources to target weights by Pfair scheduling.

Every source is a lane of blocks: a block is ``block_size`` units of its documents' sizes, in the source's own order.  Time
is counted in slots of one block.  In a fluid schedule every lane that has blocks left moves on at its weight's share among
those lanes; a block is released in the slot in which the fluid reaches it and due by the end of the one in which the fluid
leaves it.  Earliest deadline first among the released blocks fills the slots.  The fluid fills every slot and keeps to the
windows, so the windows can always be met, and a lane that meets them is at any time less than one block away from its share.

Windows come from the weights themselves, in whole-number arithmetic: nothing is rounded to a frame, and nothing builds up
however long the schedule is.  One task sweeps the slots of the whole schedule; it holds a row per source, hands on a row per
block, and the documents meet these by lane and block.  No document is dropped or repeated; a document's place is the slot of
the block that it begins in.

A document's place in its source is a running total of sizes.  It is taken from totals per chunk of the input order, so a
source with most of the rows is spread over all tasks.

Cases: a null source is a source; every source has its own lane, however many there are; weights that are missing, zero,
negative or not finite fall back to the size of the source to the power ``TEMPER``; a null or empty text has size one; repeated rows
are mixed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyhire.operators.settle import settled

BLOCK_SIZE = 65_536
#: Slots that the sweep hands on at a time; the schedule does not depend on it.
FRAME = 1024
#: Without given weights a source of size *n* weighs ``n ** TEMPER``: large sources are held back, small ones raised.
TEMPER = 0.5
#: Name of the lane for a null source; any other source's lane starts with "=".
NO_SOURCE = "-"
ROW = "__mix_row"
CHUNK_BITS = 10


@dataclass(frozen=True)
class Segment:
    """``repeats`` frames of ``slots`` slots; per lane its quota in a frame and its first block."""

    start: int
    slots: int
    repeats: int
    quotas: dict[str, int]
    first: dict[str, int]


def whole(weights: Iterable[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    ratios = [w.as_integer_ratio() for w in weights]
    common = max((d for _, d in ratios), default=1)  # a power of two, as all of them are
    return [n * (common // d) for n, d in ratios]


def placed(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """The (lane, block) of every slot, earliest deadline first among the released blocks."""
    names = sorted(lane for lane, n in blocks.items() if n > 0)
    if not names:
        return
    count, weight = [blocks[lane] for lane in names], whole(float(weights[lane]) for lane in names)
    # Block b of lane k begins at virtual time b / weight[k].  So shifted, times that differ have different whole parts.
    shift = 2 * max(weight).bit_length()
    ends = [(n << shift) // w for n, w in zip(count, weight)]
    over, moving = [0], [sum(weight)]  # after so many ends: blocks of lanes that are used up, weight of the others
    for k in sorted(range(len(names)), key=ends.__getitem__):
        over.append(over[-1] + count[k])
        moving.append(moving[-1] - weight[k])
    ends.sort()

    def reached(k: int, b: int) -> tuple[int, int]:
        """The slot in which the fluid begins block ``b`` of lane ``k``, and the end of the slot in which it ends ``b - 1``."""
        j = bisect_right(ends, (b << shift) // weight[k])
        slot, part = divmod(moving[j] * b, weight[k])
        return over[j] + slot, over[j] + slot + (part > 0)

    coming, following = [(0, k) for k in range(len(names))], [0] * len(names)
    ready: list[tuple[int, int, int]] = []
    for slot in range(sum(count)):
        while coming and coming[0][0] <= slot:
            _, k = heapq.heappop(coming)
            b = following[k]
            following[k] += 1
            release, deadline = reached(k, b + 1)
            heapq.heappush(ready, (deadline, k, b))
            if b + 1 < count[k]:
                heapq.heappush(coming, (release, k))
        deadline, k, b = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield names[k], b


def frame(quotas: Mapping[str, int]) -> list[tuple[str, int]]:
    """The (lane, block) of every slot of lanes that weigh what they hold."""
    return list(placed(quotas, quotas))


def segments(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = FRAME) -> list[Segment]:
    """The schedule counted in stretches of ``slots`` slots."""
    out: list[Segment] = []
    for part in batched(placed(blocks, weights), slots):
        first: dict[str, int] = {}
        for lane, b in part:
            first.setdefault(lane, b)
        out.append(Segment(len(out) * slots, len(part), 1, dict(Counter(lane for lane, _ in part)), first))
    return out


def _sizes(documents: DataFrame) -> Column:
    return F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")


def _lane(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(NO_SOURCE))


def lanes(documents: DataFrame, weights: Mapping[str, float] | None, block_size: int) -> DataFrame:
    """(_lane, _blocks, _weight) of every source; nothing is collected."""
    totals = documents.groupBy(_lane("source").alias("_lane")).agg(F.sum(_sizes(documents)).alias("_size"))
    tempered, given = F.pow("_size", F.lit(TEMPER)), [("=" + n, float(w)) for n, w in (weights or {}).items() if 0 < w < math.inf]
    if given:
        totals = totals.join(documents.sparkSession.createDataFrame(given, "_lane string, _given double"), "_lane", "left")
        tempered = F.coalesce("_given", tempered)
    return totals.select("_lane", F.ceil(F.col("_size") / block_size).cast("long").alias("_blocks"), tempered.alias("_weight"))


def timetable(sources: DataFrame, slots: int) -> DataFrame:
    """(_lane, _block, mix_slot) of every block: one task sweeps the slots, holds a row per source and writes as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        blocks, weights = {n: k for n, k, _ in rows}, {n: w for n, _, w in rows}
        for part in batched(enumerate(placed(blocks, weights)), slots):
            yield pa.RecordBatch.from_arrays([
                pa.array([n for _, (n, _) in part], pa.string()), pa.array([i for _, (_, i) in part], pa.int64()),
                pa.array([slot for slot, _ in part], pa.int64())], ["_lane", "_block", "mix_slot"])

    return sources.repartition(1).mapInArrow(run, "_lane string, _block long, mix_slot long")


def _slots(documents: DataFrame, weights: Mapping[str, float] | None, block_size: int, slots: int) -> DataFrame:
    """(ROW, mix_slot, mix_offset) of every row of ``documents``, which has a ROW column."""
    seen = documents.select(
        ROW, _sizes(documents).alias("_size"), F.shiftright(ROW, CHUNK_BITS).alias("_chunk"), _lane("source").alias("_lane"))

    # what stands before a chunk in its lane: totals per chunk, summed along the lane in two steps of bounded groups
    before = _running(seen.groupBy("_lane", "_chunk").agg(F.sum("_size").alias("_sum")))
    inside = W.partitionBy("_lane", "_chunk").orderBy(ROW).rowsBetween(W.unboundedPreceding, -1)
    found = seen.join(before, ["_lane", "_chunk"]).select(
        ROW, "_lane", (F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).alias("mix_offset"))
    found = found.withColumn("_block", F.expr(f"mix_offset div {block_size}"))

    # a row per block, so it grows with the bytes: broadcast only while the planner finds it small
    return found.join(timetable(lanes(documents, weights, block_size), slots), ["_lane", "_block"]).select(
        ROW, "mix_slot", "mix_offset")


def _numbered(documents: DataFrame, stored: bool) -> DataFrame:
    """A row is known by its place in the table, which only holds while the rows come in the same order twice."""
    return (documents if stored else settled(documents)).withColumn(ROW, F.monotonically_increasing_id())


def mixed(documents: DataFrame, weights: Mapping[str, float] | None = None, block_size: int = BLOCK_SIZE,
          slots: int = FRAME, stored: bool = False) -> DataFrame:
    """All columns of ``documents`` and ``mix_slot``, ``mix_offset``: the slot of the row's block and its place in the lane.

    ``stored`` says that ``documents`` is read straight from files; else it is written first.
    """
    rows = _numbered(documents, stored)
    return rows.join(_slots(rows, weights, block_size, slots), ROW).drop(ROW)


def _running(totals: DataFrame) -> DataFrame:
    """(_lane, _chunk, _before): the lane's total before each chunk; groups of 4,096 chunks, then of groups."""
    grouped = totals.withColumn("_group", F.shiftright("_chunk", 12))
    groups = grouped.groupBy("_lane", "_group").agg(F.sum("_sum").alias("_total"))
    along = W.partitionBy("_lane").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    earlier = groups.select("_lane", "_group", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_earlier"))
    within = W.partitionBy("_lane", "_group").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return grouped.withColumn("_within", F.coalesce(F.sum("_sum").over(within), F.lit(0))).join(
        earlier, ["_lane", "_group"]).select("_lane", "_chunk", (F.col("_earlier") + F.col("_within")).alias("_before"))


def in_order(documents: DataFrame, weights: Mapping[str, float] | None = None, block_size: int = BLOCK_SIZE,
             slots: int = FRAME, stored: bool = False) -> DataFrame:
    """The rows of ``documents`` in the order of the mixture; written, every stretch of files holds the target shares."""
    rows = _numbered(documents, stored)
    order = _slots(rows, weights, block_size, slots).select(
        ROW, F.struct("mix_slot", "mix_offset").alias("__mix_order"))
    return rows.join(order, ROW).repartitionByRange("__mix_order").sortWithinPartitions("__mix_order").select(
        *[F.col(f"`{c}`") for c in documents.columns])
