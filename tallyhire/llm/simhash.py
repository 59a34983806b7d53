"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary-trie self-join.

Every step after the fingerprints works on distinct fingerprints, so exact copies cost one entry however many there
are.  The sorted fingerprints are a binary trie; its top ``depth`` levels are walked as a join of node pairs whose paths
differ in few bits, and every pair of subtries is then traversed together inside a task: the bits that differ are added
up on the way down and a pair of nodes is dropped once they exceed the budget.  Four differing bits of 64 leave at most
two in one of the halves, so the trie is walked twice, each time with another half first: the first 32 levels have a
budget of two, the rest of four.  Nothing is lost by that, and far fewer pairs of upper nodes survive.

A subtrie that holds many fingerprints is laid out as several blocks of at most ``BLOCK`` neighbours, cut from the sorted
order, so no task holds more than two blocks at a time.  A pair of blocks yields a spanning forest of its links: fewer
edges than fingerprints, with the same components.

Cases: a null or empty text has no word and fingerprint zero; repeated rows share a fingerprint and a component; a null
doc_id takes part, is never smaller than another id, and is returned as null; only doc_id and text are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyhire.llm.common import as_bytes, slices
from tallyhire.llm.components import components
from tallyhire.operators.settle import settled

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
LINK_BITS = 4
BLOCK = 1024
#: Mean fingerprints of a subtrie that is traversed inside a task, and the most levels walked as a join.
SUBTRIE = 512
MAX_DEPTH = 28
#: Levels walked at once inside a task.
STRIDE = 4
#: Pairs of nodes held at once while two subtries are traversed.
FRONTIER = 1 << 21


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit set if set in over half of the shingles' hashes.  ``bytes.lower`` and ``bytes.split`` are ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    span = min(shingle_words, len(words))
    n = len(words) - span + 1
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[span - 1:].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed long."""
    out = documents.select(*keep).schema
    names = [*out.fieldNames(), "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in as_bytes(batch, "text")], np.uint64).view(np.int64)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps)], names=names)

    return documents.select(*keep, "text").mapInArrow(run, out.add("fp", "long"))


def blocks(fps: DataFrame, depth: int) -> DataFrame:
    """(node, block, fps): consecutive distinct fingerprints of one node, at most ``BLOCK`` of them, as packed bytes."""
    shift = np.uint64(BITS - depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty(0, np.uint64)

        def cut(values: np.ndarray, last: bool):
            nodes = values >> shift if depth else np.zeros(len(values), np.uint64)
            edges = np.flatnonzero(np.diff(nodes)) + 1
            bounds = [0, *edges.tolist(), len(values)]
            rows, done = [], 0
            for a, b in zip(bounds, bounds[1:]):
                for at in range(a, b, BLOCK):
                    stop = min(at + BLOCK, b)
                    if stop == len(values) and not last:
                        break
                    rows.append((int(nodes[at]), int(values[at]) ^ (1 << 63), values[at:stop].astype("<u8").tobytes()))
                    done = stop
            return rows, values[done:]

        for batch in batches:
            rows, rest = cut(np.concatenate([rest, batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)]), False)
            if rows:
                yield packed(rows)
        rows, _ = cut(rest, True) if len(rest) else ([], rest)
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        node, block, data = zip(*rows)
        return pa.RecordBatch.from_arrays([
            pa.array(node, pa.int64()), pa.array(np.array(block, np.uint64).view(np.int64)), pa.array(data, pa.binary()),
        ], names=["node", "block", "fps"])

    # signed order with the top bit flipped is unsigned order
    flipped = fps.select(F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("k"))
    sorted_fps = flipped.repartitionByRange("k").sortWithinPartitions("k")
    return sorted_fps.mapInArrow(run, "node long, block long, fps binary")


def _levels(values: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every walked level: the nodes' first positions, and each node's first child in the next level."""
    firsts = [np.array([0])]
    for level in [*range(top + STRIDE, BITS, STRIDE), BITS]:
        heads = values >> np.uint64(BITS - level)
        firsts.append(np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1]))
        if len(firsts[-1]) == len(values):
            break
    out = []
    for here, below in zip(firsts, [*firsts[1:], np.arange(len(values))]):
        out.append((here, np.append(np.searchsorted(below, here), len(below))))
    return out


def subtrie_links(a: np.ndarray, b: np.ndarray, top: int, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most ``budgets[-1]`` differing bits, both sides sorted and below one node at ``top``.

    Pairs of nodes go down ``STRIDE`` levels at a time.  The bits in which two nodes differ are those above their
    level; ``budgets[level]`` is what they may amount to there.
    """
    levels_a, levels_b = _levels(a, top), _levels(b, top)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while pending:
        depth, left, right = pending.pop()
        ends_a, ends_b = depth >= len(levels_a), depth >= len(levels_b)
        if ends_a and ends_b:
            near = np.bitwise_count(a[left] ^ b[right]) <= budgets[BITS]
            found.append((left[near], right[near]))
            continue
        # a side that has reached its single fingerprints stays where it is
        first_a, count_a = (left, np.ones_like(left)) if ends_a else (
            levels_a[depth][1][left], levels_a[depth][1][left + 1] - levels_a[depth][1][left])
        first_b, count_b = (right, np.ones_like(right)) if ends_b else (
            levels_b[depth][1][right], levels_b[depth][1][right + 1] - levels_b[depth][1][right])
        pairs = count_a * count_b
        if pairs.sum() > FRONTIER and len(left) > 1:
            half = len(left) // 2
            pending += [(depth, left[:half], right[:half]), (depth, left[half:], right[half:])]
            continue
        owner = np.repeat(np.arange(len(left)), pairs)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = first_a[owner] + place // count_b[owner]
        right = first_b[owner] + place % count_b[owner]
        level = min(top + STRIDE * (depth + 1), BITS)
        at_a = levels_a[depth + 1][0][left] if depth + 1 < len(levels_a) else left
        at_b = levels_b[depth + 1][0][right] if depth + 1 < len(levels_b) else right
        differ = np.bitwise_count((a[at_a] ^ b[at_b]) >> np.uint64(BITS - level))
        near = differ <= budgets[level]
        if near.any():
            pending.append((depth + 1, left[near], right[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest position each of ``size`` positions reaches over the links."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _turned(fp):
    """The other half of the bits first."""
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def links(fps: DataFrame, link_bits: int = LINK_BITS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, enough to connect all that are linked."""
    count = fps.count()
    depth = max(0, min(MAX_DEPTH, math.ceil(math.log2(max(count, 1) / SUBTRIE))))
    first = link_bits // 2
    budgets = np.array([first] * (BITS // 2 + 1) + [link_bits] * (BITS // 2))
    masks = [0]
    for bits in range(1, first + 1):
        masks += [sum(1 << i for i in chosen) for chosen in _choices(depth, bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for same, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a = np.frombuffer(x, "<u8")
                b = a if same else np.frombuffer(y, "<u8")
                i, j = subtrie_links(a, b, depth, budgets)
                if same:
                    up = i < j
                    root = forest(i[up], j[up], len(a))
                    values = a
                else:
                    root = forest(i, j + len(a), len(a) + len(b))
                    values = np.concatenate([a, b])
                child = np.flatnonzero(root != np.arange(len(root)))
                us.append(values[child])
                vs.append(values[root[child]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.uint64).view(np.int64)) for c in (us, vs)], names=["u", "v"])

    def walk(side: DataFrame) -> DataFrame:
        laid = settled(blocks(side, depth))
        # one side is sent to every node within the budget; the smaller path of a pair, or the smaller block, is it
        sent = laid.withColumn("to", F.explode(F.lit(masks).cast("array<bigint>"))).select(
            F.col("node").alias("from"), F.col("node").bitwiseXOR(F.col("to")).alias("node"),
            F.col("block").alias("other"), F.col("fps").alias("a"),
        ).where(F.col("from") <= F.col("node"))
        pairs = sent.join(laid, "node").where((F.col("from") < F.col("node")) | (F.col("other") <= F.col("block")))
        same = (F.col("from") == F.col("node")) & (F.col("other") == F.col("block"))
        return pairs.select(same.alias("same"), "a", F.col("fps").alias("b")).mapInArrow(run, "u long, v long")

    turned = walk(fps.select(_turned(F.col("fp")).alias("fp")))
    return walk(fps).union(turned.select(_turned(F.col("u")).alias("u"), _turned(F.col("v")).alias("v")))


def _choices(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def classes(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``fp`` and ``leader``: the smallest struct of ``keep`` in the same component."""
    rows = settled(fingerprints(documents, keep))
    # a null sorts after every value
    key = F.struct(*[c for k in keep for c in (F.col(k).isNull().alias(f"n_{k}"), F.col(k).alias(k))])
    groups = settled(rows.groupBy("fp").agg(F.min(key).alias("leader")))
    found = components(links(groups.select("fp")))
    with_root = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leaders = with_root.groupBy("root").agg(F.min("leader").alias("leader"))
    answer = with_root.select("fp", "root").join(leaders, "root").select("fp", F.struct(*[
        F.col(f"leader.{k}").alias(k) for k in keep]).alias("leader"))
    return rows.join(answer, "fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return classes(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("leader.doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``documents`` without near-duplicates: of every component the row with the smallest doc_id stays.

    A row is known by its place in the table, so of repeated rows one stays as well.  Places only hold while the rows
    come in the same order twice: ``stored`` says that ``documents`` is read straight from files; else it is written first.
    """
    place = "__simhash_row"
    placed = (documents if stored else settled(documents)).withColumn(place, F.monotonically_increasing_id())
    kept = classes(placed, ("doc_id", place)).where(F.col(f"leader.{place}") == F.col(place)).select(place)
    return placed.join(kept, place, "left_semi").drop(place)
