"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and takes the
signed axis it then lies nearest to: 2d buckets a table.  All vectors are indexed in ``TABLES`` tables.  A query probes, in
every table, the axes nearest to it; all vectors of those buckets are candidates, however many, and are ranked by their
inner product in double precision, summed in the order of the components.

How many axes are probed is measured for every length of vectors by itself: for a bounded sample of vectors and queries
(``FIT_VECTORS``, ``FIT_QUERIES``, by hash of the id) the smallest number that finds ``RECALL`` of the true neighbours inside
the sample.  Neighbours in a sample are farther away than in the whole, so the number is on the safe side.  Of a length with
at most ``EXACT_ROWS`` vectors every axis of one table is probed, which is exact; so are, afterwards, the queries of any length
that have met fewer candidates than were asked for and exist.

Unit vectors are hashed as they are.  If norms of a length differ, a vector is scaled by their largest and gets one more
component that completes it to a unit vector, which turns the largest inner product into the smallest angle.

Rows of a bucket are packed into matrices of at most ``BLOCK`` rows and joined block by block; a hot bucket is many blocks.  A
task keeps the best of the queries it has met, one row per query, and a query's rows of all tasks are merged at the end.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without vec_id;
of rows that repeat a vec_id the one with the smallest components counts; vectors are compared with those of their own
length only; equal scores go to the smaller vec_id; fewer candidates than asked for are all returned, none (a length of one row) give no
row; only vec_id and
embedding are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhire.operators.settle import settled

TABLES = 4
NEAREST = 20
QUERY_STEP = 20
FIT_VECTORS, FIT_QUERIES, RECALL = 10_000, 64, 0.97
BLOCK, QUERY_BLOCK = 2048, 256
SEED = 8
#: Queries whose best rows a task holds before it hands them on.
HELD = 50_000
#: Vectors of a length that are searched exactly.
EXACT_ROWS = 2 * BLOCK
#: More axes than any table has.
EVERY_AXIS = 1 << 30


class Fit(NamedTuple):
    """How the vectors of one length are hashed and probed."""

    rows: int
    norm: float
    uneven: bool
    probes: int
    tables: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, by butterflies; the width is a power of two."""
    x, width, half = x.copy(), x.shape[1], 1
    while half < width:
        y = x.reshape(len(x), -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return x


def turned(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    random = np.random.default_rng([SEED, table, width])
    for _ in range(3):
        y = hadamard(y * random.choice([-1.0, 1.0], width)) / np.sqrt(width)
    return y


def axis_values(x: np.ndarray, table: int) -> np.ndarray:
    """Inner products with the 2d signed axes after the table's turn: the positive axes, then the negative ones."""
    y = turned(x, table)
    return np.concatenate([y, -y], axis=1)


def units(x: np.ndarray, norm: float, uneven: bool, query: bool) -> np.ndarray:
    """What is hashed: unit vectors, completed by one component where norms differ."""
    if not uneven:
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
    y = x / norm
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, each summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def probes_needed(x: np.ndarray, q: np.ndarray, q_at: np.ndarray, norm: float, uneven: bool, nearest: int) -> int:
    """The fewest axes per table whose buckets hold ``RECALL`` of the sample queries' true neighbours in the sample."""
    scores = q @ x.T
    scores[np.arange(len(q)), q_at] = -np.inf
    k = min(nearest, len(x) - 1)
    if k < 1:
        return 1
    true = np.argsort(-scores, axis=1)[:, :k]
    best, axes = np.full(true.shape, np.iinfo(np.int64).max), 1
    for table in range(TABLES):
        bucket = axis_values(units(x, norm, uneven, False), table).argmax(axis=1)
        values = axis_values(units(q, norm, uneven, True), table)
        axes = values.shape[1]
        order = np.argsort(np.argsort(-values, axis=1), axis=1)
        best = np.minimum(best, np.take_along_axis(order, bucket[true], axis=1))
    needed = np.sort(best.ravel())
    return int(min(axes, needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)] + 1))


class Best:
    """The best candidates of the queries met so far, at most ``nearest`` each, in order."""

    def __init__(self, nearest: int) -> None:
        self.nearest, self.place = nearest, {}
        self.scores, self.ids = np.empty((0, nearest)), np.empty((0, nearest), np.int64)

    def rows(self, queries: list[int]) -> np.ndarray:
        new = [q for q in dict.fromkeys(queries) if q not in self.place]
        for q in new:
            self.place[q] = len(self.place)
        short = len(self.place) - len(self.scores)
        if short > 0:
            grow = max(short, len(self.scores))
            self.scores = np.concatenate([self.scores, np.full((grow, self.nearest), -np.inf)])
            self.ids = np.concatenate([self.ids, np.full((grow, self.nearest), -1, np.int64)])
        return np.array([self.place[q] for q in queries])

    def offer(self, q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray) -> None:
        rows = self.rows(q_ids.tolist())
        rough = q @ x.T
        rough[q_ids[:, None] == x_ids[None, :]] = -np.inf
        least = self.scores[rows, -1]
        if len(x) > self.nearest:
            least = np.maximum(least, np.partition(rough, -self.nearest, axis=1)[:, -self.nearest])
        # the product of matrices and the ordered sum may differ by a rounding per component
        slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        if not len(i):
            return
        touched, back = np.unique(rows[i], return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.nearest), back])
        score = np.concatenate([self.scores[touched].ravel(), exact(q[i], x[j])])
        ids = np.concatenate([self.ids[touched].ravel(), x_ids[j]])
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        fresh = np.ones(len(owner), bool)  # a candidate met through several tables counts once; empty places may repeat
        fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]) | ~np.isfinite(score[1:])
        owner, score, ids = owner[fresh], score[fresh], ids[fresh]
        first = np.searchsorted(owner, np.arange(len(touched)))
        rank = np.arange(len(owner)) - first[owner]
        top = rank < self.nearest
        self.scores[touched[owner[top]], rank[top]] = score[top]
        self.ids[touched[owner[top]], rank[top]] = ids[top]

    def batch(self) -> pa.RecordBatch:
        """One row per query, its candidates' ids and scores as packed bytes."""
        n = len(self.place)
        kept = np.isfinite(self.scores[:n])
        return pa.RecordBatch.from_arrays([
            pa.array(list(self.place), pa.int64()),
            pa.array([i[k].astype("<i8").tobytes() for i, k in zip(self.ids, kept)], pa.binary()),
            pa.array([s[k].astype("<f8").tobytes() for s, k in zip(self.scores, kept)], pa.binary()),
        ], names=["query_id", "ids", "scores"])


def ranked(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """(query_id, rank, vec_id, score) from the rows of all tasks, which come sorted by query."""
    now, ids, scores = None, [], []

    def answer() -> pa.RecordBatch:
        vec_id, score = np.frombuffer(b"".join(ids), "<i8"), np.frombuffer(b"".join(scores), "<f8")
        order = np.lexsort((vec_id, -score))
        vec_id, score = vec_id[order], score[order]
        fresh = np.ones(len(vec_id), bool)
        fresh[1:] = vec_id[1:] != vec_id[:-1]
        vec_id, score = vec_id[fresh][:nearest], score[fresh][:nearest]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(vec_id), now, np.int64)), pa.array(np.arange(1, len(vec_id) + 1, dtype=np.int32)),
            pa.array(vec_id), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        for query_id, own_ids, own_scores in zip(*(c.to_pylist() for c in batch.columns)):
            if query_id != now and ids:
                yield answer()
                ids, scores = [], []
            now = query_id
            ids.append(own_ids)
            scores.append(own_scores)
    if ids:
        yield answer()


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim): one row per id, components in double precision."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn(
        "dim", F.size("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: DataFrame, fits: dict[int, Fit], query: bool, parts: int) -> DataFrame:
    """(dim, tbl, bucket, ids, data): the rows of each bucket as matrices; of queries, of each bucket that they probe."""
    most = QUERY_BLOCK if query else BLOCK

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = _matrix(own.column(1))
                data = pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())
                fit = fits[int(dim)]
                for table in range(fit.tables):
                    values = axis_values(units(x, fit.norm, fit.uneven, query), table)
                    wide = min(fit.probes, values.shape[1]) if query else 1
                    near = np.argpartition(-values, wide - 1, axis=1)[:, :wide] if wide < values.shape[1] else np.tile(
                        np.arange(wide), (len(x), 1))
                    place = np.repeat(np.arange(len(x)), wide)
                    n = len(place)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, table, np.int32)),
                        pa.array(near.ravel().astype(np.int32)), own.column(0).take(pa.array(place)), data.take(pa.array(place)),
                    ], names=["dim", "tbl", "bucket", "vec_id", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, data = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                *[pa.array([k], pa.int32()) for k in key], pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(data)], pa.binary()),
            ], names=["dim", "tbl", "bucket", "ids", "data"])

        for batch in batches:
            for *now, vec_id, row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key or len(ids) >= most:
                    if ids:
                        yield block()
                    key, ids, data = now, [], []
                ids.append(vec_id)
                data.append(row)
        if ids:
            yield block()

    spread = rows.mapInArrow(hashed, "dim int, tbl int, bucket int, vec_id long, data binary")
    # a hot bucket is cut by id, so no task packs more than its share
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    return spread.withColumn("_cut", cut).repartition("dim", "tbl", "bucket", "_cut").sortWithinPartitions(
        "dim", "tbl", "bucket", "_cut", "vec_id").drop("_cut").mapInArrow(
        packed, "dim int, tbl int, bucket int, ids binary, data binary")


def fitted(rows: DataFrame, nearest: int, step: int) -> dict[int, Fit]:
    """One ``Fit`` per length; the driver holds one row per length and one length's sample at a time."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    out: dict[int, Fit] = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("most"), F.min(length).alias("least")).collect():
        uneven = r.most - r.least > 1e-4 * r.most
        if r.n <= EXACT_ROWS:
            out[r.dim] = Fit(r.n, r.most, uneven, EVERY_AXIS, 1)
            continue
        own = rows.where(F.col("dim") == r.dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_VECTORS).toArrow()
        queries = own.where(F.col("vec_id") % step == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).toArrow()
        probes = 1
        if len(queries):
            ids, q_ids = sample["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            x, q = (np.array(t["v"].to_pylist()) for t in (sample, queries))
            # a query outside the sample joins it, so that every query has its own row there
            missing = ~np.isin(q_ids, ids)
            ids, x = np.concatenate([ids, q_ids[missing]]), np.concatenate([x, q[missing]])
            place = {v: k for k, v in enumerate(ids.tolist())}
            probes = probes_needed(x, q, np.array([place[v] for v in q_ids.tolist()]), r.most, uneven, nearest)
        out[r.dim] = Fit(r.n, r.most, uneven, probes, TABLES)
    return out


def met(rows: DataFrame, queries: DataFrame, fits: dict[int, Fit], nearest: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best candidates in the buckets that the queries probe."""
    most = max(fits.values(), key=lambda f: f.rows).rows if fits else 0
    buckets = 2 * max(fits, default=1)
    probes = max((min(f.probes, 4 * dim) for dim, f in fits.items()), default=1)
    base = settled(blocks(rows.select("vec_id", "v", "dim"), fits, False, 1 + most // (8 * buckets * BLOCK)))
    asked = settled(blocks(queries.select("vec_id", "v", "dim"), fits, True,
                           1 + most // QUERY_STEP * probes // (64 * buckets * QUERY_BLOCK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(nearest)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                for row in batch.slice(at, 16).to_pylist():
                    q_ids, x_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["x_ids"], "<i8")
                    q, x = (np.frombuffer(row[c], "<f8").reshape(-1, row["dim"]) for c in ("q", "x"))
                    best.offer(q_ids, q, x_ids, x)
                if len(best.place) > HELD:
                    yield best.batch()
                    best = Best(nearest)
        if best.place:
            yield best.batch()

    pairs = base.select("dim", "tbl", "bucket", F.col("ids").alias("x_ids"), F.col("data").alias("x")).join(
        asked.select("dim", "tbl", "bucket", F.col("ids").alias("q_ids"), F.col("data").alias("q")), ["dim", "tbl", "bucket"])
    found = pairs.select("dim", "q_ids", "q", "x_ids", "x").mapInArrow(run, "query_id long, ids binary, scores binary")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        lambda batches: ranked(batches, nearest), "query_id long, rank int, vec_id long, score double")


def search(embeddings: DataFrame, nearest: int = NEAREST, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id is divisible by ``step``, the nearest other rows found."""
    rows = settled(usable(embeddings))
    queries = rows.where(F.col("vec_id") % step == 0)
    fits = fitted(rows, nearest, step)
    hashed = {dim: f for dim, f in fits.items() if f.probes < EVERY_AXIS}
    found = met(rows, queries, fits, nearest)
    if not hashed:
        return found
    # of the lengths that were not searched exactly, the queries that met too few candidates
    found = settled(found)
    had = found.groupBy("query_id").agg(F.count("*").alias("had")).withColumnRenamed("query_id", "vec_id")
    short = settled(queries.where(F.col("dim").isin(list(hashed))).join(had, "vec_id", "left").where(
        F.coalesce("had", F.lit(0)) < nearest).select("vec_id", "v", "dim"))
    if short.isEmpty():
        return found
    exact_fits = {dim: f._replace(probes=EVERY_AXIS, tables=1) for dim, f in hashed.items()}
    again = met(rows.where(F.col("dim").isin(list(hashed))), short, exact_fits, nearest)
    kept = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.unionByName(again)
