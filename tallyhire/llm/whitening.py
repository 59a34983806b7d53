"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are turned into exact integers and packed into blocks of rows once.  All that is ever computed of the covariance V
is VQ for a thin matrix Q: a pass sends Q to the tasks, every task adds up its centred XᵀXQ, and the sums are added in two
steps, so the driver receives a few matrices of the size of Q whatever the number of rows.

A cycle measures VQ, solves the small Rayleigh-Ritz problem, and stops when every wanted pair is certified, that is when
the norm of Vq - θq is within ``TOLERANCE`` of the largest eigenvalue.  Else a Chebyshev polynomial of V, by its
three-term recurrence of passes, damps the interval of the unwanted spectrum, and a QR makes the block orthonormal again.
The interval's upper end is the smallest Ritz value of the block.  Its lower end is zero at first; during the first filter
one more column of the same passes runs a Lanczos recurrence, whose smallest Ritz value less its residual is the lower end
from then on.  Should a Ritz value fall below that end it is set back to zero.  A block that is not certified after
``PATIENCE`` cycles is widened; a block as wide as the vectors needs no filter, so the iteration ends for any spectrum.

Vectors of different lengths have covariances of their own and are fitted and whitened per length, all in the same passes.

Cases: a null vector, and one that holds a null or non-finite entry, takes no part and has no row; integers are held within
±2^62; a deviation beyond a long is null; components whose variance is zero to working precision (fewer rows than
dimensions, constant or repeated columns) have no rows, so a single vector has none; ties of eigenvalues may be resolved by
any orthonormal basis of their space; repeated rows count and come again; a null id is kept; only the id and the vector are
read; an empty table, or one without a valid vector, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhire.operators.settle import settled

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Columns of the block beyond the wanted ones.
GUARD = 16
DEGREE = 8
#: Residual of a certified pair, as a share of the largest eigenvalue.
TOLERANCE = 2e-13
PATIENCE = 12
#: Eigenvalues below this share of the largest are zero to working precision.
RANK = 1e-11
BLOCK_ROWS = 1024
BOUND = 1 << 62
SEED = 20_011

BLOCKS_DDL = "dim int, ids array<long>, x binary"
PART_DDL = "dim int, n long, part binary"
Parts = dict[int, tuple[int, np.ndarray]]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000, held within ±2^62."""
    scaled = np.floor(np.clip(vectors, -BOUND / SCALE, BOUND / SCALE) * SCALE)
    return np.clip(scaled, -BOUND, BOUND - (1 << 20)).astype(np.int64) + SHIFT


def packed(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, ids, x): rows of one length, ``BLOCK_ROWS`` at a time, as little-endian 64-bit integers."""
    def row(dim: int, ids: list, vectors: list) -> tuple:
        return dim, ids, integers(np.array(vectors, np.float64)).astype("<i8").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        dims, ids, x = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(x, pa.binary())], names=["dim", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not v or None in v or not all(map(math.isfinite, v)):
                        continue
                    ids, vectors = waiting.setdefault(len(v), ([], []))
                    ids.append(k)
                    vectors.append(v)
                    if len(ids) == BLOCK_ROWS:
                        rows.append(row(len(v), *waiting.pop(len(v))))
            if rows:
                yield batch_of(rows)
        for dim, (ids, vectors) in waiting.items():
            yield batch_of([row(dim, ids, vectors)])

    read = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return read.mapInArrow(run, BLOCKS_DDL)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray]]:
    for batch in batches:
        for dim, ids, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield dim, ids, np.frombuffer(x, "<i8").reshape(-1, dim)


def summed(blocks: DataFrame, part: Callable[[int, np.ndarray], np.ndarray]) -> Parts:
    """Per length the number of rows and the sum of ``part`` over the blocks.

    Tasks add up their blocks, a square root as many tasks add up those sums, and the driver adds the rest.
    """
    def added(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums: Parts = {}
        for dim, n, value in rows:
            had = sums.get(dim)
            sums[dim] = (n, value) if had is None else (n + had[0], value + had[1])
        if sums:
            dims, parts = zip(*sums.items())
            yield pa.RecordBatch.from_arrays([
                pa.array(dims, pa.int32()), pa.array([p[0] for p in parts], pa.int64()),
                pa.array([p[1].tobytes() for p in parts], pa.binary())], names=["dim", "n", "part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added((dim, len(x), part(dim, x)) for dim, _, x in block_rows(batches))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added((dim, n, np.frombuffer(p, kind)) for batch in batches
                     for dim, n, p in zip(*(batch.column(i).to_pylist() for i in range(3))))

    kind = part(0, np.empty((0, 0), np.int64)).dtype
    tasks = math.isqrt(max(blocks.rdd.getNumPartitions() - 1, 0)) + 1
    partial = blocks.mapInArrow(first, PART_DDL)
    if tasks > 1:
        partial = partial.repartition(tasks).mapInArrow(second, PART_DDL)
    out: Parts = {}
    for r in partial.collect():
        value, had = np.frombuffer(r.part, kind), out.get(r.dim)
        out[r.dim] = (r.n, value) if had is None else (r.n + had[0], value + had[1])
    return out


@dataclass
class Fit:
    """State of one length's iteration, all of it on the driver and no larger than its block."""

    n: int
    sums: list[int]
    mean: np.ndarray
    wanted: int
    q: np.ndarray
    lower: float = 0.0
    cycles: int = 0
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    trace: float = 0.0
    done: bool = False


def exact_sums(blocks: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact per-dimension sums: upper and lower halves are added apart, so no sum overflows."""
    def halves(dim: int, x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).ravel() if len(x) else np.empty(0, np.int64)

    return {dim: (n, [(int(h) << 32) + int(low) for h, low in zip(*v.reshape(2, dim))])
            for dim, (n, v) in summed(blocks, halves).items()}


def covariance_times(blocks: DataFrame, fits: dict[int, Fit], q: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """VQ of every length in ``q`` by one pass over the rows, centred before multiplying."""
    means = {dim: fits[dim].mean for dim in q}

    def part(dim: int, x: np.ndarray) -> np.ndarray:
        if dim not in means:
            return np.zeros(0)
        centred = x - means[dim]
        return (centred.T @ (centred @ q[dim])).ravel()

    wanted = blocks.where(F.col("dim").isin(list(q)))
    return {dim: v.reshape(dim, -1) / n for dim, (n, v) in summed(wanted, part).items()}


def traces(blocks: DataFrame, fits: dict[int, Fit]) -> None:
    means = {dim: f.mean for dim, f in fits.items()}

    def part(dim: int, x: np.ndarray) -> np.ndarray:
        return np.array([((x - means[dim]) ** 2).sum()]) if dim in means else np.zeros(1)

    for dim, (n, v) in summed(blocks, part).items():
        fits[dim].trace = float(v[0]) / n


def lanczos_floor(alphas: list[float], betas: list[float]) -> float:
    """Smallest Ritz value of the tridiagonal matrix less twice its residual."""
    k = len(alphas)
    t = np.diag(alphas) + np.diag(betas[:k - 1], 1) + np.diag(betas[:k - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return float(values[0] - 2 * abs(betas[k - 1] * vectors[-1, 0]))


def rayleigh_ritz(fit: Fit, vq: np.ndarray, tolerance: float) -> None:
    """Ritz pairs of the block from Q and VQ; ``done`` once the wanted ones are certified by their residuals."""
    h = fit.q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    fit.q, vq = fit.q @ turn, vq @ turn
    fit.values, fit.vectors = values, fit.q
    residuals = np.linalg.norm(vq - fit.q * values, axis=0)[:fit.wanted]
    scale = max(float(values[0]), 0.0)
    fit.done = scale <= 0 or bool((residuals <= tolerance * scale).all()) or fit.q.shape[1] == len(fit.mean)
    if values[-1] < fit.lower:
        fit.lower = 0.0


def filtered(blocks: DataFrame, fits: dict[int, Fit], active: list[int], degree: int, rng: np.random.Generator) -> None:
    """One Chebyshev filter of ``degree`` passes over the blocks of all ``active`` lengths at once."""
    state, krylov = {}, {}
    for dim in active:
        f = fits[dim]
        upper = float(f.values[-1])
        centre, half = (upper + f.lower) / 2, max((upper - f.lower) / 2, 1e-300)
        sigma = half / (float(f.values[0]) - centre)
        state[dim] = dict(before=None, now=f.q, centre=centre, half=half, first=sigma, sigma=sigma)
        if f.cycles == 0:
            v = rng.standard_normal(dim)
            krylov[dim] = dict(before=np.zeros(dim), now=v / np.linalg.norm(v), alphas=[], betas=[])
    for step in range(degree):
        sent = {dim: np.column_stack([state[dim]["now"], krylov[dim]["now"]]) if dim in krylov else state[dim]["now"]
                for dim in active}
        product = covariance_times(blocks, fits, sent)
        for dim in active:
            s, vx = state[dim], product[dim]
            if dim in krylov:
                lanczos_step(krylov[dim], vx[:, -1])
                vx = vx[:, :-1]
            shifted = vx - s["centre"] * s["now"]
            if step == 0:
                s["before"], s["now"] = s["now"], shifted * (s["first"] / s["half"])
            else:
                following = 1 / (2 / s["first"] - s["sigma"])
                s["before"], s["now"] = s["now"], shifted * (2 * following / s["half"]) - s["before"] * (s["sigma"] * following)
                s["sigma"] = following
    for dim in active:
        f = fits[dim]
        f.q = np.linalg.qr(state[dim]["now"])[0]
        if dim in krylov:
            f.lower = max(0.0, lanczos_floor(krylov[dim]["alphas"], krylov[dim]["betas"]))
        f.cycles += 1


def lanczos_step(k: dict, product: np.ndarray) -> None:
    last = k["betas"][-1] if k["betas"] else 0.0
    rest = product - last * k["before"]
    alpha = float(rest @ k["now"])
    rest = rest - alpha * k["now"]
    beta = float(np.linalg.norm(rest))
    k["alphas"].append(alpha)
    k["betas"].append(beta)
    k["before"], k["now"] = k["now"], rest / beta if beta > 0 else np.zeros_like(rest)


def widened(f: Fit, rng: np.random.Generator) -> None:
    dim, width = f.q.shape
    more = rng.standard_normal((dim, min(dim, 2 * width) - width))
    f.q = np.linalg.qr(np.column_stack([f.q, more]))[0]
    f.cycles, f.lower = 0, 0.0


def fitted(blocks: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE,
           tolerance: float = TOLERANCE) -> dict[int, Fit]:
    """The certified leading eigenpairs of every length's covariance; ``blocks`` are read once per pass."""
    rng = np.random.default_rng(SEED)
    fits: dict[int, Fit] = {}
    for dim, (n, sums) in exact_sums(blocks).items():
        wanted = min(components, dim)
        q = np.linalg.qr(rng.standard_normal((dim, min(dim, wanted + guard))))[0]
        fits[dim] = Fit(n, sums, np.array([s / n for s in sums]), wanted, q)
    if fits:
        traces(blocks, fits)
    active = list(fits)
    while active:
        products = covariance_times(blocks, fits, {dim: fits[dim].q for dim in active})
        for dim in active:
            rayleigh_ritz(fits[dim], products[dim], tolerance)
        active = [dim for dim in active if not fits[dim].done]
        patient = [dim for dim in active if fits[dim].cycles < PATIENCE]
        if patient:
            filtered(blocks, fits, patient, degree, rng)
        for dim in set(active) - set(patient):
            widened(fits[dim], rng)
    return fits


def loadings(f: Fit) -> np.ndarray:
    """Columns that turn a centred vector into whitened values, for the components whose variance is not zero."""
    values = f.values[:f.wanted]
    kept = values > RANK * max(float(values[0]), 0.0)
    return f.vectors[:, :f.wanted][:, kept] / np.sqrt(values[kept])


def identity_errors(blocks: DataFrame, fits: dict[int, Fit], turns: dict[int, np.ndarray]) -> dict[int, float]:
    """Largest entry of the whitened values' covariance minus the identity, measured by a pass over the rows."""
    means = {dim: f.mean for dim, f in fits.items()}

    def part(dim: int, x: np.ndarray) -> np.ndarray:
        if dim not in turns:
            return np.zeros(0)
        z = (x - means[dim]) @ turns[dim]
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    out = {}
    for dim, (n, v) in summed(blocks, part).items():
        k = turns[dim].shape[1]
        mean = v[k * k:] / n
        out[dim] = float(np.abs(v[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 per row; None where it is beyond a long."""
    reach = max((abs(n * int(e) - s) for e, s in zip([*x.max(axis=0), *x.min(axis=0)], [*sums, *sums])), default=0)
    top = n * int(np.abs(x).max(initial=0))
    if top < BOUND and reach * reach * x.shape[1] < BOUND:
        away = x * n - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    blocks = settled(packed(embeddings, key, vector))
    fits = fitted(blocks, components)
    turns = {dim: loadings(f) for dim, f in fits.items()}
    errors = identity_errors(blocks, fits, turns) if fits else {}
    known = {dim: (f.n, f.sums, f.mean, turns[dim], f.values / f.trace if f.trace > 0 else f.values, errors[dim])
             for dim, f in fits.items()}
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, x in block_rows(batches):
            n, sums, mean, turn, explained, error = known[dim]
            k, rows = turn.shape[1], len(x)
            z = (x - mean) @ turn
            away = pa.array(deviations(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)), away.take(each), pa.array(z.ravel()),
                pa.array(np.tile(explained[:k], rows)), pa.array(np.full(rows * k, error))], names=names)

    return blocks.mapInArrow(
        run, f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
