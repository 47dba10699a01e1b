"""Embedding whitening: leading components of the covariance by Jacobi-Davidson, matrix-free.

Vectors become whole numbers, x = floor(256 * c). The covariance V is that of the different x, each once (divisor: their
number), and is never formed: the method asks for V times a block of vectors, which is a pass over the list, packed to
blocks of numbers, in which each task centres its rows, multiplies them with the block and back, and adds up; Spark adds up
the tasks' sums. The driver holds vectors of the dimension only: a search space of at most BASIS of them, expanded each round
by the answers of the correction equations (V - theta) t = -r, projected off the locked and the current vectors, of all pairs
that haven't converged and of EXTRA ones behind them; a few steps of MINRES, in step with each other, so that one pass serves all. Rayleigh-Ritz in the
space gives the next pairs; those whose residual is at rounding level are locked, until all are.

Rows whose vector is null, empty, or holds null, NaN or infinite entries (or entries of 2^45 and more, which no exact product
would hold) are dropped, and so are those of another length than most vectors have (the longest of equally frequent ones).
Components without variance are left out: of equal vectors, or a single one, none is left and the result is empty. Of equal
eigenvalues any vectors of their space are taken. Repeated rows are fitted once and each returned. A deviation beyond 64 bits
is null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import saved

SCALE = 256
LARGEST = float(1 << 45)
COMPONENTS, BLOCK, BASIS, EXTRA = 4, 8, 48, 4
INNER, OUTER = 2, 60
EPS = float(np.finfo(float).eps)


@dataclass
class Fit:
    """Components (columns of `vectors`) with their eigenvalues, and what belongs to the whole list."""

    n: int
    sums: list[int]  # of x, by dimension
    largest: int  # of |x|
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    products: int  # passes that the method took

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a vector that can be fitted, all of one length."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & fine)
    counts = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]
    return rows.where(F.size(v) == F.lit(most if most is not None else -1))


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """width, numbers: the different x, a batch to a row, as numbers of the least width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype("<i8")
                most = int(np.abs(x).max())
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], ["width", "numbers"])

    return saved(rows.distinct().mapInArrow(run, "width int, numbers binary"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield np.frombuffer(numbers.as_buffer(), f"<i{width}").reshape(-1, d)


def _sums(packed: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sums by dimension, largest |x|. Halves of 32 bits can't overflow in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums = 0, 0, [0] * d
        for x in _blocks(batches, d):
            x = x.astype(np.int64)
            n, most = n + len(x), max(most, int(np.abs(x).max()))
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-2, d), pa.int32()), pa.array([str(v) for v in (most, n, *sums)], pa.string())], ["i", "v"])

    v = F.col("v").cast("decimal(38,0)")
    rows = packed.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(v).alias("total"), F.max(v).alias("most")).collect()  # d + 2 rows
    by = {r["i"]: r for r in rows}
    return int(by[-1]["total"]), [int(by[i]["total"]) for i in range(d)], int(by[-2]["most"])


def _added(packed: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what `of` makes of a block (an array of the same shape each time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, d):
            part = of(x.astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = packed.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = v
    return out


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """new, off the columns of the others and off each other; what is left of a column but rounding goes."""
    kept: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(2):
            for q in against:
                v = v - q @ (q.T @ v)
            for q in kept:
                v = v - q * (q @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            v = v / left
            for q in (*against, *[k[:, None] for k in kept]):  # once more, now that it is long again
                v = v - q @ (q.T @ v)
            kept.append(v / np.linalg.norm(v))
    return np.array(kept).T.reshape(len(new), -1)


def _minres(times: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, off: list[np.ndarray], b: np.ndarray, steps: int, until: float) -> np.ndarray:
    """For each column j steps towards the t with (I - PP')(V - theta_j)(I - PP') t = b_j, P = off[j]; all columns in step."""
    project = lambda y: np.column_stack([v - p @ (p.T @ v) for v, p in zip(y.T, off, strict=True)])
    x, b = np.zeros_like(b), project(b)
    first = np.linalg.norm(b, axis=0)
    tiny = np.finfo(float).tiny
    r1 = r2 = y = b
    w = w2 = np.zeros_like(b)
    k = b.shape[1]
    beta, old, dbar, eps, phibar, cs, sn = first.copy(), np.zeros(k), np.zeros(k), np.zeros(k), first.copy(), -np.ones(k), np.zeros(k)
    live = first > 0
    for step in range(steps):
        v = np.where(live, y / np.maximum(beta, tiny), 0.0)
        y = project(times(v) - v * theta)
        if step:
            y = y - np.where(live, beta / np.maximum(old, tiny), 0.0) * r1
        alpha = (v * y).sum(axis=0)
        y = y - np.where(live, alpha / np.maximum(beta, tiny), 0.0) * r2
        r1, r2, old, beta = r2, y, beta, np.linalg.norm(y, axis=0)
        before, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w2, w, last = w, (v - before * w2 - delta * w) / gamma, w2
        x = x + np.where(live, phi * w, 0.0)
        live = live & (beta > EPS * first) & (np.abs(phibar) > until * first)
        if not live.any():
            break
    return x


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix known by products."""
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), []
    space = _orthonormal(rng.standard_normal((d, min(d, BLOCK))))
    image = times(space)
    best: dict[int, tuple[float, int]] = {}
    for outer in range(OUTER * wanted):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max([*values, *theta[:1], 0.0])
        level = 4 * EPS * np.sqrt(d) * top
        k = min(wanted - len(values) + EXTRA, space.shape[1])
        u, rho = space @ s[:, :k], theta[:k]
        r = image @ s[:, :k] - u * rho
        size = np.linalg.norm(r - locked @ (locked.T @ r), axis=0)
        full = space.shape[1] + locked.shape[1] >= d
        done = 0
        if size[0] <= 1e3 * level or full:  # near: residuals of the vectors that are returned, by a product of their own
            u /= np.linalg.norm(u, axis=0)
            au = times(u)
            rho = (u * au).sum(axis=0)
            r = au - u * rho
            size = np.linalg.norm(r - locked @ (locked.T @ r), axis=0)
            for j in range(min(k, wanted - len(values))):  # in order: a later pair must not pass an earlier one
                lowest, stuck = best.get(len(values) + j, (np.inf, 0))
                best[len(values) + j] = (min(lowest, size[j]), 0 if size[j] < lowest / 2 else stuck + 1)
                stuck = best[len(values) + j][1]
                if done == j and (size[j] <= level or full and stuck >= 2 or size[j] <= 100 * level and stuck >= 3 or top == 0):
                    done += 1
        if done:
            locked = np.column_stack([locked, _orthonormal(u[:, :done], locked)])
            values += [float(x) for x in rho[:done]]
            best = {}
            if len(values) >= wanted:
                break
            rest = s[:, done:]  # what is left of the space stays orthonormal
            space, image = space @ rest, image @ rest
            s = np.eye(space.shape[1])
            u, r, rho, k = u[:, done:], r[:, done:], rho[done:], k - done
        if not k:
            more = rng.standard_normal((d, BLOCK))
        else:
            off = [np.column_stack([locked, u[:, [j]]]) for j in range(k)]
            more = _minres(times, rho, off, -r, INNER, 2.0 ** -(outer + 3))
        if space.shape[1] + k > BASIS:  # the leading Ritz vectors stay
            keep = s[:, : 2 * BLOCK]
            space, image = space @ keep, image @ keep
        new = _orthonormal(more, locked, space)
        if not new.shape[1] and space.shape[1] + locked.shape[1] < d:
            new = _orthonormal(rng.standard_normal((d, 1)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, times(new)])
    else:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} pairs haven't converged")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def fitted(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The components of the table's usable vectors; None where there is no variance."""
    rows = usable(vectors, vec_col).select(whole(F.col(vec_col)).alias("x"))
    some = rows.select(F.size("x")).first()
    if some is None:
        return None
    d = some[0]
    packed = _packed(rows, d)
    n, sums, largest = _sums(packed, d)
    mean = np.array([s / n for s in sums])
    trace = float(_added(packed, d, lambda x: ((x - mean) ** 2).sum(axis=0)[None, :]).sum()) / n
    if trace == 0:
        return None
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            x -= mean
            return x.T @ (x @ block)

        return _added(packed, d, product) / n

    values, u = jacobi_davidson(times, d, min(components, d))
    there = values > 1e-12 * trace
    values, u = values[there], u[:, there]
    scaled = u / np.sqrt(values)
    middle = _added(packed, d, lambda x: ((x - mean) @ scaled).sum(axis=0)[None, :])[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - middle
        return w.T @ w

    error = float(np.abs(_added(packed, d, spread) / n - np.eye(len(values))).max())
    return Fit(n, sums, largest, trace, values, u, error, passes)


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum of (n * x - S)^2 by row, exact; null beyond 64 bits."""
    most = fit.n * fit.largest + max(map(abs, fit.sums))
    if most < 1 << 62 and most * most * x.shape[1] < 1 << 63:
        y = x * fit.n - np.array(fit.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((fit.n * a - s) ** 2 for a, s in zip(row, fit.sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, fit: Fit | None = None) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error of each usable row and component."""
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType([*vectors.select(id_col).schema.fields, *StructType.fromDDL(out).fields])
    fit = fit or fitted(vectors, vec_col, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    names, kinds = schema.names, to_arrow_schema(schema).types
    mean, scaled, k = fit.mean, fit.vectors / np.sqrt(fit.values), len(fit.values)
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            parts = [np.tile(np.arange(1, k + 1), len(x)), np.full(len(x) * k, fit.n), None, ((x - mean) @ scaled).ravel(), np.tile(explained, len(x)), np.full(len(x) * k, fit.identity_error)]
            columns = [pa.array(p, t) if p is not None else pa.array(deviations(x, fit), t).take(at) for p, t in zip(parts, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]).take(at), *columns], names)

    rows = usable(vectors, vec_col).select(id_col, whole(F.col(vec_col)).alias("x"))
    return rows.mapInArrow(run, schema)
