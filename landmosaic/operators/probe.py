"""A linear head on fixed features, for a whole grid of weight decays at once.

Every epoch is one pass over the features: they are packed to blocks of numbers once, each task multiplies its blocks with the
weights of all models side by side and adds up the gradients of the training rows and the confusion counts of the validation
rows, and Spark adds up the tasks' sums, by place in the vector. The driver holds weights, two moments and sums: some
(models x classes x features) numbers, however many rows there are. The optimiser is AdamW over all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import metrics, ranking

DECAYS, WARM_DECAYS = (0.001, 0.01, 0.05, 0.1, 0.3, 1.0, 3.0), (0.01, 0.05, 0.1, 0.3, 1.0)
RATE, WARM_RATE = 1e-2, 3e-3
BETAS, EPSILON = (0.9, 0.999), 1e-8


@dataclass
class Head:
    """weights (classes x features) and bias of the best epoch, with its scores on the validation rows."""

    decay: float
    weights: np.ndarray
    bias: np.ndarray
    epoch: int = 0
    scores: dict[str, float] = field(default_factory=dict)


def scores(counts: np.ndarray, capped: np.ndarray) -> dict[str, float]:
    """Of confusion counts (truth x predicted), in all and of at most so many rows of each class."""

    def f1(c: np.ndarray) -> float:
        hit, both = np.diag(c), c.sum(axis=0) + c.sum(axis=1)
        return float(np.mean(np.divide(2 * hit, both, out=np.zeros(len(c)), where=both > 0))) if len(c) else 0.0

    total = counts.sum()
    return {"accuracy": float(np.trace(counts) / total) if total else 0.0, "macro_f1": f1(counts), "balanced_f1": f1(capped)}


def _packed(rows: DataFrame) -> DataFrame:
    """x, y, w, kind (0 train, 1 validation, 2 validation under the cap) as bytes, a batch to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype("<f8")
                rest = [batch.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((1, "<i4"), (2, "<f8"), (3, "<i4"))]
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (x, *rest)], ["x", "y", "w", "kind"])

    return kept(rows.select("features", "class_id", "w", "kind").mapInArrow(run, "x binary, y binary, w binary, kind binary"), "blocks")


def _pass(blocks: DataFrame, theta: np.ndarray, classes: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the summed loss (like theta), and confusion counts (models x truth x predicted), in all and capped.

    theta: models x (features + 1) x classes, the last feature being the bias. classes: weights of the classes."""
    k, d, c = theta.shape[0], theta.shape[1] - 1, theta.shape[2]
    flat = np.concatenate(list(theta), axis=1)  # the models side by side
    size = theta.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2 * k * c * c)
        grad, counts = total[:size].reshape(k, d + 1, c), total[size:].reshape(2, k, c, c)
        for batch in batches:
            for x, y, w, kind in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                y, w, kind = np.frombuffer(y, "<i4"), np.frombuffer(w, "<f8"), np.frombuffer(kind, "<i4")
                x = np.frombuffer(x, "<f8").reshape(len(y), d)
                z = (x @ flat[:d] + flat[d]).reshape(len(y), k, c)
                train = kind == 0
                if train.any():
                    p = np.exp(z[train] - z[train].max(axis=2, keepdims=True))
                    p /= p.sum(axis=2, keepdims=True)
                    wanted = np.tile(classes * smoothing / c, (int(train.sum()), 1))
                    wanted[np.arange(len(wanted)), y[train]] += (1 - smoothing) * classes[y[train]]
                    g = (p * wanted.sum(axis=1)[:, None, None] - wanted[:, None, :]) * w[train][:, None, None]
                    for m in range(k):
                        grad[m, :d] += x[train].T @ g[:, m]
                        grad[m, d] += g[:, m].sum(axis=0)
                if not train.all():
                    said = z[~train].argmax(axis=2)
                    for m in range(k):
                        cell = y[~train] * c + said[:, m]
                        counts[0, m] += np.bincount(cell, minlength=c * c).reshape(c, c)
                        counts[1, m] += np.bincount(cell[kind[~train] == 2], minlength=c * c).reshape(c, c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    tasks = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)  # so that few vectors move
    sums = tasks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size + 2 * k * c * c)
    out[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    counts = out[size:].reshape(2, k, c, c)
    return out[:size].reshape(theta.shape), counts[0], counts[1]


def fitted(
    features: DataFrame, n_classes: int, decays: tuple[float, ...] | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, epochs: int = 60, rate: float | None = None,
    smoothing: float = 0.05, cap: int = 35, select_by: str = "accuracy",
) -> list[Head]:
    """A head for each decay: features (seq, features array, class_id, split, sample_weight); of the epochs' weights those with the
    best score on the validation rows, the first on ties. start: weights and bias to go on from (then with other decays and a
    lower rate); else zeros. Without epochs the start itself is scored. Rows without features, class or a known split are left
    out; an unknown weight is 1."""
    decays = decays or (WARM_DECAYS if start else DECAYS)
    rate = rate or (WARM_RATE if start else RATE)
    rows = features.where(F.col("features").isNotNull() & F.col("class_id").between(0, n_classes - 1) & F.col("split").isin("train", "val"))
    rows = rows.select("seq", F.transform("features", lambda x: x.cast("double")).alias("features"), F.col("class_id").cast("int").alias("class_id"), "split", F.coalesce("sample_weight", F.lit(1.0)).cast("double").alias("w"))
    first = rows.select(F.size("features")).first()
    d = first[0] if first else 0
    train = rows.where("split = 'train'")
    weights = {r["class_id"]: (r["weight"], r["n"]) for r in metrics.class_weights(train, "class_id", n_classes, "w").join(train.groupBy("class_id").agg(F.sum("w").alias("n")), "class_id").collect()}  # a row per class
    total = sum(n for _, n in weights.values())
    absent = total / n_classes  # n / (C * 1)
    classes = np.array([weights[i][0] if i in weights else absent for i in range(n_classes)])
    val = ranking.exact_rank(rows.where("split = 'val'"), ["class_id"], "seq", "42").withColumn("kind", F.when(F.col("rank") <= cap, 2).otherwise(1)).drop("rank", "rank_n")
    blocks = _packed(train.withColumn("kind", F.lit(0)).unionByName(val))

    k = len(decays)
    theta = np.zeros((k, d + 1, n_classes))
    if start:
        theta[:] = np.vstack([np.asarray(start[0], float).T, np.asarray(start[1], float)[None, :]])
    heads = [Head(x, theta[i, :d].T.copy(), theta[i, d].copy()) for i, x in enumerate(decays)]
    first_moment, second_moment, shrink = np.zeros_like(theta), np.zeros_like(theta), np.array(decays)[:, None, None]
    for epoch in range(epochs + 1):
        grad, counts, capped = _pass(blocks, theta, classes, smoothing)
        if epoch or not epochs:  # what the epoch before has made of the weights
            for i, head in enumerate(heads):
                now = scores(counts[i], capped[i])
                if not head.scores or now[select_by] > head.scores[select_by]:
                    head.weights, head.bias, head.epoch, head.scores = theta[i, :d].T.copy(), theta[i, d].copy(), epoch, now
        if epoch == epochs:
            break
        grad /= max(total, 1e-6)
        first_moment = BETAS[0] * first_moment + (1 - BETAS[0]) * grad
        second_moment = BETAS[1] * second_moment + (1 - BETAS[1]) * grad * grad
        step = rate * (first_moment / (1 - BETAS[0] ** (epoch + 1))) / (np.sqrt(second_moment / (1 - BETAS[1] ** (epoch + 1))) + EPSILON)
        theta = theta * (1 - rate * shrink) - step
    return heads


def grid(spark, heads: list[Head]) -> DataFrame:
    """decay, accuracy, macro_f1, balanced_f1: a row per model."""
    rows = [(h.decay, *(round(h.scores[c], n) for c, n in (("accuracy", 4), ("macro_f1", 6), ("balanced_f1", 6)))) for h in heads]
    return spark.createDataFrame(rows, "decay double, accuracy double, macro_f1 double, balanced_f1 double")
