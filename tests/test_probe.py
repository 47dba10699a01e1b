"""The head's passes against a plain loop in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.operators import probe


def data(spark, n=300, d=5, c=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((c, d)) * 1.5
    y = rng.choice(c, n, p=[0.6, 0.3, 0.1])
    x = centres[y] + rng.standard_normal((n, d))
    w = rng.choice([0.5, 1.0], n)
    val = np.arange(n) % 4 == 0
    rows = [(i, x[i].tolist(), int(y[i]), "val" if val[i] else "train", float(w[i])) for i in range(n)]
    odd = [(n, None, 0, "train", 1.0), (n + 1, x[0].tolist(), 99, "train", 1.0), (n + 2, x[0].tolist(), None, "val", 1.0), (n + 3, x[0].tolist(), 0, None, 1.0)]
    return spark.createDataFrame(rows + odd, "seq long, features array<double>, class_id int, split string, sample_weight double").repartition(3), x, y, w, val


def loss(theta, x, y, w, classes, smoothing):
    z = x @ theta[:-1] + theta[-1]
    logp = z - z.max(axis=1, keepdims=True)
    logp -= np.log(np.exp(logp).sum(axis=1, keepdims=True))
    own = -(1 - smoothing) * classes[y] * logp[np.arange(len(y)), y]
    return ((own - smoothing / len(classes) * (logp * classes).sum(axis=1)) * w).sum() / w.sum()


def by_loop(x, y, w, val, decay, start, epochs, rate, c=3):
    xt, yt, wt = x[~val], y[~val], w[~val]
    n = np.array([wt[yt == i].sum() for i in range(c)])
    classes = n.sum() / (c * np.maximum(n, 1))
    theta, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    best = (-1, 0)
    for t in range(1, epochs + 1):
        g = np.zeros_like(theta)
        for i in np.ndindex(theta.shape):
            e = np.zeros_like(theta)
            e[i] = 1e-6
            g[i] = (loss(theta + e, xt, yt, wt, classes, 0.05) - loss(theta - e, xt, yt, wt, classes, 0.05)) / 2e-6
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        best = max(best, (float(((x[val] @ theta[:-1] + theta[-1]).argmax(axis=1) == y[val]).mean()), -t))
    return best[0], -best[1], theta


@pytest.mark.parametrize("warm", [False, True])
def test_heads_equal_a_plain_loop(spark, warm):
    rows, x, y, w, val = data(spark)
    start = (np.random.default_rng(3).standard_normal((3, 5)), np.array([0.1, -0.2, 0.3])) if warm else None
    heads = probe.fitted(rows, 3, decays=(0.01, 1.0), start=start, epochs=8, rate=0.05)
    begin = np.vstack([start[0].T, start[1]]) if warm else np.zeros((6, 3))
    for h in heads:
        score, epoch, _ = by_loop(x, y, w, val, h.decay, begin, 8, 0.05)
        assert h.scores["accuracy"] == pytest.approx(score) and h.epoch == epoch
        _, _, theta = by_loop(x, y, w, val, h.decay, begin, h.epoch, 0.05)
        assert np.allclose(h.weights.T, theta[:-1], atol=1e-5) and np.allclose(h.bias, theta[-1], atol=1e-5)


def test_grids_and_scores(spark):
    rows, *_ = data(spark)
    heads = probe.fitted(rows, 3, epochs=25)
    assert [h.decay for h in heads] == list(probe.DECAYS) and max(h.scores["accuracy"] for h in heads) > 0.8
    start = (heads[0].weights, heads[0].bias)
    again = probe.fitted(rows, 3, start=start, epochs=0)
    assert [h.decay for h in again] == list(probe.WARM_DECAYS) and {h.scores["accuracy"] for h in again} == {heads[0].scores["accuracy"]}
    assert all(h.scores["balanced_f1"] >= 0 for h in probe.fitted(rows, 3, start=start, epochs=2, select_by="balanced_f1"))
    got = probe.scores(np.array([[2, 1, 0], [0, 3, 0], [0, 0, 0]]), np.zeros((3, 3)))
    assert got == {"accuracy": pytest.approx(5 / 6), "macro_f1": pytest.approx((0.8 + 6 / 7) / 3), "balanced_f1": 0.0}


def test_tables_without_rows(spark):
    rows, *_ = data(spark)
    for none in (rows.limit(0), rows.where("split = 'val'"), rows.where("split = 'train'")):
        heads = probe.fitted(none, 3, decays=(0.1,), epochs=2)
        assert len(heads) == 1 and 0 <= heads[0].scores["accuracy"] <= 1


def test_a_grid_is_a_table(spark):
    rows, *_ = data(spark)
    df = probe.grid(spark, probe.fitted(rows, 3, decays=(0.1, 1.0), epochs=2))
    assert df.columns == ["decay", "accuracy", "macro_f1", "balanced_f1"] and df.where(F.col("accuracy").between(0, 1)).count() == 2
