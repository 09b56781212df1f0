"""The Huber fit meets its optimality conditions, and no round raises the loss."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidecast.operators import learn


def frame(spark, x, y):
    rows = [(list(map(float, a)), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "a array<double>, y_scaled double").select(array_to_vector("a").alias("features"), "y_scaled")


@pytest.mark.parametrize("n,p,delta", [(60, 4, 0.1), (40, 3, 100.0)])
def test_conditions_of_the_minimum(spark, n, p, delta):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p))
    x[:, -1] = 2.0                                                   # a constant column
    y = x @ rng.normal(size=p) * 0.1 + 0.02 * rng.normal(size=n)
    y[:3] += 5                                                       # outliers
    train = frame(spark, x, y)
    model = learn.fit_huber(train, penalty=0.01, delta=delta)
    got = {r["step"]: r["violation"] for r in learn.huber_optimality(train, model, 0.01, delta).collect()}
    assert set(got) == set(range(-1, p)) and max(got.values()) < 1e-5

    def loss(w, b):
        r = np.abs(y - x @ w - b)
        return np.where(r <= delta, r * r / 2, delta * r - delta * delta / 2).mean() + 0.01 / 2 * w @ w

    w = np.array(model.coefficients.toArray())
    best = loss(w, model.intercept)
    for _ in range(200):
        step = rng.normal(size=p + 1) * 10 ** rng.uniform(-4, 0)
        assert loss(w + step[:-1], model.intercept + step[-1]) >= best - 1e-9


def test_more_coefficients_than_rows(spark):
    """Slow to end (100 rounds left a violation of 0.001 here), but every round lowers the loss."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12, 20))
    x[:, -1] = 2.0
    y = x @ rng.normal(size=20) * 0.1 + 0.02 * rng.normal(size=12)
    y[:3] += 5
    train, losses = frame(spark, x, y), []
    for rounds in (1, 2, 4, 8):
        model = learn.fit_huber(train, penalty=0.01, delta=0.05, rounds=rounds)
        w, r = np.array(model.coefficients.toArray()), np.abs(y - x @ np.array(model.coefficients.toArray()) - model.intercept)
        losses.append(np.where(r <= 0.05, r * r / 2, 0.05 * r - 0.05 ** 2 / 2).mean() + 0.01 / 2 * w @ w)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
