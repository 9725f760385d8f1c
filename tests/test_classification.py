"""Softmax classification against plain numpy, in bounded time."""

import time

import numpy as np

from fidelis.models.classification import MulticlassClassifier


def test_rounds_follow_the_definition_in_bounded_time(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    x[:, 0] += label
    rows = spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, label, strict=True)], "a double, b double, y int")
    start = time.monotonic()
    model = MulticlassClassifier(["a", "b"], "y", max_iter=2, tolerance=1e-12).fit(rows)
    # copies of the steps in filters made plans that were slow to make: 60,000 rows took over a minute
    assert time.monotonic() - start < 90
    # the first round has equal errors' lengths, so equal weights
    design, truth = np.column_stack([np.ones(300), x]), np.eye(3)[label]
    first = np.linalg.lstsq(design, truth - 1 / 3, rcond=None)[0]
    assert np.allclose(model.history[0]["coefficients"], first, atol=1e-6)
    powers = np.exp(design @ first)
    chance = (powers / powers.sum(1, keepdims=True))[np.arange(300), label]
    assert abs(model.history[0]["loss"] + np.log(chance).mean()) < 1e-6
    assert model.history[1]["loss"] < model.history[0]["loss"]
