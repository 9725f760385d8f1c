"""Small known and generated samples as DataFrames, for checks and examples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The four Anscombe sets (x of the first three is shared).
_X = [10, 8, 13, 9, 11, 14, 6, 4, 12, 7, 5]
ANSCOMBE = {
    1: (_X, [8.04, 6.95, 7.58, 8.81, 8.33, 9.96, 7.24, 4.26, 10.84, 4.82, 5.68]),
    2: (_X, [9.14, 8.14, 8.74, 8.77, 9.26, 8.10, 6.13, 3.10, 9.13, 7.26, 4.74]),
    3: (_X, [7.46, 6.77, 12.74, 7.11, 7.81, 8.84, 6.08, 5.39, 8.15, 6.42, 5.73]),
    4: ([8, 8, 8, 8, 8, 8, 8, 19, 8, 8, 8], [6.58, 5.76, 7.71, 8.84, 8.47, 7.04, 5.25, 12.50, 5.56, 7.91, 6.89]),
}
#: Stack loss of an ammonia plant (air flow, water temperature, acid, loss).
STACKLOSS = [
    (80, 27, 89, 42), (80, 27, 88, 37), (75, 25, 90, 37), (62, 24, 87, 28), (62, 22, 87, 18), (62, 23, 87, 18), (62, 24, 93, 19),
    (62, 24, 93, 20), (58, 23, 87, 15), (58, 18, 80, 14), (58, 18, 89, 14), (58, 17, 88, 13), (58, 18, 82, 11), (58, 19, 93, 12),
    (50, 18, 89, 8), (50, 18, 86, 7), (50, 19, 72, 8), (50, 19, 79, 8), (50, 20, 80, 9), (56, 20, 82, 15), (70, 20, 91, 15),
]


def anscombe(spark: SparkSession, number: int = 1) -> DataFrame:
    """(dataset_id, x, y): one of Anscombe's four sets."""
    if number not in ANSCOMBE:
        raise ValueError("the sets are 1 to 4")
    x, y = ANSCOMBE[number]
    return spark.createDataFrame([(number, float(a), float(b)) for a, b in zip(x, y, strict=True)], "dataset_id int, x double, y double")


def stackloss(spark: SparkSession) -> DataFrame:
    """(air_flow, water_temp, acid_conc, stack_loss)."""
    rows = [tuple(map(float, r)) for r in STACKLOSS]
    return spark.createDataFrame(rows, "air_flow double, water_temp double, acid_conc double, stack_loss double")


def line(spark: SparkSession, n: int = 20, slope: float = 3.5, intercept: float = 10.0, noise: float = 2.0, outliers: float = 0.0, seed: int = 42) -> DataFrame:
    """(x, y): a noisy line over [0, 10], a share of whose points are moved far up or down."""
    rng = np.random.default_rng(seed)
    x = rng.random(n) * 10
    y = intercept + slope * x + rng.normal(0, noise, n)
    for i in rng.choice(n, int(n * outliers), replace=False):
        y[i] += rng.choice([-1, 1]) * 10 * max(noise, 1.0)
    return spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")


def blobs(spark: SparkSession, n: int = 30, features: int = 2, classes: int = 2, apart: float = 2.0, seed: int = 42) -> DataFrame:
    """(x0, x1, ..., label): Gaussian groups around random centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, features)) * apart
    labels = np.arange(n) % classes
    x = centres[labels] + rng.normal(0, 0.7, (n, features))
    schema = ", ".join(f"x{i} double" for i in range(features)) + ", label int"
    return spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, labels, strict=True)], schema)


def moons(spark: SparkSession, n: int = 30, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """(x0, x1, label): two interleaved half circles."""
    rng = np.random.default_rng(seed)
    outer = np.linspace(0, np.pi, n - n // 2)
    inner = np.linspace(0, np.pi, n // 2)
    points = np.concatenate([np.c_[np.cos(outer), np.sin(outer)], np.c_[1 - np.cos(inner), 0.5 - np.sin(inner)]])
    points = points + rng.normal(0, noise, points.shape) if noise else points
    labels = [0] * len(outer) + [1] * len(inner)
    return spark.createDataFrame([(float(a), float(b), k) for (a, b), k in zip(points, labels, strict=True)], "x0 double, x1 double, label int")
