"""k-means with robust centroids."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.models import robust
from fidelis.models.robust import Model, Settings
from fidelis.operators.totals import valid


def squared_distance(features: list[str], centroid: np.ndarray) -> Column:
    total = F.lit(0.0)
    for f, c in zip(features, centroid, strict=True):
        total = total + (F.col(f).cast("double") - F.lit(float(c))) * (F.col(f).cast("double") - F.lit(float(c)))
    return total


def nearest(features: list[str], centroids: np.ndarray) -> Column:
    """The number of the nearest centroid; ties go to the first."""
    distances = F.array(*[squared_distance(features, c) for c in centroids])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


class KMeansClustering:
    """Rows' robust weights multiply from round to round and weigh the centroids' means."""

    def __init__(self, features: list[str], clusters: int = 3, init: str = "kmeans++", seed: int = 0, **settings):
        if clusters < 1 or init not in ("random", "kmeans++"):
            raise ValueError("clusters >= 1 and init random or kmeans++ are needed")
        self.features, self.clusters, self.init, self.seed = list(features), clusters, init, seed
        self.settings = Settings(**({"tolerance": 0.1} | settings))

    def _start(self, rows: DataFrame) -> np.ndarray:
        """Each draw is one aggregate: the row of least -ln(u) / weight, u from a hash of the row."""
        chosen: list[np.ndarray] = []
        for k in range(self.clusters):
            u = (F.pmod(F.xxhash64(*self.features, F.lit(self.seed + k)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
            weight = F.lit(1.0)
            if chosen and self.init == "kmeans++":
                weight = F.least(*[squared_distance(self.features, c) for c in chosen], F.lit(1e300))
            key = F.when(weight > 0, -F.log(u) / weight)
            drawn = rows.agg(F.min_by(F.struct(*self.features), key).alias("x")).first()["x"]
            if drawn is None:  # fewer different rows than clusters
                drawn = chosen[0] if chosen else [0.0] * len(self.features)
            chosen.append(np.array([float(v) for v in drawn]))
        return np.array(chosen)

    def fit(self, df: DataFrame) -> Model:
        rows = valid(df, *self.features).select(*[F.col(f).cast("double").alias(f) for f in self.features]).persist()
        base, centroids, weight, history = rows, self._start(rows), F.lit(1.0), []
        for i in range(1, self.settings.max_iter + 1):
            before = centroids
            centroids = update(rows, self.features, centroids, weight)
            own = nearest(self.features, before)
            size = F.sqrt(F.element_at(F.array(*[squared_distance(self.features, c) for c in centroids]), own + 1))
            low_high = robust.bounds(rows, e=size)["e"]
            mean = rows.agg(F.avg(size)).first()[0] or 0.0
            z = robust.to_z(size, low_high, self.settings.form)
            own_weight, scale = robust.robust_weight(rows, z)
            scale = scale if self.settings.scale == "auto" else float(self.settings.scale)
            reference = robust.to_z(F.lit(mean + 1e-8), (mean + 1e-8, mean + 1e-8), self.settings.form)
            loss, entropy, total = robust.criterion(rows, robust.safe_ratio(z, reference), scale, self.settings.loss, weight * own_weight)
            history.append({"iteration": i, "loss": loss, "entropy": entropy, "coefficients": centroids.tolist()})
            if robust.settled(history, self.settings) or np.linalg.norm(centroids - before) < self.settings.tolerance:
                break
            rows, weight = robust.written(rows, weight * own_weight / F.lit(total or 1.0), i)
        base.unpersist()
        return Model("kmeans", self.features, "", 1, centroids.tolist(), asdict(self.settings), history)


def update(rows: DataFrame, features: list[str], centroids: np.ndarray, weight: Column) -> np.ndarray:
    """Weighted means of the rows nearest to each centroid; a centroid without rows stays."""
    means = [F.try_divide(F.sum(F.col("_c_w") * F.col(f)), F.sum("_c_w")).alias(f"m{i}") for i, f in enumerate(features)]
    grouped = rows.withColumn("_c_w", weight).groupBy(nearest(features, centroids).alias("cluster")).agg(*means)
    out = centroids.copy()
    for r in grouped.collect():
        if r["m0"] is not None:
            out[r["cluster"]] = [r[f"m{i}"] for i in range(len(features))]
    return out


def predict(model: Model, df: DataFrame, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, nearest(model.features, np.array(model.coefficients)))


def score(model: Model, df: DataFrame) -> float:
    """Minus the sum of squared distances to the nearest centroids."""
    distances = F.array(*[squared_distance(model.features, c) for c in np.array(model.coefficients)])
    return -float(valid(df, *model.features).agg(F.sum(F.array_min(distances))).first()[0] or 0.0)
