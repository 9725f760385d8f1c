"""What the re-weighted fits share: normal equations, robust weights and criteria as aggregates."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions import az, fidelity_i, fidelity_j, irrelevance_i, irrelevance_j, mz, polynomial_terms, q_pair
from fidelis.operators.kernels import EPS, scale_of
from fidelis.operators.lineage import cut
from fidelis.operators.totals import exact_median, valid

#: Weights are expressions over the data; after so many rounds they are written down.
CUT_EVERY = 4


@dataclass
class Settings:
    """max_iter rounds at most; a change of loss or entropy under `tolerance` ends them."""

    max_iter: int = 100
    tolerance: float = 1e-2
    loss: str = "hi"
    scale: float | str = "auto"
    form: str = "a"
    early_stopping: bool = True

    def __post_init__(self) -> None:
        if self.max_iter < 1 or self.tolerance <= 0 or self.loss not in ("hi", "hj") or self.form not in ("a", "m"):
            raise ValueError("max_iter >= 1, tolerance > 0, loss hi or hj and form a or m are needed")
        if self.scale != "auto" and not 0 <= float(self.scale) <= 2:
            raise ValueError("scale is 'auto' or lies between 0 and 2")


@dataclass
class Model:
    """A fitted model: plain numbers, so it can be saved as JSON and applied as expressions."""

    kind: str
    features: list[str]
    label: str
    degree: int
    coefficients: list
    settings: dict
    history: list[dict] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as one JSON row to any path that Spark writes."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """(iteration, loss, entropy, coefficients) of each round."""
        rows = [(h["iteration"], float(h["loss"]), float(h["entropy"]), json.dumps(h["coefficients"])) for h in self.history]
        return spark.createDataFrame(rows, "iteration int, loss double, entropy double, coefficients string")

    def terms(self) -> list[Column]:
        return [c for _, c in polynomial_terms(self.features, self.degree)]


def design(df: DataFrame, features: list[str], label: str, degree: int = 1) -> tuple[DataFrame, int]:
    """(t0, t1, ..., y) of the rows whose features and label are numbers, kept for the rounds."""
    terms = [c.alias(f"t{i}") for i, (_, c) in enumerate(polynomial_terms(features, degree))]
    rows = valid(df, label, *features).select(*terms, F.col(label).cast("double").alias("y"))
    return rows.persist(), len(terms)


def linear(coefficients: np.ndarray, prefix: str = "t") -> Column:
    total = F.lit(0.0)
    for i, b in enumerate(coefficients):
        total = total + F.lit(float(b)) * F.col(f"{prefix}{i}")
    return total


def normal_equations(rows: DataFrame, p: int, weight: Column, targets: list[Column], ridge: float) -> np.ndarray:
    """Weighted least squares for each target: one aggregate of p x p sums, solved on the driver."""
    sums = [F.sum(weight * F.col(f"t{i}") * F.col(f"t{j}")) for i in range(p) for j in range(i, p)]
    sums += [F.sum(weight * F.col(f"t{i}") * y) for y in targets for i in range(p)]
    got = [0.0 if v is None else float(v) for v in rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
    matrix, k = np.zeros((p, p)), 0
    for i in range(p):
        for j in range(i, p):
            matrix[i, j] = matrix[j, i] = got[k]
            k += 1
    right = np.array(got[k:]).reshape(len(targets), p).T
    matrix += ridge * np.eye(p)
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix) @ right


def bounds(rows: DataFrame, **columns: Column) -> dict[str, tuple[float, float]]:
    found = rows.agg(*[f(c).alias(f"{n}_{k}") for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {n: (found[f"{n}_lo"] or 0.0, found[f"{n}_hi"] or 0.0) for n in columns}


def to_z(x: Column, low_high: tuple[float, float], form: str) -> Column:
    return {"a": az, "m": mz}[form](x, F.lit(float(low_high[0])), F.lit(float(low_high[1])))


def _mean(x: Column, count: str | None) -> Column:
    return F.avg(x) if count is None else F.sum(x * F.col(count)) / F.sum(F.when(x.isNotNull(), F.col(count)))


def robust_weight(rows: DataFrame, z: Column, count: str | None = None) -> tuple[Column, float]:
    """The squared fidelity about the median at the scale of the mean fidelity, and that scale; a row stands for `count`."""
    middle = exact_median(rows.select(z.alias("_z"), *([count] if count else [])), [], "_z", "m", count).first()["m"]
    ratio = z / F.lit(float(middle))
    mean = rows.agg(_mean(fidelity_i(*q_pair(ratio, 1.0)), count)).first()[0]
    scale = scale_of(float(mean))
    fidelity = fidelity_i(*q_pair(ratio, scale))
    return fidelity * fidelity, scale


def criterion(rows: DataFrame, ratio: Column, scale: float, loss: str, weight: Column, count: str | None = None) -> tuple[float, float, float]:
    """(sum of squared irrelevances, mean residual entropy scaled to its range, sum of weights); a row stands for `count`."""
    pair = q_pair(ratio, scale)
    h = irrelevance_i(*pair) if loss == "hi" else irrelevance_j(*pair)
    re, times = fidelity_j(*pair) - fidelity_i(*pair), F.lit(1) if count is None else F.col(count)
    got = rows.agg(
        F.sum(h * h * times).alias("loss"),
        _mean(re, count).alias("mean"),
        F.min(re).alias("low"),
        F.max(re).alias("high"),
        F.sum(weight * times).alias("weight"),
    ).first()
    span = (got["high"] or 0.0) - (got["low"] or 0.0)
    entropy = ((got["mean"] or 0.0) - (got["low"] or 0.0)) / span if span else (got["mean"] or 0.0)
    return got["loss"] or 0.0, entropy, got["weight"] or 0.0


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.when(F.abs(b) < EPS, EPS).otherwise(b)


def entropy_of(rows: DataFrame, z: Column, settings: Settings) -> float:
    """Mean residual entropy of z, normalised by its own range, at its own scale."""
    low_high = bounds(rows, z=z)["z"]
    zz = to_z(z, low_high, settings.form)
    scale = settings.scale
    if scale == "auto":
        scale = scale_of(float(rows.agg(F.avg(fidelity_i(*q_pair(zz, 1.0)))).first()[0]))
    return criterion(rows, zz, float(scale), "hi", F.lit(1.0))[1]


def settled(history: list[dict], settings: Settings) -> bool:
    if not settings.early_stopping or len(history) < 2:
        return False
    a, b = history[-2], history[-1]
    return abs(a["loss"] - b["loss"]) < settings.tolerance or abs(a["entropy"] - b["entropy"]) < settings.tolerance


def written(rows: DataFrame, weight: Column, round_: int) -> tuple[DataFrame, Column]:
    """Every few rounds the weights become a column of a checkpointed table."""
    if round_ % CUT_EVERY:
        return rows, weight
    return cut(rows.withColumn("_next", weight).drop("_w").withColumnRenamed("_next", "_w")), F.col("_w")
