"""Robust linear and polynomial regression by iteratively re-weighted least squares."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.models import robust
from fidelis.models.robust import Model, Settings
from fidelis.operators.kernels import EPS
from fidelis.operators.metrics import evaluation


def fit_rows(rows: DataFrame, p: int, settings: Settings) -> tuple[np.ndarray, list[dict]]:
    """Coefficients and history for a design (t0.., y); every round is a few aggregates.

    Weights are the products of all rounds' robust weights, scaled to sum one.
    """
    weight: Column = F.lit(1.0)
    beta, history = np.zeros(p), []
    for i in range(1, settings.max_iter + 1):
        beta = robust.normal_equations(rows, p, weight, [F.col("y")], EPS)[:, 0]
        fit = robust.linear(beta)
        low_high = robust.bounds(rows, e=fit - F.col("y"), y=F.col("y"), fit=fit)
        z = robust.to_z(fit - F.col("y"), low_high["e"], settings.form)
        own, scale = robust.robust_weight(rows, z)
        scale = scale if settings.scale == "auto" else float(settings.scale)
        ratio = robust.safe_ratio(robust.to_z(fit, low_high["fit"], settings.form), robust.to_z(F.col("y"), low_high["y"], settings.form))
        loss, entropy, total = robust.criterion(rows, ratio, scale, settings.loss, weight * own)
        history.append({"iteration": i, "loss": loss, "entropy": entropy, "coefficients": beta.tolist()})
        if robust.settled(history, settings):
            break
        rows, weight = robust.written(rows, weight * own / F.lit(total or 1.0), i)
    return beta, history


class Regressor:
    """A polynomial of the features; degree 1 is linear regression."""

    def __init__(self, features: list[str], label: str, degree: int = 1, **settings):
        self.features, self.label, self.degree, self.settings = list(features), label, degree, Settings(**settings)

    def fit(self, df: DataFrame) -> Model:
        rows, p = robust.design(df, self.features, self.label, self.degree)
        try:
            beta, history = fit_rows(rows, p, self.settings)
        finally:
            rows.unpersist()
        return Model("regression", self.features, self.label, self.degree, beta.tolist(), asdict(self.settings), history)


class LinearRegressor(Regressor):
    def __init__(self, features: list[str], label: str, **settings):
        super().__init__(features, label, 1, **settings)


class PolynomialRegressor(Regressor):
    def __init__(self, features: list[str], label: str, degree: int = 2, **settings):
        super().__init__(features, label, degree, **settings)


def predict(model: Model, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Adds the prediction as an expression of the features."""
    total = F.lit(0.0)
    for b, term in zip(model.coefficients, model.terms(), strict=True):
        total = total + F.lit(float(b)) * term
    return df.withColumn(name, total)


def score(model: Model, df: DataFrame) -> float:
    """Robust R2 with unit weights."""
    return evaluation(predict(model, df, "_fit"), model.label, "_fit").first()["robr2"]
