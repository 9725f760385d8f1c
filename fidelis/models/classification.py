"""Robust logistic and softmax classification."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import one_hot, sigmoid
from fidelis.models import robust
from fidelis.models.robust import Model, Settings
from fidelis.operators.classification import accuracy, averaged

RIDGE, GUARD = 1e-8, 1e-8


class LogisticRegressor:
    """Labels 0 and 1. Each round weighs rows by this round's robust weights only."""

    def __init__(self, features: list[str], label: str, degree: int = 1, **settings):
        self.features, self.label, self.degree, self.settings = list(features), label, degree, Settings(**settings)

    def fit(self, df: DataFrame) -> Model:
        rows, p = robust.design(df, self.features, self.label, self.degree)
        beta, history, y = np.zeros(p), [], F.col("y")
        for i in range(1, self.settings.max_iter + 1):
            fit = robust.linear(beta)
            z = robust.to_z(fit - y, robust.bounds(rows, e=fit - y)["e"], self.settings.form)
            weight, _ = robust.robust_weight(rows, z)
            chance = sigmoid(fit)
            bounded = F.greatest(F.lit(GUARD), F.least(F.lit(1 - GUARD), chance))
            loss = rows.agg(-F.avg(y * F.log(bounded) + (1 - y) * F.log(1 - bounded))).first()[0]
            response = fit + (y - chance) / (chance * (1 - chance) + F.lit(GUARD))
            entropy = robust.entropy_of(rows, z, self.settings)
            beta = robust.normal_equations(rows, p, weight, [response], RIDGE)[:, 0]
            history.append({"iteration": i, "loss": loss, "entropy": entropy, "coefficients": beta.tolist()})
            if robust.settled(history, self.settings):
                break
        rows.unpersist()
        return Model("logistic", self.features, self.label, self.degree, beta.tolist(), asdict(self.settings), history)


class MulticlassClassifier:
    """Labels 0..K-1; one aggregate a round gives the matrix that all classes' solves share."""

    def __init__(self, features: list[str], label: str, degree: int = 1, **settings):
        settings = {"tolerance": 0.1} | settings
        self.features, self.label, self.degree, self.settings = list(features), label, degree, Settings(**settings)

    def fit(self, df: DataFrame) -> Model:
        rows, p = robust.design(df, self.features, self.label, self.degree)
        classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
        beta, history = np.zeros((p, classes)), []
        truth = one_hot(F.col("y").cast("int"), classes)
        for i in range(1, self.settings.max_iter + 1):
            found = _with_errors(rows, [robust.linear(beta[:, k]) for k in range(classes)], truth)
            targets = [(F.col(f"_f{k}") - F.col(f"_e{k}")).alias(f"_g{k}") for k in range(classes)]
            # kept for the round: filters of the steps below would be moved before the steps above, with copies of all of them
            scored = found.select(*[f"t{j}" for j in range(p)], *targets, "_size").persist()
            z = robust.to_z(F.col("_size"), robust.bounds(scored, e=F.col("_size"))["e"], self.settings.form)
            weight, _ = robust.robust_weight(scored, z)
            entropy = robust.entropy_of(scored, z, self.settings)
            weighed = scored.withColumn("_weight", weight)
            beta = robust.normal_equations(weighed, p, F.col("_weight"), [F.col(f"_g{k}") for k in range(classes)], RIDGE)
            scored.unpersist()
            after = _with_errors(rows, [robust.linear(beta[:, k]) for k in range(classes)], truth)
            of_class = sum((truth[k] * F.log(F.greatest(F.lit(GUARD), F.least(F.lit(1 - GUARD), F.col(f"_p{k}")))) for k in range(classes)), F.lit(0.0))
            loss = after.agg(-F.avg(of_class)).first()[0]
            history.append({"iteration": i, "loss": loss, "entropy": entropy, "coefficients": beta.tolist()})
            if robust.settled(history, self.settings):
                break
        rows.unpersist()
        return Model("multiclass", self.features, self.label, self.degree, beta.tolist(), asdict(self.settings), history, {"classes": classes})


def _with_errors(rows: DataFrame, fits: list[Column], truth: Column) -> DataFrame:
    """Adds each class's logit _f, chance _p and error _e, and _size, the errors' length.

    Each step is a column of its own: later steps use it more than once, and as one
    expression its copies would grow with every step and leave generated code.
    """
    classes = range(len(fits))
    steps = [
        {f"_f{k}": f for k, f in enumerate(fits)},
        {"_top": F.greatest(*[F.col(f"_f{k}") for k in classes]) if len(fits) > 1 else F.col("_f0")},
        {f"_x{k}": F.exp(F.col(f"_f{k}") - F.col("_top")) for k in classes},
        {"_total": sum((F.col(f"_x{k}") for k in classes[1:]), F.col("_x0"))},
        {f"_p{k}": F.col(f"_x{k}") / F.col("_total") for k in classes},
        {f"_e{k}": F.col(f"_p{k}") - truth[k] for k in classes},
        {"_size": F.sqrt(sum((F.col(f"_e{k}") * F.col(f"_e{k}") for k in classes), F.lit(0.0)))},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows


def _chances(fits: list[Column]) -> Column:
    """softmax() of a fixed number of logits, as plain expressions that stay in generated code."""
    top = F.greatest(*fits) if len(fits) > 1 else fits[0]
    powers = [F.exp(f - top) for f in fits]
    total = sum(powers[1:], powers[0])
    return F.array(*[p / total for p in powers])


def _scores(model: Model, column: int | None = None) -> Column:
    total = F.lit(0.0)
    for b, term in zip(model.coefficients, model.terms(), strict=True):
        total = total + F.lit(float(b if column is None else b[column])) * term
    return total


def predict_probability(model: Model, df: DataFrame, name: str = "probability") -> DataFrame:
    """Adds the chance of label 1, or the array of all labels' chances."""
    if model.kind == "logistic":
        return df.withColumn(name, sigmoid(_scores(model)))
    return df.withColumn(name, _chances([_scores(model, k) for k in range(model.extra["classes"])]))


def predict(model: Model, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Adds the likeliest label; ties go to the smaller."""
    scored = predict_probability(model, df, "_p")
    if model.kind == "logistic":
        return scored.withColumn(name, (F.col("_p") >= 0.5).cast("int")).drop("_p")
    return scored.withColumn(name, (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).drop("_p")


def score(model: Model, df: DataFrame) -> float:
    """F1 of label 1 for logistic models, accuracy for others."""
    told = predict(model, df, "_told").withColumn("_y", F.col(model.label).cast("int"))
    if model.kind == "logistic":
        return averaged(told, "_y", "_told", "binary", labels=[0, 1]).first()["f1"]
    return accuracy(told, "_y", "_told").first()["accuracy"]
