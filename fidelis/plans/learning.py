"""Queries over models: single steps with their SQL, and whole fits, which SQL cannot express."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions import az, fidelity_i, q_pair, sigmoid
from fidelis.models import classification, clustering, forecasting, regression, robust, selection, trees
from fidelis.models.robust import Model
from fidelis.operators.kernels import EPS
from fidelis.plans import sql as S
from fidelis.sources.tables import table


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
    )


def _line(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select(F.lit(1.0).alias("t0"), F.col("l_quantity").alias("t1"), F.col("l_extendedprice").alias("y"), (1 + F.col("l_tax")).alias("w"))


def _coefficients(spark: SparkSession, names: list[str], values) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "term string, value double")


def wls_step(spark: SparkSession, sf: str) -> DataFrame:
    beta = robust.normal_equations(_line(spark, sf), 2, F.col("w"), [F.col("y")], EPS)[:, 0]
    return _coefficients(spark, ["one", "l_quantity"], np.round(beta, 3))


def _solve(a: str, b: str, c: str, d: str, e: str) -> str:
    """Rows of the solution of [[a, b], [b, c]] x = [d, e]."""
    det = f"(({a}) * ({c}) - ({b}) * ({b}))"
    return f"(({c}) * ({d}) - ({b}) * ({e})) / {det} AS b0, (({a}) * ({e}) - ({b}) * ({d})) / {det} AS b1"


WLS_STEP = f"""
WITH s AS (SELECT {_solve('sum(1 + l_tax)', 'sum((1 + l_tax) * l_quantity)', 'sum((1 + l_tax) * l_quantity * l_quantity)',
  'sum((1 + l_tax) * l_extendedprice)', 'sum((1 + l_tax) * l_quantity * l_extendedprice)')} FROM lineitem)
SELECT 'one' AS term, round(b0, 3) AS value FROM s UNION ALL SELECT 'l_quantity', round(b1, 3) FROM s
"""


def irls_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line(spark, sf)
    beta = robust.normal_equations(rows, 2, F.lit(1.0), [F.col("y")], EPS)[:, 0]
    error = robust.linear(beta) - F.col("y")
    weight, _ = robust.robust_weight(rows, robust.to_z(error, robust.bounds(rows, e=error)["e"], "a"))
    again = robust.normal_equations(rows, 2, weight, [F.col("y")], EPS)[:, 0]
    return _coefficients(spark, ["one", "l_quantity"], np.round(again, 2))


IRLS_STEP = f"""
WITH RECURSIVE r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
b AS (SELECT {_solve('count(*)::DOUBLE', 'sum(x)', 'sum(x * x)', 'sum(y)', 'sum(x * y)')} FROM r),
e AS (SELECT x, y, b0 + b1 * x - y AS e FROM r, b),
z AS (SELECT x, y, {S.az('e', 'lo', 'hi')} AS z FROM e, (SELECT min(e) AS lo, max(e) AS hi FROM e)),
c AS (SELECT x, y, z / m AS r FROM z, (SELECT median(z) AS m FROM z)),
m AS (SELECT avg({S.fi('r')}) AS f FROM c),
{S.newton('m', [], 'f')},
v AS (SELECT x, y, {S.fi('r', 'scale')} * {S.fi('r', 'scale')} AS w FROM c, scaled),
s AS (SELECT {_solve('sum(w)', 'sum(w * x)', 'sum(w * x * x)', 'sum(w * y)', 'sum(w * x * y)')} FROM v)
SELECT 'one' AS term, round(b0, 2) AS value FROM s UNION ALL SELECT 'l_quantity', round(b1, 2) FROM s
"""


def logistic_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).select(F.lit(1.0).alias("t0"), (F.col("l_quantity") / 10).alias("t1"), F.col("returned").cast("double").alias("y"))
    fit = robust.linear(np.array([-0.5, 0.1]))
    error = fit - F.col("y")
    low_high = robust.bounds(rows, e=error)["e"]
    weight, _ = robust.robust_weight(rows, az(error, F.lit(low_high[0]), F.lit(low_high[1])))
    p = sigmoid(fit)
    beta = robust.normal_equations(rows, 2, weight, [fit + (F.col("y") - p) / (p * (1 - p) + 1e-8)], 1e-8)[:, 0]
    return _coefficients(spark, ["one", "x"], np.round(beta, 5))


LOGISTIC_STEP = f"""
WITH RECURSIVE r AS (SELECT l_quantity / 10 AS x, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y, -0.5 + 0.1 * l_quantity / 10 AS fit FROM lineitem),
z AS (SELECT x, y, fit, {S.az('(fit - y)', 'lo', 'hi')} AS z FROM r, (SELECT min(fit - y) AS lo, max(fit - y) AS hi FROM r)),
c AS (SELECT x, y, fit, z / m AS r FROM z, (SELECT median(z) AS m FROM z)),
m AS (SELECT avg({S.fi('r')}) AS f FROM c),
{S.newton('m', [], 'f')},
v AS (SELECT x, {S.fi('r', 'scale')} * {S.fi('r', 'scale')} AS w, fit + (y - p) / (p * (1 - p) + 1e-8) AS y
  FROM (SELECT *, 1 / (1 + exp(-fit)) AS p FROM c), scaled),
s AS (SELECT {_solve('sum(w) + 1e-8', 'sum(w * x)', 'sum(w * x * x) + 1e-8', 'sum(w * y)', 'sum(w * x * y)')} FROM v)
SELECT 'one' AS term, round(b0, 5) AS value FROM s UNION ALL SELECT 'x', round(b1, 5) FROM s
"""

_CENTRES = np.array([[10.0, 20000.0], [25.0, 40000.0], [40.0, 60000.0]])


def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = Model("kmeans", ["l_quantity", "l_extendedprice"], "", 1, _CENTRES.tolist(), {})
    return clustering.predict(model, rows).select("l_orderkey", "l_linenumber", "cluster")


_DISTANCES = ", ".join(f"pow(l_quantity - {a}, 2) + pow(l_extendedprice - {b}, 2)" for a, b in _CENTRES.tolist())
_NEAREST = f"(list_position([{_DISTANCES}], list_min([{_DISTANCES}])) - 1)::INTEGER"
KMEANS_ASSIGN = f"SELECT l_orderkey, l_linenumber, {_NEAREST} AS cluster FROM lineitem"


def kmeans_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("w", 1 + F.col("l_tax"))
    found = clustering.update(rows, ["l_quantity", "l_extendedprice"], _CENTRES, F.col("w"))
    return spark.createDataFrame([(k, round(float(a), 4), round(float(b), 2)) for k, (a, b) in enumerate(found)], "cluster int, quantity double, price double")


KMEANS_UPDATE = f"""
SELECT cluster, round(sum((1 + l_tax) * l_quantity) / sum(1 + l_tax), 4) AS quantity, round(sum((1 + l_tax) * l_extendedprice) / sum(1 + l_tax), 2) AS price
FROM (SELECT *, {_NEAREST} AS cluster FROM lineitem) GROUP BY cluster
"""


def gnostic_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Robust weights of residuals from a given line, for each row."""
    rows = _line(spark, sf).withColumn("e", 5000 + 1500 * F.col("t1") - F.col("y"))
    z = robust.to_z(F.col("e"), robust.bounds(rows, e=F.col("e"))["e"], "a")
    return rows.select(F.round(fidelity_i(*q_pair(z, 1.0)), 6).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


GNOSTIC_PROBABILITY = f"""
WITH e AS (SELECT 5000 + 1500 * l_quantity - l_extendedprice AS e FROM lineitem),
z AS (SELECT {S.az('e', 'lo', 'hi')} AS z FROM e, (SELECT min(e) AS lo, max(e) AS hi FROM e))
SELECT round({S.fi('z')}, 6) AS f, count(*) AS n FROM z GROUP BY ALL
"""


def _summary(spark: SparkSession, model: Model, score: float) -> DataFrame:
    rows = [(i, float(h["loss"]), float(h["entropy"])) for i, h in enumerate(model.history, 1)]
    rounds = spark.createDataFrame(rows, "iteration int, loss double, entropy double")
    return rounds.withColumn("coefficients", F.lit(str(model.coefficients))).withColumn("score", F.lit(float(score)))


def linear_regressor(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    model = regression.LinearRegressor(["l_quantity", "l_discount"], "l_extendedprice", max_iter=8).fit(rows)
    return _summary(spark, model, regression.score(model, rows))


def polynomial_regressor(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("x", F.col("l_quantity") / 50)
    model = regression.PolynomialRegressor(["x"], "l_extendedprice", 2, max_iter=8).fit(rows)
    return regression.predict(model, rows).select("l_orderkey", "l_linenumber", "prediction")


def logistic_regressor(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_totalprice") / 100_000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    model = classification.LogisticRegressor(["x"], "y", max_iter=6).fit(rows)
    return _summary(spark, model, classification.score(model, rows))


def multiclass_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumns({"x": F.col("l_quantity") / 50, "x2": F.col("l_extendedprice") / 50_000})
    model = classification.MulticlassClassifier(["x", "x2"], "flag", max_iter=4).fit(rows)
    return classification.predict(model, rows).select("l_orderkey", "l_linenumber", "prediction")


def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumns({"x": F.col("l_quantity") / 50, "x2": F.col("l_extendedprice") / 50_000})
    model = clustering.KMeansClustering(["x", "x2"], 4, seed=1, max_iter=6).fit(rows)
    return clustering.predict(model, rows).select("l_orderkey", "l_linenumber", "cluster")


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


def _forecast(spark: SparkSession, model: Model, steps: int = 12) -> DataFrame:
    return spark.createDataFrame(list(enumerate(forecasting.forecast(model, steps), 1)), "step int, value double")


def auto_regressor(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, forecasting.AutoRegressor("value", "ts", 3, max_iter=5).fit(_hours(spark, sf)))


def arima(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, forecasting.ARIMA("value", "ts", optimize=True, max_iter=4).fit(_hours(spark, sf)))


def sarima(spark: SparkSession, sf: str) -> DataFrame:
    model = forecasting.SARIMA("value", "ts", (1, 0, 1), (1, 1, 0, 24), max_iter=4).fit(_hours(spark, sf))
    return _forecast(spark, model, 24)


def _trees(kind: str, classes: int | None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows, label = _rows(spark, sf), "l_extendedprice" if classes is None else "flag"
        features = ["l_quantity", "l_discount", "l_tax"] + ([] if classes is None else ["l_extendedprice"])
        model = trees.GnosticTrees(features, label, kind, classes, trees=5, depth=4, max_iter=1, seed=1).fit(rows)
        return model.predict(rows).select("l_orderkey", "l_linenumber", "prediction")

    return query


def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("x"), "o_totalprice")
    make = regression.LinearRegressor(["x"], "o_totalprice", max_iter=2)
    scores = selection.cross_validate(rows, "o_orderkey", make.fit, regression.score, k=3)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, robr2 double")


QUERIES = {
    "wls_step": (wls_step, WLS_STEP),
    "irls_step": (irls_step, IRLS_STEP),
    "logistic_step": (logistic_step, LOGISTIC_STEP),
    "kmeans_assign": (kmeans_assign, KMEANS_ASSIGN),
    "kmeans_update": (kmeans_update, KMEANS_UPDATE),
    "residual_fidelity": (gnostic_probability, GNOSTIC_PROBABILITY),
    "linear_regressor": (linear_regressor, None),
    "polynomial_regressor": (polynomial_regressor, None),
    "logistic_regressor": (logistic_regressor, None),
    "multiclass_classifier": (multiclass_classifier, None),
    "kmeans": (kmeans, None),
    "auto_regressor": (auto_regressor, None),
    "arima": (arima, None),
    "sarima": (sarima, None),
    "tree_regressor": (_trees("tree", None), None),
    "forest_regressor": (_trees("forest", None), None),
    "boosting_regressor": (_trees("boosting", None), None),
    "tree_classifier": (_trees("tree", 3), None),
    "forest_classifier": (_trees("forest", 3), None),
    "boosting_classifier": (_trees("boosting", 3), None),
    "cross_validation": (cross_validation, None),
}
