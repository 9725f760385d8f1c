"""Trees, forests and boosting: what they learn, chances of labels, models that are saved."""

import random

import pytest

from fidelis.models.trees import GnosticTrees, TreeModel


def _rows(spark, classes):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b = rng.random() * 3, rng.random()
        label = float(int(a)) if classes else 4 * a + (50.0 if i % 60 == 0 else 0.0)
        rows.append((i, a, b, float(min(label, classes - 1)) if classes else label))
    return spark.createDataFrame(rows, "id int, a double, b double, y double")


@pytest.mark.parametrize("kind", ["tree", "forest", "boosting"])
def test_regression_and_round_trip(spark, tmp_path, kind):
    rows = _rows(spark, None)
    model = GnosticTrees(["a", "b"], "y", kind, trees=4, depth=3, max_iter=2).fit(rows)
    # outliers lose their weight: the line of the others is found
    told = {r["id"]: r for r in model.predict(rows).collect()}
    clean = [r for i, r in told.items() if i % 60]
    assert sum(abs(r["prediction"] - 4 * r["a"]) for r in clean) / len(clean) < 1.0
    model.save(spark, str(tmp_path / kind))
    again = TreeModel.load(spark, str(tmp_path / kind))
    assert (again.features, again.label, again.classes, again.history) == (model.features, model.label, model.classes, model.history)
    assert {r["id"]: r["prediction"] for r in again.predict(rows).collect()} == {i: r["prediction"] for i, r in told.items()}
    assert again.history_frame(spark).count() == len(model.history) >= 1


@pytest.mark.parametrize("kind,classes", [("tree", 3), ("forest", 3), ("boosting", 3), ("boosting", 2)])
def test_classes_have_chances(spark, tmp_path, kind, classes):
    rows = _rows(spark, classes)
    model = GnosticTrees(["a", "b"], "y", kind, classes, trees=4, depth=3, max_iter=1).fit(rows)
    assert model.score(rows) > 0.9
    told = model.predict(rows).collect()
    for r in told:
        assert len(r["probability"]) == classes and sum(r["probability"]) == pytest.approx(1)
        assert r["probability"][r["prediction"]] == max(r["probability"])
    model.save(spark, str(tmp_path / kind))
    again = TreeModel.load(spark, str(tmp_path / kind)).predict(rows).collect()
    assert {(r["id"], r["prediction"]) for r in again} == {(r["id"], r["prediction"]) for r in told}


def test_rows_alike_in_bins_are_fitted_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, fitted = [], GnosticTrees._fitted
    monkeypatch.setattr(GnosticTrees, "_fitted", lambda self, rows: seen.append((rows.count(), rows.agg(F.sum("_c")).first()[0])) or fitted(self, rows))
    rows = spark.range(6000).select((F.col("id") * 7 % 1000 / 1000).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 7 % 1000 >= 500).cast("double").alias("y"))
    model = GnosticTrees(["a", "b"], "y", "tree", 2, depth=3, max_iter=1).fit(rows)
    assert seen == [(n, 6000) for n, _ in seen] and len(seen) == 2 and seen[0][0] <= 2 * 32 * 3
    assert model.score(rows) > 0.95


def test_means_of_rows_alike_give_the_same_tree(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("k"))
    rows = rows.withColumn("y", F.sin("a") * 5 + F.col("b") * F.col("b") + F.xxhash64("a", "b") % 3)
    plain = DecisionTreeRegressor(featuresCol="v", labelCol="y", maxDepth=4).fit(VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows))
    want = [r[0] for r in plain.transform(VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows)).select("prediction").collect()]
    got = [r[0] for r in GnosticTrees(["a", "b"], "y", "tree", None, depth=4, max_iter=0).fit(rows).predict(rows).select("prediction").collect()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("classes", [None, 2])
def test_forest_counts_its_draws(spark, monkeypatch, classes):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.sql import functions as F

    seen = []
    for kind in (DecisionTreeClassifier, DecisionTreeRegressor):
        fit = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, rows, fit=fit: seen.append((rows.count(), rows.agg(F.sum("_w")).first()[0])) or fit(self, rows))
    rows = spark.range(6000).select((F.col("id") * 7 % 1000 / 1000).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 7 % 1000 >= 500).cast("double").alias("y"))
    model = GnosticTrees(["a", "b"], "y", "forest", classes, trees=4, depth=3, max_iter=0).fit(rows)
    # trees get rows alike once; the draws differ, and are about as many as rows
    assert len(seen) == 4 and all(n <= 2 * 32 * 3 for n, _ in seen)
    assert len({w for _, w in seen}) > 1 and all(abs(w - 6000) < 400 for _, w in seen)
    assert model.score(rows) > 0.95


def test_draws_are_poisson(spark):
    from pyspark.sql import functions as F

    from fidelis.models.trees import _drawn

    got = spark.range(200_001).select(_drawn(F.col("id") / 200_000).alias("k")).groupBy("k").count().collect()
    shares = {r["k"]: r["count"] / 200_001 for r in got}
    for k, p in enumerate([0.367879, 0.367879, 0.183940, 0.061313, 0.015328]):
        assert shares[k] == pytest.approx(p, abs=2e-5)
    assert sum(k * p for k, p in shares.items()) == pytest.approx(1, abs=1e-3)
