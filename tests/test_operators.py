"""Operators against plain versions, known values and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis import functions as G
from fidelis.models import forecasting, regression, selection
from fidelis.models.clustering import KMeansClustering, score
from fidelis.models.robust import Model
from fidelis.operators import classification, distributions, fits, kernels, metrics, silhouette
from fidelis.operators.totals import exact_median
from fidelis.sources import datasets

OUTLIER = [-13.5, *map(float, range(1, 11))]


def _frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, x double")


def test_known_metrics(spark):
    rows = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8)], "y double, p double")
    got = metrics.evaluation(rows, "y", "p").first()
    assert got["robr2"] == pytest.approx(0.98)
    assert got["gmmfe"] == pytest.approx(1.0678089325646092)
    assert got["divi"] == pytest.approx(0.9534628418490129)
    rows = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "y double, p double")
    got = metrics.r2_score(rows, "y", "p", features=2).first()
    assert got["r2"] == pytest.approx(0.9486081370449679)
    assert got["adjusted_r2"] == pytest.approx(0.8458244111349038)


def test_known_class_metrics(spark):
    rows = spark.createDataFrame(list(zip([0, 1, 2, 2, 0], [0, 0, 2, 2, 0], strict=True)), "y int, p int")
    assert classification.accuracy(rows, "y", "p").first()["accuracy"] == pytest.approx(0.8)
    zero = classification.class_scores(rows, "y", "p").filter("label = 0").first()
    assert zero["precision"] == pytest.approx(2 / 3) and zero["recall"] == 1.0
    rows = spark.createDataFrame(list(zip([2, 0, 2, 2, 0, 1], [0, 0, 2, 2, 0, 2], strict=True)), "y int, p int")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in classification.confusion_matrix(rows, "y", "p").collect()}
    assert [[got[i, j] for j in range(3)] for i in range(3)] == [[2, 0, 0], [0, 0, 1], [1, 0, 2]]


def test_silhouette_distances_of_copies_offsets_and_infinities():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)) + 1e7
    x[1], x[3], x[4, 2] = x[0], x[2] + 1e-6, np.inf
    with np.errstate(all="ignore"):
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = silhouette.distances(x, x)
    assert np.array_equal(np.isnan(got), np.isnan(want)) and got[0, 1] == 0
    np.testing.assert_allclose(got, want, rtol=1e-11, atol=0)
    np.testing.assert_allclose(silhouette.distances(x[5:], x[5:]), want[5:, 5:], rtol=1e-11, atol=0)


def test_silhouette(spark):
    points = [(1, 2), (1, 4), (1, 0), (10, 2), (10, 4), (10, 0)]
    rows = spark.createDataFrame([(i, [float(a), float(b)], i // 3) for i, (a, b) in enumerate(points)], "id int, v array<double>, k int")
    for block in (2, 100):
        assert silhouette.silhouette_score(rows, "id", "v", "k", block).first()[0] == pytest.approx(0.7133477791749615)


def test_scale_matches_numpy(spark):
    values = [0.05, 0.3, 0.5, 0.8, 0.999]
    got = [r[0] for r in _frame(spark, values).orderBy("id").select(G.gnostic_scale(F.col("x"))).collect()]
    assert got == pytest.approx([kernels.scale_of(v) for v in values], abs=1e-12)


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2], [5, 5, 5, 1], list(range(101)), [None, 2, float("nan"), 4]])
def test_exact_median(spark, values):
    got = exact_median(_frame(spark, values), [], "x", "m").first()
    clean = [v for v in values if v is not None and not math.isnan(v)]
    assert got["m"] == pytest.approx(float(np.median(clean)))


def test_expressions_match_kernels(spark):
    ratios = np.array([0.0, 1e-12, 0.2, 1.0, 3.0, 1e9, -2.0])
    pair = G.q_pair(F.col("x"), 0.7)
    got = _frame(spark, ratios).orderBy("id").select(*pair).collect()
    q, q1 = kernels.pair(ratios, 0.7)
    assert [r[0] for r in got] == pytest.approx(q.tolist()) and [r[1] for r in got] == pytest.approx(q1.tolist())


@pytest.mark.parametrize("kind", ["egdf", "eldf", "qgdf", "qldf"])
def test_fit_properties(kind):
    fit = kernels.fit(kind, np.array(OUTLIER), points=200)
    cdf = np.array(fit["cdf"])
    assert ((cdf >= 0) & (cdf <= 1)).all()
    if kind != "qldf":
        assert (np.diff(cdf) >= 0).all()
    assert 1 < fit["z0"] < 10  # the outlier does not draw it
    assert 0.1 <= fit["s_opt"] <= 10


def test_search_beats_a_grid():
    x = np.random.default_rng(1).normal(5, 2, 40)
    fit = kernels.fit("egdf", x)
    z = kernels.to_z(np.sort(x), x.min(), x.max(), "a")
    target = (np.arange(40) + 0.5) / 40
    for s in (0.3, 0.6, 1.0, 2.0, 4.0):
        for lb in (1e-3, 0.1353, 0.3):
            for ub in (3.0, 7.389, 50.0):
                f, h = kernels.f_and_h("egdf", s, lb, ub, z, z)
                assert fit["loss"] <= np.abs(kernels.distribution("egdf", f, h, np.ones(40)) - target).max() + 1e-6


@pytest.mark.parametrize("kind", ["egdf", "qgdf"])
def test_rounds_reach_a_low_loss(spark, kind):
    rng = np.random.default_rng(4)
    samples = {"normal": rng.normal(5, 2, 40), "skewed": rng.exponential(3, 30), "two": np.concatenate([rng.normal(0, 1, 12), rng.normal(20, 1, 9)]), "outlier": np.array(OUTLIER, float)}
    frame = spark.createDataFrame([(k, float(x)) for k, xs in samples.items() for x in xs] + [("one", 4.0)], "k string, x double")
    got = {r["k"]: r for r in fits.fit(fits.sample(frame, "x", ["k"]), kind).collect()}
    assert got["one"]["loss"] is None and got["one"]["s_opt"] == 1.0
    for k, xs in samples.items():
        z = kernels.to_z(np.sort(xs), xs.min(), xs.max(), "a")
        f, h = kernels.f_and_h(kind, got[k]["s_opt"], got[k]["lb"], got[k]["ub"], z, z)
        own = np.abs(kernels.distribution(kind, f, h, np.ones(len(xs))) - (np.arange(len(xs)) + 0.5) / len(xs)).max()
        assert got[k]["loss"] == pytest.approx(own, abs=1e-9)  # the loss is that of the definition
        assert own <= kernels.fit(kind, xs)["loss"] + 0.02


def test_places_of_a_large_group(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    found = fits.sample(rows, "x", count=5).groups.first()
    assert [(p["x"], p["target"]) for p in found["_places"]] == [(0.0, 0.0005), (249.0, 0.2495), (499.0, 0.4995), (749.0, 0.7495), (999.0, 0.9995)]


def test_variance_of_five(spark):
    got = distributions.variance(_frame(spark, [1, 2, 3, 4, 5]), "x").first()["variance"]
    assert 0.5 < got < 0.75


def test_statistics_edge_cases(spark):
    assert distributions.mean(_frame(spark, [4, 4, 4]), "x").first()["mean"] == 4.0
    assert distributions.entropy(_frame(spark, [4]), "x").first()["entropy"] == 0.0
    assert distributions.mean(_frame(spark, [None, float("nan")]), "x").count() == 0
    keyed = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, x double")
    assert distributions.mean(keyed, "x", ["k"]).count() == 2


def test_large_groups_are_binned(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 997).cast("double").alias("x"))
    sample = distributions.samples(rows, "x", [], ["id"], max_points=50).first()
    assert len(sample["data"]) == 50 and sum(sample["counts"]) == 5000


def test_homogeneity(spark):
    two = [*np.linspace(0, 1, 10), *np.linspace(50, 51, 10)]
    fit = kernels.fit("egdf", np.array(two), s=0.3, points=200)
    assert not fit["homogeneous"] and len(fit["peaks"]) == 2


def test_regression_resists_outliers(spark, tmp_path):
    rows = datasets.line(spark, 60, outliers=0.05)
    model = regression.LinearRegressor(["x"], "y", max_iter=10).fit(rows)
    assert model.coefficients[1] == pytest.approx(3.5, abs=0.6)
    model.save(spark, str(tmp_path / "model"))
    assert Model.load(spark, str(tmp_path / "model")).coefficients == model.coefficients
    assert model.history_frame(spark).count() == len(model.history)


def test_kmeans_finds_blobs(spark):
    rows = datasets.blobs(spark, 60, classes=3, apart=8.0)
    assert score(KMeansClustering(["x0", "x1"], 3, seed=2).fit(rows), rows) > -300


def test_forecast_of_a_line(spark):
    rows = spark.range(40).select("id", (2.0 * F.col("id") + 1).alias("v"))
    got = forecasting.forecast(forecasting.ARIMA("v", "id", (1, 1, 0), max_iter=2).fit(rows), 3)
    assert got == pytest.approx([81.0, 83.0, 85.0], abs=0.5)


def test_split_sizes(spark):
    rows = spark.range(103)
    assert selection.train_test_split(rows, "id", 0.25).filter("is_test").count() == 26
    sizes = [r["count"] for r in selection.k_folds(rows, "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    with pytest.raises(ValueError):
        selection.k_folds(spark.range(3), "id", 5)
