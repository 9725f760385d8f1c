"""Fits on chunks: places, weights, extended samples, varying scales, running sums of odd data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import analysis, distributions, fits
from fidelis.operators.totals import exact_median, running


def _frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, x double")


def _plain_means(kind, xs, ws, at, s, lb, ub):
    """Means of fidelity and irrelevance in a loop, from the definitions."""
    low, high = min(xs), max(xs)
    z = lambda x: math.exp((2 * x - high - low) / (high - low + 1e-6))
    inner = lambda v: (v - lb) / (1 - v / ub + 1e-6)
    f = h = 0.0
    for x, w in zip(xs, ws, strict=True):
        y = max(-fits.Y_MAX, min(fits.Y_MAX, 2 / s * math.log(abs(inner(z(x)) / (inner(z(at)) + 2.2e-16)) + 1e-10)))
        f += w * (1 / math.cosh(y) if kind[0] == "e" else math.cosh(y))
        h += w * (math.tanh(y) if kind[0] == "e" else math.sinh(y))
    return f / sum(ws), h / sum(ws)


@pytest.mark.parametrize("kind", ["egdf", "qgdf"])
def test_loss_is_that_of_the_definition_with_weights(spark, kind):
    rng = np.random.default_rng(2)
    xs, ws = np.round(rng.normal(5, 2, 40), 1), rng.integers(1, 5, 40).astype(float)
    for x in set(xs.tolist()):  # rows of equal values share their weights alike
        ws[xs == x] = ws[xs == x].mean()
    frame = spark.createDataFrame(list(zip(xs.tolist(), ws.tolist(), strict=True)), "x double, w double")
    found = fits.fit(fits.sample(frame, "x", weight="w"), kind).first()
    order = np.argsort(xs, kind="stable")
    value, best = 0.0, 0.0
    for rank, i in enumerate(order):
        f, h = _plain_means(kind, xs, ws, xs[i], found["s_opt"], found["lb"], found["ub"])
        value = max(value, min(1.0, max(0.0, (1 - h / math.sqrt(f * f + h * h)) / 2)))
        best = max(best, abs(value - (rank + 0.5) / 40) * ws[i] * 40 / ws.sum())
    assert found["loss"] == pytest.approx(best, abs=1e-9)


def test_unit_weights_change_nothing_and_odd_weights_take_no_part(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(0, 1, 90).tolist()
    frame = spark.createDataFrame([(x, 2.0) for x in xs] + [(77.0, None), (88.0, float("nan")), (99.0, -1.0), (None, 1.0)], "x double, w double")
    plain = fits.fit(fits.sample(spark.createDataFrame([(x,) for x in xs], "x double"), "x")).first()
    assert fits.fit(fits.sample(frame, "x", weight="w")).first().asDict() == pytest.approx(plain.asDict())


@pytest.mark.parametrize("together", [0, 12, 1000])
def test_chunks_and_where_rounds_run_do_not_matter(spark, monkeypatch, together):
    rng = np.random.default_rng(4)
    frame = _frame(spark, {"a": np.round(rng.normal(0, 1, 150), 1), "b": rng.normal(0, 1, 70), "one": [3.0]})
    whole = {r["k"]: r for r in fits.fit(fits.sample(frame, "x", ["k"])).collect()}
    monkeypatch.setattr(fits, "CHUNK", 7)
    monkeypatch.setattr(fits, "HELD", 1)
    monkeypatch.setattr(fits, "TOGETHER", together)  # no group, some groups or all in one task
    parted = {r["k"]: r for r in fits.fit(fits.sample(frame, "x", ["k"])).collect()}
    for k, r in whole.items():
        assert {c: v for c, v in parted[k].asDict().items() if c != "k" and v is not None} == pytest.approx({c: v for c, v in r.asDict().items() if c != "k" and v is not None})


def test_places_of_all_rows_are_no_worse(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(float(x),) for x in np.round(rng.normal(0, 1, 150), 2)], "x double")
    every = fits.sample(frame, "x", count=None)
    assert len(every.groups.first()["_places"]) == 150
    assert [p["target"] for p in every.groups.first()["_places"]] == pytest.approx([(i + 0.5) / 150 for i in range(150)])
    some, whole = fits.fit(fits.sample(frame, "x")).first(), fits.fit(every).first()
    assert abs(some["loss"] - whole["loss"]) < 0.01
    assert len(fits.sample(frame, "x", count=1).groups.first()["_places"]) == 1


def test_extended_samples_equal_samples_of_more_rows(spark):
    rng = np.random.default_rng(1)
    xs = {"a": np.round(rng.normal(5, 2, 30), 1), "b": rng.normal(0, 1, 150)}
    sample = fits.sample(_frame(spark, xs), "x", ["k"])
    data = [("a", 0, -9.0), ("a", 1, 5.0), ("a", 2, float(xs["a"].max())), ("b", 0, 0.1), ("b", 1, 9.0)]
    longer = fits.extend(sample, spark.createDataFrame(data, "k string, t int, _at double"), ["t"])
    got = {(r["k"], r["t"]): r for r in longer.groups.collect()}
    found = {(r["k"], r["t"]): r for r in fits.with_z0(longer, fits.fit(longer, "eldf"), "eldf").collect()}
    for k, t, a in data:
        own = fits.sample(spark.createDataFrame([(float(v),) for v in [*xs[k], a]], "x double"), "x")
        want, have = own.groups.first(), got[k, t]
        assert [(p["p"], p["x"]) for p in have["_places"]] == [(p["p"], p["x"]) for p in want["_places"]]
        assert [p["target"] for p in have["_places"]] == pytest.approx([p["target"] for p in want["_places"]])
        assert [have[c] for c in ("n", "dlb", "dub", "median")] == [want[c] for c in ("n", "dlb", "dub", "median")]
        if t == 1:
            fit = fits.with_z0(own, fits.fit(own, "eldf"), "eldf").first()
            assert [found[k, t][c] for c in ("s_opt", "loss", "z0", "s_local")] == pytest.approx([fit[c] for c in ("s_opt", "loss", "z0", "s_local")])


def test_membership_stops_where_a_datum_parts_the_sample(spark):
    rng = np.random.default_rng(8)
    xs = {"one": np.sort(rng.normal(0, 1, 40)), "two": np.concatenate([rng.normal(0, 0.3, 20), rng.normal(30, 0.3, 20)])}
    got = {r["k"]: r for r in analysis.membership_bounds(_frame(spark, xs), "x", ["k"], points=100, steps=5).collect()}
    assert got["one"]["lsb"] <= xs["one"].min() and got["one"]["usb"] >= xs["one"].max()
    assert (got["two"]["lsb"], got["two"]["usb"]) == (xs["two"].min(), xs["two"].max())


def test_two_clusters_are_not_homogeneous(spark):
    rng = np.random.default_rng(9)
    xs = {"one": rng.normal(0, 1, 60), "two": np.concatenate([rng.normal(0, 0.3, 40), rng.normal(30, 0.3, 20)]), "flat": [2.0] * 5}
    got = {r["k"]: r for r in analysis.homogeneity(_frame(spark, xs), "x", ["k"]).collect()}
    assert {k: r["homogeneous"] for k, r in got.items()} == {"one": True, "two": False, "flat": True}
    assert len(got["two"]["peaks"]) == 2 and got["flat"]["peaks"] == [] and got["flat"]["z0"] == 2.0
    bounds = {r["k"]: r for r in analysis.cluster_analysis(_frame(spark, xs), "x", ["k"], homogeneous=False).collect()}
    assert bounds["two"]["lcb"] < 1 and bounds["two"]["ucb"] < 29  # the greater cluster


@pytest.mark.parametrize("kind", ["eldf", "qldf"])
def test_varying_scale_scores_what_it_says(spark, kind):
    xs = np.random.default_rng(11).exponential(3, 40)
    sample = fits.sample(_frame(spark, {"a": xs, "one": [1.0]}), "x", ["k"])
    got = {r["k"]: r for r in fits.varying(sample, fits.fit(sample, kind), kind).collect()}
    r, at = got["a"], np.sort(xs)
    z = lambda x: math.exp((2 * x - at[-1] - at[0]) / (at[-1] - at[0] + 1e-6))
    score = value = 0.0
    for rank, x in enumerate(at):
        scale = r["s0"] * math.exp(r["gamma"] * (z(x) - r["lb"]) / (1 - z(x) / r["ub"] + 1e-6))
        _, h = _plain_means(kind, xs.tolist(), [1.0] * 40, x, scale, r["lb"], r["ub"])
        v = (1 - (h if kind[0] == "e" else h / math.sqrt(1 + h * h))) / 2
        value = v if kind == "qldf" else max(value, v)
        target = (rank + 0.5) / 40
        score += 2 / ((value / target) ** 2 + (target / value) ** 2) / 40
    assert r["score"] == pytest.approx(score, abs=1e-6)
    assert (got["one"]["s0"], got["one"]["gamma"], got["one"]["score"]) == (1.0, 0.0, None)
    with pytest.raises(ValueError):
        distributions.varying_scale(_frame(spark, {"a": xs}), "x", "egdf", ["k"])


def test_running_sums_with_an_outlier_and_many_ties(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("k"), F.when(F.col("id") == 5, 1e12).when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(7.0).alias("x"), "id"
    )
    got = running(rows, ["k"], "x", F.lit(1), "n", ["id"])
    want = {}
    for k in (0, 1):
        own = sorted(((r["x"], r["id"]) for r in rows.filter(F.col("k") == k).collect()))
        want |= {i: n for n, (_, i) in enumerate(own, 1)}
    assert {r["id"]: r["n"] for r in got.collect()} == want
    # neither gathers in one range
    spread = rows.repartitionByRange(8, "k", "x", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread < 1000


def test_median_of_many_ties(spark):
    rows = spark.createDataFrame([(1, 5.0)] * 90 + [(1, float(i)) for i in range(10)] + [(2, 1.0), (2, 2.0)], "k int, x double")
    assert {r["k"]: r["m"] for r in exact_median(rows, ["k"], "x", "m").collect()} == {1: 5.0, 2: 1.5}
