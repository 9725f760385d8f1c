import numpy as np
import pytest

from fidelis.operators import analysis, fits


def _frame(spark, xs):
    return spark.createDataFrame([(k, float(v)) for k, own in xs.items() for v in own], "k string, x double")


def _farthest(values, s, lb, ub):
    """The greatest distance of a global function from the mid-ranks, over all rows."""
    x = np.sort(values)
    z = np.exp((2 * x - x[-1] - x[0]) / (x[-1] - x[0] + 1e-6))
    inner = (z - lb) / (1 - z / ub + 1e-6)
    y = 2 / s * np.log(np.abs(inner[:, None] / inner[None]) + 1e-10)
    f, h = (1 / np.cosh(y)).mean(0), np.tanh(y).mean(0)
    v = np.maximum.accumulate((1 - h / np.sqrt(f * f + h * h)) / 2)
    return np.abs(v - (np.arange(len(x)) + 0.5) / len(x)).max()


def test_membership_takes_the_loss_at_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xs = {"a": np.round(rng.exponential(1, 300), 2), "b": np.concatenate([rng.normal(0, 1, 150), rng.normal(6, 0.2, 20)])}
    seen, fit = [], fits.fit
    monkeypatch.setattr(fits, "fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    analysis.membership_bounds(_frame(spark, xs), "x", ["k"], points=50, steps=1).collect()
    rows = seen[0].collect()
    assert len(rows) == 8
    for r in rows:
        assert r["loss"] == pytest.approx(_farthest([*xs[r["k"]], r["_at"]], r["s_opt"], r["lb"], r["ub"]), abs=1e-9)


@pytest.mark.parametrize("kind", ["egdf", "qgdf"])
def test_blocks_of_values_give_what_whole_groups_give(spark, monkeypatch, kind):
    xs = {"a": np.round(np.random.default_rng(5).normal(0, 1, 60), 1), "b": [1.0, 2.0, 4.0, 4.0]}
    frame = _frame(spark, xs).selectExpr("*", "1 + abs(x) as w")
    weighted = fits.sample(frame, "x", ["k"], "w", 0)
    plain = fits.sample(frame, "x", ["k"], None, 0)
    data = [("a", 0, -9.0), ("a", 1, float(xs["a"].max())), ("b", 0, 3.0)]
    longer = fits.extend(plain, spark.createDataFrame(data, "k string, t int, _at double"), ["t"])
    for sample in (weighted, longer):
        whole = {tuple(r[k] for k in sample.keys): r for r in fits.fit(sample, kind).collect()}
        with monkeypatch.context() as small:
            small.setattr(fits, "WHOLE", 0)
            small.setattr(fits, "CHUNK", 16)
            blocks = {tuple(r[k] for k in sample.keys): r for r in fits.fit(sample, kind).collect()}
        assert whole.keys() == blocks.keys()
        for k, r in whole.items():
            for c in ("s_opt", "lb", "ub", "loss", "mean_f"):
                assert blocks[k][c] == pytest.approx(r[c], rel=1e-8), (k, c)


def test_interpolated_means_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    x = np.sort(np.concatenate([rng.normal(0, 1, 1500), [40.0]]))
    w = rng.integers(1, 4, len(x)).astype(float)
    for scales, lb, ub in (([0.2, 0.5, 3.0], 0.1353, 7.389), ([0.7, 1.6], 0.3, 3.0), ([0.5], np.exp(-1.000001), np.exp(1.000001))):
        f, h = fits._smooth_means(x, w, x[0], x[-1], scales, lb, ub, "a")
        sums = fits._chunk_sums(x, w, x[0], x[-1], [(s, lb, ub, 0.0) for s in scales], x, "a", True, False, False)
        assert np.abs(f - sums[:, :, 0] / sums[:, :, 4]).max() < 1e-12
        assert np.abs(h - sums[:, :, 1] / sums[:, :, 4]).max() < 1e-12
