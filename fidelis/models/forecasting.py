"""Autoregressive models of one series, fitted by robust regression on lags.

A row's lags come from a shuffle by position, not from a window over the whole series: each
value is sent to the positions that need it, so a long series is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.models import robust
from fidelis.models.regression import fit_rows
from fidelis.models.robust import Model, Settings
from fidelis.operators.totals import running, valid


def indexed(df: DataFrame, column: str, order: str, ties: list[str] = ()) -> DataFrame:
    """(t, v): the series' values by position from 0."""
    rows = valid(df.select(F.col(order).cast("double").alias("_o"), *ties, F.col(column).cast("double").alias("v")), "_o", "v")
    return running(rows, [], "_o", F.lit(1), "_k", list(ties)).select((F.col("_k") - 1).cast("long").alias("t"), "v")


def lagged(series: DataFrame, lags: dict[str, int], column: str = "v") -> DataFrame:
    """(t, column, one column for each lag) for the positions that have all of them."""
    shifts = F.array(*[F.lit(k) for k in [0, *lags.values()]])
    sent = series.select("t", column, F.posexplode(shifts).alias("_i", "_shift")).select((F.col("t") + F.col("_shift")).alias("t"), "_i", column)
    names = [column, *lags]
    picked = sent.groupBy("t").agg(*[F.max(F.when(F.col("_i") == i, F.col(column))).alias(n) for i, n in enumerate(names)])
    return picked.dropna(subset=names)


def differenced(series: DataFrame, times: int, season: int = 1) -> DataFrame:
    """(t, v): differences `season` apart, `times` over; positions are those of the later value."""
    for _ in range(times):
        series = lagged(series, {"_before": season}).select("t", (F.col("v") - F.col("_before")).alias("v"))
    return series


def long_ar_residuals(series: DataFrame, order: int) -> tuple[DataFrame, np.ndarray]:
    """(t, v, e): residuals of a plain autoregression of `order` lags; 0 where it has no lags."""
    lags = {f"l{k}": k for k in range(1, order + 1)}
    rows = lagged(series, lags)
    design = rows.select(F.lit(1.0).alias("t0"), *[F.col(n).alias(f"t{i + 1}") for i, n in enumerate(lags)], F.col("v").alias("y"), F.col("t").alias("_at"))
    beta = robust.normal_equations(design, order + 1, F.lit(1.0), [F.col("y")], 1e-10)[:, 0]
    residual = design.select(F.col("_at").alias("t"), (F.col("y") - robust.linear(beta)).alias("_e"))
    joined = series.join(residual, "t", "left")
    return joined.select("t", "v", F.coalesce("_e", F.lit(0.0)).alias("e")), beta


class SARIMA:
    """(p, d, q) and seasonal (P, D, Q, s) with trend 'c' (constant) or 'ct' (and time).

    Moving-average terms use residuals of a long plain autoregression. The constant is
    always fitted. With q = Q = d = D = P = 0 this is an autoregression.
    """

    def __init__(self, column: str, order_by: str, order: tuple[int, int, int] = (1, 0, 0), seasonal: tuple[int, int, int, int] = (0, 0, 0, 1), trend: str = "c", ties: list[str] = (), **settings):
        if min(order) < 0 or min(seasonal) < 0 or seasonal[3] < 1 or trend not in ("c", "ct", "n"):
            raise ValueError("orders must not be negative, the season at least 1, and trend c, ct or n")
        self.column, self.order_by, self.order, self.seasonal, self.trend, self.ties = column, order_by, order, seasonal, trend, list(ties)
        self.settings = Settings(**({"tolerance": 1e-3} | settings))

    def _features(self) -> tuple[dict[str, int], dict[str, int]]:
        (p, _, q), (sp, _, sq, s) = self.order, self.seasonal
        ar = {f"ar{k}": k for k in range(1, p + 1)} | {f"sar{k}": k * s for k in range(1, sp + 1)}
        ma = {f"ma{k}": k for k in range(1, q + 1)} | {f"sma{k}": k * s for k in range(1, sq + 1)}
        return ar, ma

    def fit(self, df: DataFrame) -> Model:
        (p, d, q), (sp, sd, sq, s) = self.order, self.seasonal
        raw = indexed(df, self.column, self.order_by, self.ties)
        series = differenced(differenced(raw, sd, s), d).persist()
        ar, ma = self._features()
        n = series.count()
        reach = max([0, *ar.values(), *ma.values()])
        if n <= reach + len(ar) + len(ma) + 1:
            raise ValueError(f"{n} values are too few for lags up to {reach}")
        rows = lagged(series, ar) if ar else series
        if ma:
            long = max(p, q) + 4 if not sp + sq else max(p, q) + s * max(sp, sq) + s
            with_e, _ = long_ar_residuals(series, long if n >= 2 * long else max(1, n // 4))
            rows = rows.join(lagged(with_e.select("t", F.col("e").alias("v")), ma).drop("v"), "t")
        names = [*ar, *ma, *(["t"] if self.trend == "ct" else [])]
        design = rows.select(F.lit(1.0).alias("t0"), *[F.col(c).cast("double").alias(f"t{i + 1}") for i, c in enumerate(names)], F.col("v").alias("y")).persist()
        beta, history = fit_rows(design, len(names) + 1, self.settings)
        tail = max(reach, 1)
        last = [r["v"] for r in series.orderBy(F.desc("t")).limit(tail).collect()][::-1]
        errors = [r["e"] for r in with_e.orderBy(F.desc("t")).limit(tail).collect()][::-1] if ma else []
        total = n + d + s * sd
        levels = [r["v"] for r in raw.orderBy(F.desc("t")).limit(d + s * sd + 1).collect()][::-1]
        design.unpersist()
        series.unpersist()
        return Model(
            "sarima", names, self.column, 1, beta.tolist(), asdict(self.settings), history,
            {"ar": ar, "ma": ma, "last": last, "errors": errors, "levels": levels, "length": total, "order": list(self.order), "seasonal": list(self.seasonal), "trend": self.trend},
        )


def forecast(model: Model, steps: int) -> list[float]:
    """The next values: step by step on the last few differences, errors to come as 0, then summed up again."""
    x, beta = model.extra, model.coefficients
    values, errors, out = list(x["last"]), list(x["errors"]), []
    for k in range(steps):
        row = [values[-lag] if lag <= len(values) else 0.0 for lag in x["ar"].values()]
        row += [errors[-lag] if lag <= len(errors) else 0.0 for lag in x["ma"].values()]
        if x["trend"] == "ct":
            row.append(float(x["length"] + k))
        out.append(beta[0] + float(np.dot(beta[1:], row)))
        values.append(out[-1])
        errors.append(0.0)
    (_, d, _), (_, sd, _, s) = x["order"], x["seasonal"]
    levels = [np.array(x["levels"], float)]
    gaps = [s] * sd + [1] * d
    for g in gaps:
        levels.append(levels[-1][g:] - levels[-1][:-g])
    for g, level in zip(reversed(gaps), reversed(levels[:-1]), strict=True):
        past = level.tolist()
        for v in out:
            past.append(past[-g] + v)
        out = past[-steps:]
    return out


class AutoRegressor(SARIMA):
    def __init__(self, column: str, order_by: str, lags: int = 1, trend: str = "c", ties: list[str] = (), **settings):
        super().__init__(column, order_by, (lags, 0, 0), trend=trend, ties=ties, **settings)


class ARIMA(SARIMA):
    def __init__(self, column: str, order_by: str, order: tuple[int, int, int] = (1, 0, 0), trend: str = "c", ties: list[str] = (), optimize: bool = False, max_order: int = 5, max_d: int = 1, **settings):
        super().__init__(column, order_by, order, trend=trend, ties=ties, **settings)
        self.optimize, self.max_order, self.max_d = optimize, max_order, max_d

    def fit(self, df: DataFrame) -> Model:
        if self.optimize:
            self.order = best_order(indexed(df, self.column, self.order_by, self.ties), self.max_order, self.max_d, self.order)
        return super().fit(df)


def best_order(raw: DataFrame, max_order: int = 5, max_d: int = 1, default: tuple[int, int, int] = (1, 0, 0)) -> tuple[int, int, int]:
    """The (p, d, q) of least one-step RMSE on the last fifth of the series.

    All candidates of one d share one aggregate: the cross products of all their lags over
    the first four fifths and over the rest; each candidate is a small solve on the driver.
    Candidates are fitted by plain least squares. A series of under 20 values keeps `default`.
    """
    if raw.count() < 20:
        return default
    found: list[tuple[float, tuple[int, int, int]]] = []
    for d in range(max_d + 1):
        series = differenced(raw, d)
        n = series.count()
        long = min(max_order + 4, max(1, n // 4))
        with_e, _ = long_ar_residuals(series, long)
        ar, ma = {f"ar{k}": k for k in range(1, max_order + 1)}, {f"ma{k}": k for k in range(1, max_order + 1)}
        rows = lagged(series, ar).join(lagged(with_e.select("t", F.col("e").alias("v")), ma).drop("v"), "t")
        names = [F.lit(1.0), *[F.col(c) for c in (*ar, *ma)], F.col("v")]
        held = F.col("t") >= int(0.8 * (n + d))
        size = len(names)
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        part = lambda flag: [F.sum(F.when(flag, names[i] * names[j])) for i, j in pairs]
        got = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate([*part(~held), *part(held)])]).first()
        train, test = np.zeros((size, size)), np.zeros((size, size))
        for k, (i, j) in enumerate(pairs):
            train[i, j] = train[j, i] = got[k] or 0.0
            test[i, j] = test[j, i] = got[k + len(pairs)] or 0.0
        for p in range(max_order + 1):
            for q in range(max_order + 1):
                if p + q == 0 or not test[0, 0]:
                    continue
                use = [0, *range(1, p + 1), *range(max_order + 1, max_order + 1 + q)]
                beta = np.linalg.lstsq(train[np.ix_(use, use)] + 1e-10 * np.eye(len(use)), train[use, -1], rcond=None)[0]
                square = test[-1, -1] - 2 * beta @ test[use, -1] + beta @ test[np.ix_(use, use)] @ beta
                found.append((max(0.0, square) / test[0, 0], (p, d, q)))
    return min(found)[1] if found else default


def one_step(model: Model, df: DataFrame, order_by: str, ties: list[str] = ()) -> DataFrame:
    """(t, v, fit): one-step fits of a model without moving-average terms, in differenced values."""
    x = model.extra
    if x["ma"]:
        raise ValueError("one-step fits need a model without moving-average terms")
    (_, d, _), (_, sd, _, s) = x["order"], x["seasonal"]
    series = differenced(differenced(indexed(df, model.label, order_by, ties), sd, s), d)
    rows = lagged(series, x["ar"]) if x["ar"] else series
    total: Column = F.lit(float(model.coefficients[0]))
    for b, c in zip(model.coefficients[1:], model.features, strict=True):
        total = total + F.lit(float(b)) * F.col(c).cast("double")
    return rows.select("t", "v", total.alias("fit"))


def score(model: Model, df: DataFrame, order_by: str, ties: list[str] = ()) -> float:
    """Robust R2 of the one-step fits."""
    from fidelis.operators.metrics import evaluation

    return evaluation(one_step(model, df, order_by, ties), "v", "fit").first()["robr2"]
