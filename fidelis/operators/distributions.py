"""Fitted distribution functions of groups, and the statistics that follow from them.

Statistics come from operators/fits.py, as aggregates over all rows. The analyses, which fit
a group many times over, take arrays by samples() and fitted(): there a group of over
`max_points` rows is first summed up, in shuffled aggregates, to that many bins of equal
counts (means, weighted by counts), and the fit is an approximation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import az, fidelity_i, fidelity_j, fininf, inffin, irrelevance_i, irrelevance_j, mz, q_pair, za, zm
from fidelis.operators import fits as fit_search
from fidelis.operators import kernels
from fidelis.operators.totals import join_groups, running, valid, with_totals

MAX_POINTS = 128
EPS, PLACES = kernels.EPS, fit_search.PLACES


def samples(df: DataFrame, column: str, keys: list[str], ties: list[str] = (), max_points: int = MAX_POINTS, least: int = 1) -> DataFrame:
    """(keys, data, counts): each group's values, or bins of them, as arrays of bounded size.

    Nulls, NaN and infinite values are left out, and so are groups of fewer than `least` rows.
    """
    keys = list(keys)
    rows = valid(df.select(*keys, *ties, F.col(column).cast("double").alias("_x")), "_x")
    ranked = with_totals(running(rows, keys, "_x", F.lit(1), "_k", list(ties)), keys, F.count("*").alias("_n"))
    share = F.floor((F.col("_k") - 1) * F.lit(max_points) / F.col("_n"))
    bins = ranked.filter(F.col("_n") >= least).withColumn("_bin", F.when(F.col("_n") <= max_points, F.col("_k")).otherwise(share))
    means = bins.groupBy(*keys, "_bin").agg(F.avg("_x").alias("_x"), F.count("*").cast("double").alias("_c"))
    points = F.sort_array(F.collect_list(F.struct("_x", "_c")))
    return means.groupBy(*keys).agg(points.alias("_p")).select(*keys, F.col("_p._x").alias("data"), F.col("_p._c").alias("counts")).filter(F.size("data") > 0)


def fitted(
    rows: DataFrame, kind: str, form: str = "a", points: int = 100, robust: bool = False, empirical: bool = False,
    s: Column | float | None = None, lb: Column | None = None, ub: Column | None = None, name: str = "fit", threshold: float = 0.0,
) -> DataFrame:
    """Adds `name`, the fit (see kernels.FIT) of the arrays data and counts of each row.

    s, lb and ub fix the scale and the bounds (in data units) of all rows or, as columns, of each.
    """

    @F.pandas_udf(kernels.FIT)
    def run(data: pd.Series, counts: pd.Series, s: pd.Series, lb: pd.Series, ub: pd.Series) -> pd.DataFrame:
        none = lambda v: None if v is None or v != v else float(v)
        out = [
            kernels.fit(kind, np.asarray(x, float), np.asarray(w, float), form, none(a), none(b), none(c), points, robust, empirical, threshold)
            for x, w, a, b, c in zip(data, counts, s, lb, ub, strict=True)
        ]
        return pd.DataFrame(out, columns=[p.split()[0] for p in kernels.FIT.split(", ")])

    null = F.lit(None).cast("double")
    s = null if s is None else (s if isinstance(s, Column) else F.lit(float(s)))
    args = ["data", "counts", s.cast("double"), null if lb is None else lb.cast("double"), null if ub is None else ub.cast("double")]
    # a fit is costly: marked so, it is made once and not copied into later expressions
    return rows.withColumn(name, run.asNondeterministic()(*args))


def z0_of(fit: str = "fit") -> Column:
    """The place of the density's maximum; of a constant sample its value."""
    return F.col(f"{fit}.z0")


def _mean_over(fit: str, value) -> Column:
    """The mean over the data of value(z)."""
    z = F.col(f"{fit}.z")
    return F.aggregate(F.transform(z, value), F.lit(0.0), lambda a, x: a + x) / F.size(z)


def _ratio(fit: str, at: Column, form: str):
    """Data over a place: data in the infinite domain, the place in the normalised one."""
    place = {"a": az, "m": mz}[form](at, F.col(f"{fit}.dlb"), F.col(f"{fit}.dub"))
    return lambda z: F.try_divide(fininf(z, F.col(f"{fit}.lb"), F.col(f"{fit}.ub")), place + F.lit(EPS))


def mean_square_irrelevance(fit: str, at: Column, case: str, form: str) -> Column:
    h = irrelevance_i if case == "i" else irrelevance_j
    ratio = _ratio(fit, at, form)

    def value(z: Column) -> Column:
        x = h(*q_pair(ratio(z), F.col(f"{fit}.s_local")))
        return x * x

    return _mean_over(fit, value)


def entropies(fit: str, at: Column, form: str) -> tuple[Column, Column]:
    """(residual entropy, relative residual entropy) about a place."""
    ratio = _ratio(fit, at, form)

    def both(z: Column) -> tuple[Column, Column]:
        pair = q_pair(ratio(z), F.col(f"{fit}.s_opt"))
        return fidelity_i(*pair), fidelity_j(*pair)

    residual = 2 * (_mean_over(fit, lambda z: both(z)[1]) - 1)
    return residual, _mean_over(fit, lambda z: (both(z)[1] - both(z)[0]) / (both(z)[1] + both(z)[0]))


def original_bounds(fit: str, form: str) -> tuple[Column, Column]:
    """The probable bounds in data units."""
    back = {"a": za, "m": zm}[form]
    return tuple(back(F.col(f"{fit}.{b}"), F.col(f"{fit}.dlb"), F.col(f"{fit}.dub")) for b in ("lb", "ub"))


def estimate(
    df: DataFrame, column: str, kind: str, keys: list[str] = (), form: str = "a", points: int = 500, s: float | None = None,
    weight: str | None = None, count: int | None = PLACES, homogeneous: bool = True, empirical: bool = False,
) -> DataFrame:
    """(keys, n, dlb, dub, lb, ub, s_opt, s_local, loss, z0, residual_entropy, relative_entropy) of each group.

    lb and ub are in data units. For the curve see estimated_curve(). `weight` names a column
    of weights; they count in means over rows, and multiply a row's distance in the loss.
    Groups that are not `homogeneous` get further weights from their data; `empirical`
    compares with the weighted empirical function by fidelity (see fits.fit()).
    """
    sample, fits, keys = _with_z0(df, column, kind, keys, form, points, s, weight, count, homogeneous, empirical)
    out = join_groups(fits, fit_search.about_z0(sample, fits, form), keys)
    back = {"a": za, "m": zm}[form]
    ends = [back(F.col(b), F.col("dlb"), F.col("dub")).alias(b) for b in ("lb", "ub")]
    return out.select(*keys, "n", "dlb", "dub", *ends, "s_opt", "s_local", "loss", "z0", "residual_entropy", "relative_entropy")


def estimated_curve(
    df: DataFrame, column: str, kind: str, keys: list[str] = (), form: str = "a", points: int = 500, s: float | None = None,
    weight: str | None = None, count: int | None = PLACES, homogeneous: bool = True, empirical: bool = False,
) -> DataFrame:
    """(keys, point, di, zi, cdf, pdf) of each group's fitted function."""
    sample, fits, keys = _with_z0(df, column, kind, keys, form, points, s, weight, count, homogeneous, empirical)
    return fit_search.curves(sample, fits, kind, form, points, "s_local").drop("s")


def _with_z0(
    df: DataFrame, column: str, kind: str, keys: list[str], form: str, points: int, s: float | None, weight: str | None, count: int | None,
    homogeneous: bool = True, empirical: bool = False,
):
    sample = fit_search.sample(df, column, keys, weight, count, not homogeneous, form)
    return sample, fit_search.with_z0(sample, fit_search.fit(sample, kind, form, s, empirical), kind, form, points, s), sample.keys


def _place(fits: DataFrame, keys: list[str], name: str) -> DataFrame:
    return fits.select(*keys, F.when(F.col("dlb") == F.col("dub"), F.col("dlb")).otherwise(F.col("z0")).alias(name))


def mean(
    df: DataFrame, column: str, keys: list[str] = (), case: str = "i", form: str = "a", s: float | None = None,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, mean): the local density's maximum; of a constant group its value."""
    _, fits, keys = _with_z0(df, column, {"i": "eldf", "j": "qldf"}[case], keys, form, 100, s, weight, count)
    return _place(fits, keys, "mean")


def median(
    df: DataFrame, column: str, keys: list[str] = (), case: str = "i", form: str = "a", s: float | None = None,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, median): the global density's maximum; of a constant group its value."""
    _, fits, keys = _with_z0(df, column, {"i": "egdf", "j": "qgdf"}[case], keys, form, 500, s, weight, count)
    return _place(fits, keys, "median")


def variance(
    df: DataFrame, column: str, keys: list[str] = (), case: str = "i", form: str = "a", s: float | None = None,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, variance): the mean squared irrelevance about the mean at the local scale."""
    sample, fits, keys = _with_z0(df, column, {"i": "eldf", "j": "qldf"}[case], keys, form, 100, s, weight, count)
    return fit_search.about_z0(sample, fits, form).select(*keys, F.col(f"variance_{case}").alias("variance"))


def varying_scale(
    df: DataFrame, column: str, kind: str = "eldf", keys: list[str] = (), form: str = "a", points: int = 1000,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, n, s0, gamma, score, s_low, s_high, heteroscedastic, z0): a local function whose scale varies with the datum.

    The scale of a datum is s0 exp(gamma z), z being it in the infinite domain, in tenths (see
    fits.varying()). s_low and s_high are those of the least and the greatest datum; as the
    scale rises or falls throughout, the group is homoscedastic if they are equal. z0 is the
    place of the greatest density at these scales. kind is eldf or qldf.
    """
    sample, fits = _varied(df, column, kind, keys, form, weight, count)
    curve = fit_search.curves(sample, fits, kind, form, points, "s0", "gamma")
    return fit_search.with_tops(_with_ends(fits, form), curve, sample.keys, points).select(
        *sample.keys, "n", "s0", "gamma", "score", "s_low", "s_high", (F.col("s_low") != F.col("s_high")).alias("heteroscedastic"), "z0"
    )


def varying_curve(
    df: DataFrame, column: str, kind: str = "eldf", keys: list[str] = (), form: str = "a", points: int = 1000,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, point, di, zi, s, cdf, pdf) of the function of varying_scale(), s being the scale at a place."""
    sample, fits = _varied(df, column, kind, keys, form, weight, count)
    return fit_search.curves(sample, fits, kind, form, points, "s0", "gamma")


def _varied(df: DataFrame, column: str, kind: str, keys: list[str], form: str, weight: str | None, count: int | None):
    if kind not in ("eldf", "qldf"):
        raise ValueError("only local functions have a varying scale")
    sample = fit_search.sample(df, column, keys, weight, count)
    return sample, fit_search.varying(sample, fit_search.fit(sample, kind, form), kind, form)


def _with_ends(fits: DataFrame, form: str) -> DataFrame:
    z = {"a": az, "m": mz}[form]
    at = lambda x: fininf(z(F.col(x), F.col("dlb"), F.col("dub")), F.col("lb"), F.col("ub"))
    scale = lambda x: fit_search.tenths(F.col("s0") * F.exp(F.col("gamma") * at(x)))
    return fits.withColumns({"s_low": scale("dlb"), "s_high": scale("dub")})


def with_std(rows: DataFrame, case: str = "i", form: str = "a", s: Column | float | None = None) -> DataFrame:
    """Adds lsd and usd, the ends of the standard interval about the mean, to rows of samples."""
    rows = fitted(rows, "eldf", form, 100, s=s, name="_local")
    rows = rows.withColumn("_m", z0_of("_local"))
    if case == "j":
        rows = fitted(rows, "qldf", form, 100, s=s, name="_spread")
    else:
        rows = rows.withColumn("_spread", F.col("_local"))
    rows = rows.withColumn("_v", F.abs(mean_square_irrelevance("_spread", z0_of("_spread"), case, form)))
    rows = fitted(rows, "egdf", form, 100, s=s, name="_global")
    low, high = F.col("_global.dlb"), F.col("_global.dub")
    forth, back = {"a": (az, za), "m": (mz, zm)}[form]
    lb, ub = original_bounds("_global", form)
    rows = rows.withColumns({"_lb": lb, "_ub": ub, "_r": F.sqrt("_v")})
    lb, ub, r, half = F.col("_lb"), F.col("_ub"), F.col("_r"), F.col("_global.s_opt") / 2
    place = fininf(forth(F.col("_m"), low, high), lb, ub)
    if case == "i":
        up, down = (1 + r) / (1 - r + F.lit(1e-6)), (1 - r) / (1 + r + F.lit(1e-6))
    else:
        up, down = r + (1 + r), r + (1 - r)
    ends = [back(inffin(place * F.pow(x, half), lb, ub), low, high) for x in (down, up)]
    rows = rows.withColumn("_d", ends[1] - ends[0])
    none = (F.col("_r") >= 1) if case == "i" else F.lit(False)
    return rows.withColumns(
        {"lsd": F.when(none, 0.0).otherwise(F.col("_m") - F.col("_d") / 2), "usd": F.when(none, 0.0).otherwise(F.col("_m") + F.col("_d") / 2)}
    ).drop("_local", "_spread", "_global", "_m", "_v", "_r", "_lb", "_ub", "_d")


def std(
    df: DataFrame, column: str, keys: list[str] = (), case: str = "i", form: str = "a", s: float | None = None,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, lsd, usd): the ends of the standard interval about the mean; both are 0 where the variance reaches 1."""
    keys = list(keys)
    sample = fit_search.sample(df, column, keys, weight, count)
    local = fit_search.with_z0(sample, fit_search.fit(sample, "egdf", form, s), "eldf", form, 100, s)
    spread = local if case == "i" else fit_search.with_z0(sample, fit_search.fit(sample, "qldf", form, s), "qldf", form, 100, s)
    squares = fit_search.about_z0(sample, spread, form).select(*keys, F.abs(f"variance_{case}").alias("_v"))
    out = join_groups(local, squares, keys)
    forth, back = {"a": (az, za), "m": (mz, zm)}[form]
    low, high = F.col("dlb"), F.col("dub")
    out = out.withColumns({"_lb": back(F.col("lb"), low, high), "_ub": back(F.col("ub"), low, high), "_r": F.sqrt("_v")})
    lb, ub, r, half = F.col("_lb"), F.col("_ub"), F.col("_r"), F.col("s_opt") / 2
    place = fininf(forth(F.col("z0"), low, high), lb, ub)
    if case == "i":
        up, down = (1 + r) / (1 - r + F.lit(1e-6)), (1 - r) / (1 + r + F.lit(1e-6))
    else:
        up, down = r + (1 + r), r + (1 - r)
    ends = [back(inffin(place * F.pow(x, half), lb, ub), low, high) for x in (down, up)]
    none = (r >= 1) if case == "i" else F.lit(False)
    reach = (ends[1] - ends[0]) / 2
    return out.select(*keys, *[F.when(none, 0.0).otherwise(F.col("z0") + sign * reach).alias(n) for n, sign in (("lsd", -1), ("usd", 1))])


def entropy(
    df: DataFrame, column: str, keys: list[str] = (), case: str = "i", form: str = "a", compare: str | None = None, s: float | None = None,
    weight: str | None = None, count: int | None = PLACES,
) -> DataFrame:
    """(keys, entropy): 1 - mean fidelity over data and places, or in case j mean fidelity - 1; of `compare` - column if given.

    A constant sample has entropy 0.
    """
    keys = list(keys)
    x = F.col(column).cast("double") if compare is None else F.col(compare).cast("double") - F.col(column).cast("double")
    sample = fit_search.sample(df.withColumn("_value", x), "_value", keys, weight, count)
    fits = fit_search.fit(sample, {"i": "egdf", "j": "qgdf"}[case], form, s)
    return fits.select(*keys, ((1 - F.col("mean_f")) if case == "i" else (F.col("mean_f") - 1)).alias("entropy"))


def error_means(df: DataFrame, y: str, predicted: str, keys: list[str] = (), count: int | None = PLACES) -> DataFrame:
    """(keys, mae, mse, rmse): robust means of absolute and squared errors."""
    e = F.col(y).cast("double") - F.col(predicted).cast("double")
    each = F.array(*[F.struct(F.lit(n).alias("_which"), v.alias("_v")) for n, v in (("mae", F.abs(e)), ("mse", e * e))])
    stacked = df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")
    found = mean(stacked, "_v", [*keys, "_which"], count=count)
    own = lambda n: F.max(F.when(F.col("_which") == n, F.col("mean"))).alias(n)
    return found.groupBy(*keys).agg(own("mae"), own("mse")).withColumn("rmse", F.sqrt("mse"))
