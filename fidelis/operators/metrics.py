"""Error criteria of predictions, one row for each group."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import fidelity_i, gnostic_scale, irrelevance_i, irrelevance_j, q_pair
from fidelis.operators.totals import exact_median, join_totals, valid, with_totals

#: Ratio floor and greatest logarithm of the mean multiplicative error.
RATIO_EPS, LOG_LIMIT = 1e-10, 100.0


def _pairs(df: DataFrame, y: str, fit: str, keys: list[str], weight: str | None) -> DataFrame:
    columns = [F.col(y).cast("double").alias("_y"), F.col(fit).cast("double").alias("_p")]
    columns.append((F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    return valid(df.select(*keys, *columns), "_y", "_p", "_w")


def _r2(residual: Column, total: Column, zero: Column | float) -> Column:
    zero = zero if isinstance(zero, Column) else F.lit(zero)
    return F.when(total == 0, zero).otherwise(1 - F.try_divide(residual, total))


def r2_score(df: DataFrame, y: str, fit: str, keys: list[str] = (), features: int | None = None) -> DataFrame:
    """(keys, r2[, adjusted_r2]): share of variance explained; 0 where y is constant.

    adjusted_r2 is null in groups of no more than features + 1 rows.
    """
    keys = list(keys)
    rows = with_totals(_pairs(df, y, fit, keys, None), keys, F.avg("_y").alias("_m"))
    errors = rows.groupBy(*keys).agg(
        F.sum((F.col("_y") - F.col("_p")) ** 2).alias("_res"),
        F.sum((F.col("_y") - F.col("_m")) ** 2).alias("_tot"),
        F.count("*").alias("_n"),
    )
    out = errors.select(*keys, _r2(F.col("_res"), F.col("_tot"), 0.0).alias("r2"), "_n")
    if features is None:
        return out.drop("_n")
    free = F.col("_n") - F.lit(features + 1)
    adjusted = 1 - (1 - F.col("r2")) * (F.col("_n") - 1) / F.when(free > 0, free)
    return out.select(*keys, "r2", adjusted.alias("adjusted_r2"))


def evaluation(df: DataFrame, y: str, fit: str, keys: list[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, robr2, gmmfe, divi, evalmet) of each group.

    robr2: weighted share explained, about weighted means; gmmfe: geometric mean
    multiplicative fitting error; divi: mean ratio of the information of y and its fit, each
    about its median; evalmet: robr2 / (gmmfe * divi).
    """
    keys = list(keys)
    pairs = _pairs(df, y, fit, keys, weight).withColumn("_e", F.col("_y") - F.col("_p"))
    weighted = lambda x: F.try_divide(F.sum(F.col("_w") * x), F.sum("_w"))
    rows = with_totals(pairs, keys, weighted(F.col("_e")).alias("_em"), weighted(F.col("_y")).alias("_ym"))
    rows = join_totals(rows, exact_median(pairs, keys, "_y", "_y0"), keys)
    rows = join_totals(rows, exact_median(pairs, keys, "_p", "_p0"), keys)
    ratio = F.coalesce(F.try_divide(F.col("_y"), F.col("_p")), F.lit(RATIO_EPS))
    log_ratio = F.least(F.abs(F.log(F.greatest(ratio, F.lit(RATIO_EPS)))), F.lit(LOG_LIMIT))
    out = rows.groupBy(*keys).agg(
        _r2(
            F.sum(F.col("_w") * (F.col("_e") - F.col("_em")) ** 2),
            F.sum(F.col("_w") * (F.col("_y") - F.col("_ym")) ** 2),
            0.0,
        ).alias("robr2"),
        F.exp(F.avg(log_ratio)).alias("gmmfe"),
        F.avg(
            F.try_divide(
                _information(F.try_divide(F.col("_y"), F.col("_y0"))),
                _information(F.try_divide(F.col("_p"), F.col("_p0"))),
            )
        ).alias("divi"),
    )
    return out.withColumn("evalmet", F.try_divide(F.col("robr2"), F.col("gmmfe") * F.col("divi")))


def _information(ratio: Column) -> Column:
    from fidelis.functions import information, probability

    return information(probability(irrelevance_i(*q_pair(ratio, 1.0))))


def legacy_evaluation(df: DataFrame, y: str, fit: str, keys: list[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, robr2, gmmfe, divi, evalmet) by the older definitions.

    robr2 compares weighted squared errors with weighted squares about the plain mean; divi
    is the mean ratio of absolute values; ratios of zero and less count as 1e-10.
    """
    keys = list(keys)
    rows = with_totals(_pairs(df, y, fit, keys, weight), keys, F.avg("_y").alias("_m"))
    ratio = F.coalesce(F.try_divide(F.col("_y"), F.col("_p")), F.lit(0.0))
    positive = F.when(ratio <= 0, RATIO_EPS).otherwise(ratio)
    out = rows.groupBy(*keys).agg(
        _r2(
            F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) ** 2),
            F.sum(F.col("_w") * (F.col("_y") - F.col("_m")) ** 2),
            0.0,
        ).alias("robr2"),
        F.exp(F.avg(F.abs(F.log(positive)))).alias("gmmfe"),
        F.avg((F.abs("_y") + F.lit(RATIO_EPS)) / (F.abs("_p") + F.lit(RATIO_EPS))).alias("divi"),
    )
    return out.withColumn("evalmet", F.try_divide(F.col("robr2"), F.col("gmmfe") * F.col("divi")))


def h_criterion(df: DataFrame, y: str, fit: str, keys: list[str] = (), case: str = "i", scale: float | str = "auto") -> DataFrame:
    """(keys, hc): mean squared irrelevance of y / fit.

    With scale 'auto' it is taken at the scale of the mean fidelity; a number is not used,
    as in the definition that this follows: S is 1 then, and a warning says so.
    """
    keys = list(keys)
    ratio = F.try_divide(F.col("_y"), F.col("_p"))
    rows = _pairs(df, y, fit, keys, None).withColumn("_r", ratio).filter("_r is not null")
    if scale == "auto":
        pair = q_pair(F.col("_r"), 1.0)
        fidelity = fidelity_i(*pair) if case == "i" else (pair[0] + pair[1]) / 2
        means = rows.groupBy(*keys).agg(F.avg(fidelity).alias("_f"))
        rows = join_totals(rows, means.select(*keys, gnostic_scale(F.col("_f")).alias("_s")), keys)
        pair = q_pair(F.col("_r"), F.col("_s"))
    else:
        warnings.warn("a scale other than 'auto' means S = 1", stacklevel=2)
        pair = q_pair(F.col("_r"), 1.0)
    h = irrelevance_i(*pair) if case == "i" else irrelevance_j(*pair)
    return rows.groupBy(*keys).agg(F.avg(h * h).alias("hc"))


def classic_errors(df: DataFrame, y: str, fit: str, keys: list[str] = ()) -> DataFrame:
    """(keys, mae, mse, rmse) with arithmetic means; see statistics.error_means for the robust ones."""
    keys = list(keys)
    error = F.col("_y") - F.col("_p")
    return (
        _pairs(df, y, fit, keys, None)
        .groupBy(*keys)
        .agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))
        .withColumn("rmse", F.sqrt("mse"))
    )
