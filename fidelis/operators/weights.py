"""Data-driven scale, weights and sample characteristics of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.functions import (
    az,
    fidelity_i,
    fidelity_j,
    gnostic_scale,
    irrelevance_i,
    irrelevance_j,
    mz,
    q_pair,
)
from fidelis.operators.totals import exact_median, join_totals, valid, with_totals


def normalised(df: DataFrame, column: str, keys: list[str] = (), form: str = "a", name: str = "z") -> DataFrame:
    """Adds `name`: the column in the normalised domain, by its group's own bounds."""
    keys = list(keys)
    bounded = with_totals(
        valid(df, column), keys, F.min(column).cast("double").alias("_lb"), F.max(column).cast("double").alias("_ub")
    )
    convert = {"a": az, "m": mz}[form]
    x = F.col(column).cast("double")
    return bounded.withColumn(name, convert(x, F.col("_lb"), F.col("_ub"))).drop("_lb", "_ub")


def with_scale(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Adds z0 (the group's median), ratio (column / z0) and scale (of the mean fidelity at S=1)."""
    keys = list(keys)
    rows = valid(df, column)
    centred = join_totals(rows, exact_median(rows, keys, column, "z0"), keys).withColumn(
        "ratio", F.try_divide(F.col(column).cast("double"), F.col("z0"))
    )
    fidelity = fidelity_i(*q_pair(F.col("ratio"), 1.0))
    means = centred.groupBy(*keys).agg(F.avg(fidelity).alias("_f"))
    return join_totals(centred, means.select(*keys, gnostic_scale(F.col("_f")).alias("scale")), keys)


def gnostic_weights(df: DataFrame, column: str, keys: list[str] = (), name: str = "weight") -> DataFrame:
    """Adds `name`: the squared fidelity of each datum at its group's scale."""
    rows = with_scale(df, column, keys)
    fidelity = fidelity_i(*q_pair(F.col("ratio"), F.col("scale")))
    return rows.withColumn(name, fidelity * fidelity)


def group_scales(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """(keys, z0, scale) of each group."""
    keys = list(keys)
    return with_scale(df, column, keys).groupBy(*keys).agg(F.first("z0").alias("z0"), F.first("scale").alias("scale"))


def _f_h(ratio: Column, scale: Column | float, case: str) -> tuple[Column, Column]:
    pair = q_pair(ratio, scale)
    return (fidelity_i(*pair), irrelevance_i(*pair)) if case == "i" else (fidelity_j(*pair), irrelevance_j(*pair))


def sample_characteristics(df: DataFrame, column: str, keys: list[str] = (), case: str = "i") -> DataFrame:
    """(keys, n, mean_fidelity, mean_irrelevance, modulus, variance) about the group's median.

    modulus is sqrt(|F^2 - c H^2|) with c = -1 in the estimating and 1 in the quantifying
    case; variance is the mean squared irrelevance.
    """
    f, h = _f_h(F.col("ratio"), F.col("scale"), case)
    sign = 1.0 if case == "i" else -1.0
    return (
        with_scale(df, column, keys)
        .select(*keys, f.alias("_f"), h.alias("_h"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg("_f").alias("mean_fidelity"),
            F.avg("_h").alias("mean_irrelevance"),
            F.sqrt(F.abs(F.avg("_f") * F.avg("_f") + sign * F.avg("_h") * F.avg("_h"))).alias("modulus"),
            F.avg(F.col("_h") * F.col("_h")).alias("variance"),
        )
    )


def sample_autocovariance(df: DataFrame, column: str, keys: list[str], order: list[str], lag: int) -> DataFrame:
    """(keys, autocovariance): mean product of irrelevances (S=1, about the median) `lag` rows apart.

    The sum over the pairs is divided by n - lag; groups of no more than `lag` rows give null.
    """
    rows = valid(df, column)
    centred = join_totals(rows, exact_median(rows, keys, column, "z0"), keys)
    _, h = _f_h(F.try_divide(F.col(column).cast("double"), F.col("z0")), 1.0, "i")
    later = F.lead("_h", lag).over(Window.partitionBy(*keys).orderBy(*order))
    return (
        centred.withColumn("_h", h)
        .withColumn("_p", F.col("_h") * later)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum("_p"), F.count("*") - F.lit(lag)).alias("autocovariance"))
    )


def sample_crosscovariance(df: DataFrame, first: str, second: str, keys: list[str] = ()) -> DataFrame:
    """(keys, crosscovariance, correlation) of two columns' irrelevances, each at its own scale."""
    keys = list(keys)
    rows = valid(df, first, second).select(*keys, F.col(first).alias("_a"), F.col(second).alias("_b"))
    a = group_scales(rows, "_a", keys).withColumnsRenamed({"z0": "_za", "scale": "_sa"})
    b = group_scales(rows, "_b", keys).withColumnsRenamed({"z0": "_zb", "scale": "_sb"})
    both = join_totals(join_totals(rows, a, keys), b, keys)
    _, ha = _f_h(F.try_divide(F.col("_a").cast("double"), F.col("_za")), F.col("_sa"), "i")
    _, hb = _f_h(F.try_divide(F.col("_b").cast("double"), F.col("_zb")), F.col("_sb"), "i")
    return (
        both.select(*keys, ha.alias("_ha"), hb.alias("_hb"))
        .groupBy(*keys)
        .agg(
            F.avg(F.col("_ha") * F.col("_hb")).alias("crosscovariance"),
            F.try_divide(
                F.avg(F.col("_ha") * F.col("_hb")),
                F.sqrt(F.avg(F.col("_ha") * F.col("_ha")) * F.avg(F.col("_hb") * F.col("_hb"))),
            ).alias("correlation"),
        )
    )
