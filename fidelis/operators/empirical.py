"""Empirical distribution functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.operators.totals import join_groups, running, valid, with_totals


def weighted_edf(df: DataFrame, column: str, keys: list[str], ties: list[str], weight: str | None = None) -> DataFrame:
    """Adds edf: the running weight before a row plus half its own, as a share of its group's weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = running(valid(df, column), keys, column, w, "_run", ties)
    return (
        with_totals(rows.withColumn("_w", w), keys, F.sum("_w").alias("_all"))
        .withColumn("edf", (F.col("_run") - F.col("_w") / 2) / F.col("_all"))
        .drop("_run", "_w", "_all")
    )


def ks_points(df: DataFrame, column: str, keys: list[str], ties: list[str]) -> DataFrame:
    """Adds ks: (2k - 1) / 2n for the k-th of a group's n values."""
    rows = running(valid(df, column), keys, column, F.lit(1), "_k", ties)
    return with_totals(rows, keys, F.count("*").alias("_n")).withColumn("ks", (2 * F.col("_k") - 1) / (2 * F.col("_n"))).drop("_k", "_n")


def edf_lookup(points: DataFrame, df: DataFrame, at: str, column: str, ties: list[str], weight: str | None = None) -> DataFrame:
    """`points` with edf: 0 up to the least value, 1 from the greatest, else that of the value before.

    Points and values are dealt by value bins and merged by one running window in each, so
    neither side is collected or broadcast.
    """
    steps = weighted_edf(df, column, [], ties, weight)
    # values that are equal count up to the first of them, as a lookup finds the place before it
    low = steps.groupBy(F.col(column).cast("double").alias("_x")).agg(F.min("edf").alias("_first"), F.max("edf").alias("_last"))
    merged = low.select("_x", F.lit(0).alias("_side"), F.col("_last").alias("_edf"), F.lit(None).cast(points.schema[at].dataType).alias(at)).unionByName(
        points.select(F.col(at).cast("double").alias("_x"), F.lit(-1).alias("_side"), F.lit(None).cast("double").alias("_edf"), F.col(at))
    )
    bounds = low.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    placed = join_groups(merged, bounds, [])
    part = F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    binned = placed.withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(part * 1024).cast("int"))))
    # the last value of each bin, carried on to later bins that start without one
    ends = binned.groupBy("_bin").agg(F.max(F.when(F.col("_side") == 0, F.struct("_x", "_edf"))).alias("_end"))
    carried = F.last("_end._edf", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select("_bin", carried.alias("_carried"))
    seen = F.last("_edf", ignorenulls=True).over(Window.partitionBy("_bin").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = join_groups(binned.withColumn("_seen", seen), carry, ["_bin"]).filter("_side = -1")
    edf = (
        F.when(F.col("_x") <= F.col("_lo"), 0.0)
        .when(F.col("_x") >= F.col("_hi"), 1.0)
        .otherwise(F.coalesce("_seen", "_carried", F.lit(0.0)))
    )
    return found.select(at, edf.alias("edf"))


def ks_grid(df: DataFrame, column: str, points: int) -> DataFrame:
    """(k, probability, value): (2k - 1) / 2L for k = 1..L, and the same share of the value range."""
    x = F.col(column).cast("double")
    bounds = valid(df, column).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    p = (2 * F.col("k") - 1) / F.lit(2.0 * points)
    return (
        bounds.select("_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("k"))
        .withColumn("probability", p)
        .select("k", "probability", (F.col("_lo") + F.col("probability") * (F.col("_hi") - F.col("_lo"))).alias("value"))
    )
