"""Smoothing, maxima and cluster bounds of curves on a grid.

A curve has as many points as its grid (a parameter), so each is handled as one array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.operators.totals import join_groups


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def as_arrays(curve: DataFrame, keys: list[str], columns: list[str], order: str = "point") -> DataFrame:
    """(keys, one array for each column) in the order of the grid."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return curve.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def smoothed(values: Column, sigma: float = 1.0) -> Column:
    """The array under a Gaussian kernel; beyond the ends it is mirrored, ends repeated."""
    kernel = gaussian_kernel(sigma)
    radius, n = len(kernel) // 2, F.size(values)

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for k, weight in enumerate(kernel):
            j = F.pmod(i + F.lit(k - radius), 2 * n)
            mirrored = F.when(j < n, j).otherwise(2 * n - 1 - j)
            total = total + F.lit(weight) * F.get(values, mirrored.cast("int"))
        return total

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def local_maxima(values: Column, least_share: float | None = 0.01) -> Column:
    """Indices of the array's inner maxima, of at least `least_share` of the greatest value if given.

    Of a flat top the first index counts.
    """
    n = F.size(values)
    floor = F.lit(float("-inf")) if least_share is None else F.array_max(values) * least_share
    get = lambda i: F.get(values, i.cast("int"))
    inner = F.when(n > 2, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: (get(i) > get(i - 1)) & (get(i) >= get(i + 1)) & (get(i) >= floor))


def inner_maxima(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, point, value): the inner maxima of (keys, point, value) in the order of points.

    A flat top counts as one, at its middle (rounded down); a flat stretch at an end is none.
    """
    line = Window.partitionBy(*keys).orderBy("point")
    changed = F.coalesce((F.col(value) != F.lag(value).over(line)).cast("int"), F.lit(0))
    runs = rows.select(*keys, "point", value, changed.alias("_new")).withColumn("_run", F.sum("_new").over(line))
    flat = runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min("point").alias("_a"), F.max("point").alias("_b"))
    along = Window.partitionBy(*keys).orderBy("_run")
    sides = flat.withColumns({"_before": F.lag(value).over(along), "_after": F.lead(value).over(along)})
    kept = sides.filter((F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after")))
    return kept.select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).cast("int").alias("point"), value)


def density_peaks(curve: DataFrame, keys: list[str], points: int, least_share: float = 0.01) -> DataFrame:
    """(keys, peaks): the maxima of a curve's smoothed density, highest first, as (point, height).

    They have `least_share` of the greatest smoothed value at least; of those nearer than a
    twentieth of the grid the higher stays. Curves without maxima give no row.
    """
    smooth = as_arrays(curve, keys, ["pdf"]).select(*keys, smoothed(F.col("pdf")).alias("_s"))
    rows = smooth.select(*keys, F.array_max("_s").alias("_most"), F.posexplode("_s").alias("point", "_v"))
    tops = inner_maxima(rows, keys, "_v")
    most = rows.groupBy(*keys).agg(F.first("_most").alias("_most"))
    high = join_groups(tops, most, keys).filter(F.col("_v") >= least_share * F.col("_most"))
    listed = high.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_v")).alias("low"), "point"))).alias("_t"))
    apart = max(1, points // 20)
    none = F.array().cast("array<struct<point:int,height:double>>")

    def keep(kept: Column, top: Column) -> Column:
        far = F.forall(kept, lambda k: F.abs(k["point"] - top["point"]) >= apart)
        return F.when(far, F.concat(kept, F.array(F.struct(top["point"].alias("point"), (-top["low"]).alias("height"))))).otherwise(kept)

    return listed.select(*keys, F.aggregate("_t", none, keep).alias("peaks"))


def cluster_bounds(curve: DataFrame, keys: list[str] = (), threshold: float = 0.0, at: DataFrame | None = None) -> DataFrame:
    """(keys, z0, lcb, ucb): the bounds of the cluster around a density's maximum.

    On each side the first point outwards whose normalised density plus gradient is at most
    `threshold`; else the end of the grid. `at`, of (keys, _mid), names the point to start from.
    """
    keys = list(keys)
    whole, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("point")
    low, high = F.min("pdf").over(whole), F.max("pdf").over(whole)
    normal = F.coalesce(F.try_divide(F.col("pdf") - low, high - low), F.lit(0.5))
    rows = curve.select(*keys, "point", "di", normal.alias("_p"), (F.col("pdf") == high).alias("_high"))
    before, after = F.lag("_p").over(line), F.lead("_p").over(line)
    slope = F.when(before.isNull(), after - F.col("_p")).when(after.isNull(), F.col("_p") - before).otherwise((after - before) / 2)
    top = F.min(F.when(F.col("_high"), F.col("point"))).over(whole)
    if at is not None:
        rows, top = join_groups(rows, at, keys), F.col("_mid")
    rows = rows.withColumns({"_quiet": F.col("_p") + F.coalesce(slope, F.lit(0.0)) <= threshold, "_top": top})
    at = lambda flag: F.when(flag, F.col("di"))
    quiet = F.col("_quiet")
    return rows.groupBy(*keys).agg(
        F.max(at(F.col("point") == F.col("_top"))).alias("z0"),
        F.coalesce(F.max(at(quiet & (F.col("point") < F.col("_top")))), F.min("di")).alias("lcb"),
        F.coalesce(F.min(at(quiet & (F.col("point") > F.col("_top")))), F.max("di")).alias("ucb"),
    )
