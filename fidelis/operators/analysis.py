"""Homogeneity, scedasticity, clusters, membership, intervals, stationarity and covariances of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.operators import fits, peaks
from fidelis.operators.distributions import (
    MAX_POINTS,
    fitted,
    original_bounds,
    samples,
    varying_scale,
    with_std,
    z0_of,
)
from fidelis.operators.lineage import cut
from fidelis.operators.series import sliding
from fidelis.operators.totals import join_groups, valid

#: Steps of the membership walk, its first step as a share of the range, its decay.
WALK_STEPS, WALK_STEP, WALK_DECAY = 100, 1e-3, 0.1


def _global(sample: fits.Sample, fitted_: DataFrame, form: str, points: int) -> tuple[DataFrame, DataFrame]:
    """(flags, curve): (keys, homogeneous, z0, _peaks) by the global density of a fitted sample, and its curve."""
    keys = sample.keys
    curve = cut(fits.curves(sample, fitted_, "egdf", form, points))
    marked = fits.with_tops(fitted_, curve, keys, points)
    lows = curve.groupBy(*keys).agg(F.min("pdf").alias("_least"))
    found = join_groups(join_groups(marked, lows, keys), peaks.density_peaks(curve, keys, points), keys, "left") if keys else join_groups(marked, lows, keys).join(peaks.density_peaks(curve, keys, points), how="left")
    alike, tops = F.col("dlb") == F.col("dub"), F.coalesce("peaks", F.array().cast("array<struct<point:int,height:double>>"))
    flags = found.select(
        *keys,
        (alike | ((F.col("_least") >= 0) & (F.size(tops) == 1))).alias("homogeneous"),
        F.when(alike, F.col("dlb")).otherwise(F.col("z0")).alias("z0"),
        F.when(alike, F.slice(tops, 1, 0)).otherwise(tops).alias("_peaks"),
    )
    return flags, curve


def homogeneity(
    df: DataFrame, column: str, keys: list[str] = (), form: str = "a", points: int = 500, weight: str | None = None,
    count: int | None = fits.PLACES, homogeneous: bool = True,
) -> DataFrame:
    """(keys, homogeneous, z0, peaks): peaks are (position, density) of the smoothed density's maxima, highest first.

    A group is homogeneous if its global density, at all its rows, has one such peak and is
    nowhere negative, or if it has one value. `homogeneous=False` fits with weights that the
    data give.
    """
    sample = fits.sample(df, column, keys, weight, count, not homogeneous, form)
    flags, curve = _global(sample, fits.fit(sample, "egdf", form), form, points)
    arrays = peaks.as_arrays(curve, sample.keys, ["di", "pdf"])
    place = F.transform("_peaks", lambda p: F.struct(F.get("di", p["point"]).alias("position"), F.get("pdf", p["point"]).alias("density")))
    return join_groups(flags, arrays, sample.keys).select(*sample.keys, "homogeneous", "z0", place.alias("peaks"))


def scedasticity(
    df: DataFrame, column: str, keys: list[str] = (), kind: str = "eldf", form: str = "a", weight: str | None = None, count: int | None = fits.PLACES
) -> DataFrame:
    """(keys, homoscedastic, least_scale, greatest_scale) of a scale that may vary along the data (see varying_scale())."""
    found = varying_scale(df, column, kind, keys, form, 2, weight, count)
    low, high = F.least("s_low", "s_high"), F.greatest("s_low", "s_high")
    return found.select(*keys, (~F.col("heteroscedastic")).alias("homoscedastic"), low.alias("least_scale"), high.alias("greatest_scale"))


def _settled(rows: DataFrame, points: int) -> DataFrame:
    """Adds a global fit (re-weighted where not homogeneous), homogeneous and, for local fits, s.

    s is 1 where the data stay inhomogeneous under weights, else null (to be searched).
    """
    rows = fitted(fitted(rows, "egdf", points=points, name="_first"), "egdf", points=points, robust=True, name="_again")
    first = F.col("_first.homogeneous")
    return (
        rows.withColumn("fit", F.when(first, F.col("_first")).otherwise(F.col("_again")))
        .withColumn("homogeneous", first | F.col("_again.homogeneous"))
        .withColumn("_s", F.when(~F.col("homogeneous"), 1.0))
        .drop("_again", "_first")
    )


def cluster_analysis(
    df: DataFrame, column: str, keys: list[str] = (), form: str = "a", threshold: float = 0.01, points: int = 1000,
    weight: str | None = None, count: int | None = fits.PLACES, homogeneous: bool = True,
) -> DataFrame:
    """(keys, homogeneous, lcb, ucb): bounds of the main cluster, that of the local density's maximum.

    Groups known not to be `homogeneous` are fitted with weights that the data give. One
    search of scale and bounds serves the global function, which tells homogeneity, and the
    local one. Bounds are where, on either side, the normalised density and its slope
    have fallen to `threshold`.
    """
    sample = fits.sample(df, column, keys, weight, count, not homogeneous, form)
    found = fits.fit(sample, "eldf", form)
    flags, _ = _global(sample, found, form, points)
    local = cut(fits.curves(sample, cut(fits.with_local_scale(sample, found, form)), "eldf", form, points, "s_local"))
    bounds = peaks.cluster_bounds(local, sample.keys, threshold, fits.tops(local, sample.keys))
    return join_groups(flags.select(*sample.keys, "homogeneous"), bounds.drop("z0"), sample.keys)


def _extended(rows: DataFrame, datum: Column) -> DataFrame:
    return rows.withColumn("data", F.concat("data", F.array(datum))).withColumn("counts", F.concat("counts", F.array(F.lit(1.0))))


def membership(rows: DataFrame, keys: list[str], points: int = 100, steps: int = WALK_STEPS) -> DataFrame:
    """(keys, lsb, usb) of rows with data, counts and a global fit.

    A walk from each data bound outwards adds a datum and asks whether the sample stays
    homogeneous. Its places do not depend on the answers, so all are fitted side by side,
    and the place before the first refusal is the bound.
    """
    low, high = F.col("fit.dlb"), F.col("fit.dub")
    lb, ub = original_bounds("fit", "a")
    total, offsets = 0.0, [0.0]
    for i in range(steps):
        total += WALK_STEP / (1 + WALK_DECAY * max(0, i - 1))
        offsets.append(total)
    walk = F.posexplode(F.array(*[F.lit(x) for x in offsets]))
    walked = rows.select(*keys, "data", "counts", low.alias("_low"), high.alias("_high"), lb.alias("_lb"), ub.alias("_ub"), walk.alias("_i", "_o"))
    span = F.col("_o") * (F.col("_high") - F.col("_low"))
    sides = walked.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn(
        "_at", F.when(F.col("_side") < 0, F.col("_low") - span).otherwise(F.col("_high") + span)
    )
    inside = F.when(F.col("_side") < 0, F.col("_at") > F.col("_lb")).otherwise(F.col("_at") < F.col("_ub"))
    tests = sides.filter((F.col("_i") == 0) | inside)
    # each place is a fit of its own: deal them over all tasks
    dealt = tests.repartition(*keys, "_side", "_i")
    tested = fitted(_extended(dealt, F.col("_at")), "egdf", points=points).select(*keys, "_side", "_i", "_at", "fit.homogeneous")
    refused = F.min(F.when(~F.col("homogeneous"), F.col("_i")))
    bound = tested.groupBy(*keys, "_side").agg(refused.alias("_r"), F.sort_array(F.collect_list(F.struct("_i", "_at"))).alias("_w"))
    last = F.when(F.col("_r").isNull(), F.size("_w") - 1).otherwise(F.greatest(F.lit(0), F.col("_r") - 1))
    found = bound.withColumn("_b", F.get("_w._at", last.cast("int")))
    return found.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") < 0, F.col("_b"))).alias("lsb"), F.max(F.when(F.col("_side") > 0, F.col("_b"))).alias("usb")
    )


def membership_bounds(
    df: DataFrame, column: str, keys: list[str] = (), form: str = "a", points: int = 500, steps: int = WALK_STEPS
) -> DataFrame:
    """(keys, lsb, usb): how far a further datum may lie for the sample to stay homogeneous, by fits to all rows.

    A walk from each data bound outwards adds a datum, anew at each place, and asks whether
    the sample stays homogeneous; the place before the first refusal is the bound. Places do not
    depend on the answers, so all are fitted side by side, over the same chunks. Groups that
    are not homogeneous as they are have their data bounds, as a rule.
    """
    sample = fits.sample(df, column, keys, None, 0)
    keys, asked = sample.keys, sample.groups.select(*sample.keys, "dlb", "dub")
    total, offsets = 0.0, [0.0]
    for i in range(steps):
        total += WALK_STEP / (1 + WALK_DECAY * max(0, i - 1))
        offsets.append(total)
    walk = F.expr("array(" + ", ".join(f"{x!r}D" for x in offsets) + ")")
    walked = asked.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).select("*", F.posexplode(walk).alias("_i", "_o"))
    span = F.col("_o") * (F.col("dub") - F.col("dlb"))
    additions = walked.withColumn("_at", F.when(F.col("_side") < 0, F.col("dlb") - span).otherwise(F.col("dub") + span))
    longer = fits.extend(sample, additions, ["_side", "_i"])
    stays, _ = _global(longer, fits.fit(longer, "egdf", form), form, points)
    refused = stays.groupBy(*keys, "_side").agg(F.min(F.when(~F.col("homogeneous"), F.col("_i"))).alias("_r"))
    last = F.coalesce(F.greatest(F.lit(0), F.col("_r") - 1), F.lit(steps))
    reached = join_groups(additions, refused, [*keys, "_side"]).filter(F.col("_i") == last)
    return reached.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") < 0, F.col("_at"))).alias("lsb"), F.max(F.when(F.col("_side") > 0, F.col("_at"))).alias("usb")
    )


def _search_points(z0: Column, end: Column, n: int, dense_zone: float = 0.4, dense_share: float = 0.7) -> Column:
    """n places from z0 to `end`: a share of them evenly in the zone next to z0, the rest beyond."""
    dense, mid = int(n * dense_share), z0 + (end - z0) * dense_zone
    line = lambda a, b, m: [a + (b - a) * (k / max(1, m - 1)) for k in range(m)]
    return F.array_sort(F.array_distinct(F.array(*line(z0, mid, dense), *line(mid, end, n - dense))))


def interval_analysis(
    df: DataFrame, column: str, keys: list[str] = (), ties: list[str] = (), scan: int = 10, points: int = 200, threshold: float = 0.0,
    steps: int = WALK_STEPS, max_points: int = 64,
) -> DataFrame:
    """The 15 bounds of each group of four values or more, and whether their order holds.

    (keys, homogeneous, lb, lsb, dlb, lcb, lsd, zl, z0l, z0, z0u, zu, usd, ucb, dub, usb, ub, ordered)

    A datum is added at `scan` places on either side of z0 and z0 is found anew, all places
    side by side. The places that draw z0 lowest and highest bound the typical interval
    (zl, zu), the drawn z0 the tolerance interval (z0l, z0u). Membership bounds are for
    homogeneous groups only, else null.
    """
    keys = list(keys)
    rows = _settled(samples(df, column, keys, ties, max_points, least=4), points)
    rows = fitted(rows, "eldf", points=points, s=F.col("_s"), name="local", threshold=threshold).withColumn("z0", z0_of("local"))
    # from here several branches read the fits
    rows = cut(rows)
    lb, ub = original_bounds("local", "a")
    base = rows.select(*keys, "data", "counts", "homogeneous", "_s", "z0", lb.alias("lb"), ub.alias("ub"), "local.lcb", "local.ucb", F.col("fit.dlb").alias("dlb"), F.col("fit.dub").alias("dub"))
    margin = (F.col("ub") - F.col("lb")) * 0.001
    places = F.concat(_search_points(F.col("z0"), F.col("lb") + margin, scan), _search_points(F.col("z0"), F.col("ub") - margin, scan))
    scanned = base.withColumn("_at", F.explode(F.array_distinct(places))).repartition(*keys, "_at")
    refit = fitted(_extended(scanned, F.col("_at")), "eldf", points=points, s=F.col("_s"), lb=F.col("lb"), ub=F.col("ub"))
    drawn = refit.select(*keys, "z0", "data", "_at", z0_of().alias("_z"))
    size = F.size("data")
    mean = F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / size
    spread = F.sqrt(F.aggregate("data", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / size)
    near = (F.abs(F.col("_at") - mean) <= 2 * spread).alias("_near")
    ends = drawn.select(*keys, "z0", "_at", "_z", near).groupBy(*keys).agg(
        *[F.coalesce(f(F.when(F.col("_near"), x)), f(x)).alias(n) for n, f, x in (
            ("_low", F.min, F.struct("_z", "_at")),
            ("_high", F.max, F.struct("_z", "_at")),
        )]
    )
    bounds = ends.select(*keys, F.col("_low._at").alias("_zl"), F.col("_low._z").alias("_z0l"), F.col("_high._at").alias("_zu"), F.col("_high._z").alias("_z0u"))
    walked = membership(rows.filter("homogeneous"), keys, points, steps)
    spreads = with_std(base.select(*keys, "data", "counts", "_s"), s=F.col("_s")).select(*keys, "lsd", "usd")
    out = join_groups(join_groups(join_groups(base, bounds, keys), spreads, keys), walked, keys, "left" if keys else "inner")
    z0, zl, z0l, zu, z0u = (F.col(c) for c in ("z0", "_zl", "_z0l", "_zu", "_z0u"))
    ordered = (zl < z0l) & (z0l < z0) & (z0 < z0u) & (z0u < zu)
    low, high = F.least(z0l, z0), F.greatest(z0u, z0)
    return out.select(
        *keys, "homogeneous", "lb", "lsb", "dlb", "lcb", "lsd", F.least(zl, low).alias("zl"), low.alias("z0l"), "z0", high.alias("z0u"),
        F.greatest(zu, high).alias("zu"), "usd", "ucb", "dub", "usb", "ub", ordered.alias("ordered"),
    )


def stationarity(
    df: DataFrame, column: str, keys: list[str], order: list[str], size: int = 10, form: str = "a", s: float | None = None,
    points: int = 100, count: int | None = fits.PLACES,
) -> DataFrame:
    """(keys, windows, stationary): whether the residual entropies of sliding windows are homogeneous.

    Each window of `size` successive rows is a group of its own: all are fitted side by side.
    Series of fewer than ten windows with an entropy are not stationary.
    """
    named = {o: f"_o{i}" for i, o in enumerate(order)}
    windows = sliding(df, column, keys, order, size).withColumnsRenamed(named)
    each = windows.select(*keys, *named.values(), F.explode("window").alias("_v"))
    sample = fits.sample(each, "_v", [*keys, *named.values()], None, count)
    found = fits.with_z0(sample, fits.fit(sample, "egdf", form, s), "egdf", form, points, s)
    values = cut(fits.about_z0(sample, found, form).select(*keys, F.col("residual_entropy").alias("_re")))
    counts = valid(values, "_re").groupBy(*keys).agg(F.count("*").alias("windows"))
    entropies = fits.sample(values, "_re", keys, None, count)
    flags, _ = _global(entropies, fits.fit(entropies, "egdf", "a", s), "a", points)
    whole = join_groups(counts, flags.select(*keys, "homogeneous"), list(keys))
    return whole.select(*keys, "windows", ((F.col("windows") >= 10) & F.col("homogeneous")).alias("stationary"))


def _pair_fits(df: DataFrame, columns: tuple[str, str], keys: list[str], case: str, form: str, count: int | None, settle: bool) -> tuple[DataFrame, DataFrame]:
    """The global fits of two columns, side by side; if they are to `settle`, at S = 1 where a group is not homogeneous (estimating case)."""
    each = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    sample = fits.sample(df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*"), "_v", [*keys, "_which"], None, count)
    found = fits.fit(sample, "qgdf" if case == "j" else "egdf", form)
    if settle and case == "i":
        flags, _ = _global(sample, found, form, 500)
        flags = cut(flags.select(*sample.keys, "homogeneous"))
        fixed = fits.fit(sample, "egdf", form, 1.0)
        chosen = [join_groups(x, flags.filter(keep).select(*sample.keys), sample.keys) for x, keep in ((found, "homogeneous"), (fixed, "not homogeneous"))]
        found = cut(chosen[0].unionByName(chosen[1]))
    return tuple(found.filter(F.col("_which") == i).drop("_which") for i in (0, 1))


def correlation(
    df: DataFrame, first: str, second: str, keys: list[str] = (), case: str = "i", form: str = "a", count: int | None = fits.PLACES
) -> DataFrame:
    """(keys, correlation) of two columns' whole matrices of irrelevances, paired by rank.

    The mean of products over all pairs of ranks, over the root of the product of the mean
    squares; null where that is zero. Fits sort their data, so values are paired by rank rather
    than by row. Work grows with the square of a group's distinct pairs of values of the same
    rank, in blocks of bounded size.
    """
    keys, both = list(keys), valid(df, first, second)
    fitted_ = _pair_fits(both, (first, second), keys, case, form, count, False)
    sums = fits.pair_sums(fits.rank_pairs(both, first, second, keys), fitted_, keys, form, case, False)
    return sums.select(*keys, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation"))


def _mean_products(df: DataFrame, first: str, second: str, keys: list[str], case: str, form: str, count: int | None) -> DataFrame:
    """(keys, n, xy, xx, yy): sums of products of two columns' mean irrelevances at their data, paired by rank."""
    fitted_ = _pair_fits(df, (first, second), keys, case, form, count, True)
    sums = fits.pair_sums(fits.rank_pairs(df, first, second, keys), fitted_, keys, form, case, True)
    sizes = fitted_[0].select(*keys, "n")
    means = join_groups(sums, sizes, keys)
    for c in ("x", "y"):
        mean = F.col(c) / F.col("n")
        means = means.withColumn(c, mean if case == "i" else F.least(F.lit(1e12), F.greatest(F.lit(1.0), mean)))
    product = lambda a, b, name: F.sum(F.col(a) * F.col(b) * F.col("c")).alias(name)
    return means.groupBy(*keys).agg(F.sum("c").cast("long").alias("n"), product("x", "y", "xy"), product("x", "x", "xx"), product("y", "y", "yy"))


def covariances(
    df: DataFrame, first: str, second: str, keys: list[str] = (), case: str = "i", form: str = "a", count: int | None = fits.PLACES
) -> DataFrame:
    """(keys, covariance): the mean product of two columns' mean irrelevances, paired by rank (see correlation())."""
    keys, both = list(keys), valid(df, first, second)
    return _mean_products(both, first, second, keys, case, form, count).select(*keys, (F.col("xy") / F.col("n")).alias("covariance"))


def autocovariances(
    df: DataFrame, column: str, keys: list[str], order: list[str], lag: int, case: str = "i", form: str = "a", count: int | None = fits.PLACES
) -> DataFrame:
    """(keys, covariance, correlation) of a series with itself `lag` rows later.

    covariance divides the sum over n - lag pairs by n - 2 lag, as in the definition that
    this follows; 0 where that is zero.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = valid(df.select(*keys, *order, F.col(column).alias("_now")).withColumn("_later", F.lead("_now", lag).over(w)), "_now", "_later")
    sums = _mean_products(rows, "_now", "_later", keys, case, form, count)
    return sums.select(
        *keys,
        F.coalesce(F.try_divide(F.col("xy"), F.col("n") - lag), F.lit(0.0)).alias("covariance"),
        F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation"),
    )


def local_clusters(
    df: DataFrame, column: str, keys: list[str] = (), scales: list[float] | None = None, form: str = "a", points: int = 1000,
    weight: str | None = None, count: int | None = fits.PLACES,
) -> DataFrame:
    """(keys, s, residual_entropy, centroids, boundaries): clusters of a column by its local density.

    Of the given scales (by default one that is searched) the one of least residual entropy
    counts, for each group. The density's peaks are centroids, its valleys boundaries.
    """
    sample = fits.sample(df, column, keys, weight, count)
    keys, tried = sample.keys, None
    for s in scales or [None]:
        found = fits.with_z0(sample, fits.fit(sample, "eldf", form, s), "eldf", form, points, s)
        curve = cut(fits.curves(sample, found, "eldf", form, points, "s_local"))
        own = join_groups(found.select(*keys, F.col("s_local").alias("s")), fits.about_z0(sample, found, form), keys)
        for name, sign in (("centroids", 1), ("boundaries", -1)):
            tops = peaks.inner_maxima(curve.select(*keys, "point", (sign * F.col("pdf")).alias("_v")), keys, "_v")
            places = join_groups(tops.withColumnRenamed("point", "_top"), curve, keys).filter("_top = point")
            listed = places.groupBy(*keys).agg(F.sort_array(F.collect_list("di")).alias(name))
            own = join_groups(own, listed, keys, "left") if keys else own.join(listed, how="left")
        none = F.array().cast("array<double>")
        row = F.struct("residual_entropy", "s", F.coalesce("centroids", none).alias("centroids"), F.coalesce("boundaries", none).alias("boundaries"))
        own = own.select(*keys, row.alias("_r"))
        tried = own if tried is None else tried.unionByName(own)
    return tried.groupBy(*keys).agg(F.min("_r").alias("_r")).select(*keys, "_r.s", "_r.residual_entropy", "_r.centroids", "_r.boundaries")


def assign_clusters(df: DataFrame, clusters: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Adds cluster: how many of its group's boundaries lie below a row's value."""
    x = F.col(column).cast("double")
    joined = join_groups(df, clusters.select(*keys, "boundaries"), list(keys))
    return joined.withColumn("cluster", F.size(F.filter("boundaries", lambda b: b < x))).drop("boundaries")
