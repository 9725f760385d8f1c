"""Distribution functions at given parameters, as weighted moments over a grid of points.

Every datum meets every grid point once, and the sums for a point are combined in the tasks
before they are shuffled: the cost is rows times points, the shuffle a few rows a task.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.functions import (
    az,
    fidelity_i,
    fidelity_j,
    fininf,
    irrelevance_i,
    irrelevance_j,
    mz,
    q_pair,
)
from fidelis.operators.totals import join_groups, valid

EPS = sys.float_info.epsilon
KINDS = ("egdf", "eldf", "qgdf", "qldf")
#: Powers of fidelity and irrelevance whose means the curves and derivatives use.
POWERS = {"f1": (1, 0), "h1": (0, 1), "f2": (2, 0), "fh": (1, 1), "f3": (3, 0), "f4": (4, 0), "h2": (0, 2), "h3": (0, 3), "fh2": (1, 2), "f2h": (2, 1), "f2h2": (2, 2), "f3h": (3, 1), "fh3": (1, 3)}


def _power(x: Column, n: int) -> Column:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def grid(bounds: DataFrame, keys: list[str], points: int) -> DataFrame:
    """(keys, point, di, _lo, _hi): `points` evenly spaced values from low to high."""
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(max(1, points - 1)))
    return bounds.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn(
        "di", F.col("_lo") + step * F.col("point")
    )


def moments(
    df: DataFrame, column: str, kind: str, keys: list[str] = (), s: float = 1.0, lb: float = 0.1353, ub: float = 7.389,
    points: int = 100, form: str = "a", weight: str | None = None,
) -> DataFrame:
    """(keys, point, di, zi and the mean of each of POWERS) for each grid point.

    s, lb and ub are the scale and the probable bounds in the normalised domain.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    keys, convert = list(keys), {"a": az, "m": mz}[form]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = valid(df.select(*keys, F.col(column).cast("double").alias("_x"), w.alias("_w")), "_x", "_w")
    bounds = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    lb_, ub_ = F.lit(lb), F.lit(ub)
    inner = lambda x: fininf(convert(x, F.col("_lo"), F.col("_hi")), lb_, ub_)
    data = join_groups(rows, bounds, keys).select(*keys, "_w", "_lo", "_hi", inner(F.col("_x")).alias("_zd"))
    # the grid's points follow from the bounds, so rows make them themselves
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(max(1, points - 1)))
    met = data.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "_zp", inner(F.col("_lo") + step * F.col("point"))
    )
    pair = q_pair(F.try_divide(F.col("_zd"), F.col("_zp") + F.lit(EPS)), s)
    estimating = kind[0] == "e"
    f, h = (fidelity_i(*pair), irrelevance_i(*pair)) if estimating else (fidelity_j(*pair), irrelevance_j(*pair))
    valued = met.select(*keys, "point", "_w", f.alias("_f"), h.alias("_h"), "_zd")
    sums = []
    for name, (a, b) in POWERS.items():
        x = _power(F.col("_f"), a) if a else None
        y = _power(F.col("_h"), b) if b else None
        value = x * y if x is not None and y is not None else (x if y is None else y)
        sums.append((F.sum(F.col("_w") * value) / F.sum("_w")).alias(name))
    for name, value in (("zm", F.col("_zd")), ("fz", F.col("_f") * F.col("_zd")), ("hz", F.col("_h") * F.col("_zd"))):
        sums.append((F.sum(F.col("_w") * value) / F.sum("_w")).alias(name))
    # the greatest values scale quantifying means, whose terms can be very large
    means = valued.groupBy(*keys, "point").agg(*sums)
    at = grid(bounds, keys, points).withColumn("zi", inner(F.col("di"))).withColumn("z", convert(F.col("di"), F.col("_lo"), F.col("_hi")))
    return join_groups(at.drop("_lo", "_hi"), means, [*keys, "point"])


def _safe(x: Column) -> Column:
    return F.when(x == 0, EPS).otherwise(x)


def values(kind: str, s: float) -> tuple[Column, Column]:
    """(distribution value before its running maximum, density) of a point's moments."""
    f1, h1 = F.col("f1"), F.col("h1")
    if kind == "egdf":
        norm = _safe(F.sqrt(f1 * f1 + h1 * h1))
        raised = _safe(F.pow(f1 * f1 + h1 * h1, F.lit(1.5)))
        return (1 - h1 / norm) / 2, (f1 * f1 * F.col("f2") / s + f1 * h1 * F.col("fh") / s) / raised
    if kind == "eldf":
        return (1 - h1) / 2, F.greatest(f1 * f1 / F.lit(s + EPS), F.lit(0.0))
    if kind == "qgdf":
        norm = F.hypot(f1, h1)
        ratio = F.greatest(F.lit(-1 + 1e-15), F.least(F.lit(1 - 1e-15), h1 / F.when(norm > 0, norm).otherwise(EPS)))
        slope = F.greatest(F.lit(-1 + 1e-12), F.least(F.lit(1 - 1e-12), h1 / f1))
        return (1 - ratio) / 2, (1 - slope * slope) / (s * F.col("z"))
    norm = F.sqrt(1 + h1 * h1) + F.lit(EPS)
    return (1 - h1 / norm) / 2, f1 / s / F.pow(1 + h1 * h1, F.lit(1.5))


def curve(df: DataFrame, column: str, kind: str, keys: list[str] = (), s: float = 1.0, **parameters) -> DataFrame:
    """(keys, point, di, zi, cdf, pdf) over the grid; all kinds but qldf never decrease."""
    keys = list(keys)
    cdf, pdf = values(kind, s)
    at = moments(df, column, kind, keys, s, **parameters).select(*keys, "point", "di", "zi", cdf.alias("_v"), pdf.alias("pdf"))
    # a curve has as many rows as the grid, so one task can order it
    rising = F.max("_v").over(Window.partitionBy(*keys).orderBy("point").rowsBetween(Window.unboundedPreceding, 0))
    value = F.col("_v") if kind == "qldf" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), rising))
    return at.select(*keys, "point", "di", "zi", value.alias("cdf"), "pdf")


def derivatives(df: DataFrame, column: str, kind: str, keys: list[str] = (), s: float = 1.0, **parameters) -> DataFrame:
    """(keys, point, di, second, third): higher derivatives in closed form over moments.

    For the global quantifying kind see density_slopes().
    """
    keys = list(keys)
    at = moments(df, column, kind, keys, s, **parameters)
    c = {k: F.col(k) for k in [*POWERS, "zm", "fz", "hz"]}
    if kind == "eldf":
        second = 4 * c["f2h"] / s**2
        third = 8 * (2 * c["f2h2"] - c["f4"]) / s**3
    elif kind == "egdf":
        # u and v are the parts of the second derivative, w that of its third term; slopes by the
        # rules d f = fh, d h = -f2 and so on for the products' means
        slope = {"f1": c["fh"], "h1": -c["f2"], "f2": 2 * c["f2h"], "fh": c["fh2"] - c["f3"], "fh2": c["fh3"] - 2 * c["f3h"], "f3": 3 * c["f3h"], "f2h": 2 * c["f2h2"] - c["f4"]}
        product = lambda *n: _product_slope([(c[x], slope[x]) for x in n])
        d, dd = _safe(c["f1"] * c["f1"] + c["h1"] * c["h1"]), 2 * (c["f1"] * slope["f1"] + c["h1"] * slope["h1"])
        u, du = _sum(product("f1", "h1", "f3"), _minus(product("f1", "h1", "fh2")), _minus(product("f1", "f2", "fh")))
        v, dv = _sum(_times(product("f1", "f1", "f2h"), 2), product("h1", "fh", "fh"))
        a, da = _sum(product("f1", "f1", "f2"), product("f1", "h1", "fh"))
        b, db = _sum(product("f1", "fh"), _minus(product("h1", "f2")))
        w, dw = 6 * a * b, 6 * (da * b + a * db)
        second = -(2 * (u - v) + w / d) / F.pow(d, F.lit(1.5)) / s**2
        inner = (du - dv) / F.pow(d, F.lit(1.5)) - 1.5 * (u - v) / F.pow(d, F.lit(2.5)) * dd
        outer = dw / F.pow(d, F.lit(2.5)) - 2.5 * w / F.pow(d, F.lit(3.5)) * dd
        third = 2 * (-2 * inner - outer) / s**3
    elif kind == "qldf":
        df1, dh1 = c["fz"] - c["f1"] * c["zm"], c["hz"] - c["h1"] * c["zm"]
        base = 1 + c["h1"] * c["h1"]
        second = (df1 / F.pow(base, F.lit(1.5)) - 3 * c["f1"] * c["h1"] * dh1 / F.pow(base, F.lit(2.5))) / s
        third = F.lit(None).cast("double")
    else:
        raise ValueError("closed forms are for egdf, eldf and qldf")
    return at.select(*keys, "point", "di", second.alias("second"), third.alias("third"))


def _product_slope(factors: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    value, slope = factors[0]
    for v, d in factors[1:]:
        value, slope = value * v, slope * v + value * d
    return value, slope


def _sum(*terms: tuple[Column, Column]) -> tuple[Column, Column]:
    value, slope = terms[0]
    for v, d in terms[1:]:
        value, slope = value + v, slope + d
    return value, slope


def _minus(term: tuple[Column, Column]) -> tuple[Column, Column]:
    return -term[0], -term[1]


def _times(term: tuple[Column, Column], k: float) -> tuple[Column, Column]:
    return term[0] * k, term[1] * k


def density_slopes(df: DataFrame, column: str, kind: str, keys: list[str] = (), **parameters) -> DataFrame:
    """(keys, point, di, second, third, fourth): differences of any kind's density over the grid."""
    keys = list(keys)
    at = curve(df, column, kind, keys, **parameters)
    w = Window.partitionBy(*keys).orderBy("point")

    def slope(name: str) -> Column:
        return F.try_divide(F.lead(name).over(w) - F.lag(name).over(w), F.lead("di").over(w) - F.lag("di").over(w))

    for name, of in (("second", "pdf"), ("third", "second"), ("fourth", "third")):
        at = at.withColumn(name, slope(of))
    return at.select(*keys, "point", "di", "second", "third", "fourth")


def residual_entropy_at(df: DataFrame, column: str, z0: float, keys: list[str] = (), s: float = 1.0, lb: float = 0.1353, ub: float = 7.389, form: str = "a") -> DataFrame:
    """(keys, residual_entropy, relative_entropy, entropy_i, entropy_j, variance) about z0.

    The place is taken in the normalised domain and the data in the infinite one, as in the
    definition that this follows; residual_entropy is 2 (mean fj - 1).
    """
    keys, convert = list(keys), {"a": az, "m": mz}[form]
    rows = valid(df.select(*keys, F.col(column).cast("double").alias("_x")), "_x")
    bounds = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    joined = join_groups(rows, bounds, keys)
    at = convert(F.lit(float(z0)), F.col("_lo"), F.col("_hi"))
    z = fininf(convert(F.col("_x"), F.col("_lo"), F.col("_hi")), F.lit(lb), F.lit(ub))
    pair = q_pair(F.try_divide(z, at + F.lit(EPS)), s)
    fi, fj, hi = fidelity_i(*pair), fidelity_j(*pair), irrelevance_i(*pair)
    return (
        joined.select(*keys, fi.alias("_fi"), fj.alias("_fj"), hi.alias("_hi_"))
        .groupBy(*keys)
        .agg(
            (2 * (F.avg("_fj") - 1)).alias("residual_entropy"),
            F.avg((F.col("_fj") - F.col("_fi")) / (F.col("_fj") + F.col("_fi"))).alias("relative_entropy"),
            (1 - F.avg("_fi")).alias("entropy_i"),
            (F.avg("_fj") - 1).alias("entropy_j"),
            F.avg(F.col("_hi_") * F.col("_hi_")).alias("variance"),
        )
    )
