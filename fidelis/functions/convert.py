"""Conversions between the data, the normalised multiplicative and the infinite domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards of the conversions.
EPS, TINY = 1e-6, 1e-12


def az(a: Column, lb: Column, ub: Column) -> Column:
    """Additive data to normalised multiplicative: [lb, ub] goes to about [1/e, e]."""
    return F.exp((2 * a - ub - lb) / ((ub - lb) + F.lit(EPS)))


def za(z: Column, lb: Column, ub: Column) -> Column:
    """Inverse of az()."""
    top = F.when(lb >= ub, ub + F.lit(TINY)).otherwise(ub)
    return (F.log(F.abs(z) + F.lit(EPS)) * (top - lb) + lb + top) / 2


def mz(m: Column, lb: Column, ub: Column) -> Column:
    """Positive multiplicative data to normalised multiplicative; null outside its domain."""
    span = F.log(F.try_divide(ub, lb))
    return F.exp(F.try_divide(2 * F.log(F.try_divide(m, lb)), span) - 1)


def zm(z: Column, lb: Column, ub: Column) -> Column:
    """Inverse of mz(), up to the centre of the domain."""
    v = F.sqrt(F.try_divide(ub, lb))
    return lb * v * F.pow(z, F.log(v))


def fininf(z: Column, lb: Column, ub: Column) -> Column:
    """Finite to infinite domain."""
    return F.try_divide(z - lb, 1 - z / ub + F.lit(EPS))


def inffin(z: Column, lb: Column, ub: Column) -> Column:
    """Infinite to finite domain."""
    return F.try_divide(z + lb, 1 + z / ub)


def probable_bounds(low: Column, high: Column, form: str = "a") -> tuple[Column, Column]:
    """Bounds half a range beyond the data's; in the multiplicative form ('m') by ratio."""
    if form == "a":
        pad = (high - low) / 2
        return low - pad, high + pad
    if form == "m":
        ratio = F.sqrt(F.try_divide(high, low))
        return F.try_divide(low, ratio), high * ratio
    raise ValueError(f"form must be 'a' or 'm', not {form!r}")


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half up; what comes to zero keeps its sign, as in SQL on IEEE numbers (F.round() loses it)."""
    out = F.round(x, digits)
    return F.when(out == 0, x * F.lit(0.0)).otherwise(out)
