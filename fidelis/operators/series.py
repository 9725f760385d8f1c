"""Ordered operators on the series of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def difference(df: DataFrame, column: str, keys: list[str], order: list[str], times: int = 1, season: int = 1, name: str = "diff") -> DataFrame:
    """Adds `name`: the column minus its value `season` rows before, `times` over.

    The first times * season rows of a series have null.
    """
    out = df.withColumn(name, F.col(column).cast("double"))
    for _ in range(times):
        out = out.withColumn(name, F.col(name) - F.lag(name, season).over(_window(keys, order)))
    return out


def lags(df: DataFrame, column: str, keys: list[str], order: list[str], count: int, seasonal: int = 0, season: int = 1) -> DataFrame:
    """Adds lag_1..lag_count, most recent first, and seasonal_1..: values k * season rows before.

    Rows without all of them are left out.
    """
    w = _window(keys, order)
    names = {f"lag_{k}": F.lag(column, k).over(w) for k in range(1, count + 1)}
    names |= {f"seasonal_{k}": F.lag(column, k * season).over(w) for k in range(1, seasonal + 1)}
    return df.withColumns(names).dropna(subset=list(names))


def sliding(df: DataFrame, column: str, keys: list[str], order: list[str], size: int, name: str = "window") -> DataFrame:
    """(keys, order, name): arrays of `size` successive values, each named by its first row."""
    w = _window(keys, order).rowsBetween(0, size - 1)
    return (
        df.select(*keys, *order, F.collect_list(F.col(column).cast("double")).over(w).alias(name))
        .filter(F.size(name) == size)
    )


def integrate(df: DataFrame, column: str, start: Column, keys: list[str], order: list[str], name: str = "level") -> DataFrame:
    """Adds `name`: `start` plus the running sum of differences."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, start + F.sum(column).over(w))
