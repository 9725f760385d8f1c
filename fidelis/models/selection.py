"""Splitting rows into parts of exact sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.totals import running


def shuffle_key(row_id: Column, seed: int) -> Column:
    """A number that orders rows at random but always alike: 48 bits of a hash of id and seed."""
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")


def _numbered(df: DataFrame, row_id: str, shuffle: bool, seed: int) -> tuple[DataFrame, int]:
    order = shuffle_key(F.col(row_id), seed) if shuffle else F.col(row_id).cast("double")
    rows = running(df.withColumn("_order", order), [], "_order", F.lit(1), "_k", [row_id]).drop("_order")
    return rows, df.count()


def train_test_split(df: DataFrame, row_id: str, test_size: float | int = 0.25, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Adds is_test: the last ceil(share * n) rows (or a number of rows) of the order.

    Ranks come from sums over value bins, so sizes are exact without one task seeing all rows.
    """
    rows, n = _numbered(df, row_id, shuffle, seed)
    size = -int(-test_size * n // 1) if isinstance(test_size, float) else int(test_size)
    if not 0 < size < n:
        raise ValueError(f"a test set of {size} of {n} rows leaves no train or test rows")
    return rows.withColumn("is_test", F.col("_k") > n - size).drop("_k")


def k_folds(df: DataFrame, row_id: str, k: int = 5, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Adds fold in 0..k-1: successive parts of the order, the first n mod k one row larger."""
    rows, n = _numbered(df, row_id, shuffle, seed)
    if not 2 <= k <= n:
        raise ValueError(f"{n} rows do not make {k} folds")
    size, extra = divmod(n, k)
    at = F.col("_k") - 1
    large = extra * (size + 1)
    fold = F.when(at < large, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - large) / size))
    return rows.withColumn("fold", fold.cast("int")).drop("_k")


def cross_validate(
    df: DataFrame, row_id: str, fit: Callable, score: Callable[[object, DataFrame], float], k: int = 5, shuffle: bool = True, seed: int = 0
) -> list[float]:
    """score(fit(train), test) of each fold."""
    folded = k_folds(df, row_id, k, shuffle, seed)
    parts: Iterator = ((folded.filter(F.col("fold") != i).drop("fold"), folded.filter(F.col("fold") == i).drop("fold")) for i in range(k))
    return [score(fit(train), test) for train, test in parts]
