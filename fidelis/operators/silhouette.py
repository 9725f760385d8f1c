"""Euclidean silhouette by blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.operators.totals import join_groups

BLOCK_ROWS, _STEP = 4096, 512
#: Squared distances below this part of both rows' squared lengths are not left to a difference of products.
_NEAR, _PAIRS = 1e-3, 1 << 14


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of x from each of y.

    They come from a product of matrices about a common middle. Pairs for which it would cancel
    too many digits, or is no number, are taken from their differences.
    """
    with np.errstate(all="ignore"):
        middle = y.mean(0)
        middle = np.where(np.isfinite(middle), middle, 0.0)
        p, q = x - middle, y - middle
        both = (p * p).sum(1)[:, None] + (q * q).sum(1)[None]
        d = both - 2 * (p @ q.T)
        i, j = np.nonzero(~(d >= _NEAR * both))
        for at in range(0, len(i), _PAIRS):
            a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
            d[a, b] = ((x[a] - y[b]) ** 2).sum(1)
        return np.sqrt(d, out=d)


def _label_sums(d: np.ndarray, codes: np.ndarray, labels: int) -> np.ndarray:
    """Sums of d's columns by their label's code."""
    if np.isfinite(d).all():
        return d @ (codes[:, None] == np.arange(labels)[None]).astype(float)
    return np.stack([d[:, codes == k].sum(1) for k in range(labels)], 1)


def silhouette(df: DataFrame, row_id: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, label, a, b, silhouette) of each row: mean distances to its own and the nearest cluster.

    Each pair of row blocks meets once and leaves a sum for each row of both and label, so
    memory is bounded by block_rows; the distances themselves are as many as pairs of rows.
    A row alone in its cluster has 0; with one cluster, or one for each row, all have 0.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.col(label).alias("_label")).dropna()
    blocks = max(1, -(-rows.count() // block_rows))
    own = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    up, down = F.explode(F.sequence("_b", F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.col("_b")))
    left = own.select("_id", "_v", "_label", F.col("_b").alias("_l"), up.alias("_r"), F.lit(True).alias("_left"))
    right = own.select("_id", "_v", "_label", down.alias("_l"), F.col("_b").alias("_r"), F.lit(False).alias("_left"))
    id_type, label_type = rows.schema["_id"].dataType.simpleString(), rows.schema["_label"].dataType.simpleString()

    def met(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        if a.empty or b.empty:
            return pd.DataFrame({"_id": [], "_label": [], "_other": [], "_sum": []})
        x, y = np.stack(a["_v"].to_numpy()), np.stack(b["_v"].to_numpy())
        (own, first), (codes, names) = pd.factorize(a["_label"]), pd.factorize(b["_label"])
        ahead, back = np.zeros((len(x), len(names))), np.zeros((len(y), len(first)))
        for i in range(0, len(x), _STEP):
            part = slice(i, i + _STEP)
            d = distances(x[part], y)
            ahead[part] = _label_sums(d, codes, len(names))
            # a block that meets itself has all its pairs both ways already
            if key[0] != key[1]:
                back += _label_sums(d.T, own[part], len(first))
        sides = [(a, names, ahead)] + ([(b, first, back)] if key[0] != key[1] else [])
        return pd.concat(
            pd.DataFrame(
                {
                    "_id": np.repeat(side["_id"].to_numpy(), len(others)),
                    "_label": np.repeat(side["_label"].to_numpy(), len(others)),
                    "_other": np.tile(np.asarray(others), len(side)),
                    "_sum": sums.ravel(),
                }
            )
            for side, others, sums in sides
        )

    schema = f"_id {id_type}, _label {label_type}, _other {label_type}, _sum double"
    parts = left.unionByName(right).groupBy("_l", "_r").applyInPandas(met, schema)
    sums = parts.groupBy("_id", "_label", "_other").agg(F.sum("_sum").alias("_sum"))
    sizes = rows.groupBy(F.col("_label").alias("_other")).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.count("*").alias("_k"), F.sum("_n").alias("_all"))
    same = F.col("_label") == F.col("_other")
    scored = (
        join_groups(sums, sizes, ["_other"])
        .groupBy("_id", "_label")
        .agg(
            F.max(F.when(same, F.try_divide(F.col("_sum"), F.col("_n") - 1))).alias("a"),
            F.min(F.when(~same, F.col("_sum") / F.col("_n"))).alias("b"),
        )
    )
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return join_groups(scored, totals, []).select(
        F.col("_id").alias(row_id),
        F.col("_label").alias(label),
        "a",
        "b",
        F.when((F.col("_k") < 2) | (F.col("_k") >= F.col("_all")), 0.0).otherwise(value).alias("silhouette"),
    )


def silhouette_score(df: DataFrame, row_id: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(silhouette): the mean over all rows."""
    return silhouette(df, row_id, vector, label, block_rows).agg(F.avg("silhouette").alias("silhouette"))
