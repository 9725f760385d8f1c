"""Classification metrics from one count of (true, predicted) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """(y_true, y_pred, n): everything below needs only these few rows. Null labels are left out."""
    return (
        df.select(F.col(y).alias("y_true"), F.col(predicted).alias("y_pred"))
        .dropna()
        .groupBy("y_true", "y_pred")
        .agg(F.count("*").alias("n"))
    )


def accuracy(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """(accuracy): the share of equal pairs; null for no rows."""
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return pair_counts(df, y, predicted).agg(F.try_divide(hit, F.sum("n")).alias("accuracy"))


def _labels(counts: DataFrame, labels: list | None) -> DataFrame:
    found = counts.select(F.col("y_true").alias("label")).union(counts.select("y_pred")).distinct()
    return found if labels is None else found.sparkSession.createDataFrame([(x,) for x in labels], found.schema)


def class_scores(df: DataFrame, y: str, predicted: str, labels: list | None = None) -> DataFrame:
    """(label, precision, recall, f1, support) of each label; 0 where a share has no rows.

    `labels` picks labels, which may have no rows; by default all of either side.
    """
    counts = pair_counts(df, y, predicted)
    hits = counts.filter("y_true = y_pred").select(F.col("y_true").alias("label"), F.col("n").alias("_tp"))
    true = counts.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    told = counts.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("_told"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = _labels(counts, labels).join(hits, "label", "left").join(true, "label", "left").join(told, "label", "left")
    share = lambda a, b: F.coalesce(F.try_divide(zero(a), b), F.lit(0.0))
    scored = rows.select(
        "label",
        share(F.col("_tp"), F.col("_told")).alias("precision"),
        share(F.col("_tp"), F.col("support")).alias("recall"),
        zero(F.col("support")).alias("support"),
        zero(F.col("_tp")).alias("_tp"),
        zero(F.col("_told")).alias("_told"),
    )
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def averaged(df: DataFrame, y: str, predicted: str, average: str = "binary", labels: list | None = None) -> DataFrame:
    """(precision, recall, f1) over labels.

    'binary' takes the greater of exactly two labels, 'micro' sums counts, 'macro' weighs
    labels alike, 'weighted' by support, and 'none' gives a row for each label.
    """
    scores = class_scores(df, y, predicted, labels)
    names = ("precision", "recall", "f1")
    if average == "none":
        return scores.select("label", *names)
    if average == "macro":
        return scores.agg(*[F.avg(c).alias(c) for c in names])
    if average == "weighted":
        return scores.agg(
            *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in names]
        )
    if average == "micro":
        share = lambda b: F.coalesce(F.try_divide(F.sum("_tp"), F.sum(b)), F.lit(0.0))
        return scores.agg(share("_told").alias("precision"), share("support").alias("recall")).withColumn(
            "f1", _f1(F.col("precision"), F.col("recall"))
        )
    if average == "binary":
        two = F.raise_error("binary averages need exactly two labels")
        pick = F.max(F.struct("label", *names))
        return (
            scores.agg(pick.alias("_s"), F.count("*").alias("_k"))
            .select(*[F.when(F.col("_k") == 2, F.col(f"_s.{c}")).otherwise(two.cast("double")).alias(c) for c in names])
        )
    raise ValueError(f"unknown average {average!r}")


def confusion_matrix(df: DataFrame, y: str, predicted: str, labels: list | None = None) -> DataFrame:
    """(y_true, y_pred, n) for every pair of labels, zeros too; pairs with other labels are left out."""
    counts = pair_counts(df, y, predicted)
    names = _labels(counts, labels)
    # the label set is small and its square is the result itself
    grid = names.select(F.col("label").alias("y_true")).crossJoin(names.select(F.col("label").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def report(df: DataFrame, y: str, predicted: str, labels: list | None = None, digits: int = 2) -> DataFrame:
    """(label, precision, recall, f1, support): each label as text and 'avg / total', rounded."""
    scores = class_scores(df, y, predicted, labels)
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    rounded = [F.round(F.col(c), digits).alias(c) for c in names]
    each = scores.select(F.col("label").cast("string").alias("label"), *rounded, "support")
    mean = scores.agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)).alias(c) for c in names],
        total.alias("support"),
    ).select(F.lit("avg / total").alias("label"), *rounded, "support")
    return each.unionByName(mean)


def format_report(rows: list, digits: int = 2) -> str:
    """The collected rows of report() as a text table."""
    lines = [f"{'':>16}{'precision':>12}{'recall':>12}{'f1':>12}{'support':>12}"]
    for r in rows:
        lines.append(f"{r['label']:>16}" + "".join(f"{r[c]:>12.{digits}f}" for c in ("precision", "recall", "f1")) + f"{r['support']:>12}")
    return "\n".join(lines)
