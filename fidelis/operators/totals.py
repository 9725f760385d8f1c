"""Group totals, exact medians and running sums that scale with the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.operators.lineage import cut


#: Groups whose rows are broadcast once they are known.
FEW = 20_000


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins rows with their group's row; null keys match null keys.

    Without keys `groups` has one row, which is broadcast.
    """
    if not keys:
        return df.crossJoin(F.broadcast(groups))
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(named, on, how).drop(*[f"_g_{k}" for k in keys])


def join_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """join_groups() with groups' totals, checkpointed first: where groups are FEW, rows are not shuffled.

    By Spark's estimate an aggregate is as large as its input, so rows would be dealt out by
    their keys, and a large group's rows be sorted in one task.
    """
    known = cut(totals)
    return join_groups(df, F.broadcast(known) if known.count() <= FEW else known, keys)


def with_totals(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's group: partial sums, one small shuffle, a join by size."""
    return join_totals(df, df.groupBy(*keys).agg(*aggregates), keys)


def valid(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all `columns` are numbers: neither null nor NaN nor infinite."""
    keep = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        keep = keep & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.filter(keep)


def exact_median(df: DataFrame, keys: list[str], column: str, name: str, count: str | None = None) -> DataFrame:
    """(keys, name): the exact median of each group, without holding a group in memory.

    A sketch with a rank error of 1/10000 brackets the middle; the rows below are counted,
    and only the bracket's distinct values, about a 500th of a large group, are ranked.
    Rows that stand for `count` rows each are counted so, and all distinct values are ranked.
    """
    if count is not None:
        rows = df.select(*keys, F.col(column).cast("double").alias("_x"), F.col(count).alias("_c")).filter("_x is not null and not isnan(_x)")
        values = rows.groupBy(*keys, "_x").agg(F.sum("_c").alias("_c"))
        return _middle(values, rows.groupBy(*keys).agg(F.lit(0).alias("_below"), F.sum("_c").alias("_n")), keys, name)
    rows = df.select(*keys, F.col(column).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_x", F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000)).alias("_q"),
        F.count("*").alias("_n"),
    )
    near = join_totals(rows, sketch.select(*keys, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_n"), keys)
    below = near.groupBy(*keys).agg(F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.first("_n").alias("_n"))
    values = near.filter("_x between _lo and _hi").groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    return _middle(values, below, keys, name)


def _middle(values: DataFrame, below: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the median, from its group's size _n, the rows _below those of `values`, and these with counts _c."""
    ends = running(values, keys, "_x", F.col("_c"), "_end", [])
    ranked = join_groups(ends, below, keys).withColumn("_end", F.col("_below") + F.col("_end"))
    covers = lambda r: (F.col("_end") >= r) & (F.col("_end") - F.col("_c") < r)
    low, high = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(covers(low), F.col("_x"))) + F.max(F.when(covers(high), F.col("_x")))) / 2).alias(name)
    )


def running(df: DataFrame, keys: list[str], order: str, amount: Column, name: str, ties: list[str]) -> DataFrame:
    """Adds `name`: the sum of `amount` over the group's rows up to and with this one.

    Rows are ordered by the number `order`, then `ties`; see running_sums().
    """
    return running_sums(df, keys, order, {name: amount}, ties)


def running_sums(
    df: DataFrame, keys: list[str], order: str, amounts: dict[str, Column], ties: list[str], before: dict[str, Column] | None = None
) -> DataFrame:
    """Adds each of `amounts`' sums over the group's rows up to and with this one, and of `before` the value of the row before it.

    Rows are dealt out by ranges of the keys and the order, which Spark takes from a sample, so
    neither outliers nor many equal values gather in one task; rows alike in all columns do. They
    are summed up within their range, and the sums of a group's earlier ranges, a row a
    range, are added. The dealt rows are checkpointed, as ranges must not move between the two.
    """
    totals, lasts = ({f"_{n}{i}": c for i, c in enumerate(d.values())} for n, d in (("amount", amounts), ("before", before or {})))
    by = [*keys, order, *ties]
    spread = df.withColumns(totals | lasts).repartitionByRange(*by, F.xxhash64(*df.columns, *totals.values()))
    dealt = cut(spread.withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max_by(c, F.struct(order, *ties)).alias(c) for c in lasts]
    ranges = dealt.groupBy(*keys, "_range").agg(*[F.sum(t).alias(t) for t in totals], *ends)
    starts = ranges.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_start") for t in totals],
        *[F.last(c).over(earlier).alias(f"{c}_start") for c in lasts],
    )
    line = Window.partitionBy(*keys, "_range").orderBy(order, *ties)
    within = line.rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"{t}_within": F.sum(t).over(within) for t in totals} | {f"{c}_within": F.lag(c).over(line) for c in lasts}
    added = {name: F.col(f"{t}_start") + F.col(f"{t}_within") for name, t in zip(amounts, totals, strict=True)}
    added |= {name: F.coalesce(f"{c}_within", f"{c}_start") for name, c in zip(before or {}, lasts, strict=True)}
    return join_totals(dealt.withColumns(inside), starts, [*keys, "_range"]).withColumns(added).select(*df.columns, *added)
