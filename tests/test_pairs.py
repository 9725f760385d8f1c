"""Pairs of ranks: ranks of the same values are met once, with their count."""

from pyspark.sql import functions as F

from fidelis.operators import analysis, fits


def test_copies_of_rows_add_no_pairs(spark):
    rows = spark.range(40).select(F.lit(1).alias("k"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") * 7 % 8).cast("double").alias("b"))
    often = rows.crossJoin(spark.range(60)).drop("id")
    met = [fits.rank_pairs(df, "a", "b", ["k"]).select(F.explode(F.arrays_zip("_xs", "_ys", "_cs")).alias("e")).select("e.*").collect() for df in (rows, often)]
    assert len(met[0]) == len(met[1]) <= 12 and sum(r["_cs"] for r in met[1]) == 2400
    assert {(r["_xs"], r["_ys"], 60 * r["_cs"]) for r in met[0]} == {tuple(r) for r in met[1]}
    fitted = spark.createDataFrame([(1, 0.0, 7.0, 1.0, 0.2, 6.0)], "k int, dlb double, dub double, s_opt double, lb double, ub double")
    one, many = (fits.pair_sums(fits.rank_pairs(df, "a", "b", ["k"]), (fitted, fitted), ["k"], "a", "i", False).first() for df in (rows, often))
    assert one["n"] == 1600 and all(abs(many[c] - 3600 * one[c]) <= 1e-9 * abs(many[c]) for c in ("xy", "xx", "yy", "n"))
    assert analysis.correlation(rows, "a", "b", ["k"]).count() == 1
