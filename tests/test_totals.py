"""Rows do not move to their groups' totals where groups are few."""

from pyspark.sql import functions as F

from fidelis.operators import totals


def test_rows_of_few_groups_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
        out = totals.with_totals(rows, ["k"], F.count("*").alias("n"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [tuple(r) for r in out.groupBy("k").agg(F.min("n"), F.max("n"), F.count("*")).orderBy("k").collect()] == [(k, 1000, 1000, 1000) for k in (None, 1, 2)]
        many = totals.with_totals(spark.range(totals.FEW + 2).withColumn("k", F.col("id") + 1), ["k"], F.count("*").alias("n"))
        assert many.count() == totals.FEW + 2 and many.filter("n <> 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
