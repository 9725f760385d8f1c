"""Rounded values that come to zero keep their sign, as the queries' SQL has them."""

import math

import duckdb
from pyspark.sql import functions as F

from fidelis.functions import rounded
from fidelis.plans import expressions


def test_sign_of_zero(spark):
    values = [-4e-6, 4e-6, -0.0, 0.0, -6e-6, 1.23456789, -1.23456789, None, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r["y"] for r in rows.select("i", rounded(F.col("x"), 5).alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert [str(v) for v in got] == [str(v) for v in want] and str(got[0]) == "-0.0"


def test_characteristics_about_the_median(spark, tmp_path):
    prices = [100.0, 100.0 - 1e-4, 100.0 + 1e-4, 50.0, 200.0]
    rows = spark.createDataFrame([(i, 1, "A", p) for i, p in enumerate(prices)], "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    for query, sql, column in ((expressions.characteristics_j, expressions.CHARACTERISTICS_J, "hj"), (expressions.criterion_cases, expressions.CRITERION_CASES, "error_Q3")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        want = dict(con.execute(f'SELECT l_orderkey, "{column}" FROM ({sql})').fetchall())
        got = {r["l_orderkey"]: r[column] for r in query(spark, str(tmp_path)).collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()} and "-0.0" in map(str, got.values())
