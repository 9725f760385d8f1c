"""Queries over column expressions, group scales and weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis import functions as G
from fidelis.operators import weights
from fidelis.operators.totals import with_totals
from fidelis.plans import sql as S
from fidelis.sources.tables import table


def _r(c, digits: int = 6):
    return G.rounded(F.col(c) if isinstance(c, str) else c, digits)


def convert_az(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_totals(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], F.min("s_acctbal").alias("lb"), F.max("s_acctbal").alias("ub"))
    z = G.az(F.col("s_acctbal"), F.col("lb"), F.col("ub"))
    return rows.select("s_suppkey", _r(z).alias("z"))


CONVERT_AZ = f"""
SELECT s_suppkey, round({S.az('s_acctbal', 'lb', 'ub')}, 6) AS z
FROM (SELECT *, min(s_acctbal) OVER w AS lb, max(s_acctbal) OVER w AS ub FROM supplier WINDOW w AS (PARTITION BY s_nationkey))
"""


def convert_za(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_totals(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), [], F.min("s_acctbal").alias("lb"), F.max("s_acctbal").alias("ub"))
    z = G.az(F.col("s_acctbal"), F.col("lb"), F.col("ub"))
    return rows.withColumn("z", z).select("s_suppkey", _r(G.za(F.col("z"), F.col("lb"), F.col("ub")), 4).alias("a"))


CONVERT_ZA = f"""
SELECT s_suppkey, round((ln(abs(z) + 1e-6) * (ub - lb) + lb + ub) / 2, 4) AS a
FROM (SELECT s_suppkey, lb, ub, {S.az('s_acctbal', 'lb', 'ub')} AS z
  FROM supplier, (SELECT min(s_acctbal) AS lb, max(s_acctbal) AS ub FROM supplier))
"""


def convert_mz(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("x"))
    bounded = with_totals(rows, ["l_returnflag"], F.min("x").alias("lb"), F.max("x").alias("ub"))
    return bounded.select("l_orderkey", "l_linenumber", _r(G.mz(F.col("x"), F.col("lb"), F.col("ub"))).alias("z"))


CONVERT_MZ = """
SELECT l_orderkey, l_linenumber, round(exp(ln(x / lb) * 2 / ln(ub / lb) - 1), 6) AS z
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, min(l_extendedprice) OVER w AS lb, max(l_extendedprice) OVER w AS ub
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))
"""


def convert_zm(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_totals(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("x")), [], F.min("x").alias("lb"), F.max("x").alias("ub"))
    lb, ub = F.col("lb"), F.col("ub")
    return rows.withColumn("z", G.mz(F.col("x"), lb, ub)).select("p_partkey", _r(G.zm(F.col("z"), lb, ub), 4).alias("m"))


CONVERT_ZM = """
SELECT p_partkey, round(lb * sqrt(ub / lb) * pow(z, ln(sqrt(ub / lb))), 4) AS m
FROM (SELECT p_partkey, lb, ub, exp(ln(p_retailprice / lb) * 2 / ln(ub / lb) - 1) AS z
  FROM part, (SELECT min(p_retailprice) AS lb, max(p_retailprice) AS ub FROM part))
"""


def convert_fininf(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_totals(table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x")), [], F.min("x").alias("lb"), F.max("x").alias("ub"))
    z = G.az(F.col("x"), F.col("lb"), F.col("ub"))
    inner = G.fininf(F.col("z"), F.lit(0.1353), F.lit(7.389))
    return rows.withColumn("z", z).select("s_suppkey", _r(inner).alias("zi"), _r(G.inffin(inner, F.lit(0.1353), F.lit(7.389))).alias("back"))


CONVERT_FININF = f"""
SELECT s_suppkey, round(zi, 6) AS zi, round((zi + 0.1353) / (1 + zi / 7.389), 6) AS back
FROM (SELECT s_suppkey, {S.fininf('z', '0.1353', '7.389')} AS zi FROM (
  SELECT s_suppkey, {S.az('s_acctbal', 'lb', 'ub')} AS z
  FROM supplier, (SELECT min(s_acctbal) AS lb, max(s_acctbal) AS ub FROM supplier)))
"""


def zi_bounds(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    a, m = (G.probable_bounds(F.col("lo"), F.col("hi"), form) for form in "am")
    names = ("lb_a", "ub_a", "lb_m", "ub_m")
    return groups.select("l_returnflag", *[_r(c, 4).alias(n) for c, n in zip((*a, *m), names, strict=True)])


ZI_BOUNDS = """
SELECT l_returnflag, round(lo - (hi - lo) / 2, 4) AS lb_a, round(hi + (hi - lo) / 2, 4) AS ub_a,
  round(lo / sqrt(hi / lo), 4) AS lb_m, round(hi * sqrt(hi / lo), 4) AS ub_m
FROM (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL)
"""

_RATIOS = "(SELECT l_orderkey, l_linenumber, l_extendedprice / median(l_extendedprice) OVER (PARTITION BY l_returnflag) AS r FROM lineitem)"


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    from fidelis.operators.totals import exact_median, join_totals

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    centred = join_totals(rows, exact_median(rows, ["l_returnflag"], "l_extendedprice", "m"), ["l_returnflag"])
    return centred.select("l_orderkey", "l_linenumber", F.try_divide(F.col("l_extendedprice"), F.col("m")).alias("r"))


def characteristics_i(spark: SparkSession, sf: str) -> DataFrame:
    pair = G.q_pair(F.col("r"), 1.3)
    f, h = G.fidelity_i(*pair), G.irrelevance_i(*pair)
    return _ratios(spark, sf).select(
        "l_orderkey", "l_linenumber", _r(f).alias("fi"), _r(h).alias("hi"), _r(G.entropy_i(f)).alias("ei"), _r(G.probability(h)).alias("pi")
    )


CHARACTERISTICS_I = f"""
SELECT l_orderkey, l_linenumber, round({S.fi('r', '1.3')}, 6) AS fi, round({S.hi('r', '1.3')}, 6) AS hi,
  round(1 - {S.fi('r', '1.3')}, 6) AS ei, round(abs(1 - {S.hi('r', '1.3')}) / 2, 6) AS pi
FROM {_RATIOS}
"""


def characteristics_j(spark: SparkSession, sf: str) -> DataFrame:
    pair = G.q_pair(F.col("r"), 1.3)
    fi, fj, hj = G.fidelity_i(*pair), G.fidelity_j(*pair), G.irrelevance_j(*pair)
    return _ratios(spark, sf).select(
        "l_orderkey", "l_linenumber", _r(fj, 5).alias("fj"), _r(hj, 5).alias("hj"), _r(G.entropy_j(fj), 5).alias("ej"),
        _r(G.probability(hj), 5).alias("pj"), _r(G.residual_entropy(fi, fj), 5).alias("re"),
    )


CHARACTERISTICS_J = f"""
SELECT l_orderkey, l_linenumber, round({S.fj('r', '1.3')}, 5) AS fj, round({S.hj('r', '1.3')}, 5) AS hj,
  round({S.fj('r', '1.3')} - 1, 5) AS ej, round(abs(1 - {S.hj('r', '1.3')}) / 2, 5) AS pj,
  round({S.fj('r', '1.3')} - {S.fi('r', '1.3')}, 5) AS re
FROM {_RATIOS}
"""


def entropy_info(spark: SparkSession, sf: str) -> DataFrame:
    pair = G.q_pair(F.col("r"), 2.0)
    i, j = G.information(G.probability(G.irrelevance_i(*pair))), G.information(G.probability(G.irrelevance_j(*pair)))
    return _ratios(spark, sf).select("l_orderkey", "l_linenumber", _r(i).alias("info_i"), _r(j).alias("info_j"))


ENTROPY_INFO = f"""
SELECT l_orderkey, l_linenumber, round({S.info(f"abs(1 - {S.hi('r', '2.0')}) / 2")}, 6) AS info_i,
  round({S.info(f"abs(1 - {S.hj('r', '2.0')}) / 2")}, 6) AS info_j
FROM {_RATIOS}
"""


def criterion_cases(spark: SparkSession, sf: str) -> DataFrame:
    pair = G.q_pair(F.col("r"), 2.0)
    c = {"fi": G.fidelity_i(*pair), "fj": G.fidelity_j(*pair), "hi": G.irrelevance_i(*pair), "hj": G.irrelevance_j(*pair)}
    named = _ratios(spark, sf).select("l_orderkey", "l_linenumber", *[x.alias(n) for n, x in c.items()])
    fi, fj, hi, hj = (F.col(x) for x in ("fi", "fj", "hi", "hj"))
    infos = G.information(G.probability(hi)), G.information(G.probability(hj))
    out = []
    for case in ("Q1", "Q2", "Q3", "E1", "E2", "E3"):
        out += [
            _r(G.criterion_error(case, fi, fj, hi, hj), 5).alias(f"error_{case}"),
            _r(G.filter_weight(case, fi, fj), 5).alias(f"weight_{case}"),
            _r(G.criterion(case, fi, fj, hi, hj, *infos), 5).alias(f"criterion_{case}"),
        ]
    return named.select("l_orderkey", "l_linenumber", *out)


CRITERION_CASES = f"""
SELECT l_orderkey, l_linenumber,
  round(fj, 5) AS "error_Q1", round(fj * atan(hj), 5) AS "error_Q2", round(sqrt(fj) * hj, 5) AS "error_Q3",
  round(fi, 5) AS "error_E1", round(fi * atanh(hi), 5) AS "error_E2", round(sqrt(fi) * hi, 5) AS "error_E3",
  round(fj, 5) AS "weight_Q1", 1.0::DOUBLE AS "weight_Q2", round(1 / sqrt(fj), 5) AS "weight_Q3",
  round(fi * fi, 5) AS "weight_E1", round(fi, 5) AS "weight_E2", round(1 / sqrt(fi), 5) AS "weight_E3",
  round(hi * hi / 2, 5) AS "criterion_Q1", round({S.info('abs(1 - hj) / 2')}, 5) AS "criterion_Q2", round(fj, 5) AS "criterion_Q3",
  round(hj * hj / 2, 5) AS "criterion_E1", round({S.info('abs(1 - hi) / 2')}, 5) AS "criterion_E2", round(-fi, 5) AS "criterion_E3"
FROM (SELECT l_orderkey, l_linenumber, {S.fi('r', '2.0')} AS fi, {S.fj('r', '2.0')} AS fj, {S.hi('r', '2.0')} AS hi, {S.hj('r', '2.0')} AS hj FROM {_RATIOS})
"""


def gnostic_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    return weights.group_scales(rows, "o_totalprice", ["o_orderpriority"]).select("o_orderpriority", _r("z0", 4).alias("z0"), _r("scale").alias("scale"))


GNOSTIC_SCALE = f"""
WITH RECURSIVE c AS (SELECT o_orderpriority, o_totalprice AS x, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS z0 FROM orders),
m AS (SELECT o_orderpriority, any_value(z0) AS z0, avg({S.fi('x / z0')}) AS f FROM c GROUP BY ALL),
{S.newton('m', ['o_orderpriority'], 'f')}
SELECT o_orderpriority, round(z0, 4) AS z0, round(scale, 6) AS scale FROM m JOIN scaled USING (o_orderpriority)
"""


def gnostic_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return weights.gnostic_weights(rows, "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", _r("weight").alias("weight"))


def _scaled(keys: list[str], columns: str, source: str, x: str) -> str:
    k = ", ".join(keys)
    return f"""
c AS (SELECT {columns}, {x} AS x, median({x}) OVER (PARTITION BY {k}) AS z0 FROM {source}),
m AS (SELECT {k}, avg({S.fi('x / z0')}) AS f FROM c GROUP BY ALL),
{S.newton('m', keys, 'f')},
r AS (SELECT {columns}, x / z0 AS r, scale AS s FROM c JOIN scaled USING ({k}))"""


GNOSTIC_WEIGHTS = f"""
WITH RECURSIVE {_scaled(['l_returnflag'], 'l_orderkey, l_linenumber, l_returnflag', 'lineitem', 'l_extendedprice')}
SELECT l_orderkey, l_linenumber, round({S.fi('r', 's')} * {S.fi('r', 's')}, 6) AS weight FROM r
"""


def sample_characteristics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    out = weights.sample_characteristics(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    names = ("mean_fidelity", "mean_irrelevance", "modulus", "variance")
    return out.select("l_returnflag", "l_linestatus", "n", *[_r(c).alias(c) for c in names])


SAMPLE_CHARACTERISTICS = f"""
WITH RECURSIVE {_scaled(['l_returnflag', 'l_linestatus'], 'l_returnflag, l_linestatus', 'lineitem', 'l_extendedprice')},
v AS (SELECT l_returnflag, l_linestatus, {S.fi('r', 's')} AS f, {S.hi('r', 's')} AS h FROM r)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(f), 6) AS mean_fidelity, round(avg(h), 6) AS mean_irrelevance,
  round(sqrt(abs(avg(f) * avg(f) + avg(h) * avg(h))), 6) AS modulus, round(avg(h * h), 6) AS variance
FROM v GROUP BY ALL
"""


def sample_autocovariance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return weights.sample_autocovariance(rows, "value", ["user_id"], ["ts", "event_id"], 2).select("user_id", _r("autocovariance").alias("autocovariance"))


SAMPLE_AUTOCOVARIANCE = f"""
SELECT user_id, round(sum(h * later) / nullif(count(*) - 2, 0), 6) AS autocovariance FROM (
  SELECT user_id, h, lead(h, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM (
    SELECT user_id, ts, event_id, {S.hi('(value / z0)')} AS h FROM (
      SELECT user_id, ts, event_id, value, nullif(median(value) OVER (PARTITION BY user_id), 0) AS z0 FROM events)))
GROUP BY user_id
"""


def sample_crosscovariance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return weights.sample_crosscovariance(rows, "l_quantity", "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", _r("crosscovariance").alias("crosscovariance"), _r("correlation").alias("correlation")
    )


SAMPLE_CROSSCOVARIANCE = f"""
WITH RECURSIVE c AS (SELECT l_returnflag, l_quantity / median(l_quantity) OVER w AS a, l_extendedprice / median(l_extendedprice) OVER w AS b
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
m AS (SELECT l_returnflag, avg({S.fi('a')}) AS fa, avg({S.fi('b')}) AS fb FROM c GROUP BY ALL),
{S.newton('m', ['l_returnflag'], 'fa', 'na', 'sa')}, {S.newton('m', ['l_returnflag'], 'fb', 'nb', 'sb')},
v AS (SELECT l_returnflag, {S.hi('a', 'sa')} AS ha, {S.hi('b', 'sb')} AS hb FROM c JOIN na USING (l_returnflag) JOIN nb USING (l_returnflag))
SELECT l_returnflag, round(avg(ha * hb), 6) AS crosscovariance, round(avg(ha * hb) / sqrt(avg(ha * ha) * avg(hb * hb)), 6) AS correlation
FROM v GROUP BY ALL
"""


def poly_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return rows.select("l_orderkey", "l_linenumber", *[_r(c).alias(n) for n, c in G.polynomial_terms(["x", "y"], 3)])


POLY_FEATURES = """
SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS one, round(x, 6) AS x, round(y, 6) AS y, round(x * x, 6) AS x__x, round(x * y, 6) AS x__y,
  round(y * y, 6) AS y__y, round(x * x * x, 6) AS x__x__x, round(x * x * y, 6) AS x__x__y, round(x * y * y, 6) AS x__y__y, round(y * y * y, 6) AS y__y__y
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y FROM lineitem)
"""


def softmax_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") / 10.0, 2.0 - F.col("p_size") / 25.0, F.lit(1.0)).alias("logits"))
    p = G.softmax(F.col("logits"))
    rows = rows.select("p_partkey", p.alias("p"), _r(G.sigmoid(F.col("logits")[0] - 2)).alias("sigmoid"))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return rows.select("p_partkey", *[_r(F.col("p")[k]).alias(f"p{k}") for k in range(3)], best.alias("best"), "sigmoid", _r(G.one_hot(best, 3)[1]).alias("is_1"))


SOFTMAX_PREDICT = """
SELECT p_partkey, round(exp(a - m) / t, 6) AS p0, round(exp(b - m) / t, 6) AS p1, round(exp(c - m) / t, 6) AS p2,
  (CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END)::INTEGER AS best, round(1 / (1 + exp(2 - a)), 6) AS sigmoid,
  (CASE WHEN a <> m AND b = m THEN 1 ELSE 0 END)::DOUBLE AS is_1
FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS t FROM (
  SELECT *, greatest(a, b, c) AS m FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, 2.0 - p_size / 25.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM part)))
"""

QUERIES = {
    f.__name__: (f, text)
    for f, text in (
        (convert_az, CONVERT_AZ),
        (convert_za, CONVERT_ZA),
        (convert_mz, CONVERT_MZ),
        (convert_zm, CONVERT_ZM),
        (convert_fininf, CONVERT_FININF),
        (zi_bounds, ZI_BOUNDS),
        (characteristics_i, CHARACTERISTICS_I),
        (characteristics_j, CHARACTERISTICS_J),
        (entropy_info, ENTROPY_INFO),
        (criterion_cases, CRITERION_CASES),
        (gnostic_scale, GNOSTIC_SCALE),
        (gnostic_weights, GNOSTIC_WEIGHTS),
        (sample_characteristics, SAMPLE_CHARACTERISTICS),
        (sample_autocovariance, SAMPLE_AUTOCOVARIANCE),
        (sample_crosscovariance, SAMPLE_CROSSCOVARIANCE),
        (poly_features, POLY_FEATURES),
        (softmax_predict, SOFTMAX_PREDICT),
    )
}
