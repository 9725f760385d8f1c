"""Queries over fitted distribution functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.operators import analysis, distributions
from fidelis.operators import fits as fit_search
from fidelis.plans import fit_sql, sql
from fidelis.sources.tables import table


def _balances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")


def _auto(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return distributions.estimate(_balances(spark, sf), "c_acctbal", kind, ["c_mktsegment"], points=200)

    return query


def _weighed(spark: SparkSession, sf: str) -> DataFrame:
    return _balances(spark, sf).withColumn("w", (F.col("c_custkey") % 7).cast("double") + 0.5)


def _weighted(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return distributions.estimate(_weighed(spark, sf), "c_acctbal", kind, ["c_mktsegment"], points=200, weight="w")

    return query


def egdf_empirical(spark: SparkSession, sf: str) -> DataFrame:
    return distributions.estimate(_weighed(spark, sf), "c_acctbal", "egdf", ["c_mktsegment"], points=200, weight="w", empirical=True)


def mean_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return distributions.mean(_weighed(spark, sf), "c_acctbal", ["c_nationkey"], weight="w")


def _varying(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return distributions.varying_scale(_balances(spark, sf), "c_acctbal", kind, ["c_mktsegment"], points=200)

    return query


def _statistic(f, **more):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return f(_balances(spark, sf), "c_acctbal", ["c_nationkey"], **more)

    return query


def prices_m(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return distributions.mean(rows, "p_retailprice", ["p_brand"], form="m")


def error_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return distributions.error_means(rows, "l_extendedprice", "p", ["l_returnflag"])


def _small(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("k"), "s_acctbal")


def membership(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.membership_bounds(_small(spark, sf), "s_acctbal", ["k"])


def interval_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.interval_analysis(_small(spark, sf), "s_acctbal", ["k"], ["s_suppkey"])


def homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    found = analysis.homogeneity(_balances(spark, sf), "c_acctbal", ["c_nationkey"])
    return _peaks(found, "c_nationkey")


def homogeneity_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _peaks(analysis.homogeneity(_mixed(spark, sf), "x", ["c_mktsegment"]), "c_mktsegment")


def _peaks(found: DataFrame, key: str) -> DataFrame:
    each = found.select(key, "homogeneous", "z0", F.posexplode_outer("peaks").alias("i", "_p"))
    return each.select(key, "homogeneous", "z0", (F.col("i") + 1).alias("peak"), F.col("_p.position").alias("position"), F.col("_p.density").alias("density"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of which a third lie apart from the others."""
    return _balances(spark, sf).withColumn("x", F.col("c_acctbal") / 1000 + F.when(F.col("c_custkey") % 3 == 0, 40.0).otherwise(0.0))


def cluster_analysis_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.cluster_analysis(_mixed(spark, sf), "x", ["c_mktsegment"], homogeneous=False)


def stationarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    return analysis.stationarity(rows, "value", ["event_type"], ["ts"])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


def _paired(f, **more):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return f(_parts(spark, sf), "p_size", "p_retailprice", ["p_brand"], **more)

    return query


def autocovariances(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    daily = rows.groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    return analysis.autocovariances(daily, "value", ["event_type"], ["ts"], 1)


def local_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    found = analysis.local_clusters(rows, "c_acctbal", ["c_mktsegment"], [0.2, 0.4, 0.8])
    return analysis.assign_clusters(rows, found, "c_acctbal", ["c_mktsegment"])


_BALANCE = "SELECT c_nationkey, c_acctbal AS x FROM customer"
_SEGMENT = "SELECT c_mktsegment, c_acctbal AS x FROM customer"


_WEIGHED = "SELECT {}, c_acctbal AS x, c_custkey % 7 + 0.5 AS w FROM customer"


def _auto_sql(kind: str, weighted: bool = False, empirical: bool = False) -> str:
    fi, fj = sql.fi("r", "s"), sql.fj("r", "s")
    what = f"2 * (avg({fj}) - 1) AS residual_entropy, avg(({fj} - {fi}) / ({fj} + {fi})) AS relative_entropy"
    extra = f"n, dlb, dub, {fit_sql.data_bounds()}, s AS s_opt, s_local, loss, z0, "
    source = _WEIGHED.format("c_mktsegment") if weighted else _SEGMENT
    return fit_sql.whole(source, "c_mktsegment", kind, "a", 200, fit_sql.about_z0("c_mktsegment", "a", what, extra), weighted, empirical)


def _z0_sql(kind: str, name: str, points: int) -> str:
    return fit_sql.whole(_BALANCE, "c_nationkey", kind, "a", points, f"SELECT c_nationkey, z0 AS {name} FROM tops")


_PRICES = fit_sql.whole("SELECT p_brand, p_retailprice AS x FROM part", "p_brand", "eldf", "m", 100, "SELECT p_brand, z0 AS mean FROM tops")
_VARIANCE = fit_sql.whole(
    _BALANCE, "c_nationkey", "eldf", "a", 100, fit_sql.about_z0("c_nationkey", "a", f"avg(pow({sql.hi('r', 's_local')}, 2)) AS variance")
)
_ENTROPY = f"WITH {fit_sql.fit(_BALANCE, 'c_nationkey', 'egdf')}\nSELECT c_nationkey, 1 - mean_f AS entropy FROM fitted"

_MEAN_WEIGHTED = fit_sql.whole(
    _WEIGHED.format("c_nationkey"), "c_nationkey", "eldf", "a", 100, "SELECT c_nationkey, z0 AS mean FROM tops", True
)

_MIXED = "SELECT c_mktsegment, c_acctbal / 1000 + CASE WHEN c_custkey % 3 = 0 THEN 40.0 ELSE 0.0 END AS x FROM customer"


def _homogeneity_sql(source: str, key: str, points: int = 500) -> str:
    body = fit_sql.fit(source, key, "egdf") + f",\nlocals AS (SELECT {key}, s AS s_local FROM fitted)"
    body += fit_sql.tops(key, "egdf", "a", points) + fit_sql.flags(key, points)
    return f"""WITH RECURSIVE {body}
SELECT {key}, homogeneous, z0, peak::INTEGER AS peak, di AS position, pdf AS density
FROM flags JOIN tops USING ({key}) LEFT JOIN peaks USING ({key}) LEFT JOIN dense USING ({key}, point)"""


def _flagged(of: str, by: str, points: int, count: int | None = fit_search.PLACES) -> str:
    """A query of ({by}, homogeneous) for the rows ({by}, x) of `of`."""
    return f"""(WITH RECURSIVE {fit_sql.fit(of, by, "egdf", count=count)},
locals AS (SELECT {by}, s AS s_local FROM fitted){fit_sql.tops(by, "egdf", "a", points)}{fit_sql.flags(by, points)}
SELECT {by}, homogeneous FROM flags)"""


_DAILY = "SELECT event_type, date_trunc('day', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL"
_WINDOWS = f"""
WITH RECURSIVE daily AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM ({_DAILY})),
windows AS MATERIALIZED (
  SELECT a.event_type || '/' || a.i AS g, b.v AS x FROM daily a JOIN daily b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 9
  QUALIFY count(*) OVER (PARTITION BY a.event_type, a.i) = 10),
entropies AS MATERIALIZED (
  SELECT split_part(g, '/', 1) AS event_type, re AS x FROM (
    {fit_sql.whole("SELECT g, x FROM windows", "g", "egdf", "a", 100, fit_sql.about_z0("g", "a", f"2 * (avg({sql.fj('r', 's')}) - 1) AS re"))}))
SELECT event_type, count(*) AS windows, count(*) >= 10 AND any_value(homogeneous) AS stationary
FROM entropies JOIN {_flagged("SELECT event_type, x FROM entropies", "event_type", 100)} USING (event_type) GROUP BY event_type"""


_SIZES = "SELECT p_brand, p_size AS x, p_retailprice AS y FROM part"


def _correlation_sql(core: str, kept: str) -> str:
    x, y = (kept.replace("h,", f"{c}.h,") if "," in kept else f"{c}.h" for c in ("hx", "hy"))
    return f"""WITH {fit_sql.pairs(_SIZES, "p_brand", core, False)}
SELECT p_brand, sum({x} * {y}) / nullif(sqrt(sum({x} * {x}) * sum({y} * {y})), 0) AS correlation
FROM hx JOIN hy USING (p_brand, i, j) GROUP BY p_brand"""


_COVARIANCES = f"""WITH {fit_sql.pairs(_SIZES, "p_brand", "egdf", True)},
mx AS (SELECT p_brand, j, avg(h) AS x FROM hx GROUP BY ALL), my AS (SELECT p_brand, j, avg(h) AS y FROM hy GROUP BY ALL)
SELECT p_brand, avg(x * y) AS covariance FROM mx JOIN my USING (p_brand, j) GROUP BY p_brand"""

_LATER = f"SELECT event_type, v AS x, lead(v) OVER (PARTITION BY event_type ORDER BY ts) AS y FROM ({_DAILY})"
_AUTOCOVARIANCES = f"""WITH {fit_sql.pairs(_LATER, "event_type", "egdf", True)},
mx AS (SELECT event_type, j, avg(h) AS x FROM hx GROUP BY ALL), my AS (SELECT event_type, j, avg(h) AS y FROM hy GROUP BY ALL)
SELECT event_type, coalesce(sum(x * y) / nullif(count(*) - 1, 0), 0) AS covariance, sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0) AS correlation
FROM mx JOIN my USING (event_type, j) GROUP BY event_type"""


def _membership_sql(source: str, key: str, points: int = 500, steps: int = analysis.WALK_STEPS) -> str:
    """The walk's samples as groups of their own, named by group, side and step; each is fitted to all its rows."""
    total, offsets = 0.0, [0.0]
    for i in range(steps):
        total += analysis.WALK_STEP / (1 + analysis.WALK_DECAY * max(0, i - 1))
        offsets.append(total)
    walk = "(VALUES " + ", ".join(f"({i}, {o!r}::DOUBLE)" for i, o in enumerate(offsets)) + ")"
    longer = f"SELECT g, x FROM walked JOIN base USING ({key}) UNION ALL SELECT g, spot FROM walked"
    return f"""
WITH base AS MATERIALIZED (SELECT {key}, x::DOUBLE AS x FROM ({source}) WHERE isfinite(x::DOUBLE)),
ends AS (SELECT {key}, min(x) AS dlb, max(x) AS dub FROM base GROUP BY {key}),
walked AS MATERIALIZED (
  SELECT {key}, side, i, {key} || '/' || side || '/' || i AS g, CASE WHEN side < 0 THEN dlb - o * (dub - dlb) ELSE dub + o * (dub - dlb) END AS spot
  FROM ends, (VALUES (-1), (1)) s(side), {walk} w(i, o)),
stays AS MATERIALIZED (SELECT * FROM {_flagged(longer, "g", points, None)}),
refused AS (
  SELECT {key}, side, coalesce(greatest(0, min(i) FILTER (NOT homogeneous) - 1), {steps}) AS i FROM walked JOIN stays USING (g) GROUP BY ALL)
SELECT {key}, max(spot) FILTER (side < 0) AS lsb, max(spot) FILTER (side > 0) AS usb FROM walked JOIN refused USING ({key}, side, i) GROUP BY {key}"""


_SUPPLIERS = "SELECT s_nationkey % 3 AS k, s_acctbal AS x FROM supplier"
_SCEDASTICITY = f"""SELECT c_nationkey, NOT heteroscedastic AS homoscedastic, least(s_low, s_high) AS least_scale, greatest(s_low, s_high) AS greatest_scale
FROM ({fit_sql.varying(_BALANCE, "c_nationkey", "eldf", "a", 2)})"""

QUERIES = {
    **{f"{k}_auto": (_auto(k), _auto_sql(k)) for k in ("egdf", "eldf", "qgdf", "qldf")},
    **{f"{k}_weighted": (_weighted(k), _auto_sql(k, True)) for k in ("egdf", "eldf", "qgdf", "qldf")},
    "egdf_empirical": (egdf_empirical, _auto_sql("egdf", True, True)),
    "mean_weighted": (mean_weighted, _MEAN_WEIGHTED),
    **{f"{k}_varying": (_varying(k), fit_sql.varying(_SEGMENT, "c_mktsegment", k, "a", 200)) for k in ("eldf", "qldf")},
    "mean": (_statistic(distributions.mean), _z0_sql("eldf", "mean", 100)),
    "mean_j": (_statistic(distributions.mean, case="j"), _z0_sql("qldf", "mean", 100)),
    "mean_m": (prices_m, _PRICES),
    "median": (_statistic(distributions.median), _z0_sql("egdf", "median", 500)),
    "variance": (_statistic(distributions.variance), _VARIANCE),
    "std": (_statistic(distributions.std), None),
    "entropy": (_statistic(distributions.entropy), _ENTROPY),
    "error_means": (error_means, None),
    "homogeneity": (homogeneity, _homogeneity_sql(_BALANCE, "c_nationkey")),
    "homogeneity_mixed": (homogeneity_mixed, _homogeneity_sql(_MIXED, "c_mktsegment")),
    "scedasticity": (_statistic(analysis.scedasticity), _SCEDASTICITY),
    "cluster_analysis": (_statistic(analysis.cluster_analysis), fit_sql.cluster_analysis(_BALANCE, "c_nationkey", 1000, 0.01)),
    "cluster_analysis_mixed": (
        cluster_analysis_mixed,
        fit_sql.cluster_analysis(fit_sql.robust(_MIXED, "c_mktsegment"), "c_mktsegment", 1000, 0.01, True),
    ),
    "membership": (membership, _membership_sql(_SUPPLIERS, "k")),
    "interval_analysis": (interval_analysis, None),
    "stationarity": (stationarity, _WINDOWS),
    "correlation": (_paired(analysis.correlation), _correlation_sql("egdf", "h")),
    "correlation_j": (_paired(analysis.correlation, case="j"), _correlation_sql("qgdf", "greatest(least(h, 1e12), 1.0)")),
    "covariances": (_paired(analysis.covariances), _COVARIANCES),
    "autocovariances": (autocovariances, _AUTOCOVARIANCES),
    "local_clusters": (local_clusters, None),
}
