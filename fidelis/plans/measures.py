"""Queries over metrics, empirical functions, curves, series and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions import rounded
from fidelis.models import selection
from fidelis.operators import classification, empirical, metrics, moments, peaks, series, silhouette
from fidelis.plans import sql as S
from fidelis.sources.tables import table


def _r(c, digits: int = 6):
    return rounded(F.col(c) if isinstance(c, str) else c, digits)


def _fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), F.col("l_tax"), F.col("l_quantity"))
    return rows.withColumn("p", F.col("l_quantity") * 1000 + 5000).withColumn("w", 1 + F.col("l_tax"))


_FIT = "(SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * 1000 + 5000 AS p, 1 + l_tax AS w FROM lineitem)"


def r2(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.r2_score(_fit(spark, sf), "y", "p", ["l_returnflag"], features=2)
    return out.select("l_returnflag", _r("r2").alias("r2"), _r("adjusted_r2").alias("adjusted_r2"))


R2 = f"""
SELECT l_returnflag, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2 FROM (
  SELECT l_returnflag, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, count(*) AS n FROM {_FIT} GROUP BY ALL)
"""


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.evaluation(_fit(spark, sf), "y", "p", ["l_returnflag"], weight="w")
    return out.select("l_returnflag", *[_r(c).alias(c) for c in ("robr2", "gmmfe", "divi", "evalmet")])


_INFO = {x: S.info(f"abs(1 - {S.hi(f'({x} / {x}0)')}) / 2") for x in "yp"}
EVALUATION = f"""
WITH f AS (SELECT *, y - p AS e, median(y) OVER g AS y0, median(p) OVER g AS p0,
    sum(w * (y - p)) OVER g / sum(w) OVER g AS em, sum(w * y) OVER g / sum(w) OVER g AS ym
  FROM {_FIT} WINDOW g AS (PARTITION BY l_returnflag)),
a AS (SELECT l_returnflag, 1 - sum(w * (e - em) * (e - em)) / sum(w * (y - ym) * (y - ym)) AS robr2,
  exp(avg(least(abs(ln(greatest(y / p, 1e-10))), 100))) AS gmmfe, avg({_INFO['y']} / {_INFO['p']}) AS divi FROM f GROUP BY ALL)
SELECT l_returnflag, round(robr2, 6) AS robr2, round(gmmfe, 6) AS gmmfe, round(divi, 6) AS divi, round(robr2 / (gmmfe * divi), 6) AS evalmet FROM a
"""


def legacy_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.legacy_evaluation(_fit(spark, sf), "y", "p", ["l_returnflag"], weight="w")
    return out.select("l_returnflag", *[_r(c).alias(c) for c in ("robr2", "gmmfe", "divi", "evalmet")])


LEGACY_EVALUATION = f"""
WITH f AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM {_FIT}),
a AS (SELECT l_returnflag, 1 - sum(w * (y - p) * (y - p)) / sum(w * (y - m) * (y - m)) AS robr2,
  exp(avg(abs(ln(y / p)))) AS gmmfe, avg((abs(y) + 1e-10) / (abs(p) + 1e-10)) AS divi FROM f GROUP BY ALL)
SELECT l_returnflag, round(robr2, 6) AS robr2, round(gmmfe, 6) AS gmmfe, round(divi, 6) AS divi, round(robr2 / (gmmfe * divi), 6) AS evalmet FROM a
"""


def hc(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.h_criterion(_fit(spark, sf), "y", "p", ["l_returnflag"])
    return out.select("l_returnflag", _r("hc").alias("hc"))


HC = f"""
WITH RECURSIVE m AS (SELECT l_returnflag, avg({S.fi('(y / p)')}) AS f FROM {_FIT} GROUP BY ALL),
{S.newton('m', ['l_returnflag'], 'f')},
h AS (SELECT l_returnflag, {S.hi('(y / p)', 'scale')} AS h FROM {_FIT} JOIN scaled USING (l_returnflag))
SELECT l_returnflag, round(avg(h * h), 6) AS hc FROM h GROUP BY ALL
"""


def classic_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.classic_errors(_fit(spark, sf), "y", "p", ["l_returnflag"])
    return out.select("l_returnflag", *[_r(c, 3).alias(c) for c in ("mae", "rmse")])


CLASSIC_ERRORS = f"SELECT l_returnflag, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse FROM {_FIT} GROUP BY ALL"


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    guess = F.when(F.col("o_totalprice") > 300_000, "P").when(F.col("o_totalprice") > 150_000, "O").otherwise("F")
    return rows.select(F.col("o_orderstatus").alias("y"), guess.alias("p"))


_CLASSES = """c AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'P' WHEN o_totalprice > 150000 THEN 'O' ELSE 'F' END AS p FROM orders),
labels AS (SELECT y AS label FROM c UNION SELECT p FROM c),
counts AS (SELECT label, (SELECT count(*) FROM c WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM c WHERE p = label) AS told,
  (SELECT count(*) FROM c WHERE y = label) AS support FROM labels),
s AS (SELECT *, CASE WHEN told = 0 THEN 0.0 ELSE tp / told END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM counts),
scores AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)"""


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return classification.accuracy(_classes(spark, sf), "y", "p").select(_r("accuracy").alias("accuracy"))


ACCURACY = f"WITH {_CLASSES} SELECT round(avg((y = p)::DOUBLE), 6) AS accuracy FROM c"


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = classification.class_scores(_classes(spark, sf), "y", "p")
    return out.select("label", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


CLASS_SCORES = f"WITH {_CLASSES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM scores"


def averages(spark: SparkSession, sf: str) -> DataFrame:
    rows, out = _classes(spark, sf), None
    for kind in ("micro", "macro", "weighted"):
        one = classification.averaged(rows, "y", "p", kind).select(F.lit(kind).alias("average"), *[_r(c).alias(c) for c in ("precision", "recall", "f1")])
        out = one if out is None else out.unionByName(one)
    return out


AVERAGES = f"""
WITH {_CLASSES},
a AS (SELECT 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM scores
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM scores
  UNION ALL SELECT 'micro', p, r, 2 * p * r / (p + r) FROM (SELECT sum(tp) / sum(told) AS p, sum(tp) / sum(support) AS r FROM scores))
SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a
"""


def binary_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))
    return classification.averaged(rows, "y", "p", "binary").select(*[_r(c).alias(c) for c in ("precision", "recall", "f1")])


BINARY_SCORES = """
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (
  SELECT count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (toxic = 1) AS p,
    count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1) AS r FROM labels)
"""


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return classification.confusion_matrix(_classes(spark, sf), "y", "p")


CONFUSION_MATRIX = f"""
WITH {_CLASSES} SELECT a.label AS y_true, b.label AS y_pred, (SELECT count(*) FROM c WHERE y = a.label AND p = b.label) AS n FROM labels a, labels b
"""


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return classification.report(_classes(spark, sf), "y", "p", digits=4)


CLASSIFICATION_REPORT = f"""
WITH {_CLASSES}
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM scores
UNION ALL SELECT 'avg / total', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM scores
"""


def wedf(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    out = empirical.weighted_edf(rows, "l_extendedprice", ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", _r("edf").alias("edf"))


WEDF = """
SELECT l_orderkey, l_linenumber, round((sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)
  - l_quantity / 2) / sum(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS edf FROM lineitem
"""


def ks_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return empirical.ks_points(rows, "o_totalprice", ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", _r("ks", 9).alias("ks"))


KS_POINTS = """
SELECT o_orderkey, round((2 * row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1)
  / (2 * count(*) OVER (PARTITION BY o_orderstatus)), 9) AS ks FROM orders
"""


def wedf_lookup(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "part").select(F.col("p_retailprice").alias("at")).distinct()
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), "l_quantity")
    out = empirical.edf_lookup(points, rows, "at", "x", ["l_orderkey", "l_linenumber"], "l_quantity")
    return out.select("at", _r("edf").alias("edf"))


WEDF_LOOKUP = """
WITH x AS (SELECT l_extendedprice / l_quantity AS x, l_quantity AS w, l_orderkey, l_linenumber FROM lineitem),
e AS (SELECT x, (sum(w) OVER (ORDER BY x, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER () AS edf FROM x),
m AS (SELECT x, max(edf) AS edf FROM e GROUP BY x),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
p AS (SELECT DISTINCT p_retailprice AS pt FROM part)
SELECT pt AS "at", round(CASE WHEN pt <= lo THEN 0.0 WHEN pt >= hi THEN 1.0 ELSE m.edf END, 6) AS edf
FROM p ASOF LEFT JOIN m ON p.pt > m.x, b
"""


def ks_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = empirical.ks_grid(table(spark, sf, "supplier").select("s_acctbal"), "s_acctbal", 200)
    return out.select("k", _r("probability").alias("probability"), _r("value", 4).alias("value"))


KS_GRID = """
SELECT k::INTEGER AS k, round((2 * k - 1) / 400.0::DOUBLE, 6) AS probability, round(lo + (2 * k - 1) / 400.0::DOUBLE * (hi - lo), 4) AS value
FROM range(1, 201) t(k), (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
"""

_POINTS = 60


def _moments_sql(kind: str, s: float = 1.0, names: tuple[str, ...] = ("f1", "h1", "f2", "fh")) -> str:
    f, h = (S.fi, S.hi) if kind[0] == "e" else (S.fj, S.hj)
    terms = {"f1": "f", "h1": "h", "f2": "f*f", "fh": "f*h", "f3": "f*f*f", "f4": "f*f*f*f", "fh2": "f*h*h", "f2h": "f*f*h", "f2h2": "f*f*h*h", "f3h": "f*f*f*h", "fh3": "f*h*h*h", "fz": "f*zd", "hz": "h*zd", "zm": "zd"}
    return f"""
b AS (SELECT s_nationkey % 5 AS k, s_acctbal AS x, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 5)),
d AS (SELECT k, lo, hi, {S.fininf(S.az('x', 'lo', 'hi'), '0.1353', '7.389')} AS zd FROM b),
g AS (SELECT DISTINCT k, p::INTEGER AS point, lo + (hi - lo) / {float(_POINTS - 1)} * p AS di, lo, hi FROM b, range(0, {_POINTS}) t(p)),
gz AS (SELECT k, point, di, {S.az('di', 'lo', 'hi')} AS z, {S.fininf(S.az('di', 'lo', 'hi'), '0.1353', '7.389')} AS zi FROM g),
r AS (SELECT k, point, di, z, zi, zd, zd / (zi + 2.220446049250313e-16) AS r FROM gz JOIN d USING (k)),
v AS (SELECT k, point, di, z, zi, zd, {f('r', str(s))} AS f, {h('r', str(s))} AS h FROM r),
m AS (SELECT k, point, di, z, zi, {', '.join(f'avg({terms[n]}) AS {n}' for n in names)} FROM v GROUP BY ALL)"""


def _acctbal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("k"), "s_acctbal")


def _curve(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = moments.curve(_acctbal(spark, sf), "s_acctbal", kind, ["k"], points=_POINTS)
        return out.select("k", "point", _r("di", 4).alias("di"), _r("zi").alias("zi"), _r("cdf").alias("cdf"), _r("pdf", 5).alias("pdf"))

    return query


_VALUE = {
    "egdf": ("(1 - h1 / sqrt(f1 * f1 + h1 * h1)) / 2", "(f1 * f1 * f2 + f1 * h1 * fh) / pow(f1 * f1 + h1 * h1, 1.5)"),
    "eldf": ("(1 - h1) / 2", "f1 * f1"),
    "qgdf": ("(1 - h1 / sqrt(f1 * f1 + h1 * h1)) / 2", "(1 - pow(greatest(-1 + 1e-12, least(1 - 1e-12, h1 / f1)), 2)) / z"),
    "qldf": ("(1 - h1 / sqrt(1 + h1 * h1)) / 2", "f1 / pow(1 + h1 * h1, 1.5)"),
}


def _curve_sql(kind: str) -> str:
    cdf, pdf = _VALUE[kind]
    rising = f"max({cdf}) OVER (PARTITION BY k ORDER BY point)" if kind != "qldf" else cdf
    return f"""WITH {_moments_sql(kind)}
SELECT k, point, round(di, 4) AS di, round(zi, 6) AS zi, round({rising}, 6) AS cdf, round({pdf}, 5) AS pdf FROM m"""


def _slopes(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = moments.derivatives(_acctbal(spark, sf), "s_acctbal", kind, ["k"], points=_POINTS)
        columns = ["second"] if kind == "qldf" else ["second", "third"]
        return out.select("k", "point", *[_r(c, 4).alias(c) for c in columns])

    return query


_ALL = ("f1", "h1", "f2", "fh", "f3", "f4", "fh2", "f2h", "f2h2", "f3h", "fh3", "fz", "hz", "zm")
ELDF_DERIVATIVES = f"WITH {_moments_sql('eldf', names=_ALL)} SELECT k, point, round(4 * f2h, 4) AS second, round(8 * (2 * f2h2 - f4), 4) AS third FROM m"
QLDF_DERIVATIVES = f"""WITH {_moments_sql('qldf', names=_ALL)}
SELECT k, point, round((v * (fz - f1 * zm) - f1 * 3 * sqrt(1 + h1 * h1) * h1 * (hz - h1 * zm)) / (v * v), 4) AS second
FROM (SELECT *, pow(1 + h1 * h1, 1.5) AS v FROM m)"""
EGDF_DERIVATIVES = f"""WITH {_moments_sql('egdf', names=_ALL)},
s AS (SELECT *, f1 * f1 + h1 * h1 AS d, 2 * (f1 * fh - h1 * f2) AS dd, fh2 - f3 AS dfh, fh3 - 2 * f3h AS dfh2, 2 * f2h2 - f4 AS df2h,
  h1 * f3 - h1 * fh2 - f2 * fh AS t, f1 * f1 * f2 + f1 * h1 * fh AS a, f1 * fh - h1 * f2 AS b FROM m),
x AS (SELECT *, f1 * t AS u, 2 * f1 * f1 * f2h + h1 * fh * fh AS v, 6 * a * b AS w,
  fh * t + f1 * (-f2 * f3 + 3 * h1 * f3h + f2 * fh2 - h1 * dfh2 - 2 * f2h * fh - f2 * dfh) AS du,
  4 * f1 * fh * f2h + 2 * f1 * f1 * df2h - f2 * fh * fh + 2 * h1 * fh * dfh AS dv,
  6 * ((2 * f1 * fh * f2 + 2 * f1 * f1 * f2h + fh * h1 * fh - f1 * f2 * fh + f1 * h1 * dfh) * b
    + a * (fh * fh + f1 * dfh + f2 * f2 - 2 * h1 * f2h)) AS dw FROM s)
SELECT k, point, round(-(2 * (u - v) + w / d) / pow(d, 1.5), 4) AS second,
  round(2 * (-2 * ((du - dv) / pow(d, 1.5) - 1.5 * (u - v) / pow(d, 2.5) * dd) - (dw / pow(d, 2.5) - 2.5 * w / pow(d, 3.5) * dd)), 4) AS third FROM x"""


def entropies_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = moments.residual_entropy_at(_acctbal(spark, sf), "s_acctbal", 4000.0, ["k"], s=1.5)
    return out.select("k", *[_r(c).alias(c) for c in ("residual_entropy", "relative_entropy", "entropy_i", "entropy_j", "variance")])


ENTROPIES_FIXED = f"""
WITH b AS (SELECT s_nationkey % 5 AS k, s_acctbal AS x, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 5)),
r AS (SELECT k, {S.fininf(S.az('x', 'lo', 'hi'), '0.1353', '7.389')} / ({S.az('4000.0', 'lo', 'hi')} + 2.220446049250313e-16) AS r FROM b),
v AS (SELECT k, {S.fi('r', '1.5')} AS fi, {S.fj('r', '1.5')} AS fj, {S.hi('r', '1.5')} AS hi FROM r)
SELECT k, round(2 * (avg(fj) - 1), 6) AS residual_entropy, round(avg((fj - fi) / (fj + fi)), 6) AS relative_entropy,
  round(1 - avg(fi), 6) AS entropy_i, round(avg(fj) - 1, 6) AS entropy_j, round(avg(hi * hi), 6) AS variance FROM v GROUP BY k
"""


def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    at = moments.curve(_acctbal(spark, sf), "s_acctbal", "egdf", ["k"], s=0.3, points=_POINTS)
    # rounded, so that flat stretches have no maxima in their last digits
    level = F.transform(peaks.smoothed(F.col("pdf"), 1.0), lambda x: F.round(x, 9))
    rows = peaks.as_arrays(at, ["k"], ["pdf"]).withColumn("s", level)
    return rows.select("k", F.explode(peaks.local_maxima(F.col("s"))).alias("point"), "s").select(
        "k", F.col("point").cast("int").alias("point"), _r(F.get("s", F.col("point").cast("int")), 5).alias("height")
    )


_KERNEL = peaks.gaussian_kernel(1.0)
_PDF_EGDF = "(f1 * f1 * f2 / {s} + f1 * h1 * fh / {s}) / pow(f1 * f1 + h1 * h1, 1.5)"
LOCAL_MAXIMA = f"""
WITH {_moments_sql('egdf', 0.3)},
p AS (SELECT k, point, {_PDF_EGDF.format(s=0.3)} AS pdf FROM m),
kernel(o, c) AS (VALUES {', '.join(f'({i - len(_KERNEL) // 2}, {c!r}::DOUBLE)' for i, c in enumerate(_KERNEL))}),
s AS (SELECT a.k, a.point, round(sum(c * b.pdf), 9) AS s FROM p a, kernel, p b
  WHERE a.k = b.k AND b.point = CASE WHEN a.point + o < 0 THEN -1 - a.point - o WHEN a.point + o >= {_POINTS} THEN {2 * _POINTS - 1} - a.point - o ELSE a.point + o END GROUP BY ALL),
n AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r, max(s) OVER (PARTITION BY k) AS top FROM s WINDOW w AS (PARTITION BY k ORDER BY point))
SELECT k, point, round(s, 5) AS height FROM n WHERE s > l AND s >= r AND s >= 0.01 * top
"""


def cluster_bounds_fixed(spark: SparkSession, sf: str) -> DataFrame:
    at = moments.curve(_acctbal(spark, sf), "s_acctbal", "eldf", ["k"], s=0.4, points=_POINTS)
    out = peaks.cluster_bounds(at, ["k"], threshold=0.3)
    return out.select("k", *[_r(c, 4).alias(c) for c in ("z0", "lcb", "ucb")])


CLUSTER_BOUNDS_FIXED = f"""
WITH {_moments_sql('eldf', 0.4)},
p AS (SELECT k, point, di, f1 * f1 / (0.4 + 2.220446049250313e-16) AS pdf FROM m),
n AS (SELECT *, (pdf - min(pdf) OVER w) / (max(pdf) OVER w - min(pdf) OVER w) AS p FROM p WINDOW w AS (PARTITION BY k)),
gr AS (SELECT *, p + CASE WHEN point = 0 THEN lead(p) OVER w - p WHEN point = {_POINTS - 1} THEN p - lag(p) OVER w ELSE (lead(p) OVER w - lag(p) OVER w) / 2 END AS c
  FROM n WINDOW w AS (PARTITION BY k ORDER BY point)),
t AS (SELECT k, arg_max(point, p) AS top, arg_max(di, p) AS z0, min(di) AS lo, max(di) AS hi FROM gr GROUP BY k)
SELECT k, round(any_value(z0), 4) AS z0, round(coalesce(max(di) FILTER (point < top AND c <= 0.3), any_value(lo)), 4) AS lcb,
  round(coalesce(min(di) FILTER (point > top AND c <= 0.3), any_value(hi)), 4) AS ucb
FROM gr JOIN t USING (k) GROUP BY k
"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "value")


def difference(spark: SparkSession, sf: str) -> DataFrame:
    out = series.difference(_events(spark, sf), "value", ["user_id"], ["ts", "event_id"], times=2)
    return out.select("event_id", _r("diff").alias("diff"))


DIFFERENCE = """
SELECT event_id, round(d - lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM (
  SELECT user_id, ts, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
"""


def seasonal_difference(spark: SparkSession, sf: str) -> DataFrame:
    out = series.difference(_events(spark, sf), "value", ["user_id"], ["ts", "event_id"], season=4)
    return out.select("event_id", _r("diff").alias("diff"))


SEASONAL_DIFFERENCE = "SELECT event_id, round(value - lag(value, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events"


def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    out = series.lags(_events(spark, sf), "value", ["user_id"], ["ts", "event_id"], 3, seasonal=1, season=5)
    return out.select("event_id", "value", "lag_1", "lag_2", "lag_3", "seasonal_1")


LAG_FEATURES = """
SELECT * FROM (SELECT event_id, value, lag(value) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 3) OVER w AS lag_3, lag(value, 5) OVER w AS seasonal_1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE seasonal_1 IS NOT NULL AND lag_3 IS NOT NULL AND lag_2 IS NOT NULL AND lag_1 IS NOT NULL
"""


def integrate(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.difference(_events(spark, sf), "value", ["user_id"], ["ts", "event_id"]).fillna(0.0, ["diff"])
    return series.integrate(rows, "diff", F.lit(100.0), ["user_id"], ["ts", "event_id"]).select("event_id", _r("level", 4).alias("level"))


INTEGRATE = """
SELECT event_id, round(100 + value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS level FROM events
"""


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = series.sliding(_events(spark, sf), "value", ["user_id"], ["ts", "event_id"], 5)
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 5
    return out.select("event_id", _r(mean).alias("mean"), _r(F.array_max("window")).alias("top"))


SLIDING_WINDOWS = """
SELECT event_id, round(m, 6) AS mean, round(t, 6) AS top FROM (
  SELECT event_id, avg(value) OVER w AS m, max(value) OVER w AS t, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5
"""


def silhouette_score(spark: SparkSession, sf: str) -> DataFrame:
    out = silhouette.silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return out.select("vec_id", "label", _r("silhouette").alias("silhouette"))


SILHOUETTE = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT vec_id, label, max(d / nullif(n - 1, 0)) FILTER (other = label) AS a, min(d / n) FILTER (other <> label) AS b FROM d GROUP BY ALL)
SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s
"""


def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return selection.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.25, seed=7)


SPLIT_EXACT = """
SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5(o_orderkey || ':7'), 1, 12), o_orderkey) > count(*) OVER () - ceil(0.25 * count(*) OVER ()) AS is_test FROM orders
"""


def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return selection.k_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, seed=3)


KFOLD = """
SELECT o_orderkey, (ntile(7) OVER (ORDER BY substr(md5(o_orderkey || ':3'), 1, 12), o_orderkey) - 1)::INTEGER AS fold FROM orders
"""

QUERIES = {
    "r2": (r2, R2),
    "evaluation": (evaluation, EVALUATION),
    "legacy_evaluation": (legacy_evaluation, LEGACY_EVALUATION),
    "hc": (hc, HC),
    "classic_errors": (classic_errors, CLASSIC_ERRORS),
    "accuracy": (accuracy, ACCURACY),
    "class_scores": (class_scores, CLASS_SCORES),
    "averages": (averages, AVERAGES),
    "binary_scores": (binary_scores, BINARY_SCORES),
    "confusion_matrix": (confusion_matrix, CONFUSION_MATRIX),
    "classification_report": (classification_report, CLASSIFICATION_REPORT),
    "wedf": (wedf, WEDF),
    "ks_points": (ks_points, KS_POINTS),
    "wedf_lookup": (wedf_lookup, WEDF_LOOKUP),
    "ks_grid": (ks_grid, KS_GRID),
    **{f"{k}_fixed": (_curve(k), _curve_sql(k)) for k in moments.KINDS},
    "egdf_derivatives": (_slopes("egdf"), EGDF_DERIVATIVES),
    "eldf_derivatives": (_slopes("eldf"), ELDF_DERIVATIVES),
    "qldf_derivatives": (_slopes("qldf"), QLDF_DERIVATIVES),
    "entropies_fixed": (entropies_fixed, ENTROPIES_FIXED),
    "local_maxima": (local_maxima, LOCAL_MAXIMA),
    "cluster_bounds_fixed": (cluster_bounds_fixed, CLUSTER_BOUNDS_FIXED),
    "difference": (difference, DIFFERENCE),
    "seasonal_difference": (seasonal_difference, SEASONAL_DIFFERENCE),
    "lag_features": (lag_features, LAG_FEATURES),
    "integrate": (integrate, INTEGRATE),
    "sliding_windows": (sliding_windows, SLIDING_WINDOWS),
    "silhouette": (silhouette_score, SILHOUETTE),
    "split_exact": (split_exact, SPLIT_EXACT),
    "kfold": (kfold, KFOLD),
}
