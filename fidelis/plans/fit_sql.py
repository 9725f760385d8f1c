"""The fits of groups in DuckDB SQL, from their definition: all rows, the same candidates and rounds."""

from __future__ import annotations

import math
import sys

from fidelis.operators import fits
from fidelis.plans import sql

EPS = repr(sys.float_info.epsilon)


def _z(x: str, form: str) -> str:
    return sql.az(x, "dlb", "dub") if form == "a" else f"exp(2 * ln({x} / dlb) / ln(dub / dlb) - 1)"


def _y(ratio: str, s: str) -> str:
    log_r = f"ln(least(abs({ratio}) + 1e-10, {fits.R_MAX!r}))"
    return f"greatest(least(2 / {s} * {log_r}, {fits.Y_MAX!r}), {-fits.Y_MAX!r})"


def _f_h(estimating: bool) -> tuple[str, str]:
    """Fidelity and irrelevance of the exponent y."""
    if estimating:
        return "2 / (exp(y) + exp(-y))", "(exp(y) - exp(-y)) / (exp(y) + exp(-y))"
    return "(exp(y) + exp(-y)) / 2", "(exp(y) - exp(-y)) / 2"


def _value(kind: str) -> str:
    if kind == "qldf":
        return f"(1 - h / (sqrt(1 + h * h) + {EPS})) / 2"
    if kind == "eldf":
        return "(1 - h) / 2"
    return f"(1 - greatest(least(h / CASE WHEN sqrt(f * f + h * h) > 0 THEN sqrt(f * f + h * h) ELSE {EPS} END, 1.0), -1.0)) / 2"


def _density(kind: str, s: str) -> str:
    if kind == "egdf":
        raised = "pow(f * f + h * h, 1.5)"
        return f"(f * f * f2 / {s} + f * h * fh / {s}) / CASE WHEN {raised} = 0 THEN {EPS} ELSE {raised} END"
    if kind == "eldf":
        return f"greatest(f * f / ({s} + {EPS}), 0.0)"
    if kind == "qgdf":
        slope = f"greatest(least(h / f, {1 - 1e-12!r}), {-1 + 1e-12!r})"
        return f"(1 - {slope} * {slope}) / ({s} * z)"
    return f"f / {s} / pow(1 + h * h, 1.5)"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({c}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in r) + ")" for c, r in enumerate(rows)) + ")"


def _avg(x: str, weighted: bool) -> str:
    return f"sum(w * ({x})) / sum(w)" if weighted else f"avg({x})"


def _round(i: int, key: str, core: str, form: str, weighted: bool, empirical: bool) -> str:
    f, h = _f_h(core[0] == "e")
    inner = lambda x: sql.fininf(_z(x, form), "lb", "ub")
    y = _y(f"({inner('v.x')} / ({inner('pl.x')} + {EPS}))", "c.s")
    v = "greatest(least(v, 1.0), 0.0)"
    loss = f"-avg(2 / (pow({v} / (wedf + 1e-6), 2) + pow(wedf / ({v} + 1e-6), 2)))" if empirical else f"max(abs({v} - target) * pw)"
    return f"""
means{i} AS MATERIALIZED (
  SELECT {key}, c, p, {_avg(f, weighted)} AS f, {_avg(h, weighted)} AS h FROM (
    SELECT {key}, c.c, pl.p, {"v.w, " if weighted else ""}{y} AS y FROM values_ v JOIN cands{i} c USING ({key}, dlb, dub) JOIN places pl USING ({key})) GROUP BY ALL),
best{i} AS MATERIALIZED (
  SELECT {key}, arg_min(w.c, (round(loss, {fits.DIGITS}), w.c)) AS c, arg_min(loss, (round(loss, {fits.DIGITS}), w.c)) AS loss,
    arg_min(mean_f, (round(loss, {fits.DIGITS}), w.c)) AS mean_f FROM (
    SELECT {key}, c, {loss} AS loss, avg(f) AS mean_f FROM (
      SELECT {key}, m.c, m.p, m.f, pl.target, pl.wedf, pl.pw, max({_value(core)}) OVER (PARTITION BY {key}, m.c ORDER BY m.p) AS v
      FROM means{i} m JOIN places pl USING ({key}, p)) GROUP BY ALL) w GROUP BY {key}),
at{i} AS MATERIALIZED (SELECT {key}, c.s, c.lb, c.ub, b.loss, b.mean_f, c.dlb, c.dub, c.n FROM best{i} b JOIN cands{i} c USING ({key}, c))"""


def fit(
    source: str, key: str, kind: str, form: str = "a", weighted: bool = False, empirical: bool = False, s: float | None = None, count: int | None = fits.PLACES
) -> str:
    """CTEs (for WITH RECURSIVE) that end in fitted({key}, s, lb, ub, loss, mean_f, dlb, dub, n); `source` gives ({key}, x), and w if weighted.

    Weighted, a row's distance is multiplied by its weight; rows of equal values share their
    weights alike. `empirical` compares by fidelity with the weighted empirical function before a value.
    The loss is taken at `count` rows, None for all.
    """
    many = "n" if count is None else f"least(n, {count})"
    core = {"e": "egdf", "q": "qgdf"}[kind[0]]
    low, high = ("dlb - (dub - dlb) / 2", "dub + (dub - dlb) / 2") if form == "a" else ("dlb / sqrt(dub / dlb)", "dub * sqrt(dub / dlb)")
    alike, pw, wedf, before = "", "1.0", "NULL", ""
    if weighted:
        same = f"OVER (PARTITION BY {key}, x)"
        alike = (
            f", count(*) {same} AS same, sum(w) {same} AS own,"
            f" sum(w) OVER (PARTITION BY {key} ORDER BY x) AS upto, sum(w) OVER (PARTITION BY {key}) AS everything"
        )
        pw = "own / same * n / everything"
        wedf = "CASE WHEN x <= dlb THEN 0.0 WHEN x >= dub THEN 1.0 ELSE (upto - own - last / 2) / everything END"
        before = f"""
lasts AS (
  SELECT {key}, x, lag(share) OVER (PARTITION BY {key} ORDER BY x) AS last FROM (SELECT DISTINCT {key}, x, own / same AS share FROM ranks)),"""
    out = f"""
values_ AS MATERIALIZED (
  SELECT {key}, x::DOUBLE AS x, {"w::DOUBLE AS w, " if weighted else ""}min(x::DOUBLE) OVER own AS dlb, max(x::DOUBLE) OVER own AS dub
  FROM ({source}) WHERE isfinite(x::DOUBLE) WINDOW own AS (PARTITION BY {key})),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY x) AS k, count(*) OVER (PARTITION BY {key}) AS n{alike} FROM values_),{before}
places AS MATERIALIZED (
  SELECT {key}, p, x, (k - 0.5) / n AS target, n, {pw} AS pw, {wedf} AS wedf FROM (
    SELECT *, {many} - 1 AS steps, ((k - 1) * ({many} - 1) + greatest(n - 1, 1) - 1) // greatest(n - 1, 1) AS p FROM ranks{f' LEFT JOIN lasts USING ({key}, x)' if weighted else ''})
  WHERE (p * greatest(n - 1, 1)) // greatest(steps, 1) = k - 1),
sizes AS (SELECT {key}, dlb, dub, count(*) AS n FROM values_ GROUP BY ALL),
cands0 AS MATERIALIZED (
  SELECT {key}, dlb, dub, n, c, s, CASE WHEN c = 0 THEN {_z(low, form)} ELSE lb END AS lb, CASE WHEN c = 0 THEN {_z(high, form)} ELSE ub END AS ub
  FROM sizes, {_values(fits.coarse(s))} t(c, s, lb, ub) WHERE dub > dlb),"""
    out += _round(0, key, core, form, weighted, empirical)
    for i, step in enumerate(fits.ROUNDS, 1):
        inside = lambda n: f"greatest(least(a.{n} * t.{n}, {fits.BOX[n][1]!r}), {fits.BOX[n][0]!r}) AS {n}"
        out += f""",
cands{i} AS MATERIALIZED (SELECT {key}, dlb, dub, n, t.c, {inside("s")}, {inside("lb")}, {inside("ub")} FROM at{i - 1} a, {_values(fits.cube(s, step))} t(c, s, lb, ub)),"""
        out += _round(i, key, core, form, weighted, empirical)
    return out + f""",
fitted AS MATERIALIZED (SELECT * FROM at{len(fits.ROUNDS)})"""


def local_scale(key: str, form: str = "a") -> str:
    """CTEs that end in locals({key}, s_local)."""
    inner = lambda x: sql.fininf(_z(x, form), "lb", "ub")
    return f""",
medians AS (SELECT {key}, median(x) AS m FROM values_ GROUP BY {key}),
about AS (
  SELECT {key}, avg({sql.fi("r")}) AS f FROM (
    SELECT {key}, {inner("x")} / ({inner("m")} + {EPS}) AS r FROM values_ JOIN fitted USING ({key}, dlb, dub) JOIN medians USING ({key})) GROUP BY {key}),
{sql.newton("about", [key], "f", "locals", "s_local")}"""


def tops(key: str, kind: str, form: str, points: int, weighted: bool = False, scale: str = "s_local", locals_: str = "locals", end: str = "") -> str:
    """CTEs that end in tops({key}, z0), from fitted and locals; `scale` may depend on the place z of a point.

    `end` is added to the names of all that they make.
    """
    f, h = _f_h(kind[0] == "e")
    inner = lambda x: sql.fininf(_z(x, form), "lb", "ub")
    w = "w, " if weighted else ""
    return f""",
grid{end} AS MATERIALIZED (
  SELECT * EXCLUDE (s_local), {scale} AS s_local FROM (
    SELECT *, {inner("di")} AS place FROM (
      SELECT {key}, dlb, dub, lb, ub, COLUMNS({locals_}.* EXCLUDE ({key})), i AS point, dlb + (dub - dlb) / {float(points - 1)!r} * i AS di
      FROM fitted JOIN {locals_} USING ({key}), range({points}) t(i)))),
dense{end} AS MATERIALIZED (
  SELECT {key}, point, di, {_density(kind, "s_local")} AS pdf FROM (
    SELECT {key}, point, any_value(di) AS di, any_value(s_local) AS s_local, any_value({_z("di", form)}) AS z,
      {_avg("f", weighted)} AS f, {_avg("h", weighted)} AS h, {_avg("f * f", weighted)} AS f2, {_avg("f * h", weighted)} AS fh FROM (
      SELECT *, {f} AS f, {h} AS h FROM (
        SELECT g.*, {w}{_y(f"({inner('v.x')} / ({inner('g.di')} + {EPS}))", "s_local")} AS y FROM values_ v JOIN grid{end} g USING ({key}, dlb, dub)))
    GROUP BY {key}, point)),
marked{end} AS (
  SELECT *, min(point) FILTER (pdf = high) OVER (PARTITION BY {key}) AS top, abs(pdf - high) <= greatest(0.01 * sd, 1e-10) AS near FROM (
    SELECT *, max(pdf) OVER (PARTITION BY {key}) AS high, stddev_pop(pdf) OVER (PARTITION BY {key}) AS sd FROM dense{end})),
middles{end} AS (
  SELECT {key}, a + (b - a + 1) // 2 AS point FROM (
    SELECT {key}, coalesce(max(point) FILTER (point < top AND NOT near) + 1, 0) AS a,
      coalesce(min(point) FILTER (point > top AND NOT near) - 1, max(point)) AS b FROM marked{end} GROUP BY {key})),
tops{end} AS MATERIALIZED (SELECT {key}, di AS z0 FROM dense{end} JOIN middles{end} USING ({key}, point))"""


def flags(key: str, points: int, end: str = "") -> str:
    """CTEs that end in flags({key}, homogeneous) and peaks({key}, peak, point), from dense and fitted.

    The density is smoothed by a Gaussian of one point, mirrored at the ends with these
    repeated; its maxima of a hundredth of the greatest are taken from the highest on, where
    they keep a twentieth of the grid from all taken before.
    """
    raw = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
    kernel = ", ".join(f"({k}, {w / sum(raw)!r}::DOUBLE)" for k, w in zip(range(-4, 5), raw, strict=True))
    j = "d.point + o.k"
    return f""",
smooth AS MATERIALIZED (
  SELECT d.{key}, d.point, sum(o.w * e.pdf) AS v FROM dense{end} d, (VALUES {kernel}) o(k, w), dense{end} e
  WHERE e.{key} IS NOT DISTINCT FROM d.{key} AND e.point = CASE WHEN {j} < 0 THEN -1 - ({j}) WHEN {j} >= {points} THEN {2 * points - 1} - ({j}) ELSE {j} END
  GROUP BY ALL),
runs AS (
  SELECT {key}, run, any_value(v) AS v, min(point) AS a, max(point) AS b FROM (
    SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY point) AS run FROM (
      SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY {key} ORDER BY point))::INT, 0) AS new FROM smooth)) GROUP BY ALL),
maxima AS MATERIALIZED (
  SELECT {key}, (a + b) // 2 AS point, row_number() OVER (PARTITION BY {key} ORDER BY v DESC, (a + b) // 2) AS i FROM (
    SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after, max(v) OVER (PARTITION BY {key}) AS most FROM runs WINDOW w AS (PARTITION BY {key} ORDER BY run))
  WHERE v > before AND v > after AND v >= 0.01 * most),
kept AS (
  SELECT DISTINCT {key}, 0::BIGINT AS i, []::BIGINT[] AS taken FROM fitted
  UNION ALL
  SELECT k.{key}, m.i, CASE WHEN len(list_filter(taken, lambda t: abs(t - m.point) < {max(1, points // 20)})) = 0 THEN list_append(taken, m.point::BIGINT) ELSE taken END
  FROM kept k JOIN maxima m ON m.{key} IS NOT DISTINCT FROM k.{key} AND m.i = k.i + 1),
chosen AS (SELECT {key}, arg_max(taken, i) AS taken FROM kept GROUP BY {key}),
flags AS (
  SELECT {key}, len(any_value(taken)) = 1 AND min(pdf) >= 0 AS homogeneous FROM chosen JOIN dense{end} USING ({key}) GROUP BY {key}),
peaks AS (SELECT {key}, generate_subscripts(taken, 1) AS peak, unnest(taken) AS point FROM chosen)"""


def clusters(key: str, points: int, threshold: float, end: str = "") -> str:
    """CTEs that end in clusters({key}, lcb, ucb), from dense and middles."""
    return f""",
normal AS (
  SELECT *, coalesce((pdf - min(pdf) OVER w) / nullif(max(pdf) OVER w - min(pdf) OVER w, 0), 0.5) AS q FROM dense{end} WINDOW w AS (PARTITION BY {key})),
quiet AS (
  SELECT *, q + CASE WHEN point = 0 THEN lead(q) OVER w - q WHEN point = {points - 1} THEN q - lag(q) OVER w ELSE (lead(q) OVER w - lag(q) OVER w) / 2 END
    <= {threshold!r} AS calm FROM normal WINDOW w AS (PARTITION BY {key} ORDER BY point)),
clusters AS (
  SELECT {key}, coalesce(max(di) FILTER (calm AND q.point < m.point), min(di)) AS lcb, coalesce(min(di) FILTER (calm AND q.point > m.point), max(di)) AS ucb
  FROM quiet q JOIN middles{end} m USING ({key}) GROUP BY {key})"""


def pairs(source: str, key: str, core: str, settle: bool) -> str:
    """CTEs that end in hx and hy({key}, i, j, h): irrelevances of ranks i and j of the columns x and y of `source`.

    To `settle`, groups that are not homogeneous are fitted at S = 1.
    """
    _, h = _f_h(core[0] == "e")
    out = f"twice AS MATERIALIZED (SELECT {key}, x::DOUBLE AS x, y::DOUBLE AS y FROM ({source}) WHERE isfinite(x::DOUBLE) AND isfinite(y::DOUBLE))"
    for c in ("x", "y"):
        rows = f"SELECT {key}, {c} AS x FROM twice"
        fitted = f"(WITH RECURSIVE {fit(rows, key, core)}\nSELECT {key}, s, lb, ub, dlb, dub FROM fitted)"
        if settle:
            flagged = f"(WITH RECURSIVE {fit(rows, key, core)},\nlocals AS (SELECT {key}, s AS s_local FROM fitted){tops(key, core, 'a', 500)}{flags(key, 500)}\nSELECT {key}, homogeneous FROM flags)"
            fixed = f"(WITH RECURSIVE {fit(rows, key, core, s=1.0)}\nSELECT {key}, s, lb, ub, dlb, dub FROM fitted)"
            fitted = f"(SELECT f.* FROM {fitted} f JOIN {flagged} USING ({key}) WHERE homogeneous UNION ALL SELECT f.* FROM {fixed} f JOIN {flagged} USING ({key}) WHERE NOT homogeneous)"
        inner = lambda v: sql.fininf(_z(v, "a"), "lb", "ub")
        out += f""",
f{c} AS MATERIALIZED (SELECT * FROM {fitted}),
r{c} AS MATERIALIZED (SELECT {key}, {c} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {c}) AS k FROM twice),
h{c} AS MATERIALIZED (
  SELECT {key}, i, j, {h} AS h FROM (
    SELECT {key}, a.k AS i, b.k AS j, {_y(f"({inner('a.x')} / ({inner('b.x')} + {EPS}))", "s")} AS y FROM r{c} a JOIN r{c} b USING ({key}) JOIN f{c} USING ({key})))"""
    return out


def robust(source: str, key: str) -> str:
    """A query of ({key}, x, w) with the weights that the data of `source` give in the normalised domain."""
    z = sql.az("x", "min(x) OVER own", "max(x) OVER own")
    return f"""WITH RECURSIVE placed AS (SELECT {key}, x, {z} AS z FROM (SELECT {key}, x::DOUBLE AS x FROM ({source})) WINDOW own AS (PARTITION BY {key})),
ratios AS (SELECT *, z / median(z) OVER (PARTITION BY {key}) AS r FROM placed),
mean_f AS (SELECT {key}, avg({sql.fi('r')}) AS f FROM ratios GROUP BY {key}),
{sql.newton("mean_f", [key], "f", "scales", "scale")}
SELECT {key}, x, pow({sql.fi('r', 'scale')}, 2) AS w FROM ratios JOIN scales USING ({key})"""


def cluster_analysis(source: str, key: str, points: int, threshold: float, weighted: bool = False) -> str:
    """Flags of the global function and the main cluster of the local one, from one fit."""
    body = fit(source, key, "eldf", "a", weighted) + ",\nglobals AS (SELECT " + key + ", s AS s_local FROM fitted)"
    body += tops(key, "egdf", "a", points, weighted, locals_="globals", end="_g") + flags(key, points, "_g")
    body += local_scale(key) + tops(key, "eldf", "a", points, weighted) + clusters(key, points, threshold)
    return f"WITH RECURSIVE {body}\nSELECT {key}, homogeneous, lcb, ucb FROM flags JOIN clusters USING ({key})"


def whole(source: str, key: str, kind: str, form: str, points: int, select: str, weighted: bool = False, empirical: bool = False) -> str:
    """A query over the fit: `select` may use fitted, locals, tops and values_."""
    scale = local_scale(key, form) if kind in ("eldf", "qldf") else f""",
locals AS (SELECT {key}, s AS s_local FROM fitted)"""
    return f"WITH RECURSIVE {fit(source, key, kind, form, weighted, empirical)}{scale}{tops(key, kind, form, points, weighted)}\n{select}"


def varying(source: str, key: str, kind: str, form: str, points: int) -> str:
    """A query for a scale s0 exp(gamma z): the rounds of candidates after the fit's, its ends and z0."""
    f, h = _f_h(kind[0] == "e")
    inner = lambda x: sql.fininf(_z(x, form), "lb", "ub")
    pairs = lambda rows: "(VALUES " + ", ".join(f"({c}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for c, (a, b) in enumerate(rows)) + ")"
    rising = "v" if kind == "qldf" else f"greatest(least(max(v) OVER (PARTITION BY {key}, c ORDER BY p), 1.0), 0.0)"
    out = f"""
vcands0 AS MATERIALIZED (SELECT f.*, t.c, t.s0, t.g FROM fitted f, {pairs(fits.varying_coarse())} t(c, s0, g)),"""
    (low, high), (left, right) = fits.VARYING_BOX
    for i in range(len(fits.VARYING_ROUNDS) + 1):
        if i:
            out += f"""
vcands{i} AS MATERIALIZED (
  SELECT a.* EXCLUDE (c, s0, g, score), t.c, greatest(least(a.s0 * t.a, {high!r}), {low!r}) AS s0, greatest(least(a.g + t.b, {right!r}), {left!r}) AS g
  FROM vat{i - 1} a, {pairs(fits.varying_square(fits.VARYING_ROUNDS[i - 1]))} t(c, a, b)),"""
        y = _y(f"({inner('v.x')} / ({inner('pl.x')} + {EPS}))", f"(c.s0 * exp(c.g * {inner('pl.x')}))")
        out += f"""
vmeans{i} AS MATERIALIZED (
  SELECT {key}, c, p, avg({f}) AS f, avg({h}) AS h FROM (
    SELECT {key}, c.c, pl.p, {y} AS y FROM values_ v JOIN vcands{i} c USING ({key}, dlb, dub) JOIN places pl USING ({key})) GROUP BY ALL),
vscores{i} AS MATERIALIZED (
  SELECT {key}, c, avg(2 / (pow(r / (target + 1e-12), 2) + pow(target / (r + 1e-12), 2))) AS score FROM (
    SELECT {key}, c, target, {rising} AS r FROM (
      SELECT {key}, m.c, m.p, pl.target, {_value(kind)} AS v FROM vmeans{i} m JOIN places pl USING ({key}, p))) GROUP BY ALL),
vat{i} AS MATERIALIZED (
  SELECT c.*, score FROM vcands{i} c JOIN vscores{i} USING ({key}, c)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY -round(score, {fits.DIGITS}), c) = 1),"""
    tenth = lambda at: f"greatest(floor(s0 * exp(g * {at}) * 10 + 0.5) / 10, {fits.LEAST_SCALE!r})"
    out += f"""
locals AS (SELECT {key}, s0, g, score, 0.0 AS s_local FROM vat{len(fits.VARYING_ROUNDS)})"""
    ends = ", ".join(f"{tenth(inner(x))} AS {name}" for x, name in (("dlb", "s_low"), ("dub", "s_high")))
    select = f"""
SELECT *, s_low <> s_high AS heteroscedastic FROM (
  SELECT {key}, n, s0, g AS gamma, score, {ends}, z0 FROM fitted JOIN locals USING ({key}) JOIN tops USING ({key}))"""
    return f"WITH RECURSIVE {fit(source, key, kind, form)},{out}{tops(key, kind, form, points, scale=tenth('place'))}{select}"


def about_z0(key: str, form: str, what: str, extra: str = "") -> str:
    """`what` over the ratios r of each group's data to z0; `extra` columns are of the fit."""
    r = f"{sql.fininf(_z('x', form), 'lb', 'ub')} / ({_z('z0', form)} + {EPS})"
    return f"""SELECT {key}, {extra}{what} FROM (
  SELECT *, {r} AS r FROM values_ JOIN fitted USING ({key}, dlb, dub) JOIN locals USING ({key}) JOIN tops USING ({key})) GROUP BY ALL"""


def data_bounds() -> str:
    """The probable bounds in data units (additive form)."""
    back = lambda b: f"(ln(abs({b}) + 1e-6) * (dub - dlb) + dlb + dub) / 2 AS {b}"
    return f"{back('lb')}, {back('ub')}"
