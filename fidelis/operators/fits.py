"""Fits of groups' distribution functions as aggregates: no group is held in a task.

A group's values are counted, ranked and dealt into chunks of bounded size once (see sample()).
The loss of a candidate (scale and bounds) is the greatest weighted distance between the
function and the mid-rank function, or its fidelity to the empirical function. Means of fidelity and irrelevance run over all rows of a group;
they are taken at up to `count` of its rows, evenly spread over the ranks: at every row of a
group of no more than that; with a count of 0 at all rows of any group, once for equal values. A coarse grid of candidates, then a cube of candidates about
the best one in a fixed number of rounds, are summed up side by side: a chunk meets all places
of all candidates in one task and leaves a row of sums for each, which Spark adds up. The
rounds follow each other in one plan, without an action in between.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType
from pyspark.sql.window import Window

from fidelis.functions import az, fidelity_i, fidelity_j, fininf, gnostic_scale, irrelevance_i, irrelevance_j, mz, q_pair
from fidelis.functions.characteristics import MAX_EXPONENT, R_EPS, R_MAX
from fidelis.functions.convert import EPS as Z_EPS
from fidelis.operators.lineage import cut
from fidelis.operators.totals import join_groups, running, running_sums, valid, with_totals
from fidelis.operators.weights import gnostic_weights, normalised

EPS, PLACES = sys.float_info.epsilon, 64
#: Values of a chunk, sums held by a task before it passes them on, and bytes of the groups' side that may be broadcast.
CHUNK, HELD, BROADCAST_BYTES = 512, 1 << 21, 128 << 20
#: Chunks of a group that one task may hold, and go through all rounds with.
TOGETHER = 16
#: Distinct values of a group that one task may hold where the loss is taken at all of them; nodes of a stretch on which
#: means are interpolated there; kernel terms at once.
WHOLE, NODES, ROOM = 1 << 20, 22, 1 << 21
#: Exponents stay where sums of their powers are finite.
Y_MAX = MAX_EXPONENT - 20
#: The box that scale and bounds are searched in.
BOX = {"s": (0.1, 10.0), "lb": (1e-6, math.exp(-1.000001)), "ub": (math.exp(1.000001), 1e6)}
#: The coarse grid, besides the start; then the log steps of scale and bounds in each round.
COARSE = {"s": (0.2, 0.4, 0.7, 1.0, 1.6, 3.0), "lb": (0.01, 0.1353, 0.3), "ub": (3.0, 7.389, 100.0)}
ROUNDS = ((0.28, 1.0), (0.12, 0.45), (0.05, 0.2), (0.02, 0.09))
START_S = 0.5
#: Varying scale S0 exp(gamma z): its box, start, coarse grid, and the steps (log of S0, gamma) of its rounds.
VARYING_BOX, VARYING_START = ((1e-3, 10.0), (-2.0, 2.0)), (2.0, 0.0)
VARYING_COARSE = ((0.1, 0.2, 0.4, 0.7, 1.0, 1.6, 2.5, 4.0, 6.5, 10.0), (-2.0, -1.0, -0.5, -0.2, -0.05, 0.0, 0.05, 0.2, 0.5, 1.0, 2.0))
VARYING_ROUNDS = ((0.25, 0.2), (0.12, 0.08), (0.05, 0.03), (0.02, 0.01))
LEAST_SCALE = 0.1
#: Losses are compared to this many digits; the first of equal candidates wins.
DIGITS = 10


def _convert(form: str):
    return {"a": az, "m": mz}[form]


@dataclass
class Sample:
    """A column's groups, laid out for fits.

    `chunks` has the keys, and arrays _xs, _cs and _ws of distinct values, their counts and
    weights; `groups` has the keys, n, dlb, dub, median and _places, an array of (p, x, target,
    wedf, weight). Both are checkpointed; `held` is the size of the groups' side in bytes.
    Of samples that extend() makes `by` are the chunks' keys, which several groups share, and
    _at in `groups` is the datum that each group has besides. `least` and `most` are the
    fewest and the most distinct values of a group (_values in `groups`). With a `count` of 0
    there are no _places: the loss is taken at all values of the chunks.
    """

    chunks: DataFrame
    groups: DataFrame
    keys: list[str]
    held: int
    by: list[str]
    count: int | None
    least: int
    most: int
    added: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        """(keys, _x, _c, _w) of distinct values."""
        each = self.chunks.select(*self.by, F.explode(F.arrays_zip("_xs", "_cs", "_ws")).alias("_e"))
        return each.select(*self.by, F.col("_e._xs").alias("_x"), F.col("_e._cs").alias("_c"), F.col("_e._ws").alias("_w"))

    def met(self, groups: DataFrame) -> DataFrame:
        """rows() of each group, with the group's columns."""
        whole = join_groups(self.rows(), self.sided(groups), self.by)
        if not self.added:
            return whole
        own = groups.withColumns({"_x": F.col("_at"), "_c": F.lit(1).cast("long"), "_w": F.lit(1.0)})
        return whole.unionByName(own.select(*whole.columns))

    def sided(self, groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if self.held <= BROADCAST_BYTES else groups


def sample(
    df: DataFrame, column: str, keys: list[str] = (), weight: str | None = None, count: int | None = PLACES, robust: bool = False, form: str = "a"
) -> Sample:
    """The groups of a column. Nulls, NaN and infinite values take no part, nor do rows whose
    `weight` is null, NaN, infinite or negative; a weight of zero leaves a row its rank.

    `count` is the number of places (see places()), None for all rows; 0 for all rows without
    an array of them, which fit() alone takes (to the mid-ranks). `robust`, for groups
    that are not homogeneous, multiplies the weights by those that the data give in the
    normalised domain of `form`.
    """
    keys = list(keys)
    if robust:
        placed = normalised(df.select(*keys, column, *([weight] if weight else [])), column, keys, form, "_z")
        own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        df, weight = gnostic_weights(placed, "_z", keys, "_own").withColumn("_own", F.col("_own") * own), "_own"
    weighed = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = valid(df.select(*keys, F.col(column).cast("double").alias("_x"), weighed.alias("_w")), "_x", "_w").filter("_w >= 0")
    counted = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"), F.sum("_w").alias("_w"))
    sums = {"_kc": F.col("_c"), "_kw": F.col("_w"), "_i": F.lit(1)}
    ranked = running_sums(counted, keys, "_x", sums, [], {"_last": F.col("_w") / F.col("_c")})
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    dealt = ranked.groupBy(*keys, F.floor((F.col("_i") - 1) / CHUNK).alias("_chunk")).agg(F.collect_list(F.struct("_x", "_c", "_w")).alias("_p"))
    arrays = [F.col(f"_p.{c}").alias(f"{c}s") for c in ("_x", "_c", "_w")]
    chunks = cut(dealt.select(*keys, *arrays).repartition(tasks))
    groups = cut(places(ranked, keys, count))
    return _laid_out(chunks, groups, keys, keys, count, ())


def _laid_out(chunks: DataFrame, groups: DataFrame, keys: list[str], by: list[str], count: int | None, added: tuple[str, ...]) -> Sample:
    sizes = [F.count("*").alias("g"), F.sum(F.size("_places")).alias("p"), F.min("_values").alias("a"), F.max("_values").alias("b")]
    size = groups.agg(*sizes).first()
    return Sample(chunks, groups, keys, 72 * (size["p"] or 0) + 4096 * size["g"], by, count, size["a"] or 0, size["b"] or 0, added)


_PLACES = "array<struct<p:bigint,x:double,target:double,wedf:double,weight:double>>"


def places(ranked: DataFrame, keys: list[str], count: int | None = PLACES) -> DataFrame:
    """(keys, n, dlb, dub, median, _places): each group's size, ends, median and an array of (p, x, target, wedf, weight).

    `ranked` has distinct values _x, their counts _c and weights _w, running sums _kc and _kw
    of these, and _last, the weight of a row of the value before. Of n rows those of the ranks
    floor(p (n - 1) / (m - 1)) + 1, for p below m, the lesser of n and `count`, are places.
    target is the mid-rank (rank - 1/2) / n; wedf is what the weighted empirical function
    has reached before the value, 0 and 1 at the ends; weight is scaled to a mean of one over
    the group's rows. Rows of equal values share their weights alike.
    """
    whole = with_totals(
        ranked, keys, F.sum("_c").alias("n"), F.sum("_w").alias("_all"), F.min("_x").alias("dlb"), F.max("_x").alias("dub")
    )
    c, b, n, own = F.col("_c"), F.col("_kc") - F.col("_c"), F.col("n"), F.col("_w") / F.col("_c")
    x, low, high = F.col("_x"), F.col("dlb"), F.col("dub")
    covers = lambda r: (b + c > r) & (b <= r)
    at = lambda r: F.max(F.when(covers(r), x))
    middle = (at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2
    ends = whole.groupBy(*keys, "n", "dlb", "dub").agg(middle.alias("median"), F.count("*").alias("_values"))
    if count == 0:
        return ends.withColumn("_places", F.array().cast(_PLACES))
    kept, rank = _at_ranks(whole, n, count, 0)
    reached = (F.col("_kw") - F.col("_w") - F.col("_last") / 2) / F.col("_all")
    wedf = F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(reached)
    values = {"x": x, "target": (rank + 0.5) / n, "wedf": wedf, "weight": F.try_divide(own * n, F.col("_all"))}
    spots = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", *[v.alias(k) for k, v in values.items()]))).alias("_places"))
    return join_groups(ends, spots, keys)


def _at_ranks(whole: DataFrame, n: Column, count: int | None, shift: int) -> tuple[DataFrame, Column]:
    """Rows with the place p that falls on them, and its rank from 0 on, of n rows: rows' own ranks are moved up by `shift`."""
    c, b = F.col("_c"), F.col("_kc") - F.col("_c") + shift
    if count is None:
        return whole.withColumn("p", F.explode(F.sequence(b, b + c - 1))), F.col("p")
    steps, last = F.least(n, F.lit(count)) - 1, F.greatest(n - 1, F.lit(1))
    upward = lambda x: F.floor((x * steps + last - 1) / last).cast("long")
    # a single place is that of the first row
    to = F.when(steps == 0, F.when(b == 0, 0).otherwise(-1)).otherwise(F.least(steps, upward(b + c) - 1))
    rank = F.floor(F.col("p") * last / F.greatest(steps, F.lit(1))).cast("long")
    return whole.withColumn("p", F.explode(F.when(upward(b) <= to, F.sequence(upward(b), to)))), rank


def extend(sample: Sample, additions: DataFrame, tags: list[str]) -> Sample:
    """A sample of each row of `additions` (the keys, tags, _at): its group of `sample`, which has no weights, and the datum _at besides.

    The chunks stay as they are; a datum's own terms are added where groups meet them. Places
    are those of n + 1 rows, taken from the group's rows next to the ranks that they fall on.
    """
    keys, by = [*sample.keys, *tags], sample.keys
    counted = with_totals(
        running_sums(sample.rows(), by, "_x", {"_kc": F.col("_c")}, []), by, F.sum("_c").alias("n"), F.min("_x").alias("dlb"), F.max("_x").alias("dub")
    )
    sides = []
    for name, shift in (("_low", 0), ("_high", 1)) if sample.count != 0 else ():
        rows, _ = _at_ranks(counted, F.col("n") + 1, sample.count, shift)
        sides.append(rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("p", "_x"))).alias(name)))
    b, c = F.col("_kc") - F.col("_c"), F.col("_c")
    at = lambda r: F.max(F.when((b <= r) & (r < b + c), F.col("_x")))
    middle = {f"_m{i}": at(r) for i, r in enumerate((F.floor(F.col("n") / 2) - 1, F.floor(F.col("n") / 2), F.ceil(F.col("n") / 2) - 1, F.ceil(F.col("n") / 2)))}
    ends = counted.groupBy(*by, "n", "dlb", "dub").agg(*[v.alias(k) for k, v in middle.items()], F.count("*").alias("_values"))
    for side in sides:
        ends = join_groups(ends, side, by)
    base = cut(ends)
    asked = cut(additions.select(*keys, "_at"))
    below = join_groups(sample.rows(), sample.sided(asked), by).groupBy(*keys).agg(F.sum(F.when(F.col("_x") < F.col("_at"), F.col("_c")).otherwise(0)).alias("_pos"))
    renamed = base.withColumnsRenamed({"n": "_n", "dlb": "_least", "dub": "_most"})
    wide = join_groups(join_groups(asked, renamed, by), below, keys)
    pos, last = F.col("_pos"), F.col("_n")
    n, m = last + 1, last if not sample.count else F.least(last, F.lit(sample.count - 1))
    own = lambda r, low, high: F.when(r < pos, low).when(r == pos, F.col("_at")).otherwise(high)
    first, second = F.floor(last / 2), F.ceil(last / 2)
    median = (own(first, F.col("_m1"), F.col("_m0")) + own(second, F.col("_m3"), F.col("_m2"))) / 2

    def place(p: Column) -> Column:
        rank = p if sample.count is None else F.floor(p * last / F.greatest(m, F.lit(1))).cast("long")
        x = own(rank, F.col("_low")[p], F.col("_high")[p])
        return F.struct(p.alias("p"), x.alias("x"), ((rank + 0.5) / n).alias("target"), F.lit(0.0).alias("wedf"), F.lit(1.0).alias("weight"))

    spots = F.array().cast(_PLACES) if sample.count == 0 else F.transform(F.sequence(F.lit(0).cast("long"), m), place)
    groups = wide.select(
        *keys, n.alias("n"), F.least("_least", "_at").alias("dlb"), F.greatest("_most", "_at").alias("dub"), median.alias("median"),
        spots.alias("_places"), "_at", (F.col("_values") + 1).alias("_values"),
    )
    return _laid_out(sample.chunks, cut(groups), keys, by, sample.count, ("_at",))


def start_bounds(form: str) -> tuple[Column, Column]:
    """Bounds half a range (by ratio in the multiplicative form) beyond the ends, in the normalised domain."""
    low, high = F.col("dlb"), F.col("dub")
    pad, ratio = (high - low) / 2, F.sqrt(F.try_divide(high, low))
    ends = (low - pad, high + pad) if form == "a" else (F.try_divide(low, ratio), high * ratio)
    return tuple(_convert(form)(x, low, high) for x in ends)


def _listed(values: list[float]) -> Column:
    """A constant array; as text it is one call to the JVM and not one for each value."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def coarse(s: float | None) -> list[tuple]:
    """Candidates of the first round; the first one's bounds are each group's start."""
    return [(START_S if s is None else s, 0, 0), *product(COARSE["s"] if s is None else (s,), COARSE["lb"], COARSE["ub"])]


def cube(s: float | None, step: tuple[float, float]) -> list[tuple]:
    """Factors by which a round moves the best candidate: each coordinate down, not at all or up."""
    sides = [math.exp(-step[1]), 1.0, math.exp(step[1])]
    return list(product([math.exp(-step[0]), 1.0, math.exp(step[0])] if s is None else [1.0], sides, sides))


def _coarse(s: float | None, form: str) -> dict[str, Column]:
    """Arrays of the first round's candidates by name; the first candidate has each group's start bounds."""
    rest = list(zip(*coarse(s), strict=True))
    starts = (None, *start_bounds(form))
    named = {n: _listed(rest[i]) if starts[i] is None else F.concat(F.array(starts[i]), _listed(rest[i][1:])) for i, n in enumerate(BOX)}
    return named | {"g": _listed([0.0] * len(rest[0]))}


def _cube(s: float | None, step: tuple[float, float]) -> dict[str, Column]:
    """Arrays of a later round's candidates, about _best."""
    factors, out = list(zip(*cube(s, step), strict=True)), {}
    for i, (n, (low, high)) in enumerate(BOX.items()):
        best = F.col(f"_best.{n}")
        moved = F.transform(_listed(factors[i]), _times(best))
        out[n] = moved if n == "s" and s is not None else _within(moved, low, high)
    return out | {"g": _listed([0.0] * len(factors[0]))}


def _times(factor: Column) -> Callable[[Column], Column]:
    return lambda x: factor * x


def _within(array: Column, low: float, high: float) -> Column:
    return F.transform(array, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _terms(estimating: bool, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 / cosh and tanh of y, or cosh and sinh, by one exponential."""
    if estimating:
        e = np.exp(-np.abs(y))
        square = e * e
        return 2 * e / (1 + square), np.copysign((1 - square) / (1 + square), y)
    e = np.exp(y)
    return (e + 1 / e) / 2, (e - 1 / e) / 2


def _summed(estimating: bool, y: np.ndarray, ws: np.ndarray, whole: float, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums over rows of what _terms() gives, without h itself: `y` is overwritten, `powers` is room of its shape.

    With e = exp(y) and t = 1 / (1 + e^2), 1 / cosh is 2 e t and tanh is 1 - 2 t.
    """
    np.exp(y, out=y)
    if estimating:
        np.multiply(y, y, out=powers)
        powers += 1
        np.reciprocal(powers, out=powers)
        h = whole - 2 * (ws @ powers)
        np.multiply(y, powers, out=y)
        return 2 * (ws @ y), h
    np.reciprocal(y, out=powers)
    up, down = ws @ y, ws @ powers
    return (up + down) / 2, (up - down) / 2


def _to_z(x: np.ndarray, low: float, high: float, form: str) -> np.ndarray:
    """Values in the normalised domain."""
    return np.exp((2 * x - high - low) / ((high - low) + Z_EPS)) if form == "a" else np.exp(2 * np.log(x / low) / np.log(high / low) - 1)


def _chunk_sums(xs, ws, low, high, candidates, at, form: str, estimating: bool, rounded: bool, products: bool) -> np.ndarray:
    """(candidate, place, sum): weighted sums of f, h, f^2, f h, and weights, over a chunk's values.

    With q = R^(2/S) = exp(y), R = z_i / z_p in the infinite domain, f and h are as in
    _terms(). The logarithm of R is taken once for all scales at the same bounds.
    """
    with np.errstate(all="ignore"):
        zs, zp = (_to_z(x, low, high, form) for x in (xs, at))
        known = ~np.isnan(zs)  # outside the domain of the form
        zs, ws = zs[known], ws[known]
        out = np.zeros((len(candidates), len(at), 5))
        out[:, :, 4] = ws.sum()
        room = np.empty((2, len(zs), len(at)))
        by_bounds: dict[tuple, list[int]] = {}
        for c, (_, lb, ub, _) in enumerate(candidates):
            by_bounds.setdefault((lb, ub), []).append(c)
        for (lb, ub), own in by_bounds.items():
            inner = lambda z, lb=lb, ub=ub: (z - lb) / (1 - z / ub + Z_EPS)
            place = inner(zp)
            logs = inner(zs)[:, None] / (place + EPS)[None]
            np.abs(logs, out=logs)
            logs += R_EPS
            np.minimum(logs, R_MAX, out=logs)
            np.log(logs, out=logs)
            for c in own:
                s, _, _, g = candidates[c]
                scale = s if not g and not rounded else s * np.exp(g * place)
                if rounded:
                    scale = np.maximum(np.floor(scale * 10 + 0.5) / 10, LEAST_SCALE)
                y = np.multiply(2 / scale, logs, out=room[0][: len(zs)])
                if np.ndim(scale) or abs(2 / scale) * math.log(R_MAX) > Y_MAX:
                    np.clip(y, -Y_MAX, Y_MAX, out=y)
                if not products:
                    out[c, :, 0], out[c, :, 1] = _summed(estimating, y, ws, out[c, 0, 4], room[1][: len(zs)])
                    continue
                f, h = _terms(estimating, y)
                out[c, :, 0], out[c, :, 1] = ws @ f, ws @ h
                out[c, :, 2], out[c, :, 3] = ws @ (f * f), ws @ (f * h)
        return out


def _smooth_means(xs, ws, low, high, scales, lb, ub, form: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(scale, value): estimating means f and h at all values of a group, which are sorted; None where all pairs of values are the shorter way.

    In the logarithm of the infinite domain both are sums of smooth functions of the distance of two values, whose nearest poles
    lie pi s / 4 off the line. So stretches of that length have NODES Chebyshev nodes each: weights go from the values
    to the nodes, kernels are taken between nodes, and means go from the nodes to the values, with errors about 1e-13.
    """
    zs = _to_z(xs, low, high, form)
    inner = (zs - lb) / (1 - zs / ub + Z_EPS)
    if not (np.isfinite(inner).all() and inner[0] > 0):
        return None
    at, spots = np.log(inner), np.log(inner + EPS)
    width = math.pi * min(scales) / 4
    stretch = ((at - at[0]) / width).astype(int)
    numbers, starts = np.unique(stretch, return_index=True)
    span = max(float(at[-1] - at[0]), -math.log(R_EPS)) + width
    many = len(numbers) * NODES
    if many >= len(xs) or (np.diff(at) < 0).any() or span >= math.log(R_MAX) or 2 / min(scales) * span > Y_MAX:
        return None
    bases = [at[0] + (numbers + 0.5) * width, np.append(starts, len(xs))]
    unit = np.cos((np.arange(NODES) + 0.5) * math.pi / NODES)
    across = np.cos(np.arange(NODES)[:, None] * np.arccos(unit)[None]) * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES

    def polynomials(values: np.ndarray) -> np.ndarray:
        u = (values - bases[0][np.searchsorted(numbers, stretch)]) * (2 / width)
        out = np.empty((NODES, len(u)))
        out[0], out[1] = 1, u
        for k in range(2, NODES):
            np.multiply(2 * u, out[k - 1], out=out[k])
            out[k] -= out[k - 2]
        return out

    own = polynomials(at)
    weights = (np.add.reduceat(own * ws, starts, axis=1).T @ across).ravel()
    nodes = (bases[0][:, None] + unit[None] * (width / 2)).ravel()
    f, h = np.empty((2, len(scales), many))
    step = max(1, ROOM // many)
    room = np.empty((2, many, min(step, many)))
    for a in range(0, many, step):
        logs = np.log(np.exp(nodes[:, None] - nodes[None, a : a + step]) + R_EPS)
        for c, s in enumerate(scales):
            y = np.multiply(2 / s, logs, out=room[0][:, : logs.shape[1]])
            f[c, a : a + step], h[c, a : a + step] = _summed(True, y, weights, weights.sum(), room[1][:, : logs.shape[1]])
    if np.abs(spots - at).max() > 1e-15:
        own = polynomials(spots)
    series = np.concatenate([f, h]).reshape(2 * len(scales), len(numbers), NODES) @ across.T
    means = np.empty((2 * len(scales), len(xs)))
    for i, (a, b) in enumerate(zip(bases[1][:-1], bases[1][1:], strict=True)):
        means[:, a:b] = series[:, i] @ own[:, a:b]
    means /= ws.sum()
    return means[: len(scales)], means[len(scales) :]


def _whole_means(xs, ws, low, high, scales, lb, ub, form: str, estimating: bool) -> tuple[np.ndarray, np.ndarray]:
    """(scale, value): means f and h at all values of a group."""
    with np.errstate(all="ignore"):
        found = _smooth_means(xs, ws, low, high, scales, lb, ub, form) if estimating else None
        if found is not None:
            return found
        candidates, step = [(s, lb, ub, 0.0) for s in scales], max(1, ROOM // len(xs))
        parts = [_chunk_sums(xs, ws, low, high, candidates, xs[a : a + step], form, estimating, False, False) for a in range(0, len(xs), step)]
        sums = np.concatenate(parts, 1)
        return sums[:, :, 0] / sums[:, :, 4], sums[:, :, 1] / sums[:, :, 4]


def _met(sample: Sample, groups: DataFrame, columns: tuple[str, ...], counts: bool = False) -> DataFrame:
    """(keys, _xs, _ws, dlb, dub, columns): the chunks of each group, and the datum that it has besides as one of its own; _cs too if asked for."""
    kept = [*sample.keys, "_xs", "_ws", *(["_cs"] if counts else []), "dlb", "dub", *columns]
    met = join_groups(sample.chunks, sample.sided(groups.select(*sample.keys, "dlb", "dub", *columns)), sample.by).select(*kept)
    if not sample.added:
        return met
    own = {"_xs": F.array("_at"), "_ws": F.array(F.lit(1.0)), "_cs": F.array(F.lit(1).cast("long"))}
    return met.unionByName(groups.withColumns(own).select(*kept))


_ASKED = ("_s", "_lb", "_ub", "_g", "_px", "_pt", "_pw")
_SUMS = ("_f", "_h", "_f2", "_fh", "_n")


def moments(sample: Sample, asked: DataFrame, form: str, estimating: bool, rounded: bool = False, products: bool = False) -> DataFrame:
    """(keys, c, p, s, lb, ub, g, target, weight, f, h, f2, fh): means at each place of each candidate; f2 and fh with `products` alone.

    `asked` has the keys, dlb, dub, arrays _s, _lb, _ub and _g of candidates, and _px, _pt and
    _pw of places, their targets and weights. The scale at a place z is s exp(g z), `rounded`
    to a tenth and LEAST_SCALE at least if so asked.
    """
    keys, met = sample.keys, _met(sample, asked, _ASKED)
    if sample.added:
        met = met.repartition(sample.chunks.rdd.getNumPartitions(), *keys)
    schema = StructType([met.schema[k] for k in keys])
    for name, kind in (("c", IntegerType()), ("p", IntegerType()), *((n, DoubleType()) for n in ("s", "lb", "ub", "g", "target", "weight", *_SUMS))):
        schema = schema.add(name, kind)

    def passed(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[] for _ in range(8 + len(_SUMS))]
        rows = []
        for row, sums, candidates, (_, targets, weights) in found.values():
            many, spots, _ = sums.shape
            rows.append(np.repeat(row, many * spots))
            own = [np.repeat(np.arange(many), spots), np.tile(np.arange(spots), many)]
            own += [np.repeat(np.array([c[i] for c in candidates]), spots) for i in range(4)]
            own += [np.tile(targets, many), np.tile(weights, many)]
            for to, values in zip(columns, [*own, *(sums[:, :, i].ravel() for i in range(len(_SUMS)))], strict=True):
                to.append(values)
        taken = pa.array(np.concatenate(rows))
        arrays = [batch.column(k).take(taken) for k in keys]
        arrays += [pa.array(np.concatenate(c), pa.int32() if i < 2 else pa.float64()) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows
            low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dlb", "dub"))
            lists = {c: batch.column(c) for c in ("_xs", "_ws", *_ASKED)}
            found, size = {}, 0
            for row, name in enumerate(names):
                own = {c: np.asarray(lists[c][row].values.to_numpy(zero_copy_only=False), float) for c in lists}
                known = found.get(name)
                candidates = known[2] if known else list(zip(*(own[c].tolist() for c in _ASKED[:4]), strict=True))
                sums = _chunk_sums(own["_xs"], own["_ws"], low[row], high[row], candidates, own["_px"], form, estimating, rounded, products)
                if known:
                    known[1] += sums
                    continue
                found[name] = [row, sums, candidates, (own["_px"], own["_pt"], own["_pw"])]
                size += sums.size
                if size > HELD:
                    yield passed(batch, found)
                    found, size = {}, 0
            if found:
                yield passed(batch, found)

    # the sums of a candidate meet in one task, where its function is followed over the places
    sums = met.mapInArrow(run, schema).repartition(*keys, "c").groupBy(*keys, "c", "p")
    first = [F.first(n).alias(n) for n in ("s", "lb", "ub", "g", "target", "weight")]
    added = sums.agg(*first, *[F.sum(n).alias(n) for n in _SUMS])
    means = [F.try_divide(F.col(n), F.col("_n")).alias(n[1:]) for n in _SUMS[:4]]
    return added.select(*keys, "c", "p", "s", "lb", "ub", "g", "target", "weight", *means)


def distribution(kind: str) -> Column:
    """The value of a function before its running maximum, from the means f and h."""
    f, h = F.col("f"), F.col("h")
    if kind == "qldf":
        return (1 - h / (F.sqrt(1 + h * h) + F.lit(EPS))) / 2
    if kind == "eldf":
        return (1 - h) / 2
    norm = F.sqrt(f * f + h * h)
    return (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), h / F.when(norm > 0, norm).otherwise(EPS)))) / 2


def density(kind: str, s: Column, z: Column) -> Column:
    f, h = F.col("f"), F.col("h")
    if kind == "egdf":
        raised = F.pow(f * f + h * h, F.lit(1.5))
        return (f * f * F.col("f2") / s + f * h * F.col("fh") / s) / F.when(raised == 0, EPS).otherwise(raised)
    if kind == "eldf":
        return F.greatest(f * f / (s + F.lit(EPS)), F.lit(0.0))
    if kind == "qgdf":
        slope = F.greatest(F.lit(-1 + 1e-12), F.least(F.lit(1 - 1e-12), h / f))
        return (1 - slope * slope) / (s * z)
    return f / s / F.pow(1 + h * h, F.lit(1.5))


def _asked(groups: DataFrame, candidates: dict[str, Column], keys: list[str], target: str = "target") -> DataFrame:
    """What moments() needs of groups with _places, for arrays of candidates by name."""
    names = [candidates[n].alias(f"_{n}") for n in ("s", "lb", "ub", "g")]
    spots = [F.col(f"_places.{n}").alias(c) for n, c in (("x", "_px"), (target, "_pt"), ("weight", "_pw"))]
    return groups.select(*keys, "dlb", "dub", *names, *spots, *(c for c in ("_at",) if c in groups.columns))


def _climbed(keys: list[str]) -> Column:
    """A function's values with the running maximum over places, within 0 and 1."""
    rising = F.max("_v").over(Window.partitionBy(*keys, "c").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rising))


def _alike(value: Column, target: Column, room: float) -> Column:
    """The fidelity of two values of distribution functions."""
    there, back = value / (target + F.lit(room)), target / (value + F.lit(room))
    return 2 / (there * there + back * back)


def _best(sample: Sample, asked: DataFrame, core: str, form: str, empirical: bool) -> DataFrame:
    """(keys, _best): of each group's candidates the one of least loss, with that loss and the mean fidelity."""
    keys = sample.keys
    met = moments(sample, asked, form, core[0] == "e").withColumn("_v", distribution(core)).withColumn("_v", _climbed(keys))
    loss = -F.avg(_alike(F.col("_v"), F.col("target"), 1e-6)) if empirical else F.max(F.abs(F.col("_v") - F.col("target")) * F.col("weight"))
    losses = met.groupBy(*keys, "c").agg(loss.alias("loss"), F.avg("f").alias("mean_f"), *[F.first(n).alias(n) for n in ("s", "lb", "ub")])
    ranked = F.struct(F.round("loss", DIGITS).alias("r"), "c", "s", "lb", "ub", "loss", "mean_f")
    return losses.groupBy(*keys).agg(F.min(ranked).alias("_best"))


def _searched_apart(sample: Sample, groups: DataFrame, core: str, form: str, s: float | None, empirical: bool) -> DataFrame:
    """(keys, _best) of groups of any size: their chunks meet each round's candidates in many tasks."""
    keys, target = sample.keys, "wedf" if empirical else "target"
    best = _best(sample, _asked(groups, _coarse(s, form), keys, target), core, form, empirical)
    for step in ROUNDS:
        about = join_groups(groups, sample.sided(best), keys)
        best = _best(sample, _asked(about, _cube(s, step), keys, target), core, form, empirical)
    return best


def _searched_together(sample: Sample, groups: DataFrame, core: str, form: str, s: float | None, empirical: bool) -> DataFrame:
    """The same of groups of few chunks: a group's chunks come into one task, which takes the same sums for all rounds."""
    keys, target = sample.keys, "wedf" if empirical else "target"
    starts = {f"_start_{n}": c for n, c in zip(("lb", "ub"), start_bounds(form), strict=True)}
    spots = {c: F.col(f"_places.{n}") for n, c in (("x", "_px"), (target, "_pt"), ("weight", "_pw"))}
    began, placed = tuple(starts), tuple(spots)
    met = _met(sample, groups.withColumns(starts | spots), (*began, *placed))
    schema, names = StructType([met.schema[k] for k in keys]), ("r", "c", "s", "lb", "ub", "loss", "mean_f")
    for n in names:
        schema = schema.add(n, IntegerType() if n == "c" else DoubleType())

    def run(table: pa.Table) -> pa.Table:
        one = lambda c: np.asarray(table.column(c)[0].values.to_numpy(zero_copy_only=False), float)
        low, high, lb, ub = (table.column(c)[0].as_py() for c in ("dlb", "dub", *began))
        chunks = [tuple(np.asarray(table.column(c)[i].values.to_numpy(zero_copy_only=False), float) for c in ("_xs", "_ws")) for i in range(table.num_rows)]
        at, targets, weights = (one(c) for c in placed)
        rows = coarse(s)
        rows[0] = (rows[0][0], math.nan if lb is None else lb, math.nan if ub is None else ub)
        for step in (None, *ROUNDS):
            if step is not None:
                rows = _moved(found[2:5], s, step)
            sums = sum(_chunk_sums(xs, ws, low, high, [(*r, 0.0) for r in rows], at, form, core[0] == "e", False, False) for xs, ws in chunks)
            found = min(_judged(sums, rows, targets, weights, empirical))
        own = {k: _in_utc(table.column(k).slice(0, 1)) for k in keys}
        return pa.table(own | {n: pa.array([v], pa.int32() if n == "c" else pa.float64()) for n, v in zip(names, found, strict=True)})

    return met.groupBy(*keys).applyInArrow(run, schema).select(*keys, F.struct(*names).alias("_best"))


def _searched_whole(sample: Sample, groups: DataFrame, core: str, form: str, s: float | None) -> DataFrame:
    """(keys, _best) with the loss at all rows, of groups of up to WHOLE values: a group's values come into one task, for all rounds.

    Rows of equal values differ in their targets alone, so the first and the last of them tell the greatest distance.
    """
    keys = sample.keys
    starts = {f"_start_{n}": c for n, c in zip(("lb", "ub"), start_bounds(form), strict=True)}
    began = tuple(starts)
    met = _met(sample, groups.withColumns(starts), began, True)
    schema, names = StructType([met.schema[k] for k in keys]), ("r", "c", "s", "lb", "ub", "loss", "mean_f")
    for n in names:
        schema = schema.add(n, IntegerType() if n == "c" else DoubleType())

    def run(table: pa.Table) -> pa.Table:
        low, high, lb, ub = (table.column(c)[0].as_py() for c in ("dlb", "dub", *began))
        listed = (np.concatenate([np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in table.column(c)]) for c in ("_xs", "_cs", "_ws"))
        values, cs, ws = listed
        # a datum besides may equal a value
        xs, which = np.unique(values, return_inverse=True)
        cs, ws = (np.bincount(which, v) for v in (cs, ws))
        before, n = np.cumsum(cs) - cs, cs.sum()
        targets, weights = ((before + 0.5) / n, (before + cs - 0.5) / n), ws / cs * n / ws.sum()
        rows = coarse(s)
        rows[0] = (rows[0][0], math.nan if lb is None else lb, math.nan if ub is None else ub)
        for step in (None, *ROUNDS):
            if step is not None:
                rows = _moved(found[2:5], s, step)
            by_bounds: dict[tuple, list[int]] = {}
            for c, (_, *bounds) in enumerate(rows):
                by_bounds.setdefault(tuple(bounds), []).append(c)
            judged = []
            for bounds, own in by_bounds.items():
                f, h = _whole_means(xs, ws, low, high, [rows[c][0] for c in own], *bounds, form, core[0] == "e")
                losses = np.max([_distances(f, h, t, weights) for t in targets], 0)
                judged += [(round(x, DIGITS), c, *rows[c], x, mean) for c, x, mean in zip(own, losses.tolist(), (f @ cs / n).tolist(), strict=True)]
            found = min(judged)
        own = {k: _in_utc(table.column(k).slice(0, 1)) for k in keys}
        return pa.table(own | {n: pa.array([v], pa.int32() if n == "c" else pa.float64()) for n, v in zip(names, found, strict=True)})

    # little data and much work: tasks must not be joined by size
    tasks = 4 * met.sparkSession.sparkContext.defaultParallelism
    dealt = met.repartition(max(tasks, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if keys else met
    return dealt.groupBy(*keys).applyInArrow(run, schema).select(*keys, F.struct(*names).alias("_best"))


def _moved(best: tuple[float, float, float], s: float | None, step: tuple[float, float]) -> list[tuple]:
    """The candidates of a later round, about the best one."""
    moved = [tuple(v * f for v, f in zip(best, factors, strict=True)) for factors in cube(s, step)]
    return [tuple(v if n == "s" and s is not None else max(a, min(b, v)) for v, (n, (a, b)) in zip(row, BOX.items(), strict=True)) for row in moved]


def _searched_blocks(sample: Sample, groups: DataFrame, core: str, form: str, s: float | None) -> DataFrame:
    """The same for groups of more values: chunks meet blocks of CHUNK values, in many tasks, for each round.

    The work grows with the square of a group's values, the memory of a task does not.
    """
    keys, by = sample.keys, sample.by
    blocked = replace(sample, keys=[*keys, "_block"], held=BROADCAST_BYTES + 1)
    ranked = running_sums(sample.rows(), by, "_x", {"_kc": F.col("_c"), "_i": F.lit(1)}, [])
    listed = ranked.groupBy(*by, F.floor((F.col("_i") - 1) / CHUNK).alias("_block")).agg(F.collect_list(F.struct("_x", "_c", "_w", "_kc")).alias("_p"))
    met = join_groups(cut(listed), groups.select(*keys, "n", *sample.added), by)
    whole = with_totals(sample.rows(), by, F.sum("_w").alias("_all")).select(*by, "_all").distinct()
    met = join_groups(met, whole, by)
    n, later = F.col("n"), lambda x: (x > F.col("_at")).cast("int") if sample.added else F.lit(0)
    first = lambda e: e["_kc"] - e["_c"] + later(e["_x"])
    scale = n / (F.col("_all") + F.lit(1.0)) if sample.added else n / F.col("_all")
    spots = {
        "_px": F.col("_p._x"),
        "_pt": F.transform("_p", lambda e: (first(e) + 0.5) / n),
        "_pc": F.col("_p._c"),
        "_pw": F.transform("_p", lambda e: e["_w"] / e["_c"] * scale),
    }
    blocks = met.select(*keys, "_block", *[v.alias(k) for k, v in spots.items()])
    if sample.added:
        # the datum comes after the values that it equals
        pos = join_groups(sample.rows(), groups.select(*keys, "_at"), by).groupBy(*keys).agg(F.sum(F.when(F.col("_x") <= F.col("_at"), F.col("_c")).otherwise(0)).alias("_pos"))
        own = join_groups(join_groups(groups.select(*keys, "n", "_at"), pos, keys), whole, by)
        one = (F.col("_at"), (F.col("_pos") + 0.5) / n, F.lit(1).cast("long"), F.lit(1.0) * scale)
        blocks = blocks.unionByName(own.select(*keys, F.lit(-1).cast("long").alias("_block"), *[F.array(v).alias(k) for k, v in zip(spots, one, strict=True)]))
    blocks = cut(blocks)
    sizes = blocks.select(*keys, "_block", F.posexplode(F.arrays_zip("_pc")).alias("p", "_e")).select(*keys, "_block", "p", F.col("_e._pc").alias("_c"))

    def best(asked: DataFrame) -> DataFrame:
        own = join_groups(blocks.drop("_pc"), asked, keys)
        means = join_groups(moments(blocked, own, form, core[0] == "e"), sizes, [*keys, "_block", "p"])
        means = join_groups(means, groups.select(*keys, "n"), keys).withColumn("_v", distribution(core))
        rising = F.max("_v").over(Window.partitionBy(*keys, "c").orderBy("target").rowsBetween(Window.unboundedPreceding, 0))
        means = means.withColumn("_v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rising)))
        far = [F.abs(F.col("_v") - t) for t in (F.col("target"), F.col("target") + (F.col("_c") - 1) / F.col("n"))]
        loss = F.max(F.greatest(*far) * F.col("weight"))
        losses = means.groupBy(*keys, "c").agg(loss.alias("loss"), _mean(F.col("f")).alias("mean_f"), *[F.first(x).alias(x) for x in ("s", "lb", "ub")])
        order = F.struct(F.round("loss", DIGITS).alias("r"), "c", "s", "lb", "ub", "loss", "mean_f")
        return losses.groupBy(*keys).agg(F.min(order).alias("_best"))

    def asked(about: DataFrame, candidates: dict[str, Column]) -> DataFrame:
        return about.select(*keys, "dlb", "dub", *sample.added, *[candidates[x].alias(f"_{x}") for x in ("s", "lb", "ub", "g")])

    found = best(asked(groups, _coarse(s, form)))
    for step in ROUNDS:
        found = best(asked(join_groups(groups, cut(found), keys), _cube(s, step)))
    return found


def _in_utc(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Times as Spark takes them back: in whatever zone the session's are, they come in that and go in UTC."""
    zoned = pa.types.is_timestamp(column.type) and column.type.tz is not None
    return column.cast(pa.timestamp("us", "UTC")) if zoned else column


def _risen(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(candidate, place): a global function's values, from its means at places in order."""
    norm = np.sqrt(f * f + h * h)
    v = (1 - np.clip(h / np.where(norm > 0, norm, EPS), -1, 1)) / 2
    return np.clip(np.maximum.accumulate(v, axis=1), 0, 1)


def _distances(f: np.ndarray, h: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The greatest weighted distance of each candidate from the targets, infinite where it has none."""
    with np.errstate(all="ignore"):
        losses = (np.abs(_risen(f, h) - targets) * weights).max(1)
    return np.where(np.isnan(losses), np.inf, losses)


def _judged(sums: np.ndarray, rows: list[tuple], targets: np.ndarray, weights: np.ndarray, empirical: bool) -> list[tuple]:
    """(loss in DIGITS, number, s, lb, ub, loss, mean fidelity) of each candidate from its sums, as _best() has them."""
    with np.errstate(all="ignore"):
        f, h = sums[:, :, 0] / sums[:, :, 4], sums[:, :, 1] / sums[:, :, 4]
        if empirical:
            v = _risen(f, h)
            there, back = v / (targets + 1e-6), targets / (v + 1e-6)
            losses = -(2 / (there * there + back * back)).mean(1)
            losses = np.where(np.isnan(losses), np.inf, losses)
        else:
            losses = _distances(f, h, targets, weights)
    return [(round(loss, DIGITS), c, *row, loss, mean) for c, (row, loss, mean) in enumerate(zip(rows, losses.tolist(), f.mean(1).tolist(), strict=True))]


def fit(sample: Sample, kind: str = "egdf", form: str = "a", s: float | None = None, empirical: bool = False) -> DataFrame:
    """(keys, n, dlb, dub, median, s_opt, lb, ub, loss, mean_f) of each group of a sample, checkpointed.

    The loss is the greatest weighted distance from the mid-ranks; if `empirical`, the
    negative mean fidelity to the weighted empirical function. lb and ub are in the
    normalised domain. A given `s` is kept. Groups of one value alone are not searched: scale
    one (or s), the starting bounds, no loss. Null keys are a group.
    """
    keys, core = sample.keys, {"e": "egdf", "q": "qgdf"}[kind[0]]
    whole = sample.count == 0
    if whole and empirical:
        raise ValueError("a sample without places is fitted to the mid-ranks")
    held = WHOLE if whole else TOGETHER * CHUNK
    searched, together, more = sample.groups.filter("dub > dlb"), F.col("_values") <= held, () if whole else (empirical,)
    parts = []
    if sample.least <= held:
        parts.append((_searched_whole if whole else _searched_together)(sample, searched.filter(together), core, form, s, *more))
    if sample.most > held:
        parts.append((_searched_blocks if whole else _searched_apart)(sample, searched.filter(~together), core, form, s, *more))
    best = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    lb, ub = start_bounds(form)
    groups = sample.groups.drop("_places", "_values")
    found = join_groups(groups, best, keys, "left") if keys else groups.join(best, how="left")
    return cut(
        found.select(
            *keys,
            "n",
            "dlb",
            "dub",
            "median",
            F.coalesce("_best.s", F.lit(float(s or 1.0))).alias("s_opt"),
            F.coalesce("_best.lb", lb).alias("lb"),
            F.coalesce("_best.ub", ub).alias("ub"),
            F.col("_best.loss").alias("loss"),
            F.coalesce("_best.mean_f", F.lit(1.0)).alias("mean_f"),
            *sample.added,
        )
    )


def with_local_scale(sample: Sample, fits: DataFrame, form: str = "a") -> DataFrame:
    """`fits` with s_local: the scale of the mean fidelity of rows about the median at scale one."""
    z, keys = _convert(form), sample.keys
    met = sample.met(fits.select(*keys, "dlb", "dub", "lb", "ub", "median", *sample.added))
    inner = lambda x: fininf(z(F.col(x), F.col("dlb"), F.col("dub")), F.col("lb"), F.col("ub"))
    f = fidelity_i(*q_pair(F.try_divide(inner("_x"), inner("median") + F.lit(EPS)), 1.0))
    means = met.select(*keys, f.alias("_f"), "_c").groupBy(*keys).agg(_mean(F.col("_f")).alias("_f"))
    return join_groups(fits, means.select(*keys, gnostic_scale(F.col("_f")).alias("s_local")), keys)


def _mean(x: Column) -> Column:
    """The mean over rows of what distinct values, counted _c, have; nulls take no part."""
    return F.try_divide(F.sum(x * F.col("_c")), F.sum(F.when(x.isNotNull(), F.col("_c"))))


def curves(sample: Sample, fits: DataFrame, kind: str, form: str = "a", points: int = 100, scale: str = "s_opt", gamma: str | None = None) -> DataFrame:
    """(keys, point, di, zi, s, cdf, pdf) over an even grid between each group's ends.

    With `gamma` the scale at a place is scale * exp(gamma * zi), in tenths.
    """
    z, keys = _convert(form), sample.keys
    step = (F.col("dub") - F.col("dlb")) / F.lit(float(max(1, points - 1)))
    at = lambda i: F.col("dlb") + step * i
    one = lambda c: F.array(F.col(c) if isinstance(c, str) else c)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
    none = F.transform(grid, lambda x: F.lit(0.0))
    listed = (one(scale), one("lb"), one("ub"), one(F.lit(0.0) if gamma is None else gamma), grid, none, none)
    asked = fits.select(*keys, "dlb", "dub", *sample.added, *[v.cast("array<double>").alias(n) for n, v in zip(_ASKED, listed, strict=True)])
    means = moments(sample, asked, form, kind[0] == "e", gamma is not None, True)
    lo, hi = F.col("dlb"), F.col("dub")
    whole = join_groups(means, sample.sided(fits.select(*keys, "dlb", "dub")), keys).withColumns({"di": at(F.col("p")), "_v": distribution(kind)})
    whole = whole.withColumn("_z", z(F.col("di"), lo, hi)).withColumn("zi", fininf(F.col("_z"), F.col("lb"), F.col("ub")))
    own = F.col("s") if gamma is None else tenths(F.col("s") * F.exp(F.col("g") * F.col("zi")))
    whole = whole.withColumn("_own", own)
    cdf = F.col("_v") if kind == "qldf" else _climbed(keys)
    return whole.select(*keys, F.col("p").alias("point"), "di", "zi", F.col("_own").alias("s"), cdf.alias("cdf"), density(kind, F.col("_own"), F.col("_z")).alias("pdf"))


def tenths(scale: Column) -> Column:
    """A varying scale as it is used: in tenths, LEAST_SCALE at least."""
    return F.greatest(F.floor(scale * 10 + 0.5) / 10, F.lit(LEAST_SCALE))


def tops(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _mid): the point of a density's greatest value; where it is flat to a hundredth of the spread, its middle."""
    whole = Window.partitionBy(*keys)
    near = F.abs(F.col("pdf") - F.col("_high")) <= F.greatest(0.01 * F.col("_sd"), F.lit(1e-10))
    rows = curve.withColumns({"_high": F.max("pdf").over(whole), "_sd": F.stddev_pop("pdf").over(whole)})
    rows = rows.withColumns({"_near": near, "_top": F.min(F.when(F.col("pdf") == F.col("_high"), F.col("point"))).over(whole)})
    ends = rows.groupBy(*keys).agg(
        F.coalesce(F.max(F.when((F.col("point") < F.col("_top")) & ~F.col("_near"), F.col("point"))) + 1, F.lit(0)).alias("_a"),
        F.coalesce(F.min(F.when((F.col("point") > F.col("_top")) & ~F.col("_near"), F.col("point"))) - 1, F.max("point")).alias("_b"),
    )
    return ends.select(*keys, (F.col("_a") + F.floor((F.col("_b") - F.col("_a") + 1) / 2)).cast("int").alias("_mid"))


def with_tops(fits: DataFrame, curve: DataFrame, keys: list[str], points: int) -> DataFrame:
    """`fits` with z0, the place of the curve's top."""
    step = (F.col("dub") - F.col("dlb")) / F.lit(float(max(1, points - 1)))
    return join_groups(fits, tops(curve, keys), keys).withColumn("z0", F.col("dlb") + step * F.col("_mid")).drop("_mid")


def with_z0(sample: Sample, fits: DataFrame, kind: str, form: str = "a", points: int = 100, s: float | None = None) -> DataFrame:
    """`fits` with s_local (s_opt for the global kinds, or where s is given) and z0, checkpointed."""
    local = kind in ("eldf", "qldf") and s is None
    scaled = cut(with_local_scale(sample, fits, form)) if local else fits.withColumn("s_local", F.col("s_opt"))
    return cut(with_tops(scaled, curves(sample, scaled, kind, form, points, "s_local"), sample.keys, points))


def about_z0(sample: Sample, fits: DataFrame, form: str = "a") -> DataFrame:
    """(keys, variance_i, variance_j, residual_entropy, relative_entropy) about z0, over rows.

    Data are taken in the infinite domain and z0 in the normalised one, as the definitions do;
    variances are mean squared irrelevances at s_local, entropies are at s_opt.
    """
    z, keys = _convert(form), sample.keys
    met = sample.met(fits)
    inner = fininf(z(F.col("_x"), F.col("dlb"), F.col("dub")), F.col("lb"), F.col("ub"))
    ratio = F.try_divide(inner, z(F.col("z0"), F.col("dlb"), F.col("dub")) + F.lit(EPS))
    local, whole = q_pair(ratio, F.col("s_local")), q_pair(ratio, F.col("s_opt"))
    named = {"_hi": irrelevance_i(*local), "_hj": irrelevance_j(*local), "_fi": fidelity_i(*whole), "_fj": fidelity_j(*whole)}
    fi, fj = F.col("_fi"), F.col("_fj")
    return met.select(*keys, "_c", *[v.alias(k) for k, v in named.items()]).groupBy(*keys).agg(
        _mean(F.col("_hi") * F.col("_hi")).alias("variance_i"),
        _mean(F.col("_hj") * F.col("_hj")).alias("variance_j"),
        (2 * (_mean(fj) - 1)).alias("residual_entropy"),
        _mean((fj - fi) / (fj + fi)).alias("relative_entropy"),
    )


def varying_coarse() -> list[tuple]:
    """Candidates (S0, gamma) of the first round; the first one is the start."""
    return [VARYING_START, *product(*VARYING_COARSE)]


def varying_square(step: tuple[float, float]) -> list[tuple]:
    """(factor of S0, shift of gamma): each down by two steps, one, not at all, or up."""
    return list(product([math.exp(step[0] * i) for i in (-2, -1, 0, 1, 2)], [step[1] * i for i in (-2, -1, 0, 1, 2)]))


def varying(sample: Sample, fits: DataFrame, kind: str, form: str = "a") -> DataFrame:
    """`fits` with s0, gamma and score: the scale S0 exp(gamma z) that varies with a datum's place z.

    z is the datum in the infinite domain; the fit's bounds stay. The score, which the
    rounds make great, is the weighted mean over places of the fidelity
    2 / (r^2 + 1 / r^2) of r, the local function over the mid-rank function.
    Groups of one value have s0 1 and gamma 0.
    """
    keys = sample.keys
    bounds = join_groups(sample.groups.filter("dub > dlb"), sample.sided(fits.select(*keys, "lb", "ub")), keys)
    def best(asked: DataFrame) -> DataFrame:
        met = moments(sample, asked, form, kind[0] == "e").withColumn("_v", distribution(kind))
        value = F.col("_v") if kind == "qldf" else _climbed(keys)
        met = met.withColumn("_value", value)
        met = met.withColumn("_alike", _alike(F.col("_value"), F.col("target"), 1e-12))
        scores = met.groupBy(*keys, "c").agg(
            (F.sum(F.col("_alike") * F.col("weight")) / F.sum("weight")).alias("score"), *[F.first(n).alias(n) for n in ("s", "g")]
        )
        ranked = F.struct((-F.round("score", DIGITS)).alias("r"), "c", "s", "g", "score")
        return scores.groupBy(*keys).agg(F.min(ranked).alias("_best"))

    def candidates(scales: Column, gammas: Column) -> dict[str, Column]:
        same = {n: F.array_repeat(n, F.size(scales)) for n in ("lb", "ub")}
        return same | {"s": scales, "g": gammas}

    first = list(zip(*varying_coarse(), strict=True))
    found = best(_asked(bounds, candidates(_listed(first[0]), _listed(first[1])), keys))
    for step in VARYING_ROUNDS:
        factors, shifts = zip(*varying_square(step), strict=True)
        scales = _within(F.transform(_listed(factors), lambda x: F.col("_best.s") * x), *VARYING_BOX[0])
        gammas = _within(F.transform(_listed(shifts), lambda x: F.col("_best.g") + x), *VARYING_BOX[1])
        found = best(_asked(join_groups(bounds, sample.sided(found), keys), candidates(scales, gammas), keys))
    out = join_groups(fits, found, keys, "left") if keys else fits.join(found, how="left")
    return cut(
        out.select(
            *fits.columns,
            F.coalesce("_best.s", F.lit(1.0)).alias("s0"),
            F.coalesce("_best.g", F.lit(0.0)).alias("gamma"),
            F.col("_best.score").alias("score"),
        )
    )


_PAIR = ("_xs", "_ys", "_cs", "_xt", "_yt", "_ct")
_OWN = ("dlb", "dub", "s_opt", "lb", "ub")


def rank_pairs(df: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """(keys, _chunk, _ks, _xs, _ys, _cs): the values of two columns of the same rank in their groups, in chunks of their order.

    Ranks of the same two values are one, counted _cs and named by the first of them: both
    columns rise with the rank, so a group has fewer of these than distinct values of both.
    Rows in which either is no number take no part.
    """
    both = valid(df.select(*keys, F.col(first).cast("double").alias("_x"), F.col(second).cast("double").alias("_y")), "_x", "_y")
    x, y = (running(both.select(*keys, c), keys, c, F.lit(1), "_k", []) for c in ("_x", "_y"))
    rows = join_groups(x, y, [*keys, "_k"]).groupBy(*keys, "_x", "_y").agg(F.min("_k").alias("_k"), F.count("*").alias("_c"))
    placed = running(rows, keys, "_k", F.lit(1), "_i", [])
    listed = placed.groupBy(*keys, F.floor((F.col("_i") - 1) / CHUNK).alias("_chunk")).agg(F.collect_list(F.struct("_k", "_x", "_y", "_c")).alias("_p"))
    return cut(listed.select(*keys, "_chunk", *[F.col(f"_p.{c}").alias(f"{c}s") for c in ("_k", "_x", "_y", "_c")]))


def pair_sums(pairs: DataFrame, fitted: tuple[DataFrame, DataFrame], keys: list[str], form: str, case: str, columns: bool) -> DataFrame:
    """Sums over irrelevances h[i, j] of ranks i and j, of two columns that each have a fit.

    Without `columns` (keys, xy, xx, yy, n), sums of products over all i and j; with it (keys, k, c, x, y), sums
    over i of each column's own, at the c ranks that are named k. Chunks of ranks meet chunks of ranks, a block in one task at a
    time; the quantifying irrelevances of whole sums are kept between 1 and 1e12.
    """
    met = pairs
    for name, own in zip("xy", fitted, strict=True):
        met = join_groups(met, own.select(*keys, F.array(*_OWN).alias(f"_{name}f")), keys)
    other = pairs.select(*keys, *[F.col(f"_{n}s").alias(f"_{n}t") for n in "kxyc"])
    blocks = join_groups(met, other, keys) if keys else met.crossJoin(other)
    spread = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.sparkSession.sparkContext.defaultParallelism)
    blocks = blocks.select(*keys, "_kt", "_xf", "_yf", *_PAIR).repartition(spread)
    names = ("k", "c", "x", "y") if columns else ("xy", "xx", "yy", "n")
    schema = StructType([blocks.schema[k] for k in keys])
    for n in names:
        schema = schema.add(n, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in names]
            lists = {c: batch.column(c) for c in ("_kt", "_xf", "_yf", *_PAIR)}
            for row in range(batch.num_rows):
                own = {c: lists[c][row].values.to_numpy(zero_copy_only=False).astype(float) for c in lists}
                h = [_irrelevances(own[f"_{n}s"], own[f"_{n}t"], own[f"_{n}f"], form, case) for n in "xy"]
                if columns:
                    values = [own["_kt"], own["_ct"], *(own["_cs"] @ m for m in h)]
                else:
                    h = [np.clip(m, 1, 1e12) for m in h] if case == "j" else h
                    c, t = own["_cs"], own["_ct"]
                    values = [np.array([v]) for v in (c @ (h[0] * h[1]) @ t, c @ (h[0] * h[0]) @ t, c @ (h[1] * h[1]) @ t, c.sum() * t.sum())]
                rows.append(np.full(len(values[0]), row))
                for to, v in zip(out, values, strict=True):
                    to.append(v)
            if rows:
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keys), *(pa.array(np.concatenate(o), pa.float64()) for o in out)], schema.names)

    parts = blocks.mapInArrow(run, schema)
    by = [*keys, "k", "c"] if columns else keys
    return parts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names if n not in by])


def _irrelevances(data: np.ndarray, places: np.ndarray, own: np.ndarray, form: str, case: str) -> np.ndarray:
    low, high, s, lb, ub = own.tolist()
    with np.errstate(all="ignore"):
        zs, zp = ((np.exp((2 * x - high - low) / ((high - low) + Z_EPS)) if form == "a" else np.exp(2 * np.log(x / low) / np.log(high / low) - 1)) for x in (data, places))
        at, over = ((z - lb) / (1 - z / ub + Z_EPS) for z in (zs, zp))
        y = np.clip(2 / s * np.log(np.minimum(np.abs(at[:, None] / (over + EPS)[None]) + R_EPS, R_MAX)), -Y_MAX, Y_MAX)
        return _terms(case == "i", y)[1]
