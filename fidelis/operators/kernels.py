"""Fitting one small sample's distribution function in numpy.

The search for scale and bounds is sequential and every step needs all pairs of data, so a
sample (of bounded size, see distributions.samples) is fitted within one task. Everything
that follows from a fit is done by column expressions.
"""

from __future__ import annotations

import math
import sys
from itertools import product

import numpy as np

from fidelis.functions.characteristics import MAX_EXPONENT, Q_MAX, R_EPS, R_MAX, S_MIN
from fidelis.functions.convert import EPS as CONVERT_EPS
from fidelis.functions.convert import TINY

EPS = sys.float_info.epsilon
#: The box that scale and bounds are searched in.
S_BOX, LB_BOX, UB_BOX = (0.1, 10.0), (1e-6, math.exp(-1.000001)), (math.exp(1.000001), 1e6)
#: Where the search may start besides the given place.
COARSE = {"s": (0.2, 0.4, 0.7, 1.0, 1.6, 3.0), "lb": (1e-3, 0.03, 0.1353, 0.3), "ub": (3.0, 7.389, 30.0, 1000.0)}
_GOLD = (math.sqrt(5) - 1) / 2


def to_z(x: np.ndarray | float, low: float, high: float, form: str) -> np.ndarray:
    if form == "a":
        return np.exp((2 * x - high - low) / ((high - low) + CONVERT_EPS))
    span = math.log(high / low)
    return np.exp(np.log(x / low) * (2 / span) - 1) if span else np.ones_like(np.asarray(x, float))


def from_z(z: float, low: float, high: float, form: str) -> float:
    if form == "a":
        top = high + TINY if low >= high else high
        return (math.log(abs(z) + CONVERT_EPS) * (top - low) + low + top) / 2
    v = math.sqrt(high / low)
    return low * v * z ** math.log(v)


def to_infinite(z: np.ndarray, lb: float, ub: float) -> np.ndarray:
    return (z - lb) / (1 - z / ub + CONVERT_EPS)


def pair(ratio: np.ndarray, s: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """q and its inverse, with the guards of functions.q_pair."""
    power = 2 / np.maximum(s, S_MIN) * np.log(np.clip(np.abs(ratio) + R_EPS, R_EPS, R_MAX))
    power = np.clip(power, -MAX_EXPONENT, MAX_EXPONENT)
    return np.clip(np.exp(power), R_EPS, Q_MAX), np.clip(np.exp(-power), R_EPS, Q_MAX)


def f_and_h(kind: str, s, lb: float, ub: float, z_data: np.ndarray, z_eval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fidelities and irrelevances of data (rows) at places (columns)."""
    ratio = to_infinite(z_data, lb, ub)[:, None] / (to_infinite(z_eval, lb, ub)[None] + EPS)
    q, q1 = pair(ratio, s)
    if kind[0] == "e":
        return 2 / (q + q1), np.clip((q - q1) / (q + q1), -1, 1)
    return (q + q1) / 2, (q - q1) / 2


def distribution(kind: str, f: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distribution values at the columns' places, for weights w of the rows."""
    share = w / w.sum()
    mf, mh = share @ f, share @ h
    if kind == "qldf":
        return (1 - mh / (np.sqrt(1 + mh * mh) + EPS)) / 2
    if kind == "eldf":
        value = (1 - mh) / 2
    else:
        norm = np.hypot(mf, mh)
        value = (1 - np.clip(mh / np.where(norm > 0, norm, EPS), -1, 1)) / 2
    return np.clip(np.maximum.accumulate(value), 0, 1)


def density(kind: str, f: np.ndarray, h: np.ndarray, w: np.ndarray, s: float, z: np.ndarray) -> np.ndarray:
    share = w / w.sum()
    mf, mh = share @ f, share @ h
    if kind == "egdf":
        raised = np.power(mf * mf + mh * mh, 1.5)
        return (mf * mf * (share @ (f * f)) / s + mf * mh * (share @ (f * h)) / s) / np.where(raised == 0, EPS, raised)
    if kind == "eldf":
        return np.maximum(mf * mf / (s + EPS), 0)
    if kind == "qgdf":
        floor = math.sqrt(EPS)
        slope = np.clip(mh / np.where(np.abs(mf) < floor, floor, mf), -1 + 1e-12, 1 - 1e-12)
        out = (1 - slope * slope) / (s * np.where(np.abs(z) < floor, floor, z))
        return np.where(np.isfinite(out), out, 0.0)
    return mf / s / np.power(1 + mh * mh, 1.5)


def scale_of(fidelity: float) -> float:
    """2/pi times the root of sin(S) / S = fidelity."""
    unit = 2 / math.pi
    starts = ((unit * math.sqrt(2) / 3, math.pi), (unit, 3 * math.pi / 4), (unit * math.sqrt(2), math.pi / 2))
    s = next((v for limit, v in starts if fidelity < limit), math.pi / 4)
    for _ in range(100):
        slope = math.cos(s) - fidelity
        step = (math.sin(s) - s * fidelity) / slope if slope else 0.0
        s -= step
        if abs(step) < 1e-5:
            break
    return s * unit


def sample_weights(z: np.ndarray) -> np.ndarray:
    """Squared fidelities about the median at the sample's own scale."""
    ratio = z / np.median(z)
    q, q1 = pair(ratio, 1.0)
    q, q1 = pair(ratio, scale_of(float((2 / (q + q1)).mean())))
    return (2 / (q + q1)) ** 2


def _line(loss, x: np.ndarray, k: int, low: float, high: float, best: float, steps: int = 18) -> tuple[np.ndarray, float]:
    """A coarse scan of one coordinate, then a golden-section search around its best place."""
    places = np.linspace(low, high, 9)
    found = []
    for p in places:
        y = x.copy()
        y[k] = p
        found.append(loss(y))
    i = int(np.argmin(found))
    a, b = places[max(0, i - 1)], places[min(len(places) - 1, i + 1)]
    points = [(best, x[k]), (found[i], places[i])]
    c, d = b - _GOLD * (b - a), a + _GOLD * (b - a)

    def at(p: float) -> float:
        y = x.copy()
        y[k] = p
        v = loss(y)
        points.append((v, p))
        return v

    fc, fd = at(c), at(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - _GOLD * (b - a)
            fc = at(c)
        else:
            a, c, fc = c, d, fd
            d = a + _GOLD * (b - a)
            fd = at(d)
    value, place = min(points)
    y = x.copy()
    y[k] = place
    return y, value


def minimise(loss, start: dict[str, float], box: dict[str, tuple[float, float]], tolerance: float = 1e-7, rounds: int = 6) -> tuple[dict[str, float], float]:
    """From the best of `start` and a coarse grid, coordinate by coordinate in log space until a
    round gains less than `tolerance`."""
    names = list(box)
    tried = [{n: start[n] for n in names}, *(dict(zip(names, p, strict=True)) for p in product(*(COARSE[n] for n in names)))]
    start = min(tried, key=loss)
    low = np.log([box[n][0] for n in names])
    high = np.log([box[n][1] for n in names])
    x = np.clip(np.log([start[n] for n in names]), low, high)
    value = loss({n: math.exp(v) for n, v in zip(names, x, strict=True)})
    of = lambda y: loss({n: math.exp(v) for n, v in zip(names, y, strict=True)})
    for _ in range(rounds):
        before = value
        for k in range(len(names)):
            x, value = _line(of, x, k, low[k], high[k], value)
        if before - value < tolerance:
            break
    return {n: math.exp(v) for n, v in zip(names, x, strict=True)}, value


FIT = (
    "n int, dlb double, dub double, lb double, ub double, s_opt double, s_local double, loss double, "
    "z array<double>, weights array<double>, di array<double>, zi array<double>, cdf array<double>, pdf array<double>, "
    "mean_f double, h_rows array<double>, z0 double, homogeneous boolean, peaks array<int>, lcb double, ucb double, "
    "tops array<int>, valleys array<int>"
)


def plateau_middle(values: np.ndarray) -> int:
    """The place of the greatest value; where the top is flat to a hundredth of the spread, its middle."""
    top = int(np.argmax(values))
    near = np.abs(values - values[top]) <= max(0.01 * float(np.std(values)), 1e-10)
    first = last = top
    while first and near[first - 1]:
        first -= 1
    while last + 1 < len(values) and near[last + 1]:
        last += 1
    return first + (last - first + 1) // 2


def inner_maxima(values: np.ndarray) -> list[int]:
    """Inner places higher than both sides; of a flat top its middle."""
    out, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i] > values[i - 1]:
            j = i
            while j + 1 < n and values[j + 1] == values[i]:
                j += 1
            if j + 1 < n and values[j + 1] < values[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Under a Gaussian kernel of four sigmas, mirrored at the ends with the ends repeated."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, radius, mode="symmetric"), kernel / kernel.sum(), "valid")


def density_peaks(pdf: np.ndarray) -> list[int]:
    """Maxima of the smoothed density of a hundredth of the greatest at least; of those nearer
    than a twentieth of the grid the higher stays. Highest first."""
    s = smooth(pdf)
    apart, kept = max(1, len(pdf) // 20), []
    for i in sorted((i for i in inner_maxima(s) if s[i] >= 0.01 * s.max()), key=lambda i: -s[i]):
        if all(abs(i - k) >= apart for k in kept):
            kept.append(i)
    return kept


def main_cluster(di: np.ndarray, pdf: np.ndarray, at: int, threshold: float = 0.0) -> tuple[float, float]:
    """On each side of a place the first point whose normalised density plus slope is at most `threshold`."""
    span = pdf.max() - pdf.min()
    normal = (pdf - pdf.min()) / span if span else np.full(len(pdf), 0.5)
    quiet = np.flatnonzero(normal + (np.gradient(normal) if len(normal) > 1 else 0.0) <= threshold)
    left, right = quiet[quiet < at], quiet[quiet > at]
    return float(di[left[-1]] if len(left) else di[0]), float(di[right[0]] if len(right) else di[-1])


def fit(
    kind: str, data: np.ndarray, weights: np.ndarray | None = None, form: str = "a", s: float | None = None,
    lb: float | None = None, ub: float | None = None, points: int = 100, robust: bool = False, empirical: bool = False,
    threshold: float = 0.0,
) -> dict:
    """Fits a sample: scale and bounds (in the normalised domain), the curve on a grid and its marks.

    Marks are z0 (the density's greatest place), whether the density has one peak and no
    negative value, and the bounds of the cluster around z0 (see main_cluster).

    s None means to search; lb and ub are in data units. With one bound given and no s,
    nothing is searched and s is 1. `robust` multiplies the weights by sample_weights();
    `empirical` compares with the weighted empirical function by fidelity, else by the
    greatest distance from the mid-rank function.
    """
    order = np.argsort(data, kind="stable")
    x = np.asarray(data, float)[order]
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)[order]
    low, high = float(x[0]), float(x[-1])
    z = to_z(x, low, high, form)
    if robust:
        w = w * sample_weights(z)
    w = w * len(w) / w.sum()
    pad = (high - low) / 2
    spread = math.sqrt(high / low) if form == "m" else 1.0
    lb_start = float(to_z(lb if lb is not None else (low - pad if form == "a" else low / spread), low, high, form))
    ub_start = float(to_z(ub if ub is not None else (high + pad if form == "a" else high * spread), low, high, form))
    target = (np.cumsum(w) - w / 2) / w.sum()
    if empirical:  # the value before each datum; the ends are 0 and 1
        target = np.concatenate([[0.0], target[:-1]])
        target[x >= high] = 1.0
        target[x <= low] = 0.0
    core = {"e": "egdf", "q": "qgdf"}[kind[0]]

    def loss(p: dict[str, float]) -> float:
        a, b = p.get("lb", lb_start), p.get("ub", ub_start)
        value = distribution(core, *f_and_h(core, p.get("s", s), a, b, z, z), w)
        if empirical:
            return -float((2 / ((value / (target + 1e-6)) ** 2 + (target / (value + 1e-6)) ** 2)).sum())
        return float((np.abs(value - target) * w).max())

    box: dict[str, tuple[float, float]] = {}
    both, neither = lb is not None and ub is not None, lb is None and ub is None
    if s is None and (both or neither):
        box["s"] = S_BOX
    if neither or (s is not None and not both):
        box |= {"lb": LB_BOX, "ub": UB_BOX}
    if high == low:
        box = {}
    s_start = 1.0 if s is None else s
    found, value = ({}, float("nan"))
    if box:
        found, value = minimise(loss, {"s": 0.5, "lb": lb_start, "ub": ub_start}, box)
    s_opt, lb_z, ub_z = found.get("s", s_start), found.get("lb", lb_start), found.get("ub", ub_start)
    scale = s_opt
    if kind in ("eldf", "qldf") and s is None:
        middle = to_infinite(to_z(np.median(x), low, high, form), lb_z, ub_z)
        q, q1 = pair(to_infinite(z, lb_z, ub_z) / (middle + EPS), 1.0)
        scale = scale_of(float((2 / (q + q1)).mean()))
    di = np.linspace(low, high, points)
    zp = to_z(di, low, high, form)
    f, h = f_and_h(kind, scale, lb_z, ub_z, z, zp)
    own_f, own_h = f_and_h(kind, scale, lb_z, ub_z, z, z)
    pdf = np.nan_to_num(density(kind, f, h, w, scale, zp), posinf=Q_MAX, neginf=-Q_MAX)
    at, peaks = plateau_middle(pdf), density_peaks(pdf)
    lcb, ucb = main_cluster(di, pdf, at, threshold)
    clean = lambda v: np.nan_to_num(np.asarray(v, float), posinf=Q_MAX, neginf=-Q_MAX).tolist()
    return {
        "n": len(x),
        "dlb": low,
        "dub": high,
        "lb": lb_z,
        "ub": ub_z,
        "s_opt": float(s_opt),
        "s_local": float(scale),
        "loss": value,
        "z": z.tolist(),
        "weights": w.tolist(),
        "di": di.tolist(),
        "zi": clean(to_infinite(zp, lb_z, ub_z)),
        "cdf": clean(distribution(kind, f, h, w)),
        "pdf": pdf.tolist(),
        "mean_f": float(own_f.mean()),
        "h_rows": clean(own_h.mean(0)),
        "z0": low if low == high else float(di[at]),
        "homogeneous": bool(low == high or ((pdf >= 0).all() and len(peaks) == 1)),
        "peaks": peaks,
        "lcb": lcb,
        "ucb": ucb,
        "tops": inner_maxima(pdf),
        "valleys": inner_maxima(-pdf),
    }


def varying_scale(data: np.ndarray, kind: str, form: str, result: dict, least: float = 0.1) -> list[float]:
    """Scales S0 exp(gamma * zi) at the data, rounded to tenths, that raise the fidelity to the mid ranks most."""
    z, w = np.array(result["z"]), np.array(result["weights"])
    lb, ub = result["lb"], result["ub"]
    zi = to_infinite(z, lb, ub)
    target = (np.cumsum(w) - w / 2) / w.sum()

    def loss(s0: float, gamma: float) -> float:
        s = s0 * np.exp(np.clip(gamma * zi, -50, 50))
        value = distribution(kind, *f_and_h(kind, s[None], lb, ub, z, z), w)
        fidelity = 2 / ((value / (target + 1e-12)) ** 2 + (target / (value + 1e-12)) ** 2)
        return -float((fidelity * w).sum())

    s0, gamma, best = 2.0, 0.0, loss(2.0, 0.0)
    step = np.array([1.0, 0.5])
    while step.max() > 1e-3:
        moves = [(s0 + a * step[0], gamma + b * step[1]) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        moves = [(min(10.0, max(1e-3, a)), min(2.0, max(-2.0, b))) for a, b in moves]
        values = [loss(*m) for m in moves]
        k = int(np.argmin(values))
        if values[k] < best - 1e-12:
            (s0, gamma), best = moves[k], values[k]
        else:
            step /= 2
    return np.maximum(np.round(s0 * np.exp(np.clip(gamma * zi, -50, 50)), 1), least).tolist()
