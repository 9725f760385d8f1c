"""Fidelities, irrelevances, entropies and criteria of ratios R = datum / ideal value."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards that keep powers of R finite.
R_EPS, S_MIN = 1e-10, 0.01
LOG_MAX = math.log(sys.float_info.max)
R_MAX, MAX_EXPONENT, Q_MAX = math.exp(LOG_MAX / 10), LOG_MAX - 2, sys.float_info.max / 1e6
P_EPS = 1e-12


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def q_pair(r: Column, s: Column | float = 1.0) -> tuple[Column, Column]:
    """q = R^(2/S) and its inverse, in log space and clipped to finite values."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    log_r = F.log(_clip(F.abs(r) + F.lit(R_EPS), R_EPS, R_MAX))
    power = 2 / F.greatest(s, F.lit(S_MIN)) * log_r
    q = F.exp(_clip(power, -MAX_EXPONENT, MAX_EXPONENT))
    q1 = F.exp(_clip(-power, -MAX_EXPONENT, MAX_EXPONENT))
    return _clip(q, R_EPS, Q_MAX), _clip(q1, R_EPS, Q_MAX)


def fidelity_i(q: Column, q1: Column) -> Column:
    """Estimating fidelity, in (0, 1]."""
    return 2 / (q + q1)


def fidelity_j(q: Column, q1: Column) -> Column:
    """Quantifying fidelity, 1 or more."""
    return (q + q1) / 2


def irrelevance_i(q: Column, q1: Column) -> Column:
    """Estimating irrelevance, in [-1, 1]."""
    return _clip((q - q1) / (q + q1), -1.0, 1.0)


def irrelevance_j(q: Column, q1: Column) -> Column:
    """Quantifying irrelevance, unbounded."""
    return (q - q1) / 2


def residual_entropy(fi: Column, fj: Column) -> Column:
    return fj - fi


def entropy_i(fi: Column) -> Column:
    return 1 - fi


def entropy_j(fj: Column) -> Column:
    return fj - 1


def probability(h: Column) -> Column:
    """The distribution value of an irrelevance of either kind."""
    return F.abs(1 - h) / 2


def information(p: Column) -> Column:
    """Binary entropy of a probability, in nats."""
    p = _clip(p, P_EPS, 1 - P_EPS)
    return -p * F.log(p + F.lit(P_EPS)) - (1 - p) * F.log(1 - p + F.lit(P_EPS))


def _case(case: str, of: dict[str, Column]) -> Column:
    if case not in of:
        raise ValueError(f"case must be one of {sorted(of)}, not {case!r}")
    return of[case]


def criterion_error(case: str, fi: Column, fj: Column, hi: Column, hj: Column) -> Column:
    """The error that a criterion case looks at."""
    return _case(
        case,
        {
            "Q1": fj,
            "E1": fi,
            "Q2": fj * F.atan(hj),
            "E2": fi * F.atanh(hi),
            "Q3": F.sqrt(fj) * hj,
            "E3": F.sqrt(fi) * hi,
        },
    )


def filter_weight(case: str, fi: Column, fj: Column) -> Column:
    """The weight by which a criterion case filters data."""
    one = F.lit(1.0)
    return _case(case, {"Q1": fj, "E1": fi * fi, "Q2": one, "E2": fi, "Q3": one / F.sqrt(fj), "E3": one / F.sqrt(fi)})


def criterion(case: str, fi: Column, fj: Column, hi: Column, hj: Column, info_i: Column, info_j: Column) -> Column:
    """The value that a criterion case minimises."""
    return _case(
        case, {"Q1": hi * hi / 2, "E1": hj * hj / 2, "Q2": info_j, "E2": info_i, "Q3": fj, "E3": -fi}
    )


def sigmoid(x: Column) -> Column:
    """The logistic function; exp() never overflows in it."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)
