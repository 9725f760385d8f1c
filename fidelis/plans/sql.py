"""Pieces of DuckDB SQL that the oracle queries are built from, written apart from the Spark code."""

from __future__ import annotations

import math
import sys

LOG_MAX = math.log(sys.float_info.max)


def q(r: str, s: str = "1.0") -> str:
    power = f"(2 / greatest({s}, 0.01) * ln(greatest(least(abs({r}) + 1e-10, {math.exp(LOG_MAX / 10)!r}), 1e-10)))"
    return f"greatest(least(exp(greatest(least({power}, {LOG_MAX - 2!r}), {2 - LOG_MAX!r})), {sys.float_info.max / 1e6!r}), 1e-10)"


def q1(r: str, s: str = "1.0") -> str:
    power = f"(-2 / greatest({s}, 0.01) * ln(greatest(least(abs({r}) + 1e-10, {math.exp(LOG_MAX / 10)!r}), 1e-10)))"
    return f"greatest(least(exp(greatest(least({power}, {LOG_MAX - 2!r}), {2 - LOG_MAX!r})), {sys.float_info.max / 1e6!r}), 1e-10)"


def fi(r: str, s: str = "1.0") -> str:
    return f"(2 / ({q(r, s)} + {q1(r, s)}))"


def fj(r: str, s: str = "1.0") -> str:
    return f"(({q(r, s)} + {q1(r, s)}) / 2)"


def hi(r: str, s: str = "1.0") -> str:
    a, b = q(r, s), q1(r, s)
    return f"greatest(least(({a} - {b}) / ({a} + {b}), 1.0), -1.0)"


def hj(r: str, s: str = "1.0") -> str:
    return f"(({q(r, s)} - {q1(r, s)}) / 2)"


def info(p: str) -> str:
    p = f"greatest(least({p}, {1 - 1e-12!r}), 1e-12)"
    return f"(-({p}) * ln({p} + 1e-12) - (1 - {p}) * ln(1 - {p} + 1e-12))"


def az(x: str, lb: str, ub: str) -> str:
    return f"exp((2 * {x} - {ub} - {lb}) / (({ub} - {lb}) + 1e-6))"


def fininf(z: str, lb: str, ub: str) -> str:
    return f"(({z} - {lb}) / (1 - {z} / {ub} + 1e-6))"


def newton(source: str, keys: list[str], fidelity: str, name: str = "scaled", out: str = "scale") -> str:
    """CTEs (for WITH RECURSIVE) that end in `name`(keys, out) for the groups of `source`."""
    k = "".join(f"{x}, " for x in keys)
    pi = math.pi
    return f"""
{name}_steps AS (
  SELECT {k}{fidelity} AS f, 0 AS i, false AS done,
    CASE WHEN {fidelity} < {2 / pi * math.sqrt(2) / 3!r} THEN {pi!r} WHEN {fidelity} < {2 / pi!r} THEN {3 * pi / 4!r}
      WHEN {fidelity} < {2 / pi * math.sqrt(2)!r} THEN {pi / 2!r} ELSE {pi / 4!r} END::DOUBLE AS s
  FROM {source}
  UNION ALL
  SELECT {k}f, i + 1, abs((sin(s) - s * f) / (cos(s) - f)) < 1e-5, s - (sin(s) - s * f) / (cos(s) - f)
  FROM {name}_steps WHERE NOT done AND i < 100
),
{name} AS (SELECT {k}arg_max(s, i) * {2 / pi!r}::DOUBLE AS {out} FROM {name}_steps {'GROUP BY ' + ', '.join(keys) if keys else ''})"""
