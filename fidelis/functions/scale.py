"""The scale parameter that belongs to a mean fidelity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps at most, the step that ends the search.
STEPS, STEP_EPS = 100, 1e-5
_UNIT = 2 / math.pi


def gnostic_scale(fidelity: Column) -> Column:
    """2/pi times the root S of sin(S) / S = fidelity, by Newton's method in the JVM.

    The start depends on the fidelity's size; a step under 1e-5 ends the search. Fidelities
    of one and more have no root but zero: the result then lies near zero. Null gives null.
    """
    start = (
        F.when(fidelity < _UNIT * math.sqrt(2) / 3, math.pi)
        .when(fidelity < _UNIT, 3 * math.pi / 4)
        .when(fidelity < _UNIT * math.sqrt(2), math.pi / 2)
        .otherwise(math.pi / 4)
    )

    def step(state: Column, _: Column) -> Column:
        s = state["s"]
        delta = F.coalesce(F.try_divide(F.sin(s) - s * fidelity, F.cos(s) - fidelity), F.lit(0.0))
        return (
            F.when(state["done"], state)
            .otherwise(F.struct((s - delta).alias("s"), (F.abs(delta) < STEP_EPS).alias("done")))
        )

    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.struct(start.alias("s"), F.lit(False).alias("done")), step
    )
    return F.when(fidelity.isNotNull(), state["s"] * _UNIT)
