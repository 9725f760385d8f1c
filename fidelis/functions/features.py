"""Feature expressions."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F


def polynomial_terms(columns: list[str], degree: int) -> list[tuple[str, Column]]:
    """All monomials up to `degree`, with the constant; by degree, then in column order.

    Names are like ``x__x__y``; the constant's is ``one``.
    """
    if degree < 1:
        raise ValueError("degree must be at least 1")
    terms = [("one", F.lit(1.0))]
    for d in range(1, degree + 1):
        for chosen in combinations_with_replacement(columns, d):
            product = F.col(chosen[0]).cast("double")
            for c in chosen[1:]:
                product = product * F.col(c).cast("double")
            terms.append(("__".join(chosen), product))
    return terms


def one_hot(label: Column, classes: int) -> Column:
    """An array with 1.0 at the place of an integer label 0..classes-1, else zeros."""
    return F.array(*[(label == k).cast("double") for k in range(classes)])
