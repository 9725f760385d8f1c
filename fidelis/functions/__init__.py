"""Column expressions: they stay in the JVM and inside generated code."""

from fidelis.functions.characteristics import (
    criterion,
    criterion_error,
    entropy_i,
    entropy_j,
    fidelity_i,
    fidelity_j,
    filter_weight,
    information,
    irrelevance_i,
    irrelevance_j,
    probability,
    q_pair,
    residual_entropy,
    sigmoid,
    softmax,
)
from fidelis.functions.convert import az, fininf, inffin, mz, probable_bounds, rounded, za, zm
from fidelis.functions.features import one_hot, polynomial_terms
from fidelis.functions.scale import gnostic_scale

__all__ = [
    "az",
    "criterion",
    "criterion_error",
    "entropy_i",
    "entropy_j",
    "fidelity_i",
    "fidelity_j",
    "filter_weight",
    "fininf",
    "gnostic_scale",
    "inffin",
    "information",
    "irrelevance_i",
    "irrelevance_j",
    "mz",
    "one_hot",
    "polynomial_terms",
    "probability",
    "probable_bounds",
    "q_pair",
    "residual_entropy",
    "rounded",
    "sigmoid",
    "softmax",
    "za",
    "zm",
]
