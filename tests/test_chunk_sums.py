"""Sums of a chunk against the fidelities and irrelevances themselves, up to the ends of their range."""

import numpy as np
import pytest

from fidelis.operators import fits


@pytest.mark.parametrize("estimating", [True, False])
def test_summed_terms(estimating):
    y = np.concatenate([np.linspace(-30, 30, 241), [-fits.Y_MAX, fits.Y_MAX if estimating else 300.0]])[:, None] * np.array([[1.0, 0.01]])
    ws = np.arange(1.0, len(y) + 1)
    f, h = fits._terms(estimating, y)
    got = fits._summed(estimating, y.copy(), ws, ws.sum(), np.empty_like(y))
    scale = ws.sum() if estimating else ws @ f
    assert all(np.all(np.abs(a - ws @ b) <= 1e-14 * scale) for a, b in zip(got, (f, h), strict=True))
