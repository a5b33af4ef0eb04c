"""Sums over ticks have no end short of the last."""
import numpy as np
import pytest

from oddsmill.operators import fits


@pytest.mark.parametrize("theta", [(0.4, 0.1, 1.3, 0.6, 0.5, 0.7), (0.2, 0.5, 0.8, 0.9, 0.98, 0.3)])
def test_ticks_below_are_summed_to_the_end(theta):
    """the sum began 60 ticks below the move, where a slow tail holds much of the rest."""
    ks = np.arange(-60.0, 61.0)
    below = fits.masses_below(ks, *theta)
    for k, b in zip(ks, below, strict=True):
        assert abs(b - fits.masses(np.arange(-3000.0, k), *theta).sum()) < 1e-9
