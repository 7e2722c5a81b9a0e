"""The screen in single precision keeps every row that can be among the nearest."""

import numpy as np
import pytest

from foldwright.operators.neighbors import _distances, _Screen


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 1e6), (1e-30, 0), (1e12, 0), (1e200, 0)])
def test_no_near_row_is_ruled_out(p, scale, shift):
    rng = np.random.default_rng(p)
    x, z = (scale * (rng.normal(size=(n, 16)) + shift) for n in (5000, 20))
    x[4000:4010] = x[:10]  # ties
    screen = _Screen(x, p)
    for q in z:
        d = _distances(q[None], x, p)[0]
        assert set(np.flatnonzero(d <= np.sort(d)[4])) <= set(screen.near(q, 5))


@pytest.mark.parametrize("p", [1, 2])
def test_most_rows_are_ruled_out(p):
    rng = np.random.default_rng(p)
    x, z = rng.normal(size=(5000, 64)), rng.normal(size=64)
    assert len(_Screen(x, p).near(z, 5)) < 20


def test_values_that_are_no_numbers_leave_all_rows():
    x = np.ones((10, 2))
    x[3, 1] = np.nan
    assert len(_Screen(x, 1).near(np.ones(2), 2)) == 10
    assert len(_Screen(np.ones((10, 2)), 2).near(np.array([np.inf, 0]), 2)) == 10
