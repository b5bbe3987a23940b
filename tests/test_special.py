from __future__ import annotations

import math

import numpy as np
import pytest

from quantell.functions.special import beta_inc, f_sf_array, gamma_q, hypergeom_sf_array, norm_sf_array, t_two_sided_array
from quantell.operators.plot_tests import shapiro


@pytest.mark.parametrize(("z", "p"), [(0, 0.5), (1.959963985, 0.025), (3, 0.001349898), (8, 6.22096e-16), (-1, 0.841344746)])
def test_normal(z, p):
    assert norm_sf_array(np.array([z]))[0] == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize(("t", "df", "p"), [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 1e9, 0.05), (0, 5, 1.0), (4.032143, 5, 0.01), (2.776445, 4, 0.05)])
def test_student(t, df, p):
    assert t_two_sided_array(np.array([t, -t]), np.array([df, df])) == pytest.approx([p, p], rel=1e-5)


@pytest.mark.parametrize(("x", "df", "p"), [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (0, 3, 1.0), (2, 2, math.exp(-1)), (149.449253, 100, 0.001)])
def test_chi_square(x, df, p):
    assert gamma_q(np.array([df / 2]), np.array([x / 2]))[0] == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize(("f", "a", "b", "p"), [(4.964603, 1, 10, 0.05), (3.325835, 5, 10, 0.05), (161.447639, 1, 1, 0.05), (0, 2, 3, 1.0)])
def test_f(f, a, b, p):
    assert f_sf_array(np.array([f]), np.array([a]), np.array([b]))[0] == pytest.approx(p, rel=1e-5)


def test_edges_and_hypergeometric():
    assert np.isnan(beta_inc(np.array([np.nan]), np.array([1.0]), np.array([0.5])))[0]
    assert beta_inc(np.array([2.0, 2.0]), np.array([3.0, 3.0]), np.array([0.0, 1.0])).tolist() == [0.0, 1.0]
    want = sum(math.comb(5, i) * math.comb(15, 6 - i) for i in range(2, 6)) / math.comb(20, 6)
    assert hypergeom_sf_array(np.array([2.0]), np.array([20.0]), np.array([5.0]), np.array([6.0]))[0] == pytest.approx(want)
    assert gamma_q(np.array([]), np.array([])).size == 0 and norm_sf_array(np.array([])).size == 0


def test_shapiro_on_published_values():
    # weights of eleven men, the example of Shapiro and Wilk (1965): W = 0.79
    w, p = shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    rng = np.random.default_rng(0)
    assert shapiro(rng.normal(size=200))[1] > 0.05 and shapiro(rng.exponential(size=200))[1] < 1e-6
    assert shapiro(np.array([1.0, 1.0, 1.0])) == (1.0, 1.0)
