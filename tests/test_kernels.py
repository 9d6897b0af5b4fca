import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.functions.kernels import Correlator, distances

P = np.array([(1.9, 0.1), (2.1, -0.1), (3.4, 0.4)])
Q = np.array([(1.8, 0.5), (2.4, 0.0), (3.2, -0.5)])
A, B = np.array([[1.0], [2.0]]), np.array([[1.1], [2.9]])
U, V = np.array([[1.0, 2.0, -1.0]]), np.array([[1.5, 2.9, -0.7]])
of = Correlator.of


def test_values():
    assert np.allclose(of("exp_sq", theta=1.0).corr(P, Q)[0], [0.8436648, 0.6376282, 0.07653555], atol=1e-7)
    two = Correlator("exp_sq", (("theta", np.array([1.0, 0.5])),))
    assert np.allclose(two.corr(P, Q)[0], [0.5220457768, 0.2165356706, 0.07427355], atol=1e-7)
    assert np.allclose(of("matern", theta=0.4, nu=2.5).corr(A, B), [[0.950959922, 0.09449877], [0.001200627, 0.09449877]], atol=1e-8)
    assert np.allclose(of("rat_quad", theta=0.4, alpha=2.5).corr(A, B), [[0.96942099, 0.1740445], [0.01401614, 0.1740445]], atol=1e-7)
    assert np.allclose(of("gamma_exp", theta=0.4, gamma=0.6).corr(A, B), [[0.6470865, 0.196575705], [0.07832213, 0.196575705]], atol=1e-7)
    assert np.isclose(of("rat_quad", theta=0.2, alpha=0.5).corr(U, V)[0, 0], 0.1833397, atol=1e-7)


def test_matern_half_is_orn_uhl():
    a, b = of("matern", theta=0.2, nu=0.5).corr(U, V), of("orn_uhl", theta=0.2).corr(U, V)
    assert np.isclose(a[0, 0], 0.0046919704, atol=1e-9) and np.allclose(a, b)


def test_derivatives():
    assert np.isclose(of("exp_sq", theta=0.4).corr_d(A, B, 0)[0, 0], 1.174266, atol=1e-6)
    # these two are with respect to the second argument
    assert np.isclose(-of("matern", theta=0.4, nu=2.5).corr_d(A, B, 0)[0, 0], -0.928542145, atol=1e-8)
    assert np.isclose(-of("rat_quad", theta=0.4, alpha=2.5).corr_d(A, B, 0)[0, 0], -0.5984080, atol=1e-7)
    assert np.isclose(of("matern", theta=1.0, nu=2.5).corr_d(P[:1], Q[:1], 0, 1)[0, 0], 0.132580306, atol=1e-8)
    assert np.isclose(of("rat_quad", theta=1.0, alpha=2.5).corr_d(P[:1], Q[:1], 0, 1)[0, 0], 0.04817765, atol=1e-8)


@settings(max_examples=25, deadline=None)
@given(st.floats(-1, 1), st.floats(-1, 1), st.sampled_from(["exp_sq", "matern", "rat_quad"]))
def test_derivatives_are_differences(x, y, name):
    c = {"exp_sq": of("exp_sq", theta=0.7), "matern": of("matern", theta=0.7, nu=2.5), "rat_quad": of("rat_quad", theta=0.7, alpha=1.2)}[name]
    a, b, h = np.array([[x, 0.3]]), np.array([[y, -0.2]]), 1e-5
    e = np.array([[h, 0.0]])
    assert np.isclose(c.corr_d(a, b, 0)[0, 0], ((c.corr(a + e, b) - c.corr(a - e, b)) / (2 * h))[0, 0], atol=1e-6)
    assert np.isclose(c.corr_d(a, b, 0, 1)[0, 0], ((c.corr_d(a, b + e[:, ::-1], 0) - c.corr_d(a, b - e[:, ::-1], 0)) / (2 * h))[0, 0], atol=1e-5)


def test_swapping_negates_and_transposes():
    c = of("matern", theta=0.5, nu=2.5)
    assert np.allclose(c.corr_d(P, Q, 0), -c.corr_d(Q, P, 0).T)


def test_inactive_nugget_and_errors():
    c = of("exp_sq", 0.1, theta=0.5)
    act = np.array([True, False])
    assert (c.corr_d(P, Q, 1, active=act) == 0).all()
    same = c.corr(P, P, act)
    assert np.allclose(np.diag(same), 1) and same[0, 1] < 1
    assert c.corr(P[:1]) == 1
    with pytest.raises(ValueError):
        distances(P, U)
    with pytest.raises(ValueError):
        of("orn_uhl", theta=1.0).corr_d(P, Q, 0)
    with pytest.raises(ValueError):
        of("matern", theta=1.0, nu=1.0).corr(P, Q)
    with pytest.raises(ValueError):
        of("exp_sq", alpha=1.0)
    assert np.isclose(distances(np.array([[1, 0.1]]), np.array([[0, 0]]))[0, 0], 1.0049876)
