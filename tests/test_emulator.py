import warnings

import numpy as np
import pytest

from tidewright.functions.basis import Basis, parse_term, term_text
from tidewright.functions.kernels import Correlator
from tidewright.functions.scalar import kurtosis, truncated_t
from tidewright.operators import diagnostics, idemc
from tidewright.operators.design import directional_deriv, directional_proposal, get_deriv_info, maximin, seek_good
from tidewright.operators.train import fuzzy_two_means
from tidewright.plans.collections import EmulatorSet, subset_emulators
from tidewright.plans.emulator import EmulatedMatrix, Emulator, HierarchicalEmulator, ProtoEmulator, distance
from tidewright.plans.targets import Target, convert_ranges

R = {"a": (-0.5, 0.5), "b": (-1.0, 2.0)}


def prior(**more):
    s = np.array([[0.5, -0.1, 0.2], [-0.1, 1.0, 0.0], [0.2, 0.0, 1.5]])
    return Emulator(**{"basis": Basis.linear(R), "beta_mu": np.array([1.0, 2.0, 3.0]), "sigma": 3.0, "ranges": R, "beta_sigma": s, "name": "f", **more})


def trained(beta_sigma=None, corr=None, name="f", f=lambda a, b: np.sin(3 * a) + b**2):
    g = np.array([(a, b) for a in np.linspace(-0.5, 0.5, 5) for b in np.linspace(-1, 2, 5)])
    em = prior(beta_sigma=beta_sigma, corr=corr or Correlator.of("matern", theta=0.8, nu=2.5), name=name)
    return em.adjust(g, f(*g.T)), g


def test_documented_prior():
    x = np.array([[0.1, 0.1]])
    assert np.isclose(prior().get_exp(x)[0], 0.6) and np.isclose(prior().get_var(x)[0], 9.5, atol=0.01)


def test_interpolates_with_zero_variance():
    for s in (None, np.diag([0.5, 1.0, 1.5])):
        em, g = trained(s)
        assert np.allclose(em.get_exp(g), em.y, atol=1e-5) and np.allclose(em.get_var(g), 0, atol=1e-4)


def test_covariance_is_symmetric_and_psd():
    em, _ = trained()
    x = np.random.default_rng(0).uniform([-0.5, -1], [0.5, 2], (12, 2))
    c = em.get_cov(x)
    assert np.allclose(c, c.T, atol=1e-8) and np.linalg.eigvalsh(c).min() > -1e-6
    assert np.allclose(np.diag(c), em.get_var(x), atol=1e-8)
    assert (em.get_cov(x, compat=True) >= 0).all()


def test_derivatives_are_differences():
    em, _ = trained(np.diag([0.5, 1.0, 1.5]))
    x, h = np.array([[0.12, 0.4], [-0.2, 1.1]]), 1e-4
    e = np.array([[h, 0.0]])
    assert np.allclose(em.get_exp_d(x, "a"), (em.get_exp(x + e) - em.get_exp(x - e)) / (2 * h), atol=1e-4)
    v = em.get_cov_d(x, "a")
    num = [(em.get_cov(p + e, p + e) - em.get_cov(p + e, p - e) - em.get_cov(p - e, p + e) + em.get_cov(p - e, p - e))[0, 0] / (4 * h * h) for p in x[:, None]]
    assert np.allclose(v, num, rtol=0.05, atol=0.05)
    before = prior(corr=em.corr, beta_sigma=np.diag([0.5, 1.0, 1.5])).get_cov_d(x, "a")
    assert (v < before).all()  # data lower the variance of the slope
    info = get_deriv_info(em, x, var=True)
    assert info["exp"].shape == (2, 2) and info["var"].shape == (2, 2, 2)
    c = directional_deriv(em, x, [1, 0], sd=1.0)
    assert (c[:, 0] <= c[:, 1]).all() and (np.abs(c[:, 1]) <= 1).all()


def test_updates_return_copies():
    em, g = trained()
    assert em.mult_sigma(2).sd(g[:1])[0] == 6 and em.sd(g[:1])[0] == 3
    assert em.set_sigma(lambda x: 1 + x[:, 0] ** 2).get_var(g).shape == (25,)
    assert em.set_hyperparams(theta=0.3, nu=1.5).corr.params == {"theta": 0.3, "nu": 1.5}
    with pytest.raises(ValueError):
        em.set_hyperparams(alpha=1.0)
    assert "training points" in repr(em)


def test_implausibility():
    assert distance(np.array([0.0, 4.0]), np.array([0.0, 0.0]), Target.of((1, 2))).tolist() == [100.0, 200.0]
    assert distance(np.array([1.5]), np.array([0.0]), Target.of((1, 2)))[0] == 0
    d = distance(np.array([3.0]), np.array([3.0]), Target.of({"val": 5, "sigma": 1}))
    assert np.isclose(d[0], 1.0)
    em, g = trained()
    i = em.implausibility(g, {"val": 1.0, "sigma": 0.1})
    assert (em.implausibility(g, {"val": 1.0, "sigma": 0.1}, 3.0) == (i <= 3)).all()


def test_targets_and_ranges():
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert Target.of(10.0).sigma == 0.5 and convert_ranges({"a": (1,)}) is None
        assert len(w) == 2
    assert convert_ranges({"a": (2, 1)}) == {"a": (1.0, 2.0)}
    with pytest.raises(ValueError):
        convert_ranges({"a": (1, 1)})


def test_hierarchical():
    g = np.array([(a, b) for a in np.linspace(-0.5, 0.5, 4) for b in np.linspace(-1, 2, 4)])
    em = HierarchicalEmulator(basis=Basis.linear(R), beta_mu=np.zeros(3), sigma=1.0, ranges=R, corr=Correlator.of("exp_sq", theta=0.5), name="v", noise=lambda x, n: 0.5 / n, em_type="variance")
    em = em.adjust(g, np.full(16, 0.01), np.full(16, 10.0))
    assert (em.get_exp(g) > 0).all() and np.isclose(em.extra_variance(g)[0], 0.05)
    z = {"val": 2.0, "sigma": 0.0}
    assert (em.implausibility(g, z) >= 0).all() and em.disc == (0.0, 0.0)


def test_proto():
    p = ProtoEmulator(R, "f", lambda x, k: x[:, 0] * k, lambda x: np.full(len(x), 0.01), args={"k": 2})
    assert np.isclose(p.get_exp(np.array([[0.2, 0.0]]))[0], 0.4)
    assert np.isclose(p.implausibility(np.array([[0.2, 0.0]]), {"val": 0.5})[0], 1.0)
    with pytest.raises(ValueError):
        ProtoEmulator(R, "f", lambda y: y[:, 0], lambda x: x[:, 0])
    with pytest.raises(ValueError):
        ProtoEmulator(R, "f", lambda x, k: x[:, 0], lambda x: x[:, 0])
    with pytest.raises(ValueError):
        diagnostics.summary_diag(p, None)


def test_matrix():
    a, _ = trained(name="aa")
    b, g = trained(name="ab", f=lambda a, b: 0.1 * a)
    m = EmulatedMatrix(((a, b), (b, a)))
    e = m.get_exp(g[:3])
    assert e.shape == (3, 2, 2) and np.linalg.eigvalsh(e).min() >= -1e-9 and m.size == 2
    assert (np.linalg.eigvalsh(EmulatedMatrix(((a, None), (None, a)), logged=True).get_exp(g)) > 0).all()
    assert m.get_uncertainty(g[:2], [a, a]).shape == (2, 2, 2)


def test_collections():
    a, _ = trained(name="a")
    b, _ = trained(name="b")
    s = EmulatorSet.of([[a, b], [a]])
    assert s.outputs == ["a", "b"] and len(s.recent().members) == 2 and len(s.recent(rest=True).members) == 1
    assert subset_emulators({"expectation": [a, b], "variance": [a]}, ["a"]).kind == "variance"
    assert EmulatorSet.of({"mode1": [a], "mode2": [b], "prop": a}).kind == "multistate"
    assert s.ranges() == R
    assert len(s.ordered({"a": (0, 1)}).members) == 3


def test_terms():
    names = ["a", "ab"]
    for t in [(0, 0), (1, 0), (2, 1), (0, 3)]:
        assert parse_term(term_text(t, names), names) == t
    with pytest.raises(ValueError):
        parse_term("__import__('os')", names)
    assert np.allclose(Basis.full(names, 2).derivative(np.array([[2.0, 3.0]]), 0), [[0, 1, 0, 4, 3, 0]])


def test_closed_forms():
    assert np.isclose(kurtosis(np.arange(0, 4.001, 0.01)), 9 / 5, atol=1e-3)
    r = np.random.default_rng(1).standard_t(6, 10**6) * np.sqrt(4 / 6) * 0.7 - 0.2
    r = r[r > 0]
    m, v = truncated_t(-0.2, 0.49)
    assert np.isclose(m, r.mean(), rtol=0.01) and np.isclose(v, r.var(), rtol=0.05)


def test_errors_and_folds():
    em, g = trained()
    import pandas as pd

    x = np.random.default_rng(2).uniform([-0.5, -1], [0.5, 2], (8, 2))
    v = pd.DataFrame(x, columns=["a", "b"]).assign(f=np.sin(3 * x[:, 0]) + x[:, 1] ** 2)
    c = em.get_cov(x) + 1e-12 * np.eye(8)
    f, o = diagnostics.pivoted_cholesky(c)
    assert np.allclose(f @ f.T, c[np.ix_(o, o)], atol=1e-8)
    for k in ("normal", "eigen", "chol", "cholpivot"):
        assert len(diagnostics.individual_errors(em, v, k)) == 8
    s = diagnostics.summary_diag(em, v)
    chol = diagnostics.individual_errors(em, v, "chol")["error"]
    assert np.isclose((chol**2).sum(), s["mahalanobis"], rtol=1e-3)
    one, five = diagnostics.k_fold_measure(em), diagnostics.k_fold_measure(em, 5)
    assert len(one) == len(five) == 25
    assert diagnostics.effect_strength([em]).shape == (1, 3) and diagnostics.binomial_diagnostic_test(0, 30)


def test_thinning_and_seeking():
    em, g = trained()
    p = np.random.default_rng(0).uniform([-0.5, -1], [0.5, 2], (100, 2))
    rows = maximin(p, 10, 200)
    assert len(set(rows)) == 10
    assert seek_good([em], p, {"f": {"val": 1.0, "sigma": 0.2}}, 5).shape == (5, 2)
    start = np.array([0.4, 1.9])
    end = directional_proposal([em], start, {"f": {"val": 0.5, "sigma": 0.2}})
    z = {"val": 0.5, "sigma": 0.2}
    assert em.implausibility(end[None], z)[0] <= em.implausibility(start[None], z)[0]


def test_modes_and_idemc():
    y = np.concatenate([np.random.default_rng(0).normal(0, 1, 50), np.random.default_rng(1).normal(30, 1, 50)])
    lab, one, two = fuzzy_two_means(y)
    assert one >= two and lab[:50].sum() == 0 and lab[50:].sum() == 50
    one_blob = fuzzy_two_means(np.random.default_rng(2).normal(0, 1, 200))
    assert one_blob[1] < one_blob[2]
    em, _ = trained()
    z = {"f": {"val": 0.5, "sigma": 0.1}}
    got = idemc.idemc([em], 30, z, s=150, mutations=4, detailed=True)
    x = got["points"].to_numpy()
    assert len(x) == 30 and (em.implausibility(x, z["f"]) <= got["rungs"][-1] + 1e-9).all()
    assert got["rungs"] == sorted(got["rungs"], reverse=True)
