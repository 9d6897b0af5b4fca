"""Bayes linear emulators as driver-side values.

f(x) = sum beta_i h_i(x) + u(x): training points are few, so the matrices are
built once on the driver and travel in a broadcast; scoring is in ``score``.
With data D, E_D[f] = E[f] + Cov(f,D) Var(D)^-1 (D - E[D]) and Var_D[f] =
Var[f] - Cov(f,D) Var(D)^-1 Cov(D,f); the uncertainty of beta is part of both.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.basis import Basis
from ..functions.kernels import Correlator
from ..functions.scalar import scale_array, truncated_t
from .targets import Ranges, Target

DIGITS = 10  # covariances are rounded to so many places
FLOOR = 1e-6  # and variances are not below this


def solve(k: np.ndarray) -> np.ndarray:
    """The inverse of a covariance matrix; the pseudo-inverse where it is singular."""
    try:
        c = np.linalg.cholesky(k)
        inv = np.linalg.inv(c)
        return inv.T @ inv
    except np.linalg.LinAlgError:
        return np.linalg.pinv(k)


@dataclass(frozen=True)
class Emulator:
    basis: Basis
    beta_mu: np.ndarray
    sigma: float | Callable  # a number, or a function of scaled points
    ranges: Ranges
    corr: Correlator = field(default_factory=Correlator)
    beta_sigma: np.ndarray | None = None
    name: str = "y"
    x: np.ndarray | None = None  # scaled training inputs
    y: np.ndarray | None = None
    disc: tuple[float, float] = (0.0, 0.0)  # internal, external
    multiplier: float = 1.0
    active: np.ndarray | None = None
    extra: np.ndarray | None = None  # further variances of the training outputs
    residual_sd: float = float("nan")

    def __post_init__(self):
        set_ = object.__setattr__
        q = len(self.basis.terms)
        set_(self, "beta_mu", np.asarray(self.beta_mu, float))
        set_(self, "beta_sigma", np.zeros((q, q)) if self.beta_sigma is None else np.asarray(self.beta_sigma, float))
        if self.active is None:
            set_(self, "active", self.basis.active())
        if self.x is None:
            return
        h = self.basis.values(self.x)
        s = self.sd(self.x)
        k = s[:, None] * s[None, :] * self.corr.corr(self.x, self.x, self.active)
        k = k + h @ self.beta_sigma @ h.T
        if self.extra is not None:
            k = k + np.diag(self.extra)
        inv = solve(k)
        set_(self, "k_inv", inv)
        set_(self, "weights", inv @ (self.y - h @ self.beta_mu))
        set_(self, "h_sigma", h @ self.beta_sigma)

    # ------------------------------------------------------------- parts

    @property
    def inputs(self) -> list[str]:
        return list(self.ranges)

    def sd(self, x: np.ndarray) -> np.ndarray:
        s = self.sigma(x) if callable(self.sigma) else np.full(len(x), float(self.sigma))
        return self.multiplier * np.asarray(s, float)

    def scaled(self, points: np.ndarray) -> np.ndarray:
        return scale_array(np.atleast_2d(np.asarray(points, float)), self.ranges)

    def cross(self, x: np.ndarray) -> np.ndarray:
        """Cov(f(x), D): a row for each point."""
        c = self.corr.corr(self.x, x, self.active) * self.sd(x)[:, None] * self.sd(self.x)[None, :]
        return c + self.basis.values(x) @ self.h_sigma.T

    # ------------------------------------------------------------- moments

    def get_exp(self, points: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = points if scaled else self.scaled(points)
        e = self.basis.values(x) @ self.beta_mu
        return e if self.x is None else e + self.cross(x) @ self.weights

    def get_var(self, points: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = points if scaled else self.scaled(points)
        h = self.basis.values(x)
        v = ((h @ self.beta_sigma) * h).sum(1) + self.sd(x) ** 2
        if self.x is not None:
            t = self.cross(x)
            v = v - ((t @ self.k_inv) * t).sum(1)
        return np.where((v := np.round(v, DIGITS)) < 0, FLOOR, v)

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance at scaled points, from one set of correlations."""
        h, s = self.basis.values(x), self.sd(x)
        e, v = h @ self.beta_mu, ((h @ self.beta_sigma) * h).sum(1) + s**2
        if self.x is not None:
            t = self.cross(x)
            e, v = e + t @ self.weights, v - ((t @ self.k_inv) * t).sum(1)
        v = np.round(v, DIGITS)
        return e, np.where(v < 0, FLOOR, v)

    def get_cov(self, points: np.ndarray, others: np.ndarray | None = None, full: bool = True, compat: bool = False) -> np.ndarray:
        """Covariances (rows: points, columns: others). Negative variances become 1e-6; ``compat`` does so off the diagonal too."""
        x = self.scaled(points)
        xp = x if others is None else self.scaled(others)
        if not full and len(x) == len(xp):
            return self.get_var(points) if others is None else np.diag(self.get_cov(points, others))
        c = self.basis.values(x) @ self.beta_sigma @ self.basis.values(xp).T
        c = c + self.sd(x)[:, None] * self.sd(xp)[None, :] * self.corr.corr(xp, x, self.active)
        if self.x is not None:
            c = c - self.cross(x) @ self.k_inv @ self.cross(xp).T
        c = np.round(c, DIGITS)
        if compat:
            return np.where(c < 0, FLOOR, c)
        if others is None:
            np.fill_diagonal(c, np.where(np.diag(c) < 0, FLOOR, np.diag(c)))
        return c

    def _cross_d(self, x: np.ndarray, p: int) -> np.ndarray:
        if callable(self.sigma):
            raise ValueError("derivatives need a constant sigma")
        s2 = (self.multiplier * self.sigma) ** 2
        return s2 * self.corr.corr_d(x, self.x, p, active=self.active).T + self.basis.derivative(x, p) @ self.h_sigma.T

    def half_width(self, p: int) -> float:
        lo, hi = list(self.ranges.values())[p]
        return (hi - lo) / 2

    def get_exp_d(self, points: np.ndarray, p: str) -> np.ndarray:
        """E[df/dx_p] in the units of the input."""
        i, x = self.inputs.index(p), self.scaled(points)
        e = self.basis.derivative(x, i) @ self.beta_mu
        if self.x is not None:
            e = e + self._cross_d(x, i) @ self.weights
        return e / self.half_width(i)

    def get_cov_d(self, points: np.ndarray, p1: str, others: np.ndarray | None = None, p2: str | None = None, full: bool = False) -> np.ndarray:
        """Cov[df/dx_p1, df/dx_p2]; training data lower it."""
        i, j = self.inputs.index(p1), self.inputs.index(p2 or p1)
        x = self.scaled(points)
        xp = x if others is None else self.scaled(others)
        s2 = (self.multiplier * self.sigma) ** 2
        c = self.basis.derivative(x, i) @ self.beta_sigma @ self.basis.derivative(xp, j).T + s2 * self.corr.corr_d(x, xp, i, j, self.active).T
        if self.x is not None:
            c = c - self._cross_d(x, i) @ self.k_inv @ self._cross_d(xp, j).T
        c = np.round(c / self.half_width(i) / self.half_width(j), DIGITS)
        return c if full or len(x) != len(xp) else np.diag(c)

    def extra_variance(self, x: np.ndarray) -> np.ndarray | float:
        return 0.0

    def implausibility(self, points: np.ndarray, z, cutoff: float | None = None) -> np.ndarray:
        """|z - E| / sqrt(Var + sigma^2 + disc^2); for an interval the distance to it, zero inside."""
        x = self.scaled(points)
        e, v = self.moments(x)
        return distance(e, v + self.extra_variance(x), Target.of(z), self.disc, cutoff)

    # ------------------------------------------------------------- updates

    def adjust(self, x: np.ndarray, y: np.ndarray, extra: np.ndarray | None = None) -> Emulator:
        """Trained on unscaled inputs and outputs; self stays the prior."""
        return replace(self, x=self.scaled(x), y=np.asarray(y, float), extra=extra)

    def set_sigma(self, sigma) -> Emulator:
        return replace(self, sigma=sigma)

    def mult_sigma(self, m: float) -> Emulator:
        return replace(self, multiplier=self.multiplier * m)

    def set_hyperparams(self, nugget: float | None = None, **hp) -> Emulator:
        return replace(self, corr=self.corr.set_hyper_p(nugget, **hp))

    def __repr__(self) -> str:
        terms = "; ".join(f"{t}: {b:.4g}" for t, b in zip(self.basis.text(), self.beta_mu, strict=True))
        rng = "; ".join(f"{k}: [{a:g}, {b:g}]" for k, (a, b) in self.ranges.items())
        s = "function" if callable(self.sigma) else f"{self.multiplier * self.sigma:.4g}"
        act = ", ".join(n for n, a in zip(self.inputs, self.active, strict=True) if a)
        return f"{type(self).__name__}({self.name})\n  inputs {rng}\n  terms {terms}\n  active {act}\n  kernel {self.corr.name} {self.corr.params} nugget {self.corr.nugget:g}, sigma {s}\n  {'prior' if self.x is None else f'{len(self.x)} training points'}"


def distance(e, v, z: Target, disc: tuple[float, float] = (0.0, 0.0), cutoff: float | None = None, floor: float = 1e-4) -> np.ndarray:
    d2 = sum(d * d for d in disc)
    if z.interval:
        out = np.where(e < z.lo, z.lo - e, np.where(e > z.hi, e - z.hi, 0.0)) / np.sqrt(np.maximum(v + d2, floor))
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.abs(z.val - e) / np.sqrt(v + z.sigma**2 + d2)
        out = np.where(np.isnan(out), 0.0, out)
    return out if cutoff is None else out <= cutoff


@dataclass(frozen=True)
class HierarchicalEmulator(Emulator):
    """An emulator of a statistic of replicates.

    ``noise``: (x, n) -> variance of the statistic at scaled x from n replicates;
    ``em_type``: mean, variance or covariance; variances are kept positive.
    """

    noise: Callable | None = None
    samples: np.ndarray | None = None
    em_type: str = "mean"

    def __post_init__(self):
        if self.x is not None and self.noise is not None and self.samples is not None:
            object.__setattr__(self, "extra", np.asarray(self.noise(self.x, self.samples), float))
        super().__post_init__()

    def adjust(self, x, y, samples=None) -> HierarchicalEmulator:
        return replace(self, x=self.scaled(x), y=np.asarray(y, float), samples=None if samples is None else np.asarray(samples, float))

    def moments(self, x):
        e, v = super().moments(x)
        if self.em_type == "variance":
            m, w = truncated_t(e, v)
            e, v = np.where(e <= 0, m, e), np.where(e <= 0, w, v)
        return e, v

    def get_exp(self, points, scaled: bool = False):
        return self.moments(points if scaled else self.scaled(points))[0]

    def get_var(self, points, scaled: bool = False):
        return self.moments(points if scaled else self.scaled(points))[1]

    def extra_variance(self, x):
        """What a run of average replication adds."""
        if self.noise is None or self.samples is None:
            return 0.0
        return np.asarray(self.noise(x, np.full(len(x), self.samples.mean())), float)

    def implausibility(self, points, z, cutoff=None):
        """Without any discrepancy an external one of 5 % of the target is taken (self does not change)."""
        z = Target.of(z)
        disc = self.disc if any(self.disc) else (0.0, abs(0.05 * z.centre))
        x = self.scaled(points)
        e, v = self.moments(x)
        return distance(e, v + self.extra_variance(x), z, disc, cutoff)


@dataclass(frozen=True)
class ProtoEmulator:
    """Any predictor behind the emulator interface: functions of a table of points named ``x``."""

    ranges: Ranges
    name: str
    predict: Callable
    variance: Callable
    implausible: Callable | None = None
    describe: Callable | None = None
    args: dict = field(default_factory=dict)
    active: np.ndarray | None = None
    disc: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        for f, lead in ((self.predict, ["x"]), (self.variance, ["x"]), (self.implausible, ["x", "z", "cutoff"])):
            if f is None:
                continue
            have = list(inspect.signature(f).parameters)
            if have[: len(lead)] != lead:
                raise ValueError(f"{f.__name__} must start with the arguments {', '.join(lead)}")
            known = {*lead, "xp", "full", "z", "cutoff", *self.args}
            if missing := [p for p, v in inspect.signature(f).parameters.items() if p not in known and v.default is inspect.Parameter.empty and v.kind not in (v.VAR_POSITIONAL, v.VAR_KEYWORD)]:
                raise ValueError(f"no value for the argument {missing[0]!r}")
        middle = np.array([[(a + b) / 2 for a, b in self.ranges.values()]])
        for f in (self.get_exp, self.get_var):
            if np.size(f(middle)) != 1:
                raise ValueError("a function must give one value for each point")
        if self.active is None:
            object.__setattr__(self, "active", np.ones(len(self.ranges), bool))

    def _call(self, f, x, **more):
        have = inspect.signature(f).parameters
        return f(x, **{k: v for k, v in {**self.args, **more}.items() if k in have})

    @property
    def inputs(self) -> list[str]:
        return list(self.ranges)

    def get_exp(self, points, scaled: bool = False):
        return np.ravel(np.asarray(self._call(self.predict, np.atleast_2d(points)), float))

    def get_var(self, points, scaled: bool = False):
        return np.ravel(np.asarray(self._call(self.variance, np.atleast_2d(points)), float))

    def get_cov(self, points, others=None, full: bool = False):
        return np.asarray(self._call(self.variance, np.atleast_2d(points), xp=others, full=full), float)

    def implausibility(self, points, z, cutoff=None):
        if self.implausible is not None:
            return np.asarray(self._call(self.implausible, np.atleast_2d(points), z=z, cutoff=cutoff))
        return distance(self.get_exp(points), self.get_var(points), Target.of(z), (0.0, 0.0), cutoff, floor=1e-6)

    def __repr__(self) -> str:
        return self.describe() if self.describe else f"ProtoEmulator({self.name})"


@dataclass(frozen=True)
class EmulatedMatrix:
    """A symmetric k x k matrix of emulators (None: zero); ``logged`` ones hold a matrix logarithm."""

    entries: tuple[tuple[object, ...], ...]
    logged: bool = False
    theta_t: float | None = None
    rho: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.entries)

    def _fill(self, points: np.ndarray, what: str) -> np.ndarray:
        k, n = self.size, len(np.atleast_2d(points))
        out = np.zeros((n, k, k))
        for i in range(k):
            for j in range(i, k):
                em = self.entries[i][j]
                if em is not None:
                    out[:, i, j] = out[:, j, i] = getattr(em, what)(points)
        return out

    def get_exp(self, points: np.ndarray) -> np.ndarray:
        """One matrix for each point: symmetric, with eigenvalues at least 0 (exponentials of them if logged)."""
        val, vec = np.linalg.eigh(self._fill(points, "get_exp"))
        val = np.exp(val) if self.logged else np.maximum(val, 0.0)
        return (vec * val[:, None, :]) @ np.swapaxes(vec, 1, 2)

    def get_cov(self, points: np.ndarray) -> np.ndarray:
        return self._fill(points, "get_var")

    def get_uncertainty(self, points: np.ndarray, mean_ems: list) -> np.ndarray:
        """sqrt(V) * correlation * sqrt(V), V the variances of the mean emulators."""
        m = self.get_exp(points)
        d = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 1e-12))
        cor = m / d[:, :, None] / d[:, None, :]
        sd = np.sqrt(np.stack([e.get_var(points) for e in mean_ems], axis=1))
        return cor * sd[:, :, None] * sd[:, None, :]

    def get_matrix(self) -> tuple:
        return self.entries

    def __repr__(self) -> str:
        return "\n".join(" ".join("." if e is None else str(e.name) for e in row) for row in self.entries)
