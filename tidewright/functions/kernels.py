"""Isotropic correlation functions, as numpy and as Column expressions.

Every kernel is given by a function phi of the squared distance s and its first
two derivatives, so that with D = x - x'

    dc/dx_i = 2 phi'(s) D_i          d2c/dx_i dx'_j = -4 phi''(s) D_i D_j - 2 phi'(s) [i = j]

Derivatives are with respect to the first argument (the second argument's are
the negatives). ``REGISTRY`` may be extended with ``register``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points closer than this are the same point (where the nugget applies).
SAME = 1e-10


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, one row for each row of ``b`` and one column for each row of ``a``."""
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    if a.shape[1] != b.shape[1]:
        raise ValueError("the two sets of points have different numbers of columns")
    return np.sqrt(np.maximum(((b[:, None, :] - a[None, :, :]) ** 2).sum(-1), 0.0))


def _half(nu: float) -> int:
    p = nu - 0.5
    if p < 0 or abs(p - round(p)) > 1e-9:
        raise ValueError("matern needs a half-integer nu")
    return round(p)


def _bessel_poly(p: int) -> list[float]:
    """Coefficients of r^0..r^p in r^(p+1/2) K_(p+1/2)(r) e^r / sqrt(pi/2)."""
    out = [0.0] * (p + 1)
    for k in range(p + 1):
        out[p - k] = math.factorial(p + k) / (math.factorial(k) * math.factorial(p - k)) / 2**k
    return out


def _matern_norm(p: int) -> float:
    """2^(1-nu) / Gamma(nu) * sqrt(pi/2), nu = p + 1/2."""
    return 2 ** (0.5 - p) / math.gamma(p + 0.5) * math.sqrt(math.pi / 2)


def _matern(s, hp, order: int):
    p = _half(hp["nu"])
    if order > p:
        raise ValueError("matern has derivatives up to order nu - 1/2 only")
    a = math.sqrt(2 * p + 1) / hp["theta"]
    r = a * np.sqrt(s)
    c = _bessel_poly(p - order)
    return (-(a**2) / 2) ** order * _matern_norm(p) * np.exp(-r) * sum(v * r**k for k, v in enumerate(c))


@dataclass(frozen=True)
class Kernel:
    name: str
    phi: Callable  # (s, hp, order) -> values; order 0, 1, 2
    column: Callable  # (Column s, hp) -> Column
    orders: int  # derivatives that exist
    params: tuple[str, ...] = ("theta",)
    per_dimension: bool = False  # theta may be a vector


def _none(order: int, at_most: int, name: str) -> None:
    if order > at_most:
        raise ValueError(f"{name} has no derivative of order {order}")


def _exp_sq(s, hp, order):
    t2 = hp["theta"] ** 2
    return (-1 / t2) ** order * np.exp(-s / t2)


def _orn_uhl(s, hp, order):
    _none(order, 0, "orn_uhl")
    return np.exp(-np.sqrt(s) / hp["theta"])


def _gamma_exp(s, hp, order):
    _none(order, 0, "gamma_exp")
    if not 0 < hp["gamma"] <= 2:
        raise ValueError("gamma_exp needs 0 < gamma <= 2")
    return np.exp(-((np.sqrt(s) / hp["theta"]) ** hp["gamma"]))


def _rat_quad(s, hp, order):
    t2, al = hp["theta"] ** 2, hp["alpha"]
    if al <= 0:
        raise ValueError("rat_quad needs alpha > 0")
    u = 1 + s / (2 * al * t2)
    if order == 0:
        return u**-al
    if order == 1:
        return -1 / (2 * t2) * u ** (-al - 1)
    return (al + 1) / (4 * al * t2**2) * u ** (-al - 2)


def _matern_col(s: Column, hp: dict) -> Column:
    p = _half(hp["nu"])
    r = F.sqrt(s) * (math.sqrt(2 * p + 1) / hp["theta"])
    poly = F.lit(0.0)
    for v in reversed(_bessel_poly(p)):
        poly = poly * r + F.lit(v * _matern_norm(p))
    return poly * F.exp(-r)


REGISTRY: dict[str, Kernel] = {}


def register(kernel: Kernel) -> None:
    REGISTRY[kernel.name] = kernel


for _k in (
    Kernel("exp_sq", _exp_sq, lambda s, hp: F.exp(-s / F.lit(hp["theta"] ** 2)), 2, per_dimension=True),
    Kernel("matern", lambda s, hp, order: _matern(s, hp, order), _matern_col, 2, ("theta", "nu")),
    Kernel("orn_uhl", _orn_uhl, lambda s, hp: F.exp(-F.sqrt(s) / F.lit(hp["theta"])), 0),
    Kernel("gamma_exp", _gamma_exp, lambda s, hp: F.exp(-F.pow(F.sqrt(s) / F.lit(hp["theta"]), F.lit(hp["gamma"]))), 0, ("theta", "gamma")),
    Kernel("rat_quad", _rat_quad, lambda s, hp: F.pow(1 + s / F.lit(2 * hp["alpha"] * hp["theta"] ** 2), F.lit(-hp["alpha"])), 2, ("theta", "alpha")),
):
    register(_k)


def squared(xs: list[Column], ys: list[Column]) -> Column:
    """The squared distance of two points given by columns."""
    s = F.lit(0.0)
    for x, y in zip(xs, ys, strict=True):
        s = s + (x - y) * (x - y)
    return s


@dataclass(frozen=True)
class Correlator:
    """A kernel with its hyper-parameters and a nugget.

    ``(1 - nugget) * c + nugget * [same point]``: the kernel looks at the active
    inputs, coincidence at all of them.
    """

    name: str = "exp_sq"
    hp: tuple[tuple[str, object], ...] = (("theta", 0.1),)
    nugget: float = 0.0

    @classmethod
    def of(cls, name: str = "exp_sq", nugget: float = 0.0, **hp) -> Correlator:
        k = REGISTRY[name]
        if set(hp) != set(k.params):
            raise ValueError(f"{name} has the hyper-parameters {', '.join(k.params)}")
        return cls(name, tuple((p, hp[p]) for p in k.params), nugget)

    @property
    def kernel(self) -> Kernel:
        return REGISTRY[self.name]

    @property
    def params(self) -> dict:
        return dict(self.hp)

    def set_hyper_p(self, nugget: float | None = None, **hp) -> Correlator:
        """A copy with other hyper-parameters; names must match."""
        new = Correlator.of(self.name, self.nugget if nugget is None else nugget, **(hp or self.params))
        return replace(self, hp=new.hp, nugget=new.nugget)

    def corr(self, x: np.ndarray, xp: np.ndarray | None = None, active: np.ndarray | None = None, use_nugget: bool = True) -> np.ndarray:
        """Correlations: a row for each row of ``xp``, a column for each row of ``x``."""
        x = np.atleast_2d(np.asarray(x, float))
        if xp is None:
            if len(x) == 1:
                return np.ones((1, 1))
            xp = x
        xp = np.atleast_2d(np.asarray(xp, float))
        hp = self.params
        act = np.ones(x.shape[1], bool) if active is None else np.asarray(active, bool)
        diff = xp[:, None, :] - x[None, :, :]
        theta = np.asarray(hp["theta"], float)
        if theta.ndim and theta.size > 1:
            if not self.kernel.per_dimension:
                raise ValueError(f"{self.name} takes one theta")
            s = ((diff[..., act] / theta) ** 2).sum(-1)
            c = self.kernel.phi(s, hp | {"theta": 1.0}, 0)
        else:
            c = self.kernel.phi((diff[..., act] ** 2).sum(-1), hp | {"theta": float(theta)}, 0)
        if not use_nugget or self.nugget == 0:
            return c
        same = (diff**2).sum(-1) < SAME**2
        return (1 - self.nugget) * c + self.nugget * same

    def corr_d(self, x: np.ndarray, xp: np.ndarray, p1: int, p2: int | None = None, active: np.ndarray | None = None) -> np.ndarray:
        """dc/dx_p1, or d2c/dx_p1 dx'_p2; zero in an inactive direction. Rows: ``xp``; columns: ``x``."""
        x, xp = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(xp, float))
        order = 1 if p2 is None else 2
        if self.kernel.orders < order:
            raise ValueError(f"{self.name} has no derivative of order {order}")
        act = np.ones(x.shape[1], bool) if active is None else np.asarray(active, bool)
        if not act[p1] or (p2 is not None and not act[p2]):
            return np.zeros((len(xp), len(x)))
        hp = self.params
        diff = x[None, :, :] - xp[:, None, :]
        s = (diff[..., act] ** 2).sum(-1)
        scale = 1 - self.nugget
        if p2 is None:
            return scale * 2 * self.kernel.phi(s, hp, 1) * diff[..., p1]
        out = -4 * self.kernel.phi(s, hp, 2) * diff[..., p1] * diff[..., p2]
        return scale * (out - 2 * self.kernel.phi(s, hp, 1) * (p1 == p2))

    def column(self, xs: list[Column], ys: list[Column], all_xs: list[Column] | None = None, all_ys: list[Column] | None = None) -> Column:
        """The correlation of two points given by columns (the active inputs; all inputs for the nugget)."""
        hp = self.params
        theta = np.atleast_1d(np.asarray(hp["theta"], float))
        if theta.size > 1:
            c = self.kernel.column(squared([x / F.lit(float(t)) for x, t in zip(xs, theta, strict=True)], [y / F.lit(float(t)) for y, t in zip(ys, theta, strict=True)]), hp | {"theta": 1.0})
        else:
            c = self.kernel.column(squared(xs, ys), hp | {"theta": float(theta[0])})
        if self.nugget == 0:
            return c
        same = squared(all_xs or xs, all_ys or ys) < SAME**2
        return F.lit(1 - self.nugget) * c + F.when(same, self.nugget).otherwise(0.0)

    def column_d(self, xs: list[Column], ys: list[Column], p1: int, p2: int | None = None) -> Column:
        """dc/dx_p1, or d2c/dx_p1 dx'_p2, of two points given by columns, for exp_sq, rat_quad and matern."""
        if self.kernel.orders < (1 if p2 is None else 2):
            raise ValueError(f"{self.name} has no such derivative")
        hp, s = self.params, squared(xs, ys)
        if self.name == "exp_sq":
            t2 = hp["theta"] ** 2
            c = F.exp(-s / t2)
            d1, d2 = -c / t2, c / t2**2
        elif self.name == "rat_quad":
            t2, al = hp["theta"] ** 2, hp["alpha"]
            u = 1 + s / (2 * al * t2)
            d1, d2 = F.pow(u, F.lit(-al - 1)) * (-1 / (2 * t2)), F.pow(u, F.lit(-al - 2)) * ((al + 1) / (4 * al * t2**2))
        else:
            p = _half(hp["nu"])
            a = math.sqrt(2 * p + 1) / hp["theta"]
            r = F.sqrt(s) * a

            def g(order):
                if order > p:
                    raise ValueError("matern has derivatives up to order nu - 1/2 only")
                poly = F.lit(0.0)
                for v in reversed(_bessel_poly(p - order)):
                    poly = poly * r + F.lit(v)
                return F.exp(-r) * poly * ((-(a**2) / 2) ** order * _matern_norm(p))

            d1 = g(1)
            d2 = g(2) if p2 is not None else None
        if p2 is None:
            return d1 * 2 * (xs[p1] - ys[p1])
        out = d2 * -4 * (xs[p1] - ys[p1]) * (xs[p2] - ys[p2])
        return out - d1 * 2 if p1 == p2 else out
