"""Scaling, moments and small closed forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_columns(ranges: dict[str, tuple[float, float]], forward: bool = True, table: str | None = None) -> dict[str, Column]:
    """Each input to [-1, 1] by (x - centre) / half-width, or back."""
    out = {}
    for name, (lo, hi) in ranges.items():
        c, h = (lo + hi) / 2, (hi - lo) / 2
        x = F.col(f"{table}.{name}" if table else name).cast("double")
        out[name] = (x - F.lit(c)) / F.lit(h) if forward else x * F.lit(h) + F.lit(c)
    return out


def scale_input(df: DataFrame, ranges: dict[str, tuple[float, float]], forward: bool = True) -> DataFrame:
    """``df`` with its inputs scaled; other columns stay."""
    return df.withColumns(scale_columns(ranges, forward))


def scale_array(x: np.ndarray, ranges: dict[str, tuple[float, float]], forward: bool = True) -> np.ndarray:
    lo, hi = (np.array([r[i] for r in ranges.values()], float) for i in (0, 1))
    c, h = (lo + hi) / 2, (hi - lo) / 2
    return (x - c) / h if forward else x * h + c


def kurtosis(x: np.ndarray) -> float:
    """n * sum(d^4) / sum(d^2)^2, not the excess; NaN values are left out."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    d = x - x.mean() if len(x) else x
    s = (d**2).sum()
    return float("nan") if s == 0 else float(len(x) * (d**4).sum() / s**2)


def kurtosis_column(c: str) -> Column:
    """The same as an aggregate (Spark's own is the excess)."""
    return F.kurtosis(c) + 3


def _t_cdf(x: np.ndarray, nu: int) -> np.ndarray:
    """Student's t distribution function for even nu (4 and 6 are used), in closed form."""
    u = x / np.sqrt(nu + x**2)
    term, total = 1.0, 1.0
    z = 1 - u**2
    for k in range(1, nu // 2):
        term = term * z * (2 * k - 1) / (2 * k)
        total = total + term
    return 0.5 + 0.5 * u * total


def _t_pdf(x: np.ndarray, nu: int) -> np.ndarray:
    c = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2))
    return c * (1 + x**2 / nu) ** (-(nu + 1) / 2)


def truncated_t(e, v, nu: int = 6, lower: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a t variable with mean e and variance v, cut to (lower, inf); v is at least 1e-10."""
    e, v = np.asarray(e, float), np.maximum(np.asarray(v, float), 1e-10)
    scale = np.sqrt(v * (nu - 2) / nu)
    a = (lower - e) / scale
    p = np.maximum(1 - _t_cdf(a, nu), 1e-300)
    m1 = nu / (nu - 1) * (1 + a**2 / nu) * _t_pdf(a, nu) / p
    # E[T^2; T > a] from the distribution with nu - 2 degrees of freedom
    b = a * math.sqrt((nu - 2) / nu)
    m2 = (nu * (nu - 1) / (nu - 2) * (1 - _t_cdf(b, nu - 2)) - nu * p) / p
    mean = e + scale * m1
    return mean, np.maximum(scale**2 * (m2 - m1**2), 0.0)


def ball(n: int, d: int, centre: np.ndarray, radius: np.ndarray | float, rng: np.random.Generator) -> np.ndarray:
    """Uniform points in a d-ball (or axis-aligned ellipsoid)."""
    z = rng.standard_normal((n, d))
    return np.asarray(centre) + np.asarray(radius) * z / np.sqrt((z**2).sum(1, keepdims=True) + rng.exponential(2.0, (n, 1)))


def ball_columns(names: list[str], radius: float, seed: int) -> dict[str, Column]:
    """The same for each row of a table, as expressions."""
    z = [F.randn(seed + i) for i in range(len(names))]
    norm = F.sqrt(sum((c * c for c in z), F.lit(0.0)) - 2 * F.log(1 - F.rand(seed + len(names))))
    return {n: c * radius / norm for n, c in zip(names, z, strict=True)}


def inside_ellipsoid(xs: list[Column], centre: list[float], radius: list[float]) -> Column:
    s = F.lit(0.0)
    for x, c, r in zip(xs, centre, radius, strict=True):
        s = s + ((x - F.lit(float(c))) / F.lit(float(r))) * ((x - F.lit(float(c))) / F.lit(float(r)))
    return F.when(s <= 1, 1).otherwise(0)


def significant(c: Column, digits: int = 7) -> Column:
    """A number rounded to so many significant digits."""
    x = F.abs(c)
    e = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.when(x > 0, x).otherwise(1.0))))
    return F.when(x > 0, F.rint(c * e) / e).otherwise(c)


def logged(c: Column, floor: float = 1e-4) -> Column:
    return F.log(F.greatest(c, F.lit(floor)))


def normalised(c: Column, lo: float, hi: float) -> Column:
    return (2 * c - F.lit(lo + hi)) / F.lit(hi - lo)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(z, float) / math.sqrt(2)))


class Pca:
    """Standardise by sample mean and deviation, rotate, whiten; eigenvalues are at least 1e-10."""

    def __init__(self, names: list[str], mean: np.ndarray, sd: np.ndarray, corr: np.ndarray):
        self.names, self.mean, self.sd = names, mean, np.where(sd > 0, sd, 1.0)
        val, vec = np.linalg.eigh(corr)
        self.val, self.vec = np.maximum(val[::-1], 1e-10), vec[:, ::-1]

    @classmethod
    def fit(cls, df: DataFrame, names: list[str]) -> Pca:
        """All moments by one aggregation."""
        pairs = [(i, j) for i in range(len(names)) for j in range(i)]
        aggs = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)] + [F.stddev_samp(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]
        r = df.agg(*aggs).first()
        mean, sd = (np.array([r[f"{k}{i}"] or 0.0 for i in range(len(names))]) for k in "ms")
        corr = np.eye(len(names))
        for i, j in pairs:
            s = sd[i] * sd[j]
            corr[i, j] = corr[j, i] = (r[f"c{i}_{j}"] or 0.0) / s if s else 0.0
        return cls(names, mean, sd, corr)

    def transform(self, x: np.ndarray, forward: bool = True) -> np.ndarray:
        if forward:
            return (x - self.mean) / self.sd @ self.vec / np.sqrt(self.val)
        return (x * np.sqrt(self.val)) @ self.vec.T * self.sd + self.mean

    def columns(self) -> list[Column]:
        out = []
        for k in range(len(self.names)):
            c = F.lit(0.0)
            for i, n in enumerate(self.names):
                c = c + (F.col(n) - F.lit(float(self.mean[i]))) * F.lit(float(self.vec[i, k] / self.sd[i] / math.sqrt(self.val[k])))
            out.append(c)
        return out
