"""Ranges, targets and waves in one normal form."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = dict[str, tuple[float, float]]


def convert_ranges(obj, strict: bool = True) -> Ranges | None:
    """Ranges from a mapping, a pandas frame with row names, or (name, lo, hi) rows; bounds are sorted.

    Malformed ranges warn and give None; a range without width is an error.
    """
    try:
        if hasattr(obj, "iterrows"):
            rows = {str(k): tuple(map(float, r)) for k, r in obj.iterrows()}
        elif isinstance(obj, Mapping):
            rows = {str(k): tuple(map(float, v)) for k, v in obj.items()}
        else:
            rows = {str(k): (float(a), float(b)) for k, a, b in obj}
        if not rows or any(len(v) != 2 or not all(np.isfinite(v)) for v in rows.values()):
            raise ValueError
    except (TypeError, ValueError):
        warnings.warn("ranges need a name and two finite numbers each", stacklevel=2)
        return None
    out = {k: (min(v), max(v)) for k, v in rows.items()}
    if strict and any(lo == hi for lo, hi in out.values()):
        raise ValueError("a range has no width")
    return out


@dataclass(frozen=True)
class Target:
    """An observation: ``val`` with deviation ``sigma``, or the interval [lo, hi]."""

    val: float = float("nan")
    sigma: float = 0.0
    lo: float = float("nan")
    hi: float = float("nan")

    @property
    def interval(self) -> bool:
        return not np.isnan(self.lo)

    @classmethod
    def of(cls, t) -> Target:
        if isinstance(t, Target):
            return t
        if isinstance(t, Mapping):
            return cls(float(t["val"]), float(t.get("sigma", 0.0)))
        if isinstance(t, Sequence) and len(t) == 2:
            return cls(lo=float(min(t)), hi=float(max(t)))
        warnings.warn("a bare number as target gets a deviation of 5 %", stacklevel=2)
        return cls(float(t), abs(0.05 * float(t)))

    @property
    def centre(self) -> float:
        return (self.lo + self.hi) / 2 if self.interval else self.val

    def bounds(self, n_sigma: float = 3.0) -> tuple[float, float]:
        return (self.lo, self.hi) if self.interval else (self.val - n_sigma * self.sigma, self.val + n_sigma * self.sigma)

    def hit(self, c: Column, n_sigma: float = 3.0) -> Column:
        lo, hi = self.bounds(n_sigma)
        return c.between(F.lit(lo), F.lit(hi))


def targets(z: Mapping) -> dict[str, Target]:
    return {k: Target.of(v) for k, v in z.items()}
