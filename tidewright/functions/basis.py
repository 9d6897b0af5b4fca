"""Regression terms as exponent vectors: text forms, values, derivatives, Column expressions."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Term = tuple[int, ...]


@dataclass(frozen=True)
class Basis:
    names: tuple[str, ...]
    terms: tuple[Term, ...]

    @classmethod
    def constant(cls, names) -> Basis:
        return cls(tuple(names), ((0,) * len(tuple(names)),))

    @classmethod
    def linear(cls, names) -> Basis:
        n = len(tuple(names))
        return cls(tuple(names), ((0,) * n, *(unit(i, n) for i in range(n))))

    @classmethod
    def full(cls, names, order: int) -> Basis:
        """All monomials up to a degree."""
        n = len(tuple(names))
        terms = [t for k in range(order + 1) for t in _of_degree(n, k)]
        return cls(tuple(names), tuple(terms))

    def values(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        return np.stack([np.prod(x ** np.array(t), axis=1) for t in self.terms], axis=1)

    def derivative(self, x: np.ndarray, p: int) -> np.ndarray:
        x = np.atleast_2d(x)
        cols = []
        for t in self.terms:
            if t[p] == 0:
                cols.append(np.zeros(len(x)))
            else:
                d = tuple(k - (i == p) for i, k in enumerate(t))
                cols.append(t[p] * np.prod(x ** np.array(d), axis=1))
        return np.stack(cols, axis=1)

    def columns(self, xs: list[Column]) -> list[Column]:
        return [_monomial(t, xs) for t in self.terms]

    def derivative_columns(self, xs: list[Column], p: int) -> list[Column]:
        return [F.lit(0.0) if t[p] == 0 else _monomial(tuple(k - (i == p) for i, k in enumerate(t)), xs) * float(t[p]) for t in self.terms]

    def active(self) -> np.ndarray:
        """Inputs that some term other than the constant has; all if none has."""
        a = np.array([any(t[i] for t in self.terms) for i in range(len(self.names))])
        return a if a.any() else np.ones(len(self.names), bool)

    def text(self) -> list[str]:
        return [term_text(t, self.names) for t in self.terms]


def _of_degree(n: int, k: int):
    for combo in itertools.combinations_with_replacement(range(n), k):
        yield tuple(combo.count(i) for i in range(n))


def unit(i: int, n: int, power: int = 1) -> Term:
    return tuple(power if j == i else 0 for j in range(n))


def _monomial(t: Term, xs: list[Column]) -> Column:
    out = F.lit(1.0)
    for k, x in zip(t, xs, strict=True):
        for _ in range(k):
            out = out * x
    return out


def term_text(t: Term, names) -> str:
    """``(Intercept)``, ``a``, ``I(a^2)``, ``a:b``."""
    parts = [n if k == 1 else f"I({n}^{k})" for n, k in zip(names, t, strict=True) if k]
    return ":".join(parts) or "(Intercept)"


_POWER = re.compile(r"I\((.+)\^(\d+)\)\Z")


def parse_term(text: str, names) -> Term:
    """The term that a text such as ``a:I(b^2)`` stands for; names are matched whole, nothing is evaluated."""
    names = list(names)
    out = [0] * len(names)
    if text.strip() in ("(Intercept)", "1"):
        return tuple(out)
    for part in re.split(r"\s*[:*]\s*", text.strip()):
        m = _POWER.match(part)
        name, power = (m.group(1).strip(), int(m.group(2))) if m else (part, 1)
        if name not in names:
            raise ValueError(f"{name!r} is no input")
        out[names.index(name)] += power
    return tuple(out)
