"""Small seeded simulators that stand in for the reference data sets."""

from __future__ import annotations

import numpy as np

SIRS_RANGES = {"aSI": (0.1, 0.8), "aIR": (0.0, 0.5), "aSR": (0.0, 0.05)}


def sirs(x: np.ndarray, t: float = 10.0, steps: int = 400) -> np.ndarray:
    """S, I and R at time t of the deterministic model with rates (aSI, aIR, aSR), started at (950, 50, 0)."""
    x = np.atleast_2d(x)
    a, b, c = x.T
    y = np.tile([950.0, 50.0, 0.0], (len(x), 1))
    n, h = 1000.0, t / steps

    def f(y):
        s, i, r = y.T
        new, out, back = a * s * i / n, b * i, c * r
        return np.stack([back - new, new - out, out - back], axis=1)

    for _ in range(steps):
        k1 = f(y)
        k2 = f(y + h / 2 * k1)
        k3 = f(y + h / 2 * k2)
        k4 = f(y + h * k3)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    return y


def birth_death(lam: float, mu: float, reps: int, rng: np.random.Generator, start: int = 100, t: float = 15.0, dt: float = 0.05) -> np.ndarray:
    """Sizes at time t of populations with birth rate lam and death rate mu each, in small binomial steps."""
    y = np.full(reps, start)
    for _ in range(round(t / dt)):
        y = y + rng.binomial(y, 1 - np.exp(-lam * dt)) - rng.binomial(y, 1 - np.exp(-mu * dt))
    return y


def sine(x: np.ndarray) -> np.ndarray:
    return 2 * x + 3 * x * np.sin(5 * np.pi * (x - 0.1) / 0.4)


def trig(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 2 * np.cos(1.2 * x - 2) + 3 * np.sin(-0.8 * y + 1), y * np.sin(x) - 3 * np.cos(x * y)
