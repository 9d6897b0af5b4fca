"""Scoring tables of points: expectation, variance, implausibility, n-th implausibility.

Means can be Column expressions over the training points as an array literal;
means and variances together come from one vectorised pass for all emulators.
No scoring shuffles. Training arrays are a few hundred rows by construction,
and their size is checked before they are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions.scalar import scale_columns
from ..plans.collections import EmulatorSet, Member
from ..plans.emulator import Emulator, HierarchicalEmulator
from ..plans.targets import Target, targets
from .ship import Shipped

#: Training rows of all emulators that may travel in one broadcast.
MAX_TRAINING_ROWS = 2_000_000


def scaled_inputs(em, table: str | None = None) -> list[Column]:
    return list(scale_columns(em.ranges, table=table).values())


def prior_mean(em: Emulator) -> Column:
    xs = scaled_inputs(em)
    out = F.lit(0.0)
    for h, b in zip(em.basis.columns(xs), em.beta_mu, strict=True):
        out = out + h * F.lit(float(b))
    return out


def prior_var(em: Emulator) -> Column:
    xs = scaled_inputs(em)
    h = em.basis.columns(xs)
    out = F.lit(float((em.multiplier * em.sigma) ** 2))
    for i in range(len(h)):
        for j in range(len(h)):
            if em.beta_sigma[i, j]:
                out = out + h[i] * h[j] * F.lit(float(em.beta_sigma[i, j]))
    return out


def mean_column(em: Emulator) -> Column:
    """E_D[f] as one expression; for a number as sigma and no variance of beta."""
    if em.x is None:
        return prior_mean(em)
    if callable(em.sigma) or em.beta_sigma.any():
        raise ValueError("this emulator needs score()")
    act = np.flatnonzero(em.active)
    xs = scaled_inputs(em)
    s2 = float((em.multiplier * em.sigma) ** 2)
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in (*row, w * s2))) for row, w in zip(em.x, em.weights, strict=True)))
    d = em.x.shape[1]

    def add(acc, t):
        ys = [t[int(i)] for i in act]
        every = [t[i] for i in range(d)]
        return acc + t[d] * em.corr.column([xs[int(i)] for i in act], ys, xs, every)

    return prior_mean(em) + F.aggregate(rows, F.lit(0.0), add)


def mean_d_column(em: Emulator, p: str) -> Column:
    """E_D[df/dx_p] as one expression."""
    i = em.inputs.index(p)
    xs = scaled_inputs(em)
    out = F.lit(0.0)
    for h, b in zip(em.basis.derivative_columns(xs, i), em.beta_mu, strict=True):
        out = out + h * F.lit(float(b))
    act = [int(k) for k in np.flatnonzero(em.active)]
    if em.x is not None and i in act:
        s2 = float((em.multiplier * em.sigma) ** 2) * (1 - em.corr.nugget)
        rows = F.array(*(F.array(*(F.lit(float(v)) for v in (*row, w * s2))) for row, w in zip(em.x, em.weights, strict=True)))
        d = em.x.shape[1]
        out = out + F.aggregate(rows, F.lit(0.0), lambda acc, t: acc + t[d] * em.corr.column_d([xs[k] for k in act], [t[k] for k in act], act.index(i)))
    return out / F.lit(em.half_width(i))


def implausibility_column(e: Column, v: Column, z: Target, disc: tuple[float, float] = (0.0, 0.0), floor: float = 1e-4) -> Column:
    d2 = sum(x * x for x in disc)
    if z.interval:
        away = F.when(e < z.lo, F.lit(z.lo) - e).when(e > z.hi, e - F.lit(z.hi)).otherwise(0.0)
        return away / F.sqrt(F.greatest(v + F.lit(d2), F.lit(floor)))
    return F.coalesce(F.try_divide(F.abs(F.lit(z.val) - e), F.sqrt(v + F.lit(z.sigma**2 + d2))), F.lit(0.0))


def _checked(ems: list) -> list:
    rows = sum(len(e.x) for e in ems if getattr(e, "x", None) is not None)
    if rows > MAX_TRAINING_ROWS:
        raise ValueError(f"{rows} training rows are too many to broadcast")
    return ems


def _batches(points: np.ndarray, width: int):
    """Rows at a time such that points x training rows stay near 32 MB."""
    step = max(64, (4 << 20) // max(1, width))
    for at in range(0, len(points), step):
        yield points[at : at + step]


def _apply(df: DataFrame, names: list[str], columns: list[str], kinds, f) -> DataFrame:
    """Append columns from ``f(matrix of inputs)``; rows with a null input get nulls."""
    schema = StructType([*df.schema.fields, *(StructField(c, k) for c, k in zip(columns, kinds, strict=True))])
    at = [df.columns.index(n) for n in names]

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at], axis=1) if b.num_rows else np.empty((0, len(at)))
            ok = ~np.isnan(x).any(axis=1)
            got = f(x[ok]) if ok.any() else [np.empty(0)] * len(columns)
            new = []
            for v, k in zip(got, kinds, strict=True):
                full = np.zeros(len(x), dtype=bool if isinstance(k, BooleanType) else float)
                full[ok] = v
                new.append(pa.array(full, mask=~ok))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def score(df: DataFrame, ems, inputs: list[str] | None = None) -> DataFrame:
    """``df`` with ``<output>_exp`` and ``<output>_var`` for each emulator (suffixed by surface, mode and wave where needed)."""
    s = EmulatorSet.of(ems)
    names = inputs or list(dict.fromkeys(n for m in s.members for n in m.em.inputs))
    cols = [f"{label(m, s)}_{k}" for m in s.members for k in ("exp", "var")]
    shared = Shipped(df.sparkSession, (_checked([m.em for m in s.members]), names))

    def f(x):
        ems, names = shared.value
        out = []
        for em in ems:
            own = x[:, [names.index(n) for n in em.inputs]]
            e, v = [], []
            for part in _batches(own, 0 if getattr(em, "x", None) is None else len(em.x)):
                a, b = em.moments(em.scaled(part)) if isinstance(em, Emulator) else (em.get_exp(part), em.get_var(part))
                e.append(a)
                v.append(b)
            out += [np.concatenate(e), np.concatenate(v)]
        return out

    return _apply(df, names, cols, [DoubleType()] * len(cols), f)


def label(m: Member, s: EmulatorSet) -> str:
    out = m.output
    if any(x.surface != m.surface for x in s.members):
        out += f"_{m.surface}"
    if m.mode:
        out += f"_mode{m.mode}"
    if any(x.wave != m.wave for x in s.members):
        out += f"_w{m.wave}"
    return out


def _targets_of(s: EmulatorSet, z: dict) -> dict[tuple[str, str], Target]:
    if set(z) <= {"expectation", "variance"} and "expectation" in z:
        return {(o, k): t for k, own in z.items() for o, t in targets(own).items()}
    return {(o, "expectation"): t for o, t in targets(z).items()}


def default_n(s: EmulatorSet) -> int:
    return 2 if len(s.outputs) > 10 else 1


def implausibilities(df: DataFrame, ems, z: dict) -> tuple[DataFrame, EmulatorSet, list[str]]:
    """``df`` with a column of implausibility for each emulator that has a target."""
    s = EmulatorSet.of(ems)
    zs = _targets_of(s, z)
    keep = tuple(m for m in s.members if (m.output, m.surface) in zs)
    s = EmulatorSet(keep, s.prop)
    names = list(dict.fromkeys(n for m in s.members for n in m.em.inputs))
    cols = [f"_imp_{i}" for i in range(len(keep))]
    shared = Shipped(df.sparkSession, (_checked([m.em for m in keep]), [zs[m.output, m.surface] for m in keep], names))

    def f(x):
        ems, ts, names = shared.value
        out = []
        for em, t in zip(ems, ts, strict=True):
            own = x[:, [names.index(n) for n in em.inputs]]
            width = 0 if getattr(em, "x", None) is None else len(em.x)
            out.append(np.concatenate([em.implausibility(p, t) for p in _batches(own, width)]))
        return out

    return _apply(df, names, cols, [DoubleType()] * len(cols), f), s, cols


def combine(s: EmulatorSet, cols: list[str], n: int, max_imp: float = float("inf"), cutoff: float | list[float] | None = None) -> tuple[Column, dict[str, Column]]:
    """The n-th largest implausibility over outputs (or, with a cutoff, whether few enough outputs fail), and one column for each output.

    Waves of an output collapse by maximum (all must pass); modes by the lesser
    (either may pass); expectation and variance surfaces count as outputs each.
    """
    def group(members) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i in members:
            m = s.members[i]
            out.setdefault(m.output if m.surface == "expectation" else f"{m.output}_variance", []).append(i)
        return out

    def number(i: int) -> Column:
        return F.col(cols[i])

    def passes(i: int) -> Column:
        return F.col(cols[i]) <= F.lit(float(cutoff[i] if isinstance(cutoff, (list, tuple)) else cutoff))

    def largest(xs: list[Column]) -> Column:
        return xs[0] if len(xs) == 1 else F.greatest(*xs)

    modes = sorted({m.mode for m in s.members})
    by_mode = {k: group(i for i, m in enumerate(s.members) if m.mode == k) for k in modes}
    raw = {}
    if cutoff is None:
        for k in modes:
            for o, ids in by_mode[k].items():
                x = largest([number(i) for i in ids])
                raw.setdefault(o, []).append(x)
        raw = {o: xs[0] if len(xs) == 1 else F.when(F.isnan(xs[0]) & F.isnan(xs[1]), 0.0).otherwise(F.least(F.nanvl(xs[0], xs[1]), F.nanvl(xs[1], xs[0]))) for o, xs in raw.items()}
        n = min(n, len(raw))
        nth = list(raw.values())[0] if len(raw) == 1 else F.greatest(*raw.values()) if n == 1 else F.sort_array(F.array(*raw.values()), asc=False)[n - 1]
        return nth if max_imp == float("inf") else F.when(nth.isNotNull(), F.least(nth, F.lit(float(max_imp)))), raw
    for k in modes:
        for o, ids in by_mode[k].items():
            x = passes(ids[0])
            for i in ids[1:]:
                x = x & passes(i)
            raw[o] = raw[o] | x if o in raw else x
    n = min(n, len(raw))
    votes = sum((x.cast("int") for x in raw.values()), F.lit(0))
    return votes > F.lit(len(raw) - n), raw


def nth_implausible(df: DataFrame, ems, z: dict, n: int | None = None, max_imp: float = float("inf"), cutoff=None, get_raw: bool = False, sequential: bool | None = None, alias: str = "I") -> DataFrame:
    """``df`` with the combined implausibility (a number, or a truth value with ``cutoff``), or with one column for each output.

    With a cutoff and more than ten outputs (or ``sequential``), emulators are
    ordered and a point is scored only until it can no longer pass.
    """
    import warnings

    s = EmulatorSet.of(ems)
    if n is None:
        n = default_n(s)
    if n > len(s.outputs):
        warnings.warn("n is larger than the number of outputs", stacklevel=2)
        n = len(s.outputs)
    if sequential is None:
        sequential = cutoff is not None and len(s.members) > 10
    if sequential and cutoff is not None and s.kind == "flat" and not get_raw:
        return sequential_imp(df, s, z, n, cutoff, alias)
    scored, s, cols = implausibilities(df, s, z)
    nth, raw = combine(s, cols, n, max_imp, cutoff)
    if get_raw:
        return scored.select(*df.columns, *(c.alias(o) for o, c in raw.items()))
    return scored.select(*df.columns, nth.alias(alias))


def sequential_imp(df: DataFrame, ems, z: dict, n: int, cutoff, alias: str = "I") -> DataFrame:
    """The boolean form with early exit: emulator after emulator on the points that still can pass."""
    s = EmulatorSet.of(ems)
    zs = _targets_of(s, z)
    keep = [m for m in EmulatorSet(s.members).ordered({o: t for (o, _), t in zs.items()}, float(np.mean(cutoff))).members if (m.output, m.surface) in zs]
    cut = {id(m.em): float(c) for m, c in zip(s.members, cutoff, strict=True)} if isinstance(cutoff, (list, tuple)) else {}
    names = list(dict.fromkeys(x for m in keep for x in m.em.inputs))
    shared = Shipped(df.sparkSession, (_checked([m.em for m in keep]), [m.output for m in keep], [zs[m.output, m.surface] for m in keep], [cut.get(id(m.em), cutoff if not cut else 3.0) for m in keep], names))

    def f(x):
        ems, outs, ts, cuts, names = shared.value
        failed: dict[str, np.ndarray] = {o: np.zeros(len(x), bool) for o in outs}
        alive = np.arange(len(x))
        for em, o, t, c in zip(ems, outs, ts, cuts, strict=True):
            if not len(alive):
                break
            own = x[alive][:, [names.index(k) for k in em.inputs]]
            width = 0 if getattr(em, "x", None) is None else len(em.x)
            ok = np.concatenate([em.implausibility(p, t, c) for p in _batches(own, width)])
            failed[o][alive] |= ~ok
            alive = np.flatnonzero(sum(failed.values()) < n)
        out = np.zeros(len(x), bool)
        out[alive] = True
        return [out]

    return _apply(df, names, [alias], [BooleanType()], f)


# ------------------------------------------------------------------ further moments of a table of points

#: Points that covariances are taken with, at most.
MAX_OTHERS = 5_000


def covariance_with(df: DataFrame, em: Emulator, others: np.ndarray, compat: bool = False) -> DataFrame:
    """``df`` with ``<output>_cov_<k>``, the covariance of its points with the k-th of some other points (the design's size)."""
    others = np.atleast_2d(np.asarray(others, float))
    if len(others) > MAX_OTHERS:
        raise ValueError(f"more than {MAX_OTHERS} points to take covariances with")
    cols = [f"{em.name}_cov_{k}" for k in range(len(others))]
    shared = Shipped(df.sparkSession, (em, others, compat))

    def f(x):
        em, others, compat = shared.value
        got = [em.get_cov(part, others, compat=compat) for part in _batches(x, len(em.x) if em.x is not None else 1)]
        return list(np.concatenate(got).T)

    return _apply(df, em.inputs, cols, [DoubleType()] * len(cols), f)


def derivative_covariance(df: DataFrame, em: Emulator, p1: str, p2: str | None = None, alias: str = "cov_d") -> DataFrame:
    """``df`` with Cov[df/dx_p1, df/dx_p2] at each point; training data lower it."""
    shared = Shipped(df.sparkSession, (em, p1, p2))

    def f(x):
        em, p1, p2 = shared.value
        return [np.concatenate([np.array([em.get_cov_d(row[None], p1, p2=p2)[0] for row in part]) for part in _batches(x, 1)])]

    return _apply(df, em.inputs, [alias], [DoubleType()], f)


def gradient_columns(em: Emulator) -> dict[str, Column]:
    """The expected gradient, ``d_<input>``, as expressions."""
    return {f"d_{n}": mean_d_column(em, n) for n in em.inputs}


def direction_column(em: Emulator, v: dict[str, float]) -> Column:
    """The cosine of the expected gradient with a direction, as one expression."""
    size = math.sqrt(sum(x * x for x in v.values()))
    g = {n: mean_d_column(em, n) for n in em.inputs}
    dot = sum((g[n] * F.lit(v.get(n, 0.0) / size) for n in em.inputs), F.lit(0.0))
    return dot / F.greatest(F.sqrt(sum((c * c for c in g.values()), F.lit(0.0))), F.lit(1e-300))


def score_matrix(df: DataFrame, matrix, mean_ems: list[Emulator] | None = None) -> DataFrame:
    """``df`` with the entries ``m_<i>_<j>`` (i <= j) of an emulated matrix, or of the uncertainty that it gives to ``mean_ems``."""
    k = matrix.size
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = next(e.inputs for row in matrix.entries for e in row if e is not None)
    shared = Shipped(df.sparkSession, (matrix, mean_ems))

    def f(x):
        matrix, mean_ems = shared.value
        got = [matrix.get_exp(p) if mean_ems is None else matrix.get_uncertainty(p, mean_ems) for p in _batches(x, 64)]
        m = np.concatenate(got)
        return [m[:, i, j] for i, j in pairs]

    return _apply(df, names, [f"m_{i}_{j}" for i, j in pairs], [DoubleType()] * len(pairs), f)


def hit_probabilities(df: DataFrame, ems, z: dict, distro: str = "norm", alias: str = "p_hit") -> DataFrame:
    """``df`` with the product over outputs of the probability to hit the target."""
    s = EmulatorSet.of(ems)
    names = list(dict.fromkeys(n for m in s.members for n in m.em.inputs))
    shared = Shipped(df.sparkSession, (s, z, distro))

    def f(x):
        from .design import hit_probability

        s, z, distro = shared.value
        return [np.concatenate([hit_probability(s, p, z, distro) for p in _batches(x, 64)])]

    return _apply(df, names, [alias], [DoubleType()], f)


__all__ = ["Emulator", "HierarchicalEmulator", "combine", "implausibilities", "implausibility_column", "mean_column", "nth_implausible", "prior_mean", "prior_var", "score", "sequential_imp"]
