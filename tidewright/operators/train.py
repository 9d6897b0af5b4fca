"""Training: regression terms from sufficient statistics, kernels by a distributed grid, adjustment.

One aggregation gives each output's Gram matrix over all candidate terms; the
stepwise search by BIC runs on it without touching the rows again.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Basis, Term, unit
from ..functions.kernels import REGISTRY, Correlator
from ..functions.scalar import scale_array, scale_columns
from ..plans.collections import EmulatorSet
from ..plans.emulator import Emulator, HierarchicalEmulator, solve
from ..plans.targets import Ranges, convert_ranges
from . import stats
from .ship import Shipped

#: Training points that may come to the driver; more are an error, not cut.
MAX_POINTS = 20_000
#: Sums of cubes of training points over the kernel grid that the driver does itself.
DRIVER_WORK = 2_000_000_000
SMALL_SHARE = 0.01  # non-linear terms with less of the explained sum of squares go


@dataclass
class Priors:
    """Parts of the prior given by the user; what is None is estimated."""

    basis: Basis | None = None
    beta: np.ndarray | None = None
    beta_sigma: np.ndarray | None = None
    sigma: float | Callable | None = None
    hyper: dict = field(default_factory=dict)
    nugget: float | None = None


@dataclass
class Fit:
    basis: Basis
    beta: np.ndarray
    cov: np.ndarray
    rss: float
    n: int


def _ols(g: np.ndarray, cols: list[int], n: int) -> tuple[np.ndarray, float, np.ndarray]:
    a, b, yy = g[np.ix_(cols, cols)], g[cols, -1], g[-1, -1]
    inv = np.linalg.pinv(a)
    beta = inv @ b
    return beta, max(float(yy - b @ beta), 0.0), inv


def _bic(rss: float, n: int, k: int) -> float:
    return n * math.log(max(rss, 1e-300) / n) + k * math.log(n)


def _parents(t: Term) -> list[Term]:
    """What marginality asks for: an interaction needs its factors."""
    if sum(1 for k in t if k) < 2:
        return []
    return [tuple(k if j == i else 0 for j, k in enumerate(t)) for i in range(len(t)) if t[i]]


def stepwise(g: np.ndarray, terms: list[Term], start: list[int], fixed: set[int], n: int, backward: bool = True) -> list[int]:
    """Add and drop terms while BIC falls; an interaction comes after its factors and keeps them."""
    have = list(start)
    at = {t: i for i, t in enumerate(terms)}
    best = _bic(_ols(g, have, n)[1], n, len(have) + 1)
    while True:
        moves = []
        for i, t in enumerate(terms):
            if i in have:
                needed = any(t in _parents(terms[j]) for j in have if j != i)
                if backward and i not in fixed and not needed:
                    moves.append([j for j in have if j != i])
            elif len(have) < n - 2 and all(at.get(p) in have for p in _parents(t) if p in at):
                moves.append([*have, i])
        scored = [(_bic(_ols(g, m, n)[1], n, len(m) + 1), sorted(m)) for m in moves]
        if not scored or min(scored)[0] >= best - 1e-9:
            return sorted(have)
        best, have = min(scored)


def coefficient_model(df: DataFrame, ranges: Ranges, output: str, order: int = 2) -> Fit:
    """Regression terms for an output: first linear terms and powers choose the active inputs, then interactions join."""
    names = list(ranges)
    terms = candidate_terms(len(names), order)
    d = df.select(*(c.alias(k) for k, c in scale_columns(ranges).items()), F.col(output).cast("double").alias("_y")).dropna()
    g = stats.gram(d, [*Basis(tuple(names), tuple(terms)).columns([F.col(x) for x in names]), F.col("_y")])
    return select_terms(g, names, order)


def candidate_terms(n_in: int, order: int) -> list[Term]:
    """The constant, pure powers by degree, then interactions."""
    pure = [unit(i, n_in, p) for p in range(1, order + 1) for i in range(n_in)]
    return [(0,) * n_in, *pure, *(t for t in Basis.full([str(i) for i in range(n_in)], order).terms if sum(1 for k in t if k) > 1)]


def select_terms(g: np.ndarray, names: list[str], order: int) -> Fit:
    """The terms that BIC chooses, from the Gram matrix of the candidate terms and the output."""
    n_in, terms = len(names), candidate_terms(len(names), order)
    n_pure = 1 + n_in * order
    n = round(g[0, 0])
    big = math.comb(n_in + order, order) > 2 * n / 3
    first = stepwise(g[np.ix_([*range(n_pure), len(terms)], [*range(n_pure), len(terms)])], terms[:n_pure], [0] if big else [i for i in range(n_pure) if i < n - 2], {0}, n)
    active = {k for i in first for k, p in enumerate(terms[i]) if p}
    allowed = [i for i, t in enumerate(terms) if not any(p and k not in active for k, p in enumerate(t))]
    sub = [*allowed, len(terms)]
    got = stepwise(g[np.ix_(sub, sub)], [terms[i] for i in allowed], [allowed.index(i) for i in first], {0}, n)
    cols = [allowed[i] for i in got]
    beta, rss, inv = _ols(g, cols, n)
    total = g[-1, -1] - g[0, -1] ** 2 / max(n, 1)
    # sums of squares term by term, in the order of the terms
    small, before = set(), _ols(g, [0], n)[1]
    for k in range(1, len(cols)):
        after = _ols(g, cols[: k + 1], n)[1]
        t = terms[cols[k]]
        if sum(t) > 1 and total > 0 and (before - after) < SMALL_SHARE * max(total - rss, 1e-300):
            small.add(cols[k])
        before = after
    needed = {p for c in cols if c not in small for p in _parents(terms[c])}
    cols = [c for c in cols if c not in small or terms[c] in needed]
    beta, rss, inv = _ols(g, cols, n)
    s2 = rss / max(1, n - len(cols))
    return Fit(Basis(tuple(names), tuple(terms[c] for c in cols)), beta, inv * s2, rss, n)


def theta_range(order: int) -> tuple[float, float]:
    return min(2 / (order + 1), 1 / 3), 2 / order


def _profile(x: np.ndarray, y: np.ndarray, h: np.ndarray, c: Correlator, active: np.ndarray) -> tuple[float, float]:
    """Profile log likelihood and the estimate of sigma, beta by generalised least squares."""
    a = c.corr(x, x, active)
    sign, logdet = np.linalg.slogdet(a)
    if sign <= 0:
        return -np.inf, float("nan")
    inv = solve(a)
    beta = np.linalg.pinv(h.T @ inv @ h) @ (h.T @ inv @ y)
    r = y - h @ beta
    s2 = max(float(r @ inv @ r) / len(y), 1e-300)
    return -len(y) / 2 * math.log(s2) - logdet / 2, math.sqrt(s2)


def hyper_grid(corr_name: str, order: int, nsteps: int, theta_ranges: dict | None = None) -> list[dict]:
    lo, hi = theta_range(order)
    steps = np.linspace(lo, hi, nsteps)
    if theta_ranges:
        axes = {k: np.linspace(*v, nsteps) if len(v) == 2 else np.asarray(v, float) for k, v in theta_ranges.items()}
        return [dict(zip(axes, map(float, v), strict=True)) for v in itertools.product(*axes.values())]
    if corr_name == "matern":
        return [{"theta": float(t), "nu": nu} for nu in (0.5, 1.5, 2.5) for t in np.linspace(lo, hi, 4 * nsteps)]
    if corr_name == "rat_quad":
        return [{"theta": float(t), "alpha": float(a)} for t in steps for a in np.linspace(0.1, 2.0, 10)]
    if corr_name in ("exp_sq", "orn_uhl"):
        return [{"theta": float(t)} for t in steps]
    raise ValueError(f"{corr_name} needs theta_ranges")


#: The nugget that grid points are compared with where none is given.
GRID_NUGGET = 0.01
#: The largest nugget that refinement may choose.
MAX_NUGGET = 0.2


def estimate_hyper(spark, jobs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], corr_name: str, order: int, nsteps: int = 30, nugget: float | None = None, theta_ranges: dict | None = None) -> list[tuple[Correlator, float]]:
    """For each (x, y, h, active) the correlator with the best profile likelihood, and sigma.

    The grid points of all outputs are rows of a table, scored in parallel and
    folded by the best of each output. Then its length scale is raised to the
    largest gap between neighbouring points, where that is below the range's
    top, and the nugget is set: next to none where all inputs are active.
    """
    grid = hyper_grid(corr_name, order, nsteps, theta_ranges)
    names = [p for p in REGISTRY[corr_name].params if p != "theta"] if corr_name in REGISTRY else [p for p in grid[0] if p != "theta"]
    nug = GRID_NUGGET if nugget is None else max(nugget, 1e-10)
    rows = [(j, k, hp["theta"], {a: b for a, b in hp.items() if a != "theta"}, nug) for j in range(len(jobs)) for k, hp in enumerate(grid)]
    if sum(len(jobs[j][0]) ** 3 for j, *_ in rows) <= DRIVER_WORK:  # sooner done than sent
        best: dict[int, tuple] = {}
        for j, _, th, more, nug in rows:
            x, y, h, active = jobs[j]
            c = Correlator.of(corr_name, nug, theta=float(th), **more)
            ll, _ = _profile(x, y, h, c, active)
            if j not in best or ll > best[j][0]:
                best[j] = (ll, c)
        chosen = [best[j][1] for j in range(len(jobs))]
    else:
        shared = Shipped(spark, jobs)

        def run(parts):
            for pdf in parts:
                out, jobs = [], shared.value
                for j, th, nug, *more in pdf[["job", "theta", "nugget", *names]].itertuples(index=False):
                    x, y, h, active = jobs[int(j)]
                    c = Correlator.of(corr_name, nug, theta=float(th), **dict(zip(names, map(float, more), strict=True)))
                    out.append(_profile(x, y, h, c, active)[0])
                yield pdf.assign(loglik=out)

        fields = "job int, step int, theta double, nugget double" + "".join(f", {p} double" for p in names)
        table = spark.createDataFrame([(j, k, th, nug, *(more[p] for p in names)) for j, k, th, more, nug in rows], fields).repartition(min(len(rows), max(2, spark.sparkContext.defaultParallelism)))
        top = table.mapInPandas(run, fields + ", loglik double").groupBy("job").agg(F.max(F.struct("loglik", (-F.col("step")).alias("_s"), "theta", "nugget", *names)).alias("b")).collect()
        by = {r.job: Correlator.of(corr_name, r.b.nugget, theta=r.b.theta, **{p: r.b[p] for p in names}) for r in top}
        chosen = [by[j] for j in range(len(jobs))]
    limit = max(hp["theta"] for hp in grid)
    return [_settled(job, c, limit, nugget) for job, c in zip(jobs, chosen, strict=True)]


def _settled(job: tuple, c: Correlator, limit: float, nugget: float | None) -> tuple[Correlator, float]:
    x, y, h, active = job
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    gap = float(d.min(axis=1).max()) if len(x) > 1 else 0.0
    theta = float(c.params["theta"])
    theta = max(theta, gap) if gap < limit else theta
    nug = (1e-10 if active.all() else 0.05) if nugget is None else max(nugget, 1e-10)
    c = replace(c.set_hyper_p(**(c.params | {"theta": theta})), nugget=nug)
    return c, _profile(x, y, h, c, active)[1]


def climb(f: Callable, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 80) -> tuple[np.ndarray, float]:
    """A maximum of ``f`` within bounds, uphill from ``at``: quasi-Newton steps on the parameters that no bound holds, cut back until ``f`` rises."""
    width = high - low
    z, top = (np.clip(at, low, high) - low) / width, None  # parameters on 0..1
    value = lambda z: f(low + z * width)
    top = value(z)

    def slope(z: np.ndarray) -> np.ndarray:
        g = np.empty(len(z))
        for i in range(len(z)):
            a, b = z.copy(), z.copy()
            a[i], b[i] = max(0.0, z[i] - 1e-5), min(1.0, z[i] + 1e-5)
            g[i] = (value(b) - value(a)) / (b[i] - a[i])
        return np.nan_to_num(g, nan=0.0, posinf=0.0, neginf=0.0)

    g, curve = slope(z), None
    for _ in range(steps):
        free = ~(((z <= 0) & (g <= 0)) | ((z >= 1) & (g >= 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-7 * max(1.0, abs(top)):
            break
        inverse = np.eye(len(z)) * (0.1 / max(np.abs(g[free]).max(), 1e-300)) if curve is None else curve
        step = np.zeros(len(z))
        step[free] = inverse[np.ix_(free, free)] @ g[free]
        if step @ g <= 0:
            step, curve = np.where(free, g, 0.0) * (0.1 / max(np.abs(g[free]).max(), 1e-300)), None
            inverse = np.eye(len(z)) * (0.1 / max(np.abs(g[free]).max(), 1e-300))
        size, new, got = 1.0, z, top
        while size > 1e-10:
            new = np.clip(z + size * step, 0.0, 1.0)
            got = value(new)
            if got > top:
                break
            size /= 2
        if not got > top:
            if curve is None:
                break
            curve = None  # once more, straight uphill
            continue
        after = slope(new)
        s, y = new - z, g - after
        if s @ y > 1e-14:
            rho, one = 1 / (s @ y), np.eye(len(z))
            curve = (one - rho * np.outer(s, y)) @ inverse @ (one - rho * np.outer(y, s)) + rho * np.outer(s, s)
        gain, z, top, g = got - top, new, got, after
        if gain < 1e-12 * max(1.0, abs(top)):
            break
    return low + z * width, top


def refine_hyper(spark, jobs: list[tuple], starts: list[Correlator], order: int) -> list[tuple[Correlator, float]]:
    """Length scale, further scale parameters and nugget together, uphill in the profile likelihood from each start; never below it.

    Each output's climb is a row of one job.
    """
    bounds = {"theta": theta_range(order), "alpha": (0.1, 2.0), "gamma": (0.1, 2.0)}

    def refined(job: tuple, c: Correlator) -> tuple[Correlator, float]:
        x, y, h, active = job
        names = [n for n in c.params if n in bounds and np.ndim(c.params[n]) == 0]
        low, high = (np.array([*(bounds[n][i] for n in names), (1e-10, MAX_NUGGET)[i]]) for i in (0, 1))
        at = np.array([*(float(c.params[n]) for n in names), c.nugget])
        low, high = np.minimum(low, at), np.maximum(high, at)
        made = lambda v: replace(c.set_hyper_p(**(c.params | dict(zip(names, map(float, v[:-1]), strict=True)))), nugget=float(v[-1]))
        # the likelihood may have several tops: climbs start from the grid's best and from a few other scales and nuggets
        first = [at, *(np.array([t, *at[1:-1], g]) for t in np.linspace(low[0], high[0], 4) for g in (0.001, 0.03, 0.12))] if names[:1] == ["theta"] else [at]
        best, _ = max((climb(lambda v: _profile(x, y, h, made(v), active)[0], v, low, high) for v in first), key=lambda b: b[1])
        return made(best), _profile(x, y, h, made(best), active)[1]

    if sum(len(j[0]) ** 3 for j in jobs) * 3000 <= DRIVER_WORK:
        return [refined(j, c) for j, c in zip(jobs, starts, strict=True)]
    shared = Shipped(spark, (jobs, starts))

    def run(parts):
        for pdf in parts:
            jobs, starts = shared.value
            out = []
            for k in pdf["job"]:
                c, sigma = refined(jobs[int(k)], starts[int(k)])
                out.append((int(k), c.nugget, sigma, {n: float(v) for n, v in c.params.items()}))
            yield pd.DataFrame(out, columns=["job", "nugget", "sigma", "params"])

    rows = spark.range(len(jobs)).withColumnRenamed("id", "job").repartition(len(jobs)).mapInPandas(run, "job long, nugget double, sigma double, params map<string, double>").collect()
    by = {r.job: (replace(starts[r.job].set_hyper_p(**r.params), nugget=r.nugget), r.sigma) for r in rows}
    return [by[k] for k in range(len(jobs))]


def refine_theta(job: tuple, c: Correlator, bounds: tuple[float, float], steps: int = 40) -> tuple[Correlator, float]:
    """The length scale that maximises the profile likelihood between ``bounds``, by golden section from the grid's best."""
    x, y, h, active = job
    at = lambda t: _profile(x, y, h, c.set_hyper_p(**(c.params | {"theta": float(t)})), active)[0]
    (a, b), g = bounds, (math.sqrt(5) - 1) / 2
    p, q = b - g * (b - a), a + g * (b - a)
    fp, fq = at(p), at(q)
    for _ in range(steps):
        if fp >= fq:
            b, q, fq = q, p, fp
            p = b - g * (b - a)
            fp = at(p)
        else:
            a, p, fp = p, q, fq
            q = a + g * (b - a)
            fq = at(q)
    best = c.set_hyper_p(**(c.params | {"theta": float((a + b) / 2)}))
    if at(best.params["theta"]) < at(c.params["theta"]):
        best = c
    return best, _profile(x, y, h, best, active)[1]


def _points(df: DataFrame, cols: list[str]) -> pd.DataFrame:
    n = df.limit(MAX_POINTS + 1)
    pdf = n.select(*(F.col(c).cast("double").alias(c) for c in cols)).toPandas()
    if len(pdf) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} training points")
    return pdf


def train(
    df: DataFrame,
    outputs: list[str],
    ranges,
    order: int = 2,
    corr_name: str = "exp_sq",
    beta_var: bool = False,
    adjusted: bool = True,
    discrepancies: dict[str, tuple[float, float]] | None = None,
    priors: dict[str, Priors] | None = None,
    check_ranges: bool = True,
    theta_ranges: dict | None = None,
    na_rm: bool = True,
    extra: dict[str, tuple[list[str], str]] | None = None,
    nsteps: int = 30,
    make: Callable | None = None,
    refine: bool = False,
) -> dict[str, Emulator]:
    """Emulators of deterministic outputs; replicated points are trained on their means, with the replicate variance in the internal discrepancy.

    With ``refine`` the kernel's parameters and the nugget are refined together, uphill from the grid's best.
    """
    ranges = convert_ranges(ranges)
    names, spark = list(ranges), df.sparkSession
    if corr_name not in REGISTRY:
        warnings.warn(f"{corr_name} is no kernel; exp_sq is used", stacklevel=2)
        corr_name = "exp_sq"
    counts = df.agg(F.count("*").alias("n"), F.countDistinct(*names).alias("k")).first()
    rep: dict[str, float] = {}
    if counts.k < counts.n:
        warnings.warn("replicated points are averaged", stacklevel=2)
        d = stats.collapse(df, names, outputs)
        first = d.first()
        rep = {o: float(first[f"{o}_rep"] or 0.0) for o in outputs} if first else {}
        df = d.select(*names, *outputs)
    if counts.k < 10 * len(names):
        warnings.warn("fewer than ten points for each input", stacklevel=2)
    if check_ranges:
        ranges = stats.shrink_ranges(df, ranges)
    priors, fits, frames = priors or {}, {}, {}
    every = _points(df, [*names, *outputs])
    for o in outputs:
        pdf = every[[*names, o]].dropna() if na_rm else every[[*names, o]]
        p = priors.get(o, Priors())
        x, y = scale_array(pdf[names].to_numpy(float), ranges), pdf[o].to_numpy(float)
        frames[o] = (x, y)
        if p.basis is not None and p.beta is not None:
            fits[o] = Fit(p.basis, np.asarray(p.beta, float), np.zeros((len(p.basis.terms),) * 2) if p.beta_sigma is None else np.asarray(p.beta_sigma, float), float("nan"), 0)
        else:
            m = np.column_stack([Basis(tuple(names), tuple(candidate_terms(len(names), order))).values(x), y])
            fits[o] = select_terms(m.T @ m, names, order)
    jobs = []
    for o in outputs:
        x, y = frames[o]
        jobs.append((x, y, fits[o].basis.values(x), fits[o].basis.active()))
    found = {}
    open_ = [k for k, o in enumerate(outputs) if not ("theta" in priors.get(o, Priors()).hyper and priors[o].sigma is not None)]
    if open_:
        got = estimate_hyper(spark, [jobs[k] for k in open_], corr_name, order, nsteps, None, theta_ranges)
        if refine and not theta_ranges:
            got = refine_hyper(spark, [jobs[k] for k in open_], [c for c, _ in got], order)
        found = dict(zip((outputs[k] for k in open_), got, strict=True))
    out = {}
    for k, o in enumerate(outputs):
        p, f = priors.get(o, Priors()), fits[o]
        x, y, _, active = jobs[k]
        corr, sigma = found.get(o, (None, None))
        if p.hyper:
            corr = Correlator.of(corr_name, p.nugget if p.nugget is not None else 0.0, **p.hyper)
        elif p.nugget is not None:
            corr = replace(corr, nugget=p.nugget)
        sigma = p.sigma if p.sigma is not None else max(1e-3 * float(y.max() - y.min()), sigma)
        disc = (discrepancies or {}).get(o, (0.0, 0.0))
        if rep.get(o):
            disc = (math.sqrt(disc[0] ** 2 + rep[o]), disc[1])
        rsd = math.sqrt(f.rss / max(1, f.n - len(f.beta))) if f.n else float("nan")
        em = (make or Emulator)(basis=f.basis, beta_mu=f.beta, sigma=sigma, ranges=ranges, corr=corr, beta_sigma=f.cov if beta_var or p.beta_sigma is not None else None, name=o, disc=disc, active=active, residual_sd=rsd)
        out[o] = replace(em, x=x, y=y) if adjusted else em
    return out


# ------------------------------------------------------------------ stochastic


@dataclass(frozen=True)
class SampleNoise:
    """(E^2 + Var)/n * (kurtosis - 1 + 2/(n-1)) of a variance emulator: how uncertain a sample variance is."""

    em: Emulator
    kurt: float

    def __call__(self, x, n):
        n = np.asarray(n, float)
        e, v = self.em.moments(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (e**2 + v) / n * (self.kurt - 1 + 2 / (n - 1))
        return np.where(n <= 1, 0.0, out)


@dataclass(frozen=True)
class MeanNoise:
    """E_var(x)/n, exponentiated if the variance emulator holds logarithms."""

    em: Emulator
    logged: bool = False

    def __call__(self, x, n):
        e = self.em.moments(x)[0]
        return np.maximum(np.exp(e) if self.logged else e, 1e-10) / np.asarray(n, float)


def train_variance(df: DataFrame, outputs: list[str], ranges, order: int = 2, corr_name: str = "exp_sq", high_reps: int | None = None, **options) -> dict[str, dict[str, HierarchicalEmulator]]:
    """{expectation, variance} emulators of stochastic outputs from replicated runs.

    Points with many replicates give the prior of the variance surface (order
    one lower), which is then adjusted by all; its expectation is the noise of
    the means. With one run for each point plain emulators come back.
    """
    ranges = convert_ranges(ranges)
    names = list(ranges)
    per = stats.replicates(df, names, outputs).cache()
    top = per.agg(F.max("n").alias("n"), F.expr("percentile(n, 0.5)").alias("m")).first()
    if top.n is None or top.n < 2:
        warnings.warn("one run for each point: plain emulators are trained", stacklevel=2)
        return {"expectation": train(df, outputs, ranges, order, corr_name, **options), "variance": {}}
    ranges = stats.shrink_ranges(per, ranges)
    options = {"check_ranges": False} | options
    kurt = stats.mean_kurtosis(per, outputs).first()
    bar = high_reps or max(2, int(top.m))
    variance, mean = {}, {}
    for o in outputs:
        v = per.filter("n > 1").select(*names, F.col(f"{o}_var").alias(o), "n").dropna()
        high = v.filter(F.col("n") >= bar)
        if high.count() < len(names) + 3:
            high = v
        prior = train(high.drop("n"), [o], ranges, max(1, order - 1), corr_name, adjusted=False, **options)[o]
        pdf = _points(v, [*names, o, "n"])
        x = pdf[names].to_numpy(float)
        plain = prior.adjust(x, pdf[o].to_numpy(float))
        variance[o] = _hierarchical(prior, SampleNoise(plain, float(kurt[o])), "variance").adjust(x, pdf[o].to_numpy(float), pdf["n"].to_numpy(float))
        m = per.select(*names, F.col(f"{o}_mean").alias(o), "n").dropna()
        prior = train(m.drop("n"), [o], ranges, order, corr_name, adjusted=False, **options)[o]
        pdf = _points(m, [*names, o, "n"])
        mean[o] = _hierarchical(prior, MeanNoise(variance[o]), "mean").adjust(pdf[names].to_numpy(float), pdf[o].to_numpy(float), pdf["n"].to_numpy(float))
    per.unpersist()
    return {"expectation": mean, "variance": variance}


def _hierarchical(em: Emulator, noise: Callable, kind: str) -> HierarchicalEmulator:
    return HierarchicalEmulator(basis=em.basis, beta_mu=em.beta_mu, sigma=em.sigma, ranges=em.ranges, corr=em.corr, beta_sigma=em.beta_sigma, name=em.name, disc=em.disc, active=em.active, noise=noise, em_type=kind, residual_sd=em.residual_sd)


def emulator_set(trained: dict) -> EmulatorSet:
    if "expectation" in trained:
        return EmulatorSet.of({k: list(v.values()) for k, v in trained.items()})
    return EmulatorSet.of(list(trained.values()))


def train_covariance(df: DataFrame, outputs: list[str], ranges, order: int = 2, corr_name: str = "exp_sq", logged: bool = False, matrix: np.ndarray | None = None, rho: np.ndarray | None = None, theta: float | None = None, **options):
    """Mean emulators, and an EmulatedMatrix of the replicate covariances (or of their matrix logarithms).

    ``matrix``: truth values of the pairs to emulate; with one output the variance emulation is used.
    ``rho``: correlations of outputs at one time, by label pair; ``theta``: the correlation length in time.
    What is not given is estimated from the replicate variances (theta where outputs have times).
    """
    from ..plans.emulator import EmulatedMatrix

    base = train_variance(df, outputs, ranges, order, corr_name, **options)
    if len(outputs) < 2 or not base["variance"]:
        warnings.warn("one output: variances are emulated", stacklevel=2)
        return base
    names = list(convert_ranges(ranges))
    per = stats.covariances(df, names, outputs).filter("n > 1")
    k = len(outputs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cols = [f"{outputs[i]}_{outputs[j]}" for i, j in pairs]
    if logged:

        def log_rows(parts):
            for pdf in parts:
                m = np.zeros((len(pdf), k, k))
                for (i, j), c in zip(pairs, cols, strict=True):
                    m[:, i, j] = m[:, j, i] = pdf[c].fillna(0.0)
                val, vec = np.linalg.eigh(m)
                m = (vec * np.log(np.maximum(val, 1e-8))[:, None, :]) @ np.swapaxes(vec, 1, 2)
                yield pdf[names].assign(**{c: m[:, i, j] for (i, j), c in zip(pairs, cols, strict=True)})

        per = per.select(*names, *cols).mapInPandas(log_rows, ", ".join(f"`{c}` double" for c in [*names, *cols]))
    want = [c for (i, j), c in zip(pairs, cols, strict=True) if matrix is None or matrix[i][j]]
    ems = train(per.select(*(F.col(c).cast("double").alias(c) for c in [*names, *want])), want, ranges, max(1, order - 1), corr_name, **({"check_ranges": False} | options))
    entries = [[None] * k for _ in range(k)]
    for (i, j), c in zip(pairs, cols, strict=True):
        entries[i][j] = entries[j][i] = ems.get(c)
    parts = [stats.split_name(o) for o in outputs]
    if rho is None:
        rho = np.eye(k)
        by = {frozenset((r.a, r.b)): r.rho for r in stats.rho_estimate(df, names, outputs).collect() if r.rho is not None}
        for i, j in itertools.combinations(range(k), 2):
            rho[i, j] = rho[j, i] = by.get(frozenset((parts[i][0], parts[j][0])), 1.0 if parts[i][0] == parts[j][0] else 0.0)
    if theta is None:
        label = next((lab for lab, t in parts if t is not None and sum(p[0] == lab for p in parts) > 1), None)
        own = [o for o, p in zip(outputs, parts, strict=True) if p[0] == label]
        if label is not None:
            r = per_variances(df, names, own).agg(*(stats.corr(a, b).alias(f"{a}_{b}") for a, b in itertools.combinations(own, 2))).first()
            c = np.eye(len(own))
            for (i, a), (j, b) in itertools.combinations(enumerate(own), 2):
                c[i, j] = c[j, i] = r[f"{a}_{b}"] or 0.0
            theta = stats.theta_estimate(c, [float(stats.split_name(o)[1]) for o in own])
    return {"expectation": base["expectation"], "variance": EmulatedMatrix(tuple(map(tuple, entries)), logged, theta, np.asarray(rho))}


def per_variances(df: DataFrame, names: list[str], outputs: list[str]) -> DataFrame:
    """The replicate variance of each output at each point."""
    return df.groupBy(*names).agg(*(F.var_samp(o).alias(o) for o in outputs))


# ------------------------------------------------------------------ multistate


#: Bins of a point's replicates, and replicates that its centres are found from.
MODE_BINS, MODE_ROWS = 1024, 2_000


def fuzzy_two_means(y: np.ndarray, m: float = 2.0, steps: int = 50, weight: np.ndarray | None = None, inner: float | np.ndarray = 0.0) -> tuple[np.ndarray, float, float]:
    """(labels 0/1, sum of squares with one cluster, with two times a margin) for fuzzy c-means; labels follow the order of the centres.

    Rows may stand for ``weight`` values each, with sums of squares ``inner`` about them.
    """
    y = np.atleast_2d(np.asarray(y, float).T).T
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    inner = np.broadcast_to(np.asarray(inner, float), len(y))
    centre = lambda k: (weight[k, None] * y[k]).sum(0) / weight[k].sum()
    spread = lambda k: float((weight[k, None] * (y[k] - centre(k)) ** 2).sum() + inner[k].sum())
    total, every = weight.sum(), np.ones(len(y), bool)
    one = spread(every) if len(y) else 0.0
    if total < 4 or len(y) < 2 or one == 0:
        return np.zeros(len(y), int), one, one
    order = np.argsort(y[:, 0], kind="stable")
    low = np.zeros(len(y), bool)
    low[order[: max(1, min(len(y) - 1, int(np.searchsorted(np.cumsum(weight[order]), total / 2, "right"))))]] = True
    c = np.stack([centre(low), centre(~low)])
    for _ in range(steps):
        d = np.maximum(((y[:, None, :] - c[None]) ** 2).sum(-1), 1e-18)
        u = 1 / (d ** (1 / (m - 1)) * (1 / d ** (1 / (m - 1))).sum(1, keepdims=True))
        w = u**m * weight[:, None]
        new = (w.T @ y) / w.sum(0)[:, None]
        if np.abs(new - c).max() < 1e-10:
            break
        c = new
    labels = np.argmax(u, axis=1)
    if c[0, 0] > c[1, 0]:
        labels = 1 - labels
    within = sum(spread(labels == k) for k in (0, 1) if (labels == k).any())
    # two clusters must explain far more than halving one blob would, the more so in small samples
    return labels, one, within * 5 * (1 + 6 / total)


def detect_modes(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Per point and output: whether its replicates form two clusters, and the share of the lower one.

    Replicates are folded to at most MODE_BINS bins between the least and the
    largest before a worker sees them, so no group grows with their number.
    """
    keys = [*inputs, "output"]
    long = df.select(*(F.col(c).cast("double").alias(c) for c in [*inputs, *outputs])).unpivot(inputs, outputs, "output", "_y").dropna()
    span = long.groupBy(*keys).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    bins = long.join(span, keys).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(MODE_BINS - 1), F.floor((F.col("_y") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * MODE_BINS))).otherwise(0))
    y = F.col("_y") - F.col("_lo")
    folded = bins.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q"))
    schema = ", ".join(f"`{c}` double" for c in inputs) + ", output string, bimodal boolean, prop double, n long"

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["_n"].to_numpy(float), pdf["_s"].to_numpy(float)
        lab, one, two = fuzzy_two_means(s / n, weight=n, inner=np.maximum(pdf["_q"].to_numpy(float) - s * s / n, 0.0))
        both = one >= two and 0 < lab.sum() < len(lab)
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in keys), bool(both), float(n[lab == 0].sum() / n.sum()) if both else 1.0, int(n.sum()))], columns=[*keys, "bimodal", "prop", "n"])

    return folded.groupBy(*keys).applyInPandas(f, schema)


def split_modes(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """The runs with ``mode`` 1 and 2; runs of points with one mode are in both.

    A point's centres are found from about MODE_ROWS of its runs (all, if it
    has fewer), by hash; every run goes to the nearer one.
    """
    d = df.select(*(F.col(c).cast("double").alias(c) for c in [*inputs, *outputs]))
    sizes = d.groupBy(*inputs).agg(F.count("*").alias("_n"))
    some = d.withColumn("_h", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *outputs), F.lit(1 << 30))).join(sizes, inputs).filter(F.col("_h") < F.lit(float(1 << 30)) * MODE_ROWS / F.col("_n"))
    schema = ", ".join(f"`{c}` double" for c in inputs) + ", _two boolean, _sd array<double>, _c1 array<double>, _c2 array<double>"

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[outputs].to_numpy(float)
        sd = np.where(np.nanstd(x, axis=0) > 0, np.nanstd(x, axis=0), 1.0)
        z = np.nan_to_num(x / sd)
        lab, one, two = fuzzy_two_means(z)
        both = bool(one >= two and 0 < lab.sum() < len(lab))
        c = [z[lab == k].mean(0).tolist() if both else [0.0] * len(outputs) for k in (0, 1)]
        return pd.DataFrame([(*(pdf[n].iloc[0] for n in inputs), both, sd.tolist(), *c)], columns=[*inputs, "_two", "_sd", "_c1", "_c2"])

    centres = some.groupBy(*inputs).applyInPandas(f, schema)
    away = lambda c: sum(((F.coalesce(F.nanvl(F.col(o), F.lit(0.0)), F.lit(0.0)) / F.col("_sd")[i] - F.col(c)[i]) ** 2 for i, o in enumerate(outputs)), F.lit(0.0))
    mode = F.when(~F.col("_two"), F.array(F.lit(1), F.lit(2))).when(away("_c1") <= away("_c2"), F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    return d.join(centres, inputs).select(*inputs, *outputs, F.explode(mode).alias("mode"))


def train_multistate(df: DataFrame, outputs: list[str], ranges, order: int = 2, corr_name: str = "exp_sq", share: float = 0.1, **options):
    """{mode1, mode2, prop}: an output has two modes if at least ``share`` of the points do; if none has, variance emulation."""
    names = list(convert_ranges(ranges))
    modes = detect_modes(df, names, outputs).cache()
    two = {r.output for r in modes.groupBy("output").agg(F.avg(F.col("bimodal").cast("double")).alias("s")).filter(F.col("s") >= share).collect()}
    if not two:
        warnings.warn("no output has two modes: variances are emulated", stacklevel=2)
        modes.unpersist()
        return train_variance(df, outputs, ranges, order, corr_name, **options)
    both = split_modes(df, names, sorted(two)).cache()
    out = {}
    for k in (1, 2):
        own = train_variance(both.filter(F.col("mode") == k).drop("mode"), sorted(two), ranges, order, corr_name, **options)
        rest = [o for o in outputs if o not in two]
        if rest:
            more = train_variance(df, rest, ranges, order, corr_name, **options)
            own = {s: own[s] | more[s] for s in own}
        out[f"mode{k}"] = own
    prop = modes.filter(F.col("output").isin(*two)).groupBy(*names).agg(F.avg("prop").alias("prop"))
    out["prop"] = train(prop, ["prop"], ranges, max(1, order - 1), corr_name, **options)["prop"]
    modes.unpersist()
    both.unpersist()
    return {"mode1": {s: list(v.values()) for s, v in out["mode1"].items()}, "mode2": {s: list(v.values()) for s, v in out["mode2"].items()}, "prop": out["prop"]}


def emulator_from_data(df: DataFrame | dict[str, DataFrame], outputs: list[str], ranges=None, emulator_type: str | None = "default", targets: dict | None = None, input_names: list[str] | None = None, **options):
    """The one entry point: type default, variance, covariance or multistate; types that the data cannot carry step down with a warning.

    ``df`` is one table, or a table for each output. Without ranges the inputs
    ``input_names`` are taken to be in [-1, 1]; an unknown type is the default.
    With ``targets`` a preflight runs first and warns of outputs that never hit.
    """
    if ranges is None:
        if not input_names:
            raise ValueError("ranges or input_names are needed")
        warnings.warn("no ranges: inputs are taken to be in [-1, 1]", stacklevel=2)
        ranges = dict.fromkeys(input_names, (-1.0, 1.0))
    if isinstance(df, dict):
        if missing := [o for o in outputs if o not in df]:
            raise ValueError(f"no table for the output {missing[0]!r}")
        parts = [emulator_from_data(df[o], [o], ranges, emulator_type, None if targets is None else {k: t for k, t in targets.items() if k == o}, **options) for o in outputs]
        if all("expectation" in p for p in parts):
            return {s: {o: e for p in parts for o, e in p[s].items()} for s in ("expectation", "variance")}
        return {o: p[o] if o in p else p for o, p in zip(outputs, parts, strict=True)}
    if missing := [o for o in outputs if o not in df.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    if targets:
        checked = stats.preflight(df, {o: t for o, t in targets.items() if o in df.columns})
        if checked["missed"]:
            warnings.warn("; ".join(f"{o}: never hit ({k})" for o, k in checked["missed"].items()), stacklevel=2)
    kinds = {"default": train, "variance": train_variance, "covariance": train_covariance, "multistate": train_multistate}
    if emulator_type not in kinds:
        emulator_type = "default"
    names = list(convert_ranges(ranges))
    if emulator_type != "default":
        c = df.agg(F.count("*").alias("n"), F.countDistinct(*names).alias("k")).first()
        if c.n == c.k:
            warnings.warn("one run for each point: type default", stacklevel=2)
            emulator_type = "default"
    return kinds[emulator_type](df, outputs, ranges, **options)


def variance_emulator_from_data(df: DataFrame, outputs: list[str], ranges, **options):
    """Older name for ``emulator_from_data(..., "variance")``."""
    warnings.warn("use emulator_from_data with emulator_type='variance'", DeprecationWarning, stacklevel=2)
    return emulator_from_data(df, outputs, ranges, "variance", **options)


def bimodal_emulator_from_data(df: DataFrame, outputs: list[str], ranges, **options):
    """Older name for ``emulator_from_data(..., "multistate")``."""
    warnings.warn("use emulator_from_data with emulator_type='multistate'", DeprecationWarning, stacklevel=2)
    return emulator_from_data(df, outputs, ranges, "multistate", **options)
