"""Implausibility-driven evolutionary Monte Carlo over a ladder of cutoffs.

The chains of one run depend on each other, so a run is driver work on a few
hundred points; independent runs are dealt to tasks by ``idemc_runs``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.collections import EmulatorSet
from ..plans.targets import targets
from .ship import Shipped

SILHOUETTE_ROWS = 500


def implausibility_nth(s: EmulatorSet, z: dict, x: np.ndarray, n: int) -> np.ndarray:
    ts = targets(z)
    by: dict[str, np.ndarray] = {}
    for m in s.members:
        if m.output in ts and m.surface == "expectation":
            i = m.em.implausibility(x, ts[m.output])
            by[m.output] = np.maximum(by[m.output], i) if m.output in by else i
    return np.sort(np.stack(list(by.values())), axis=0)[::-1][min(n, len(by)) - 1]


def fuzzy_clusters(x: np.ndarray, k: int, m: float = 2.0, steps: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of fuzzy c-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        d = np.maximum(((x[:, None] - c[None]) ** 2).sum(-1), 1e-18)
        u = 1 / (d ** (1 / (m - 1)) * (1 / d ** (1 / (m - 1))).sum(1, keepdims=True))
        w = u**m
        new = (w.T @ x) / w.sum(0)[:, None]
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return np.argmax(u, axis=1), c


def silhouette(x: np.ndarray, lab: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own = np.stack([d[:, lab == k].mean(1) if (lab == k).any() else np.full(len(x), np.inf) for k in range(lab.max() + 1)], axis=1)
    a = own[np.arange(len(x)), lab]
    own[np.arange(len(x)), lab] = np.inf
    b = own.min(1)
    return float(np.mean((b - a) / np.maximum(np.maximum(a, b), 1e-300)))


def obtain_clusters(x: np.ndarray, most: int = 6, seed: int = 0) -> list[dict]:
    """Clusters of a sample (two to ``most``, by silhouette): centre and inverse covariance of each.

    The silhouette, which compares all pairs, is of at most ``SILHOUETTE_ROWS`` random rows; clusters are of all rows.
    """
    some = np.arange(len(x)) if len(x) <= SILHOUETTE_ROWS else np.random.default_rng(seed).choice(len(x), SILHOUETTE_ROWS, replace=False)
    best = (-1.0, np.zeros(len(x), int))
    for k in range(2, min(most, len(x) - 1) + 1):
        lab, _ = fuzzy_clusters(x, k, seed=seed)
        if len(np.unique(lab[some])) > 1:
            best = max(best, (silhouette(x[some], lab[some]), lab), key=lambda b: b[0])
    out = []
    for k in np.unique(best[1]):
        own = x[best[1] == k]
        cov = np.cov(own.T).reshape(x.shape[1], -1) if len(own) > x.shape[1] + 1 else np.cov(x.T).reshape(x.shape[1], -1)
        cov = cov + 1e-10 * np.eye(len(cov))
        val, vec = np.linalg.eigh(cov)
        out.append({"centre": own.mean(0), "cov": cov, "inv": np.linalg.pinv(cov), "root": vec * np.sqrt(np.maximum(val, 0.0))})
    return out


def predict_cluster(x: np.ndarray, clusters: list[dict]) -> np.ndarray:
    """The Mahalanobis-nearest cluster."""
    d = [np.einsum("ni,ij,nj->n", x - c["centre"], c["inv"], x - c["centre"]) for c in clusters]
    return np.argmin(np.stack(d), axis=0)


def step(state: list[np.ndarray], rungs: list[float], imp, ranges, clusters, rng, pm: float = 0.9, w: float = 0.8, mutations: int = 10) -> list[np.ndarray]:
    """One move of all rungs: mutations (or a crossover between rungs), then an exchange of neighbours.

    ``state[k]`` is the current point of rung k, whose implausibility is at most rungs[k].
    """
    lo, hi = ranges
    k = len(state)
    if k == 1 or rng.random() < pm:
        for _ in range(mutations):  # the rungs do not look at each other: one evaluation for all
            y = np.empty((k, len(lo)))
            for i in range(k):
                c = clusters[i][predict_cluster(state[i][None], clusters[i])[0]]
                jump = c["root"] @ rng.standard_normal(len(lo)) if rng.random() < w else rng.standard_normal(len(lo)) * (hi - lo) * 0.05
                y[i] = state[i] + jump
            inside = np.flatnonzero(((y >= lo) & (y <= hi)).all(1))
            for i, v in zip(inside, imp(y[inside]) if len(inside) else (), strict=True):
                if v <= rungs[i]:
                    state[i] = y[i]
    else:
        i, j = rng.choice(k, 2, replace=False)
        cut = rng.integers(1, len(lo)) if len(lo) > 1 else 0
        a = np.concatenate([state[i][:cut], state[j][cut:]])
        b = np.concatenate([state[j][:cut], state[i][cut:]])
        v = imp(np.stack([a, b]))
        if v[0] <= rungs[i] and v[1] <= rungs[j]:
            state[i], state[j] = a, b
    for i in range(k - 1):
        if rng.random() < 0.5 and imp(state[i][None])[0] <= rungs[i + 1]:
            state[i], state[i + 1] = state[i + 1], state[i]
    return state


def idemc(ems, n: int, z: dict, cutoff: float = 3.0, s: int | None = None, nth: int | None = None, share: float = 0.4, thin: int = 1, mutations: int = 10, pm: float = 0.9, w: float = 0.8, seed: int = 0, max_rungs: int = 12, detailed: bool = False, get_burnt: bool = False, burnt: dict | None = None):
    """``n`` points below ``cutoff``: rungs are added until the last one is at it, each reached from the ``share`` quantile of the one before.

    Where the ladder ends above the cutoff, a warning says at what the points
    are. ``get_burnt`` returns the ladder alone, for later calls as ``burnt``.
    """
    es = EmulatorSet.of(ems)
    ranges = es.ranges()
    names = list(ranges)
    lo, hi = (np.array([r[i] for r in ranges.values()]) for i in (0, 1))
    rng = np.random.default_rng(seed)
    nth = nth or (2 if len(es.outputs) > 10 else 1)
    imp = lambda x: implausibility_nth(es, z, x, nth)
    s = s or max(500, n // 5)
    sample = lo + rng.random((s, len(names))) * (hi - lo)
    vals = imp(sample)
    rungs, history = [float("inf")], [sample]
    pools = [sample]
    if burnt is not None:
        rungs, pools, history = list(burnt["rungs"]), list(burnt["pools"]), list(burnt["pools"])
    for _ in range(max_rungs if burnt is None else 0):
        new = max(cutoff, float(np.quantile(vals, share)))
        keep = sample[vals <= new]
        if len(keep) < 2:
            break
        rungs.append(new)
        pools.append(keep)
        history.append(keep)
        if new <= cutoff:
            break
        clusters = [obtain_clusters(p, seed=seed) for p in pools]
        state, got = [p[rng.integers(len(p))].copy() for p in pools], []
        for _ in range(s):
            state = step(state, rungs, imp, (lo, hi), clusters, rng, pm, w, mutations)
            got.append(state[-1].copy())
        sample = np.array(got)
        vals = imp(sample)
    if rungs[-1] > cutoff:
        warnings.warn(f"the cutoff {cutoff} is out of reach; points are at {rungs[-1]:.3f}", stacklevel=2)
    if get_burnt:
        return {"rungs": rungs, "pools": pools}
    clusters = [obtain_clusters(p, seed=seed) for p in pools]
    state, out = [p[rng.integers(len(p))].copy() for p in pools], []
    for i in range(n * thin):
        state = step(state, rungs, imp, (lo, hi), clusters, rng, pm, w, mutations)
        if i % thin == thin - 1:
            out.append(state[-1].copy())
    pts = pd.DataFrame(np.array(out).reshape(-1, len(names)), columns=names)
    return {"points": pts, "rungs": rungs[1:], "history": history} if detailed else pts


def idemc_runs(spark: SparkSession, ems, n: int, z: dict, runs: int = 8, **options) -> DataFrame:
    """Independent runs in parallel: (run, inputs)."""
    es = EmulatorSet.of(ems)
    names = list(es.ranges())
    shared = Shipped(spark, (es, z))

    def f(parts):
        for pdf in parts:
            for r in pdf["id"]:
                e, t = shared.value
                yield idemc(e, n, t, seed=int(r), **options).assign(run=int(r))[["run", *names]]

    return spark.range(runs).repartition(runs).mapInPandas(f, "run long, " + ", ".join(f"`{c}` double" for c in names))
