"""Design: proposing points of the space not yet ruled out.

Candidates are tables that are scored and filtered in parallel; what comes to
the driver is the plausible set, which has the size of a design. Every loop has
a bound.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import Pca, _t_cdf, ball, normal_cdf, scale_array, significant
from ..plans.collections import EmulatorSet, collect_emulators
from ..plans.emulator import Emulator
from ..plans.targets import Ranges, targets
from ..sources.generators import lhs, lhs_array
from .idemc import fuzzy_clusters, implausibility_nth, silhouette
from .lines import walked
from .saving import saved
from .score import default_n, nth_implausible
from .stats import in_range

HOPELESS = 20.0
#: Points that the driver scores itself: a job would take longer to start.
DRIVER_POINTS = 20_000
#: Accepted points that the driver holds between stages.
MAX_KEPT = 200_000


@dataclass
class Options:
    points_factor: int = 40
    nth: int | None = None
    accept: Callable | None = None  # (df, ems, z, cutoff, n) -> df with a boolean column I
    cluster: bool = False
    cutoff_tolerance: float = 0.01
    ladder_tolerance: float = 0.1
    resample: int = 1
    seek: int = 0
    to_file: str | None = None
    pca_lhs: bool = False  # candidates from a box in the whitened space of the training points
    pca_slice: bool = False  # slices in the whitened space of the points so far
    seek_distro: str = "norm"  # norm, logis, cauchy or t: the emulator's distribution when good points are sought
    use_collect: bool = True  # whether emulators are put in order first
    corners: bool = False
    n_lines: int = 20
    ppl: int = 50
    imp_distro: str = "sphere"
    imp_scale: float = 2.0
    max_rungs: int = 12
    max_rounds: int = 12
    seed: int = 0


@dataclass
class Design:
    points: pd.DataFrame
    cutoff: float
    log: list[str] = field(default_factory=list)


def maximin(points: np.ndarray, n: int, reps: int = 1000, seed: int = 0) -> np.ndarray:
    """Rows of the best of ``reps`` random subsets by least distance."""
    if len(points) <= n:
        return np.arange(len(points))
    rng = np.random.default_rng(seed)
    best, rows = -1.0, np.arange(n)
    for _ in range(reps):
        pick = rng.choice(len(points), n, replace=False)
        d = _least_distance(points[pick])
        if d > best:
            best, rows = d, pick
    return rows


def _least_distance(x: np.ndarray) -> float:
    if len(x) < 2:
        return math.inf
    s = (x**2).sum(1)
    d = s[:, None] + s[None, :] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return math.sqrt(max(0.0, float(d.min())))


#: Points that one task, or the driver, spreads at once.
GROUP_ROWS = 100_000


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of greedily farthest points: first the one farthest from the origin, then ever the one farthest from those; ties go to the first row."""
    if not len(x):
        return np.empty(0, np.int64)
    pick = [int(np.argmax(np.round((x**2).sum(1), 9)))]
    near = ((x - x[pick[0]]) ** 2).sum(1)
    while len(pick) < min(n, len(x)):
        k = int(np.argmax(np.round(near, 9)))
        pick.append(k)
        near = np.minimum(near, ((x - x[k]) ** 2).sum(1))
    return np.array(pick)


def exchanged(x: np.ndarray, pick: np.ndarray, reps: int) -> np.ndarray:
    """The picked rows after up to ``reps`` exchanges: one of the closest two goes for the row that is farthest from the rest, while the least distance grows."""
    pick = pick.copy()
    for _ in range(reps if len(pick) > 1 else 0):
        d = ((x[pick][:, None] - x[pick][None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        now, best = d.min(), None
        for out in np.unravel_index(int(np.argmin(d)), d.shape):
            near = np.full(len(x), np.inf)
            for k in np.delete(pick, out):
                near = np.minimum(near, ((x - x[k]) ** 2).sum(1))
            others = np.delete(np.delete(d, out, 0), out, 1).min() if len(pick) > 2 else np.inf
            k = int(np.argmax(near))
            got = min(float(near[k]), others)
            if got > now * (1 + 1e-12) and (best is None or got > best[0]):
                best = (got, out, k)
        if best is None:
            # pairs as close as the closest remain: exchanges that only lower their number are not sought
            break
        pick[best[1]] = best[2]
    return pick


def _spread_out(df: DataFrame, n: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(points, scaled points) that hold a good spread of all rows of the table.

    All rows are read: distinct points are dealt by their hash to groups of
    some ``GROUP_ROWS``, each of which gives 4 n farthest points, until the
    driver can hold what is left.
    """
    d = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna().distinct()
    d = saved(d, "points")
    r = d.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rows = r["n"]
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([r[f"s{i}"] or 1.0 for i in range(len(names))])

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names].sort_values(names)
        return pdf.iloc[np.sort(farthest((pdf.to_numpy(float) - mean) / scale, 4 * n))]

    schema = ", ".join(f"`{c}` double" for c in names)
    while rows > GROUP_ROWS:
        groups = math.ceil(rows / GROUP_ROWS)
        d = saved(d.groupBy(F.pmod(F.xxhash64(F.lit(rows), *names), F.lit(groups)).alias("_g")).applyInPandas(some, schema), "points")
        before, rows = rows, d.count()
        if rows > before // 2:
            raise ValueError(f"{n} points are too many to spread over groups of {GROUP_ROWS}")
    x = d.toPandas().sort_values(names).to_numpy(float)
    return x, (x - mean) / scale


def farthest_points(df: DataFrame, n: int, names: list[str]) -> DataFrame:
    """(step, inputs): ``n`` points, each the farthest (over scaled inputs) from those before, the first from the mean; of all rows where there are up to GROUP_ROWS points."""
    x, scaled = _spread_out(df, n, names)
    pick = farthest(scaled, n)
    rows = [(k, *map(float, x[i])) for k, i in enumerate(pick)]
    return df.sparkSession.createDataFrame(rows, "step int, " + ", ".join(f"`{c}` double" for c in names))


def maximin_sample(df: DataFrame, n: int, names: list[str], reps: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` rows of the table whose least distance (over scaled inputs) is large: farthest points of all rows, then up to ``reps`` exchanges.

    ``seed`` deals the random subsets that the result is at least as good as.
    """
    x, scaled = _spread_out(df, n, names)
    pick = exchanged(scaled, farthest(scaled, n), reps)
    other = maximin(scaled, n, min(reps, 200), seed)
    if _least_distance(scaled[other]) > _least_distance(scaled[pick]):
        pick = exchanged(scaled, other, reps)
    return df.sparkSession.createDataFrame(pd.DataFrame(x[np.sort(pick)], columns=names), ", ".join(f"`{c}` double" for c in names))


def _kept(df: DataFrame, names: list[str]) -> np.ndarray:
    pdf = df.select(*names).limit(MAX_KEPT + 1).toPandas()
    if len(pdf) > MAX_KEPT:
        raise ValueError(f"more than {MAX_KEPT} points to keep on the driver")
    return pdf.to_numpy(float)


def kth_smallest(df: DataFrame, k: int, col: str = "I") -> float:
    """The exact k-th smallest value, by a top-k sort."""
    r = df.select(col).orderBy(F.asc_nulls_last(col)).limit(k).agg(F.max(col)).first()[0]
    return math.inf if r is None else float(r)


def dedupe(df: DataFrame, names: list[str], digits: int = 7) -> DataFrame:
    """One row for each point to so many significant digits."""
    keys = [f"_k{i}" for i in range(len(names))]
    return df.withColumns({k: significant(F.col(n), digits) for k, n in zip(keys, names, strict=True)}).dropDuplicates(keys).drop(*keys)


class Proposer:
    """One run of a design: emulators, targets and options, and the scoring that all stages share."""

    def __init__(self, spark: SparkSession, ems, z: dict, opts: Options):
        self.spark, self.z, self.opts = spark, z, opts
        order = opts.use_collect and opts.accept is None
        self.ems: EmulatorSet = collect_emulators(ems, {k: v for k, v in z.items() if k not in ("expectation", "variance")}) if order else EmulatorSet.of(ems)
        self.ranges: Ranges = self.ems.ranges()
        self.names = list(self.ranges)
        self.rng = np.random.default_rng(opts.seed)
        self.log: list[str] = []

    def frame(self, x: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pd.DataFrame(x, columns=self.names))

    def scored(self, df: DataFrame) -> DataFrame:
        if self.opts.accept is not None:
            raise ValueError("an acceptance measure of one's own has no numbers")
        return nth_implausible(df, self.ems, self.z, self.opts.nth)

    def accepted(self, df: DataFrame, cutoff: float) -> DataFrame:
        if self.opts.accept is not None:
            return self.opts.accept(df, self.ems, self.z, cutoff, self.opts.nth).filter("I").drop("I")
        return nth_implausible(df, self.ems, self.z, self.opts.nth, cutoff=cutoff).filter("I").drop("I")

    def inside(self, x: np.ndarray) -> np.ndarray:
        lo, hi = (np.array([r[i] for r in self.ranges.values()]) for i in (0, 1))
        return x[((x >= lo) & (x <= hi)).all(1)]

    @property
    def here(self) -> bool:
        """Whether the driver can score points itself: one surface, one mode, the usual measure."""
        return self.opts.accept is None and self.ems.kind == "flat" and set(self.z) != {"expectation", "variance"}

    def implausibilities(self, x: np.ndarray) -> np.ndarray:
        return implausibility_nth(self.ems, self.z, x, self.opts.nth or default_n(self.ems)) if len(x) else np.empty(0)

    def passes(self, x: np.ndarray, cutoff: float) -> np.ndarray:
        """Which points are in the ranges and not ruled out."""
        lo, hi = (np.array([r[i] for r in self.ranges.values()]) for i in (0, 1))
        ok = ((x >= lo) & (x <= hi)).all(1)
        if self.here and len(x) <= DRIVER_POINTS:
            ok[ok] = self.implausibilities(x[ok]) <= cutoff
        elif ok.any():
            rows = self.spark.createDataFrame(pd.DataFrame({**{c: x[ok][:, k] for k, c in enumerate(self.names)}, "_i": np.flatnonzero(ok)}))
            got = self.accepted(rows, cutoff).select("_i").toPandas()["_i"].to_numpy()
            ok = np.zeros(len(x), bool)
            ok[got] = True
        return ok

    def keep(self, x: np.ndarray, cutoff: float) -> np.ndarray:
        if self.here and len(x) <= DRIVER_POINTS:
            return x[self.passes(x, cutoff)]
        x = self.inside(x)
        return _kept(self.accepted(self.frame(x), cutoff), self.names) if len(x) else x

    # ------------------------------------------------------------- stages

    def lhs_stage(self, n: int, cutoff: float, pca: Pca | None = None) -> tuple[np.ndarray, float]:
        """Latin hypercube candidates; where too few pass, the cutoff rises to what enough points reach."""
        total = max(n, 10 * len(self.names)) * self.opts.points_factor
        if self.opts.pca_lhs and (pca := pca or self.training_pca()) is not None:
            box = {f"p{i}": (-3.0, 3.0) for i in range(len(self.names))}
            x = self.inside(pca.transform(lhs_array(total, box, self.rng), forward=False))
        elif self.here and total <= DRIVER_POINTS:
            x = lhs_array(total, self.ranges, np.random.default_rng([self.opts.seed, total]))
        else:
            x = None
        if self.opts.corners:
            x = self.corners() if x is None else np.concatenate([x, self.corners()])
        df = None if x is not None and (self.opts.pca_lhs or self.here and total <= DRIVER_POINTS) else lhs(self.spark, self.ranges, total, self.opts.seed).drop("point_id")
        if x is not None and df is not None:
            df = df.unionByName(self.frame(x))
        if df is None and not self.here:
            df = self.frame(x)
        if self.opts.accept is not None:
            return _kept(self.accepted(df, cutoff), self.names), cutoff
        k = min(max(1, n - 1, math.floor(0.8 * n)), 5 * len(self.names))
        if df is None:
            imp = self.implausibilities(x)
            reach = float(np.sort(imp)[min(k, len(imp)) - 1]) if len(imp) else math.inf
            if reach >= HOPELESS:
                warnings.warn("no candidate comes near the targets", stacklevel=2)
                return np.empty((0, len(self.names))), reach
            at = max(cutoff, reach)
            return x[imp <= at], at
        d = self.scored(df).cache()
        reach = kth_smallest(d, k)
        if reach >= HOPELESS:
            warnings.warn("no candidate comes near the targets", stacklevel=2)
            d.unpersist()
            return np.empty((0, len(self.names))), reach
        at = max(cutoff, reach)
        x = _kept(d.filter(F.col("I") <= at), self.names)
        d.unpersist()
        return x, at

    def training_pca(self) -> Pca | None:
        """Principal axes of the training points of the emulators with all inputs; None where they have too few."""
        found = [scale_array(m.em.x, m.em.ranges, forward=False) for m in self.ems.members if getattr(m.em, "x", None) is not None and list(m.em.ranges) == self.names]
        x = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, len(self.names)))
        return _pca(self.names, x) if len(x) > len(self.names) else None

    def corners(self) -> np.ndarray:
        """The corners of the ranges; a random choice of them where there are more than a hundred times the points' factor."""
        d, most = len(self.names), 100 * self.opts.points_factor
        bits = np.array([[k >> i & 1 for i in range(d)] for k in range(1 << d)]) if d < 20 and 1 << d <= most else np.unique(self.rng.integers(0, 2, (most, d)), axis=0)
        lo, hi = (np.array([r[i] for r in self.ranges.values()]) for i in (0, 1))
        return np.where(bits == 1, hi, lo).astype(float)

    def line_stage(self, x: np.ndarray, cutoff: float) -> np.ndarray:
        """Points at the edge of the plausible set on the longest of random lines through pairs of it."""
        if self.here and len(x) > 1 and self.opts.n_lines * (self.opts.ppl + 1) <= DRIVER_POINTS:
            a, b = longest_pairs(x, self.opts.n_lines, self.rng)
            t = (np.arange(self.opts.ppl + 1) - self.opts.ppl / 4) / (self.opts.ppl / 2)
            y = a[:, None] + (b - a)[:, None] * t[None, :, None]
            ok = self.passes(y.reshape(-1, y.shape[2]), cutoff).reshape(y.shape[:2])
            out = np.zeros((len(y), 1), bool)
            return y[ok & ~(np.hstack([out, ok[:, :-1]]) & np.hstack([ok[:, 1:], out]))]
        return _kept(boundary(self.accepted_flags(line_points(self.spark, x, self.names, self.opts.n_lines, self.opts.ppl, self.rng), cutoff)), self.names) if len(x) > 1 else np.empty((0, len(self.names)))

    def accepted_flags(self, df: DataFrame, cutoff: float) -> DataFrame:
        box = in_range(self.ranges)
        if self.opts.accept is not None:
            d = self.opts.accept(df, self.ems, self.z, cutoff, self.opts.nth)
        else:
            d = nth_implausible(df, self.ems, self.z, self.opts.nth, cutoff=cutoff)
        return d.withColumn("ok", F.col("I") & box).drop("I")

    def importance_stage(self, x: np.ndarray, n: int, cutoff: float) -> np.ndarray:
        """Proposals around accepted points in whitened space, thinned by how many seeds cover them; the radius follows the acceptance."""
        if len(x) < 2:
            return np.empty((0, len(self.names)))
        pca = _pca(self.names, x)
        seeds = pca.transform(x)
        radius, got = self.opts.imp_scale / 2, np.empty((0, len(self.names)))
        burn = max(n // 4, 200)
        for _ in range(self.opts.max_rounds):
            y = self.propose(seeds, burn if len(got) < n else 0, radius)
            new = self.keep(pca.transform(y, forward=False), cutoff)
            rate = len(new) / max(1, len(y))
            got = np.concatenate([got, new])
            if rate < 0.1:
                radius *= 0.9
            elif rate > 0.225:
                radius *= 1.1
            if len(got) >= n:
                break
            burn = min(50 * n, max(burn, math.ceil((n - len(got)) / max(rate, 0.02))))
        return got

    def propose(self, seeds: np.ndarray, n: int, radius: float) -> np.ndarray:
        d = seeds.shape[1]
        at = seeds[self.rng.integers(0, len(seeds), n)]
        if self.opts.imp_distro == "normal":
            y = at + radius * self.rng.standard_normal((n, d))
            dens = np.zeros(n)
            for k in range(0, len(seeds), 512):
                dens += np.exp(-((y[:, None, :] - seeds[None, k : k + 512]) ** 2).sum(-1) / (2 * radius**2)).sum(1)
            w = dens.min() / np.maximum(dens, 1e-300) if n else dens
        else:
            y = ball(n, d, at, radius, self.rng)
            cover = np.zeros(n)
            for k in range(0, len(seeds), 512):
                cover += (((y[:, None, :] - seeds[None, k : k + 512]) ** 2).sum(-1) <= radius**2 * (1 + 1e-9)).sum(1)
            w = 1 / np.maximum(cover, 1)
        return y[self.rng.random(n) <= w]

    def slice_stage(self, x: np.ndarray, n: int, cutoff: float, sweeps: int = 5) -> np.ndarray:
        """Coordinate-wise slice sampling: all chains move at once, each shrinking its own interval on rejection.

        With ``pca_slice`` the coordinates are those of the whitened space of the points, from -5 to 5.
        """
        if not len(x):
            return x
        pca = _pca(self.names, x) if self.opts.pca_slice and len(x) > 1 else None
        there = (lambda y: pca.transform(y, forward=False)) if pca else (lambda y: y)
        y = (pca.transform(x) if pca else x)[self.rng.integers(0, len(x), n)].copy()
        bounds = [(-5.0, 5.0)] * len(self.names) if pca else list(self.ranges.values())
        for _ in range(sweeps):
            for j, (lo, hi) in enumerate(bounds):
                a, b = np.full(n, lo), np.full(n, hi)
                open_ = np.arange(n)
                for _ in range(self.opts.max_rounds):
                    z = y[open_].copy()
                    z[:, j] = a[open_] + self.rng.random(len(open_)) * (b[open_] - a[open_])
                    ok = self.passes(there(z), cutoff)
                    y[open_[ok], j] = z[ok, j]
                    bad = open_[~ok]
                    below = z[~ok, j] < y[bad, j]
                    a[bad[below]], b[bad[~below]] = z[~ok, j][below], z[~ok, j][~below]
                    open_ = bad
                    if not len(open_):
                        break
        return there(y)

    def cluster_stage(self, n: int, cutoff: float) -> tuple[np.ndarray, float]:
        """Emulators in two groups by their active inputs: a design for each group, combined and scored again.

        Inputs that both groups use come from the first group's design.
        """
        groups = active_clusters(self.ems)
        if len(groups) < 2:
            return self.lhs_stage(n, cutoff)
        parts = []
        for outs, names in groups:
            own = Proposer(self.spark, self.ems.subset(outs), self.z, replace(self.opts, cluster=False))
            x, _ = own.lhs_stage(n, cutoff)
            names = [k for k in names if not parts or k not in parts[0][0]]
            parts.append((names, x[:, [self.names.index(k) for k in names]]))
        if any(not len(x) for _, x in parts):
            return self.lhs_stage(n, cutoff)
        m = max(1, math.isqrt(n * self.opts.points_factor))
        a, b = (self.spark.createDataFrame(pd.DataFrame(x[self.rng.permutation(len(x))[:m]], columns=names)) for names, x in parts)
        both = a.crossJoin(b)  # at most m x m rows, both sides cut to m
        rest = [k for k in self.names if k not in both.columns]
        for i, k in enumerate(rest):
            lo, hi = self.ranges[k]
            both = both.withColumn(k, F.lit(lo) + F.rand(self.opts.seed + i) * F.lit(hi - lo))
        x = _kept(self.accepted(both.select(*self.names), cutoff), self.names)
        return (x, cutoff) if len(x) >= n // 2 else self.lhs_stage(n, cutoff)


def active_clusters(s: EmulatorSet) -> list[tuple[list[str], list[str]]]:
    """Outputs in two groups by their active inputs, or in one: (outputs, inputs).

    Where inputs part the outputs, those are the groups; else fuzzy clusters of
    the sets of active inputs, if they stand clearly apart and each has inputs of its own.
    """
    groups: list[tuple[set, set]] = []
    for m in s.members:
        act = {n for n, a in zip(m.em.inputs, m.em.active, strict=True) if a}
        hit = [g for g in groups if g[1] & act]
        new = ({m.output}.union(*(g[0] for g in hit)), act.union(*(g[1] for g in hit)))
        groups = [g for g in groups if g not in hit] + [new]
    names, outs = list(s.ranges()), s.outputs
    if len(groups) == 1 and len(outs) > 2:
        act = np.array([[any(n in m.em.inputs and m.em.active[m.em.inputs.index(n)] for m in s.members if m.output == o) for n in names] for o in outs], float)
        tries = [fuzzy_clusters(act, 2, seed=k)[0] for k in range(8)]
        lab = max(tries, key=lambda v: silhouette(act, v) if len(np.unique(v)) == 2 else -1.0)
        sets = [{n for n, a in zip(names, act[lab == k].any(0), strict=True) if a} for k in (0, 1)]
        if len(np.unique(lab)) == 2 and silhouette(act, lab) > 0.5 and sets[0] - sets[1] and sets[1] - sets[0]:
            groups = [({o for o, v in zip(outs, lab, strict=True) if v == k}, sets[k]) for k in (0, 1)]
    return [(sorted(o), sorted(a)) for o, a in groups] if len(groups) == 2 else [(outs, names)]


def _pca(names: list[str], x: np.ndarray) -> Pca:
    """Principal axes of an array of points."""
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
    c = z.T @ z / max(1, len(x) - 1)
    np.fill_diagonal(c, 1.0)
    return Pca(names, x.mean(0), sd, c)


def longest_pairs(x: np.ndarray, n_lines: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the longest of ten times as many random pairs."""
    k = 10 * n_lines
    a, b = x[rng.integers(0, len(x), k)], x[rng.integers(0, len(x), k)]
    far = np.argsort(-((a - b) ** 2).sum(1), kind="stable")[:n_lines]
    return a[far], b[far]


def line_points(spark: SparkSession, x: np.ndarray, names: list[str], n_lines: int, ppl: int, rng: np.random.Generator) -> DataFrame:
    """(line, step, inputs): the longest of ten times as many random pairs, walked past both ends by a half."""
    a, b = longest_pairs(x, n_lines, rng)
    rows = [(i, *map(float, a[i]), *map(float, b[i])) for i in range(len(a))]
    ends = spark.createDataFrame(rows, "line int, " + ", ".join(f"`{p}{n}` double" for p in ("a_", "b_") for n in names))
    return walked(ends, names, ppl)


def boundary(df: DataFrame) -> DataFrame:
    """Accepted points on a line whose neighbour is rejected, or at its end."""
    w = Window.partitionBy("line").orderBy("step")
    edge = ~F.coalesce(F.lag("ok").over(w), F.lit(False)) | ~F.coalesce(F.lead("ok").over(w), F.lit(False))
    return df.withColumn("_edge", edge).filter(F.col("ok") & F.col("_edge")).drop("_edge", "ok")


#: Distribution functions with mean 0 and deviation 1 (the Cauchy one has neither).
DISTROS: dict[str, Callable] = {
    "norm": normal_cdf,
    "logis": lambda v: 1 / (1 + np.exp(-np.clip(v * math.pi / math.sqrt(3), -700, 700))),
    "cauchy": lambda v: 0.5 + np.arctan(v) / math.pi,
    "t": lambda v: _t_cdf(np.asarray(v) * math.sqrt(1.5), 6),
}


def hit_probability(ems, x: np.ndarray, z: dict, distro: str = "norm") -> np.ndarray:
    """For each point the product over outputs of the probability to hit the target (the least over waves)."""
    if distro not in DISTROS:
        raise ValueError(f"seek_distro is one of {', '.join(DISTROS)}")
    cdf, by = DISTROS[distro], {}
    for m in EmulatorSet.of(ems).members:
        t = targets(z).get(m.output)
        if t is None or m.surface != "expectation":
            continue
        lo, hi = t.bounds(3.0)
        e, sd = m.em.get_exp(x), np.sqrt(np.maximum(m.em.get_var(x), 1e-12))
        p = cdf((hi - e) / sd) - cdf((lo - e) / sd)
        by[m.output] = np.minimum(by[m.output], p) if m.output in by else p
    return np.prod(list(by.values()), axis=0) if by else np.ones(len(x))


def seek_good(ems, x: np.ndarray, z: dict, n: int, distro: str = "norm") -> np.ndarray:
    """The points with the largest product over targets of the probability to hit, thinned greedily by distance."""
    p = hit_probability(ems, x, z, distro)
    top = x[np.argsort(-p, kind="stable")[: 5 * n]]
    sd = np.where(x.std(0) > 0, x.std(0), 1.0)
    chosen = [0] if len(top) else []
    while len(chosen) < min(n, len(top)):
        d = (((top[:, None] - top[chosen][None]) / sd) ** 2).sum(-1).min(1)
        chosen.append(int(np.argmax(d)))
    return top[chosen]


def generate_new_design(spark: SparkSession, ems, n_points: int, z: dict, method: tuple[str, ...] = ("lhs", "line", "importance"), cutoff: float = 3.0, plausible: pd.DataFrame | None = None, thin: bool = True, opts: Options | None = None) -> Design:
    """Points not ruled out: by default Latin hypercube, lines, importance; a ladder of falling cutoffs where the first is out of reach."""
    opts = opts or Options()
    p = Proposer(spark, ems, z, opts)
    known = {"lhs", "line", "importance", "slice"}
    if bad := set(method) - known:
        raise ValueError(f"unknown method {sorted(bad)[0]!r}")
    d = len(p.names)
    at = cutoff
    if plausible is not None:
        x = p.keep(plausible[p.names].to_numpy(float), cutoff)
        if not len(x) and opts.accept is None:
            at = max(cutoff, kth_smallest(p.scored(p.frame(plausible[p.names].to_numpy(float))), 5 * d))
            x = p.keep(plausible[p.names].to_numpy(float), at)
    elif "lhs" in method:
        x, at = p.cluster_stage(n_points, cutoff) if opts.cluster else p.lhs_stage(n_points, cutoff)
        p.log.append(f"lhs: {len(x)} points at {at:.3f}")
        if at <= cutoff and len(x) >= 0.25 * n_points:  # high yield: more of the same
            for k in range(opts.max_rounds):
                if len(x) >= n_points:
                    break
                p.opts = replace(opts, seed=opts.seed + 101 * (k + 1))
                x = np.concatenate([x, p.lhs_stage(n_points, cutoff)[0]])
            p.opts = opts
    else:
        raise ValueError("without a plausible set the method needs lhs")
    if not len(x):
        return Design(pd.DataFrame(columns=p.names), at, p.log)
    for rung in range(opts.max_rungs):
        want = n_points if at <= cutoff + opts.cutoff_tolerance else max(n_points // 2, 5 * d)
        for stage in ("line", "importance", "slice"):
            if stage not in method or (stage != "line" and len(x) >= want and at <= cutoff):
                continue
            new = p.line_stage(x, at) if stage == "line" else p.importance_stage(x, want, at) if stage == "importance" else p.slice_stage(x, want, at)
            x = np.concatenate([x, new])
            p.log.append(f"{stage}: {len(x)} points at {at:.3f}")
            _to_file(p, x)
        x = _unique(x)
        if at <= cutoff + opts.cutoff_tolerance or opts.accept is not None:
            break
        if p.here and len(x) <= DRIVER_POINTS:
            s = pd.DataFrame(x, columns=p.names).assign(I=p.implausibilities(x))
        else:
            s = p.scored(p.frame(x)).select(*p.names, "I").toPandas()
        low = float(np.sort(s["I"].to_numpy())[min(len(s) - 1, max(5 * d, len(s) // 5))])
        if at - low < opts.ladder_tolerance and low > cutoff:
            p.log.append(f"the ladder ends at {at:.3f}")
            warnings.warn(f"the cutoff {cutoff} is out of reach; points are at {at:.3f}", stacklevel=2)
            break
        at = max(cutoff, low)
        x = s[s["I"] <= at][p.names].to_numpy(float)
    for _ in range(opts.resample if at <= cutoff + opts.cutoff_tolerance and "importance" in method else 0):
        base = x[maximin(_scaled(x), max(2, n_points // 2), 50, opts.seed)]
        x = _unique(np.concatenate([base, p.line_stage(base, at), p.importance_stage(base, n_points, at)]))
    good = seek_good(p.ems, x, z, opts.seek, opts.seek_distro) if opts.seek else np.empty((0, d))
    if thin and len(x) > n_points - len(good):
        x = x[maximin(_scaled(x), n_points - len(good), 1000, opts.seed)]
    x = np.concatenate([good, x])[:n_points]
    _to_file(p, x)
    return Design(pd.DataFrame(x, columns=p.names), at, p.log)


def generate_new_runs(spark: SparkSession, ems, n_points: int, z: dict, **options) -> Design:
    """Older name for ``generate_new_design``."""
    warnings.warn("use generate_new_design", DeprecationWarning, stacklevel=2)
    return generate_new_design(spark, ems, n_points, z, **options)


def _scaled(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)


def _unique(x: np.ndarray, digits: int = 7) -> np.ndarray:
    with np.errstate(divide="ignore"):
        e = np.where(x == 0, 0, np.floor(np.log10(np.abs(np.where(x == 0, 1, x)))))
    k = np.round(x / 10.0**e, digits - 1) * 10.0**e
    return x[np.sort(np.unique(k, axis=0, return_index=True)[1])]


def _to_file(p: Proposer, x: np.ndarray) -> None:
    if p.opts.to_file:
        from ..sources.models import checkpoint_points

        checkpoint_points(p.frame(x), p.opts.to_file)


# ------------------------------------------------------------------ gradients


def gradient(em: Emulator, x: np.ndarray) -> np.ndarray:
    return np.stack([em.get_exp_d(x, n) for n in em.inputs], axis=1)


def get_deriv_info(em: Emulator, x: np.ndarray, var: bool = False) -> dict:
    out = {"exp": gradient(em, x)}
    if var:
        d = em.inputs
        out["var"] = np.stack([np.stack([em.get_cov_d(x, a, p2=b) for b in d], axis=-1) for a in d], axis=-2)
    return out


def directional_deriv(em: Emulator, x: np.ndarray, v: np.ndarray, sd: float | None = None) -> np.ndarray:
    """Cosine of the expected gradient with a direction, with a band of ``sd`` deviations of the directional derivative."""
    v = np.asarray(v, float) / np.linalg.norm(v)
    g = gradient(em, x)
    size = np.maximum(np.linalg.norm(g, axis=1), 1e-300)
    c = g @ v / size
    if sd is None:
        return c
    cov = get_deriv_info(em, x, var=True)["var"]
    s = np.sqrt(np.maximum(np.einsum("i,nij,j->n", v, cov, v), 0.0)) / size
    return np.stack([c - sd * s, c, c + sd * s], axis=1)


def directional_proposal(ems: list[Emulator], x: np.ndarray, z: dict, accept: float = 2.0, h_start: float = 0.1, h_min: float = 1e-9, steps: int = 100, nv: int = 100, seed: int = 0) -> np.ndarray:
    """From one point along a direction that lowers every implausibility above ``accept``; the step halves on failure."""
    rng, ts = np.random.default_rng(seed), targets(z)
    x = np.asarray(x, float).reshape(1, -1)
    ranges = list(ems[0].ranges.values())
    width = np.array([b - a for a, b in ranges])
    h = h_start
    imp = lambda y: np.array([float(e.implausibility(y, ts[e.name])[0]) for e in ems])
    now = imp(x)
    for _ in range(steps):
        bad = now > accept
        if not bad.any() or h < h_min:
            break
        sign = np.array([np.sign(ts[e.name].centre - e.get_exp(x)[0]) for e in ems])
        g = np.concatenate([gradient(e, x) for e in ems])[bad] * sign[bad, None] * width
        v = rng.standard_normal((nv * len(width), len(width)))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        gain = (v @ g.T).min(1)
        y = np.clip(x + h * v[np.argmax(gain)] * width, [a for a, _ in ranges], [b for _, b in ranges])
        new = imp(y)
        if new[bad].max() < now[bad].max() and (new[~bad] <= accept).all():
            x, now = y, new
        else:
            h /= 2
    return x[0]

