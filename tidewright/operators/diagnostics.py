"""Diagnostics of emulators on validation runs, and what is left of the space."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.collections import EmulatorSet
from ..plans.emulator import Emulator, HierarchicalEmulator, ProtoEmulator
from ..plans.targets import Target, targets
from ..sources.generators import grid_or_uniform
from .score import implausibility_column, nth_implausible, score
from .stats import clean_data, clean_data_variance, structured_error, structured_error_all


def _real(em, what: str) -> None:
    if isinstance(em, ProtoEmulator):
        raise ValueError(f"{what} needs an emulator with a regression surface")


def scored_validation(em, validation: DataFrame) -> DataFrame:
    """Inputs, ``y`` (the output), ``rep`` (variance of the mean over replicates), ``e`` and ``v``; rows without an output go."""
    names = em.inputs
    if isinstance(em, HierarchicalEmulator):
        d = clean_data_variance(validation, names, em.name) if em.em_type == "variance" else clean_data(validation, names, em.name)
        d = d.select(*names, F.col("mean").alias("y"), F.coalesce("var", F.lit(0.0)).alias("rep"))
    else:
        d = validation.select(*names, F.col(em.name).cast("double").alias("y"), F.lit(0.0).alias("rep"))
    s = score(d.dropna(subset=["y"]), [em])
    return s.withColumnRenamed(f"{em.name}_exp", "e").withColumnRenamed(f"{em.name}_var", "v")


def get_diagnostic(em, validation: DataFrame, which: str = "cd", z=None, stdev: float = 3.0) -> DataFrame:
    """se: standardised errors; cd: prediction and its band; ce: emulator's and simulator's implausibility."""
    d = scored_validation(em, validation)
    d2 = sum(x * x for x in em.disc)
    sd = F.sqrt(F.col("v") + F.col("rep") + F.lit(d2))
    if which == "se":
        return d.withColumn("error", F.coalesce(F.try_divide(F.col("e") - F.col("y"), sd), F.lit(0.0)))
    if which == "cd":
        return d.withColumn("unc", F.lit(stdev) * sd)
    if which != "ce":
        raise ValueError("which is se, cd or ce")
    t = Target.of(z)
    em_imp = implausibility_column(F.col("e"), F.col("v") + F.col("rep"), t, em.disc)
    if t.interval:
        sim = F.abs(F.col("y") - F.lit(t.centre)) / F.lit((t.hi - t.lo) / 2)
    else:
        sim = F.coalesce(F.try_divide(F.abs(F.lit(t.val) - F.col("y")), F.lit(math.sqrt(t.sigma**2 + d2) or 1e-12)), F.lit(0.0))
    return d.withColumn("em_imp", em_imp).withColumn("sim_imp", sim)


def near_target(t: Target) -> Column:
    lo, hi = (t.lo - (t.hi - t.lo) / 2, t.hi + (t.hi - t.lo) / 2) if t.interval else (t.val - 6 * t.sigma, t.val + 6 * t.sigma)
    return F.col("y").between(F.lit(lo), F.lit(hi))


def failing(d: DataFrame, which: str, z=None, cutoff: float = 3.0) -> DataFrame:
    """The failing points of a diagnostic."""
    t = None if z is None else Target.of(z)
    if which == "se":
        bad = F.abs("error") > 3
    elif which == "cd":
        bad = (F.col("y") > F.col("e") + F.col("unc")) | (F.col("y") < F.col("e") - F.col("unc"))
    else:
        bad = (F.col("em_imp") > cutoff) & (F.col("sim_imp") <= (cutoff / 3 if t is not None and t.interval else cutoff))
    if which != "ce" and t is not None:
        bad = bad & near_target(t)
    return d.filter(bad)


def validation_diagnostics(ems, z: dict | None, validation: DataFrame, which: tuple[str, ...] = ("cd", "ce", "se")) -> DataFrame:
    """The distinct points that fail any diagnostic of any emulator; modes are matched to clusters of the runs by the lesser deviation."""
    s = EmulatorSet.of(ems)
    out = None
    ts = targets(z) if z else {}
    for m in s.members:
        if m.surface == "variance":
            continue
        v = validation
        if m.mode:
            from .train import split_modes

            v = split_modes(validation, m.em.inputs, [m.output]).filter(F.col("mode") == m.mode).drop("mode")
        for w in which:
            if w == "ce" and m.output not in ts:
                continue
            f = failing(get_diagnostic(m.em, v, w, ts.get(m.output)), w, ts.get(m.output)).select(*m.em.inputs)
            out = f if out is None else out.unionByName(f)
    return out.distinct()


def classification_diag(em, z, validation):
    return failing(get_diagnostic(em, validation, "ce", z), "ce", z)


def comparison_diag(em, z, validation):
    return failing(get_diagnostic(em, validation, "cd"), "cd", z)


def standard_errors(em, z, validation):
    return failing(get_diagnostic(em, validation, "se"), "se", z)


#: Points whose whole covariance the driver holds; ``tiles`` has errors and distances of more.
MAX_WHOLE = 5_000


def _few(validation: pd.DataFrame) -> None:
    if len(validation) > MAX_WHOLE:
        raise ValueError(f"more than {MAX_WHOLE} points: tiles.uncorrelated_errors and tiles.mahalanobis take tables of any size")


def summary_diag(em: Emulator, validation: pd.DataFrame) -> dict:
    """Whether the sum of squared standardised errors and the Mahalanobis distance are within three deviations of their mean."""
    _real(em, "summary_diag")
    _few(validation)
    x, y = validation[em.inputs].to_numpy(float), validation[em.name].to_numpy(float)
    e, c = em.get_exp(x), em.get_cov(x)
    m, n, q = len(x), 0 if em.x is None else len(em.x), len(em.basis.terms)
    chi = float(((y - e) ** 2 / np.maximum(np.diag(c), 1e-12)).sum())
    maha = float((y - e) @ np.linalg.pinv(c + 1e-10 * np.eye(m)) @ (y - e))
    sd = math.sqrt(2 * m * (m + n - q - 2) / (n - q - 4)) if n - q - 4 > 0 else math.inf
    return {"chi": chi, "mahalanobis": maha, "m": m, "chi_ok": abs(chi - m) <= 3 * math.sqrt(2 * m), "mahalanobis_ok": abs(maha - m) <= 3 * sd}


def residual_diag(em: Emulator, df: DataFrame, limit: float = 3.0) -> DataFrame:
    """Points whose regression residual is over ``limit`` residual deviations."""
    _real(em, "residual_diag")
    from .score import prior_mean

    sd = em.residual_sd if math.isfinite(em.residual_sd) else em.multiplier * em.sigma
    return df.withColumn("residual", (F.col(em.name) - prior_mean(em)) / F.lit(float(sd))).filter(F.abs("residual") > limit)


def pivoted_cholesky(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor L, order) with c[order][:, order] = L L', largest variance first."""
    a, n = c.astype(float).copy(), len(c)
    order, f = np.arange(n), np.zeros((n, n))
    d = np.diag(a).copy()
    for k in range(n):
        p = k + int(np.argmax(d[k:]))
        if d[p] <= 1e-14:
            break
        for v in (order, d):
            v[[k, p]] = v[[p, k]]
        f[[k, p]] = f[[p, k]]
        f[k, k] = math.sqrt(d[k])
        rest = slice(k + 1, n)
        f[rest, k] = (a[order[k], order[rest]] - f[rest, :k] @ f[k, :k]) / f[k, k]
        d[rest] -= f[rest, k] ** 2
    return f, order


def individual_errors(em: Emulator, validation: pd.DataFrame, errtype: str = "normal") -> pd.DataFrame:
    """Standardised errors: normal, eigen, chol or cholpivot."""
    _real(em, "individual_errors")
    _few(validation)
    x, y = validation[em.inputs].to_numpy(float), validation[em.name].to_numpy(float)
    c = em.get_cov(x) + 1e-12 * np.eye(len(x))
    r = y - em.get_exp(x)
    order = np.arange(len(x))
    if errtype == "normal":
        err = r / np.sqrt(np.diag(c))
    elif errtype == "eigen":
        val, vec = np.linalg.eigh(c)
        keep = np.argsort(-val)
        err = (vec.T @ r)[keep] / np.sqrt(np.maximum(val[keep], 1e-12))
    elif errtype == "chol":
        err = np.linalg.solve(np.linalg.cholesky(c), r)
    elif errtype == "cholpivot":
        f, order = pivoted_cholesky(c)
        err = np.linalg.lstsq(f, r[order], rcond=None)[0]
    else:
        raise ValueError("errtype is normal, eigen, chol or cholpivot")
    return pd.DataFrame({"point": order, "error": err})


def k_fold_measure(em: Emulator, k: int = 1, spark=None) -> pd.DataFrame:
    """Predictions of left-out blocks of ``k`` training points (of one, if k does not divide their number), all refits in parallel."""
    _real(em, "k_fold_measure")
    n = len(em.x)
    if n % k:
        warnings.warn("k does not divide the number of points: one is left out at a time", stacklevel=2)
        k = 1
    from dataclasses import replace

    def one(b: int) -> list[tuple[int, float, float, float]]:
        out = np.arange(b * k, (b + 1) * k)
        rest = np.setdiff1d(np.arange(n), out)
        extra = None if em.extra is None else em.extra[rest]
        fit = replace(em, x=em.x[rest], y=em.y[rest], extra=extra) if not isinstance(em, HierarchicalEmulator) else replace(em, x=em.x[rest], y=em.y[rest], samples=None if em.samples is None else em.samples[rest], extra=None)
        e, v = fit.moments(em.x[out])
        return [(int(i), float(em.y[i]), float(a), float(b)) for i, a, b in zip(out, e, v, strict=True)]

    cols = ["point", "y", "e", "v"]
    if spark is None:
        return pd.DataFrame([r for b in range(n // k) for r in one(b)], columns=cols)

    def run(parts):
        for pdf in parts:
            rows = [r for b in pdf["id"] for r in one(int(b))]
            yield pd.DataFrame(rows, columns=cols)

    return spark.range(n // k).mapInPandas(run, "point long, y double, e double, v double").orderBy("point").toPandas()


def space_removal(spark, ems, z: dict, points: DataFrame | None = None, ppd: int = 10, cutoff: float = 3.0, individual: bool = True) -> DataFrame:
    """The share of points ruled out, by output or by all together."""
    s = EmulatorSet.of(ems)
    if points is None:
        points = grid_or_uniform(spark, s.ranges(), ppd)
    if individual:
        raw = nth_implausible(points, s, z, cutoff=cutoff, get_raw=True)
        outs = [c for c in raw.columns if c not in points.columns]
        return raw.agg(*((1 - F.avg(F.col(o).cast("double"))).alias(o) for o in outs)).unpivot([], outs, "output", "removed")
    return nth_implausible(points, s, z, cutoff=cutoff).agg((1 - F.avg(F.col("I").cast("double"))).alias("removed"))


def space_removed(spark, ems, z: dict, ppd: int = 10, u_mod: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2), cutoffs: tuple[float, ...] = tuple(np.arange(0.5, 5.01, 0.5)), modified: str = "obs", max_points: int = 50_000) -> DataFrame:
    """(u_mod, cutoff, removed): with observation errors, variances, hyper-parameters or discrepancies scaled; one pass for each scale."""
    from dataclasses import replace

    s = EmulatorSet.of(ems)
    pts = grid_or_uniform(spark, s.ranges(), ppd, max_points)
    out = None
    for u in u_mod:
        es, ts = s, targets(z)
        if modified == "obs":
            ts = {k: replace(t, sigma=t.sigma * u) if not t.interval else Target(lo=t.centre - u * (t.hi - t.lo) / 2, hi=t.centre + u * (t.hi - t.lo) / 2) for k, t in ts.items()}
        elif modified == "var":
            es = replace(s, members=tuple(replace(m, em=m.em.mult_sigma(math.sqrt(u))) for m in s.members))
        elif modified == "hp":
            es = replace(s, members=tuple(replace(m, em=m.em.set_hyperparams(**(m.em.corr.params | {"theta": m.em.corr.params["theta"] * u}))) for m in s.members))
        elif modified == "disc":
            es = replace(s, members=tuple(replace(m, em=replace(m.em, disc=tuple(x * u for x in m.em.disc))) for m in s.members))
        else:
            raise ValueError("modified is obs, var, hp or disc")
        d = nth_implausible(pts, es, ts)
        row = d.agg(*((F.avg((F.col("I") > float(c)).cast("double"))).alias(f"c{i}") for i, c in enumerate(cutoffs)))
        long = row.select(F.explode(F.array(*(F.struct(F.lit(float(u)).alias("u_mod"), F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("removed")) for i, c in enumerate(cutoffs)))).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def points_of_concern(ems, z: dict, validation: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Points that an emulator wrongly rules out and the others do not."""
    s = EmulatorSet.of(ems)
    out = None
    for m in s.members:
        bad = classification_diag(m.em, targets(z)[m.output], validation).select(*m.em.inputs).distinct()
        rest = s.subset([o for o in s.outputs if o != m.output])
        if rest.members:
            bad = nth_implausible(bad, rest, z, 1).filter(F.col("I") < cutoff).drop("I")
        out = bad if out is None else out.unionByName(bad)
    return out.distinct()


def binomial_diagnostic_test(n_failed: int, n: int) -> bool:
    """Whether the failures are within three deviations of what a 4/(9*9) tail bound allows."""
    p = 4 / (9 * 3.0**2)
    return n_failed <= n * p + 3 * math.sqrt(n * p * (1 - p))


def structured_error_check(df: DataFrame, failed: Column, predictors: list[str], limit: float = 0.3, together: bool = False) -> list[str]:
    """Predictors that explain failures (adjusted R squared above ``limit``): each by itself, or all ``together``."""
    if together:
        return list(predictors) if structured_error_all(df, failed, predictors)[2] > limit else []
    found = []
    for p in predictors:
        r = structured_error(df, failed, p).first()
        if r.adj_r2 is not None and r.adj_r2 > limit:
            found.append(p)
    return found


def effect_strength(ems, quadratic: bool = False) -> pd.DataFrame:
    """Linear effects (f(+1) - f(-1))/2, or quadratic ones, of each input on the regression surface, to 6 places."""
    rows = []
    for m in EmulatorSet.of(ems).members:
        _real(m.em, "effect_strength")
        f = lambda x, em=m.em: float((em.basis.values(np.atleast_2d(x)) @ em.beta_mu)[0])
        d = len(m.em.inputs)
        row = {"output": m.output}
        for i, n in enumerate(m.em.inputs):
            e = np.eye(d)[i]
            row[n] = round((f(e) + f(-e) - 2 * f(0 * e)) / 2 if quadratic else (f(e) - f(-e)) / 2, 6)
        rows.append(row)
    return pd.DataFrame(rows)


def validation_pairs(ems, points: DataFrame, z: dict, nth: int = 1) -> DataFrame:
    """For each run the largest standardised error and the n-th implausibility."""
    s = EmulatorSet.of(ems)
    d = score(points, s)
    errs = [F.abs(F.col(m.output) - F.col(f"{m.output}_exp")) / F.sqrt(F.greatest(F.col(f"{m.output}_var") + F.lit(sum(x * x for x in m.em.disc)), F.lit(1e-12))) for m in s.members]
    d = d.withColumn("max_error", F.greatest(*errs) if len(errs) > 1 else errs[0])
    return nth_implausible(d, s, z, nth).drop(*(f"{m.output}_{k}" for m in s.members for k in ("exp", "var")))


def diagnostic_pass(ems: dict[str, Emulator], z: dict, validation: DataFrame, max_rounds: int = 20, share: float = 0.05, retrain: Callable | None = None, resamples: int = 5, seed: int = 0) -> dict[str, Emulator]:
    """Repair: outputs that never come near their target go; theta shrinks to a third at most; sigma grows until ce and cd are clear.

    Where too many points still fail with the least theta, an emulator is
    trained anew by ``retrain(output, training rows)`` on other halves of all
    runs, its own and those for validation, ``resamples`` times at most.
    """
    from ..functions.scalar import scale_array
    from ..sources.generators import halves

    ts, out = targets(z), {}
    validation = validation.cache()
    n = validation.count()
    for o, em in ems.items():
        seen = validation.agg(F.max(ts[o].hit(F.col(o), 6.0).cast("int")).alias("h")).first().h
        if not seen:
            warnings.warn(f"{o} never comes near its target and is left out", stacklevel=2)
            continue
        held, m = validation, n

        def poor(e, held=held, o=o):
            return comparison_diag(e, ts[o], held).count()

        def shrunk(e, poor=poor, m=m):
            theta0 = e.corr.params["theta"]
            while poor(e) > share * m and np.min(e.corr.params["theta"]) > np.min(theta0) / 3 * 1.05:
                e = e.set_hyperparams(**(e.corr.params | {"theta": e.corr.params["theta"] * 0.9}))
            return e

        em = shrunk(em)
        if retrain is not None and em.x is not None and poor(em) > share * n:
            own = scale_array(em.x, em.ranges, forward=False)
            rows = validation.sparkSession.createDataFrame(pd.DataFrame({**{c: own[:, i] for i, c in enumerate(em.inputs)}, o: em.y}))
            every = validation.select(*em.inputs, o).unionByName(rows)
            for k in range(resamples):
                a, held = halves(every, len(em.x) / (len(em.x) + n), seed + k + 1)
                m = max(1, held.count())
                em = shrunk(retrain(o, a), lambda e, held=held, o=o: comparison_diag(e, ts[o], held).count(), m)
                if comparison_diag(em, ts[o], held).count() <= share * m:
                    break
        for _ in range(max_rounds):
            if classification_diag(em, ts[o], held).isEmpty() and binomial_diagnostic_test(comparison_diag(em, ts[o], held).count(), m):
                break
            em = em.mult_sigma(1.1)
        out[o] = em
    validation.unpersist()
    return out


def full_wave(spark, data: DataFrame, ranges, z: dict, old=None, prop_train: float = 0.7, cutoff: float = 3.0, n_points: int | None = None, max_inflations: int = 30, drop_above: float = 0.25, opts=None, seed: int = 0, **options) -> dict:
    """A whole wave: split, train, drop poor emulators, inflate sigma until nothing is misclassified, propose."""
    from ..plans.collections import collect_emulators
    from ..plans.targets import convert_ranges
    from ..sources.generators import halves
    from .design import Options, generate_new_design
    from .stats import preflight
    from .train import train

    ranges, ts = convert_ranges(ranges), targets(z)
    checked = preflight(data, ts)
    if checked["missed"]:
        warnings.warn(f"never hit: {checked['missed']}", stacklevel=2)
    a, b = halves(data, prop_train, seed)
    ems = train(a, list(ts), ranges, **options)
    b = b.cache()
    n = max(1, b.count())
    good = {}
    for o, em in ems.items():
        if comparison_diag(em, ts[o], b).count() > drop_above * n:
            continue
        for _ in range(max_inflations):
            if failing(get_diagnostic(em, b, "ce", ts[o]), "ce", ts[o], cutoff).isEmpty():
                break
            em = em.mult_sigma(1.1)
        good[o] = em
    b.unpersist()
    if not good:
        raise ValueError("no emulator passes its diagnostics")
    every = collect_emulators([list(good.values()), *([old] if old else [])], z, cutoff)
    d = generate_new_design(spark, every, n_points or 10 * len(ranges) * 3, {o: ts[o] for o in {m.output for m in every.members}}, cutoff=cutoff, opts=opts or Options(seed=seed))
    return {"points": d.points, "emulators": good, "cutoff": d.cutoff, "design": d}

