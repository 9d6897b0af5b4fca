"""Statistics of replicated runs: grouped moments, hits, preflight, principal variables.

Every statistic is one or two aggregations with partial sums before the
shuffle; groups are the distinct input points, compared by value.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import kurtosis_column
from ..plans.targets import Ranges, targets


def corr(a, b) -> Column:
    """The correlation as an aggregate; null where one side does not vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def in_range(ranges: Ranges) -> Column:
    """Closed box test."""
    out = F.lit(True)
    for n, (lo, hi) in ranges.items():
        out = out & F.col(n).between(F.lit(lo), F.lit(hi))
    return out


def shrink_ranges(df: DataFrame, ranges: Ranges, slack: float = 0.05) -> Ranges:
    """Each range cut to the data's range widened by ``slack`` of it on both sides."""
    r = df.agg(*(f(n).alias(f"{n}_{k}") for n in ranges for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for n, (lo, hi) in ranges.items():
        a, b = float(r[f"{n}_lo"]), float(r[f"{n}_hi"])
        w = slack * (b - a)
        out[n] = (max(lo, a - w), min(hi, b + w))
    return out


def replicates(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Per point: n, and for each output mean, variance, deviation, kurtosis and the variance of the sample variance."""
    aggs = [F.count("*").alias("n")]
    for o in outputs:
        aggs += [F.avg(o).alias(f"{o}_mean"), F.var_samp(o).alias(f"{o}_var"), F.stddev_samp(o).alias(f"{o}_sd"), (F.kurtosis(o) + 3).alias(f"{o}_kurt")]
    out = df.groupBy(*inputs).agg(*aggs)
    for o in outputs:
        vov = vofv(F.col(f"{o}_var"), F.col(f"{o}_kurt"), F.col("n"))
        out = out.withColumn(f"{o}_vofv", vov).withColumn(f"{o}_kurt_kept", F.when(F.try_divide(vov, F.col(f"{o}_var") * F.col(f"{o}_var")) <= 1, F.col(f"{o}_kurt")))
    return out


def vofv(var: Column, kurt: Column, n: Column) -> Column:
    """s^4 (kurtosis - 1 + 2/(n-1)) / n."""
    return F.when(n > 1, var * var * (kurt - 1 + F.try_divide(F.lit(2.0), n - 1)) / n)


def mean_kurtosis(stats: DataFrame, outputs: list[str]) -> DataFrame:
    """Per output the mean of kept kurtoses; 3 where their sum is below 2."""
    cols = [F.when(F.sum(f"{o}_kurt_kept") < 2, 3.0).otherwise(F.coalesce(F.avg(f"{o}_kurt_kept"), F.lit(3.0))).alias(o) for o in outputs]
    return stats.agg(*cols)


def collapse(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """One row for each point: means of the outputs, and the mean of the replicate variances as ``<output>_rep``."""
    per = df.groupBy(*inputs).agg(*(F.avg(o).alias(o) for o in outputs), *(F.var_samp(o).alias(f"_{o}") for o in outputs))
    mean = per.agg(*(F.avg(f"_{o}").alias(f"{o}_rep") for o in outputs))
    return per.select(*inputs, *outputs).crossJoin(F.broadcast(mean))  # one row


def clean_data(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Per point with n > 1: the mean, its variance s^2/n, and n."""
    return df.groupBy(*inputs).agg(F.avg(output).alias("mean"), (F.var_samp(output) / F.count(output)).alias("var"), F.count(output).alias("n")).filter("n > 1")


def clean_data_variance(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Per point with n > 1: the sample variance, the variance of it over bootstrap samples, and n.

    Resamples draw n values from the point's own: the variance of their sample
    variance is (m4 - (n - 3) / (n - 1) * m2^2) / n with m2 and m4 the point's
    central moments, which is what ever more resamples tend to.
    """
    m2 = F.var_pop(output)
    per = df.groupBy(*inputs).agg(F.var_samp(output).alias("mean"), m2.alias("m2"), (kurtosis_column(output) * m2 * m2).alias("m4"), F.count(output).alias("n")).filter("n > 1")
    var = (F.coalesce(F.nanvl("m4", F.lit(0.0)), F.lit(0.0)) - (F.col("n") - 3) / (F.col("n") - 1) * F.col("m2") * F.col("m2")) / F.col("n")
    return per.select(*inputs, "mean", F.greatest(var, F.lit(0.0)).alias("var"), "n")


def covariances(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Per point the covariances of output pairs, ``<a>_<b>``."""
    pairs = list(itertools.combinations_with_replacement(outputs, 2))
    return df.groupBy(*inputs).agg(F.count("*").alias("n"), *((F.var_samp(a) if a == b else F.covar_samp(a, b)).alias(f"{a}_{b}") for a, b in pairs))


def split_name(name: str) -> tuple[str, int | None]:
    """``I10`` -> (I, 10); without trailing digits there is no time."""
    m = re.match(r"(.*\D)(\d+)\Z", name)
    return (m.group(1), int(m.group(2))) if m else (name, None)


def partition_by_output(names: list[str], by_time: bool = True) -> dict:
    """Outputs by time, or by label."""
    out: dict = {}
    for n in names:
        lab, t = split_name(n)
        out.setdefault(t if by_time else lab, []).append(n)
    return out


def rho_estimate(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """(a, b, rho): over times, the mean of the correlations over points between replicate variances of two labels."""
    per = df.groupBy(*inputs).agg(*(F.var_samp(o).alias(o) for o in outputs))
    by_time = partition_by_output(outputs)
    cols, names = [], []
    for own in by_time.values():
        for a, b in itertools.combinations(own, 2):
            cols.append(corr(a, b).alias(f"{len(cols)}"))
            names.append((split_name(a)[0], split_name(b)[0]))
    if not cols:
        return df.sparkSession.createDataFrame([], "a string, b string, rho double")
    wide = per.agg(*cols)
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(names)))).alias("x")
    return wide.select(rows).select("x.*").groupBy("a", "b").agg(F.avg("r").alias("rho"))


def theta_estimate(cor: np.ndarray, times: list[float], rho: float = 1.0) -> float:
    """Mean over time pairs of sqrt(-dt^2 / ln(cor / rho)); pairs without a real value are left out."""
    got = []
    for i, j in itertools.combinations(range(len(times)), 2):
        r = cor[i, j] / rho
        if 0 < r < 1:
            got.append(np.sqrt(-((times[i] - times[j]) ** 2) / np.log(r)))
    return float(np.mean(got)) if got else float("nan")


# ------------------------------------------------------------------ hits


def hits(df: DataFrame, z: dict, n_sigma: float = 3.0, prefix: str = "hit_") -> DataFrame:
    return df.withColumns({f"{prefix}{o}": t.hit(F.col(o), n_sigma).cast("int") for o, t in targets(z).items()})


def overlap_hits(df: DataFrame, inputs: list[str], z: dict, n_sigma: float = 3.0) -> DataFrame:
    """Per point and output: do mean +- n_sigma * sd/sqrt(reps) and the target overlap."""
    ts = targets(z)
    per = df.groupBy(*inputs).agg(*(F.avg(o).alias(f"_m{o}") for o in ts), *((F.coalesce(F.stddev_samp(o), F.lit(0.0)) / F.sqrt(F.count(o))).alias(f"_s{o}") for o in ts))
    cols = []
    for o, t in ts.items():
        lo, hi = t.bounds(n_sigma)
        half = F.lit(n_sigma) * F.col(f"_s{o}")
        cols.append(((F.col(f"_m{o}") - half <= F.lit(hi)) & (F.col(f"_m{o}") + half >= F.lit(lo))).cast("int").alias(f"hit_{o}"))
    return per.select(*inputs, *cols)


#: Indicators in one packed word.
WORD_BITS = 62


def joint_counts(df: DataFrame, indicators: list[str], most: int = 3) -> tuple[int, dict[frozenset, int]]:
    """(rows, counts): in how many rows all of a set of 0/1 columns are 1, for every set of up to ``most`` (at most three).

    Rows are folded to packed words of their indicators and counted; each task
    adds up the sets of its words by matrix products, so that what is shuffled
    is a number for each set and task.
    """
    k = len(indicators)
    words = []
    for at in range(0, k, WORD_BITS):
        part = [F.shiftleft(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), i) for i, c in enumerate(indicators[at : at + WORD_BITS])]
        word = part[0]
        for p in part[1:]:
            word = word.bitwiseOR(p)
        words.append(word.alias(f"w{at // WORD_BITS}"))
    packed = df.select(*words)
    packed = packed.groupBy(*packed.columns).agg(F.count(F.lit(1)).alias("n"))

    def run(parts):
        import pandas as pd

        total = np.zeros((k + 1, k + 1, k + 1))  # index k: no column
        for pdf in parts:
            w = pdf.iloc[:, :-1].to_numpy(np.int64)
            bits = np.ones((len(pdf), k + 1))
            for i in range(k):
                bits[:, i] = (w[:, i // WORD_BITS] >> (i % WORD_BITS)) & 1
            n = pdf["n"].to_numpy(float)
            for c in range(k + 1) if most > 2 else [k]:
                total[c] += (bits * (n * bits[:, c])[:, None]).T @ bits
        rows = [(a, b, c, int(total[c, a, b])) for c in (range(k + 1) if most > 2 else [k]) for a in range(k + 1) for b in range(k + 1) if (a < b or a == b == k) and (b < c or c == b == k or c == k) and total[c, a, b]]
        yield pd.DataFrame(rows, columns=["a", "b", "c", "n"])

    got = packed.mapInPandas(run, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()
    by = {frozenset(indicators[i] for i in (r.a, r.b, r.c) if i < k): r.n for r in got}
    return by.pop(frozenset(), 0), by


def preflight(df: DataFrame, z: dict, threshold: float = 0.95) -> dict:
    """Which outputs never hit (and whether from below or above), and strongly correlated hit indicators.

    Two aggregations, whatever the number of outputs; rows with a null output are left out.
    """
    ts = targets(z)
    d = hits(df.dropna(subset=list(ts)), ts)
    outs = list(ts)
    pairs = list(itertools.combinations(outs, 2))
    triples = [(a, b, c) for a, b in pairs for c in outs if c not in (a, b)]
    r = d.agg(*(F.min(o).alias(f"lo_{o}") for o in outs), *(F.max(o).alias(f"hi_{o}") for o in outs)).first()
    n, found = joint_counts(d, [f"hit_{o}" for o in outs])
    joint = lambda s: found.get(frozenset(f"hit_{o}" for o in s), 0)

    def correlation(a: set, b: set) -> float | None:
        x, y, both = joint(a), joint(b), joint(a | b)
        spread = x * (n - x) * y * (n - y)
        return (n * both - x * y) / spread**0.5 if spread else None

    missed = {}
    for o, t in ts.items():
        if not joint({o}):
            lo, hi = t.bounds(3.0)
            missed[o] = "under" if r[f"hi_{o}"] is not None and r[f"hi_{o}"] < lo else "over" if r[f"lo_{o}"] is not None and r[f"lo_{o}"] > hi else "straddles"
    strong = lambda xs: [(*x, v) for x in xs if (v := correlation(set(x[:-1]), {x[-1]})) is not None and abs(v) > threshold]
    return {"missed": missed, "pairs": strong(pairs), "triples": strong(triples), "ok": not missed}


def prin_vars(df: DataFrame, outputs: list[str], max_vars: int | None = None, var_cut: float = 0.95) -> list[tuple[str, float]]:
    """Principal variables by the largest sum of squares of what the chosen ones leave of the correlations; (name, cumulated share of variance)."""
    pairs = list(itertools.combinations(outputs, 2))
    r = df.agg(*(corr(a, b).alias(str(i)) for i, (a, b) in enumerate(pairs))).first() if pairs else {}
    n = len(outputs)
    c = np.eye(n)
    for i, (a, b) in enumerate(pairs):
        j, k = outputs.index(a), outputs.index(b)
        c[j, k] = c[k, j] = r[str(i)] or 0.0
    out, left, v = [], list(range(n)), c.copy()
    while left and len(out) < (max_vars or n):
        sub = v[np.ix_(left, left)]
        best = left[int(np.argmax((sub**2).sum(1)))]
        if v[best, best] < 1e-10:
            break
        v = v - np.outer(v[:, best], v[best, :]) / v[best, best]
        left.remove(best)
        share = 1 - float(np.trace(v)) / n
        out.append((outputs[best], share))
        if share >= var_cut:
            break
    return out


# ------------------------------------------------------------------ waves


def wave_union(waves: list[DataFrame], zero_in: bool = True) -> DataFrame:
    """Waves under one another, with their number from 0 (or 1)."""
    out = None
    for k, w in enumerate(waves):
        w = w.withColumn("wave", F.lit(k + (0 if zero_in else 1)))
        out = w if out is None else out.unionByName(w, allowMissingColumns=True)
    return out


def hit_by_wave(runs: DataFrame, z: dict, inputs: list[str], measure: str = "real", n_sigma: float = 3.0, by_hit: bool = True, as_percent: bool = False) -> DataFrame:
    """Hits by wave: (wave, hits, count), or with ``by_hit=False`` (wave, output, count).

    ``real`` counts runs, ``mean`` points by their means, ``stoch`` points whose
    mean +- sd/sqrt(n) overlaps the target; shares are of the units counted.
    """
    ts = targets(z)
    keys = ["wave", *inputs]
    if measure == "real":
        d = hits(runs, ts, n_sigma)
    elif measure == "mean":
        d = hits(runs.groupBy(*keys).agg(*(F.avg(o).alias(o) for o in ts)), ts, n_sigma)
    elif measure == "stoch":
        d = overlap_hits(runs, keys, ts, n_sigma)
    else:
        raise ValueError("measure is real, mean or stoch")
    if by_hit:
        total = sum((F.col(f"hit_{o}") for o in ts), F.lit(0))
        out = d.groupBy("wave", total.alias("hits")).agg(F.count("*").alias("count"))
    else:
        wide = d.groupBy("wave").agg(F.count("*").alias("_n"), *(F.sum(f"hit_{o}").alias(o) for o in ts))
        out = wide.unpivot(["wave", "_n"], list(ts), "output", "count")
    if as_percent:
        n = F.sum("count").over(Window.partitionBy("wave")) if by_hit else F.col("_n")
        from ..functions.scalar import significant

        out = out.withColumn("count", significant(F.col("count") / n, 2) * 100)
    return out.drop("_n")


def structured_error(df: DataFrame, failed: Column, predictor: str) -> DataFrame:
    """R squared and its adjusted form of a failure indicator on one predictor."""
    r2 = F.regr_r2(failed.cast("double"), F.col(predictor).cast("double"))
    return df.agg(r2.alias("r2"), F.count("*").alias("n")).select("n", "r2", (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adj_r2"))


def structured_error_all(df: DataFrame, failed: Column, predictors: list[str]) -> tuple[int, float, float]:
    """(n, R squared, adjusted R squared) of a failure indicator on all predictors together: one aggregation."""
    g = gram(df.dropna(subset=predictors), [F.lit(1.0), *(F.col(p) for p in predictors), failed.cast("double")])
    n, k = round(g[0, 0]), len(predictors)
    total = g[-1, -1] - g[0, -1] ** 2 / max(n, 1)
    if total <= 0 or n <= k + 1:
        return n, float("nan"), float("nan")
    rest = g[-1, -1] - g[:-1, -1] @ np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]
    r2 = 1 - rest / total
    return n, r2, 1 - (1 - r2) * (n - 1) / (n - k - 1)


def gram(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums of products of all pairs of columns: one aggregation, k (k + 1) / 2 numbers."""
    k = len(columns)
    d = df.select(*(c.cast("double").alias(f"g{i}") for i, c in enumerate(columns)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = d.agg(*(F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"s{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = r[f"s{i}_{j}"] or 0.0
    return out

