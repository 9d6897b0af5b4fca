"""The data behind each plot, as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import logged, normalised
from ..plans.collections import EmulatorSet
from ..plans.targets import Ranges, targets
from ..sources.generators import grid, grid_or_uniform
from .score import nth_implausible, score
from .stats import wave_union

#: Upper edges of the colour bands of implausibility.
BREAKS = (0.3, 0.7, 1.0, 1.3, 1.7, 2.0, 2.3, 2.7, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0, float("inf"))


def band(c, breaks: tuple[float, ...] = BREAKS):
    """The index of the first break that a value does not exceed."""
    if len(breaks) != len(BREAKS) or any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)):
        raise ValueError(f"{len(BREAKS)} increasing breaks are needed")
    out = F.when(c <= breaks[0], 0)
    for i, b in enumerate(breaks[1:-1], 1):
        out = out.when(c <= b, i)
    return out.otherwise(len(breaks) - 1)


def emulator_plot(spark: SparkSession, ems, params: tuple[str, str], plot_type: str = "exp", z: dict | None = None, ppd: int = 30, fixed: dict[str, float] | None = None, nth: int | None = None) -> DataFrame:
    """A two-dimensional slice: exp, var, sd, imp (with bands) or nimp; other inputs at mid-range or fixed."""
    s = EmulatorSet.of(ems)
    ranges = s.ranges()
    rest = {n: (a + b) / 2 for n, (a, b) in ranges.items() if n not in params} | {k: v for k, v in (fixed or {}).items() if k not in params}
    g = grid(spark, ranges, ppd, rest)
    if plot_type in ("exp", "var", "sd"):
        d = score(g, s)
        outs = [c for c in d.columns if c.endswith("_exp" if plot_type == "exp" else "_var")]
        return d.select("point_id", *params, *((F.sqrt(c) if plot_type == "sd" else F.col(c)).alias(c.rsplit("_", 1)[0]) for c in outs))
    if plot_type == "imp":
        d = nth_implausible(g, s, z, get_raw=True)
        outs = [c for c in d.columns if c not in g.columns]
        long = d.select("point_id", *params, *outs).unpivot(["point_id", *params], outs, "output", "I")
        return long.withColumn("band", band(F.col("I")))
    if plot_type == "nimp":
        return nth_implausible(g, s, z, nth).select("point_id", *params, "I", band(F.col("I")).alias("band"))
    raise ValueError("plot_type is exp, var, sd, imp or nimp")


def output_plot(ems, points: DataFrame, z: dict) -> DataFrame:
    """Predictions under one another, with the targets' bounds."""
    s = EmulatorSet.of(ems)
    names = list(s.ranges())
    d = score(points.select(*names).withColumn("run", F.monotonically_increasing_id()), s)
    outs = list(targets(z))
    long = d.select("run", *(F.col(f"{o}_exp").alias(o) for o in outs)).unpivot("run", outs, "output", "value")
    lo, hi = (F.create_map(*(F.lit(v) for o, t in targets(z).items() for v in (o, t.bounds()[k]))) for k in (0, 1))
    return long.withColumn("lower", lo[F.col("output")]).withColumn("upper", hi[F.col("output")])


def lattice_bins(df: DataFrame, ranges: Ranges, bins: int, names: tuple[str, ...]) -> DataFrame:
    """Bin numbers of inputs, ``b_<input>``: 0 .. bins-1, closed on both sides of the range."""
    cols = {}
    for n in names:
        lo, hi = ranges[n]
        cols[f"b_{n}"] = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(n) - F.lit(lo)) / F.lit((hi - lo) / bins)))).cast("int")
    return df.withColumns(cols)


def depth(df: DataFrame, keys: list[str], cutoff: float, imp: str = "I") -> DataFrame:
    """Least implausibility and optical depth (share not ruled out) of each bin."""
    return df.groupBy(*keys).agg(F.min(imp).alias("min_I"), F.avg((F.col(imp) <= cutoff).cast("double")).alias("depth"), F.count("*").alias("n"))


def plot_lattice(spark: SparkSession, ems, z: dict, ppd: int = 20, cutoff: float = 3.0, max_points: int = 50_000, bins: int | None = None) -> DataFrame:
    """(x, y, bin_x, bin_y, min_I, depth, n) for all inputs (y null) and pairs of inputs: scored once, then one aggregation by grouping sets."""
    s = EmulatorSet.of(ems)
    ranges = s.ranges()
    names = list(ranges)
    k = bins or ppd
    d = lattice_bins(nth_implausible(grid_or_uniform(spark, ranges, ppd, max_points), s, z), ranges, k, tuple(names))
    pairs = [(a, None) for a in names] + [(a, b) for i, a in enumerate(names) for b in names[:i]]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).cast("string").alias("y"), F.col(f"b_{a}").alias("bin_x"), (F.col(f"b_{b}") if b else F.lit(None).cast("int")).alias("bin_y")) for a, b in pairs))).alias("k")
    return depth(d.select("I", each).select("I", "k.*"), ["x", "y", "bin_x", "bin_y"], cutoff)


def plot_actives(spark: SparkSession, ems) -> DataFrame:
    rows = [(m.output, n, bool(a)) for m in EmulatorSet.of(ems).members for n, a in zip(m.em.inputs, m.em.active, strict=True)]
    return spark.createDataFrame(rows, "output string, input string, active boolean")


def plot_wrap(points: DataFrame, ranges: Ranges) -> DataFrame:
    """The points, and the two extreme corners of the ranges marked as frame."""
    spark = points.sparkSession
    names = list(ranges)
    ends = spark.createDataFrame([tuple(float(ranges[n][k]) for n in names) for k in (0, 1)], ", ".join(f"`{n}` double" for n in names))
    return points.select(*(F.col(n).cast("double").alias(n) for n in names)).withColumn("frame", F.lit(False)).unionByName(ends.withColumn("frame", F.lit(True)))


def behaviour_plot(points: DataFrame, inputs: list[str], outputs: list[str], z: dict | None = None, ems=None) -> DataFrame:
    """(input, x, output, y, lower, upper): runs, or predictions of emulators."""
    if ems is not None:
        d = score(points, ems)
        points = d.select(*inputs, *(F.col(f"{o}_exp").alias(o) for o in outputs))
    ts = targets(z or {})
    cast = [F.col(c).cast("double").alias(c) for c in [*inputs, *outputs]]
    long = points.select(*cast).unpivot(outputs, inputs, "input", "x").unpivot(["input", "x"], outputs, "output", "y")
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for o, t in ts.items():
        lo = F.when(F.col("output") == o, t.bounds()[0]).otherwise(lo)
        hi = F.when(F.col("output") == o, t.bounds()[1]).otherwise(hi)
    return long.withColumn("lower", lo).withColumn("upper", hi)


def wave_points(waves: list[DataFrame], inputs: list[str], zero_in: bool = True) -> DataFrame:
    return wave_union(waves, zero_in).select("wave", *inputs)


def wave_values(waves: list[DataFrame], z: dict, ems=None, restrict: bool = False, zero_in: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Outputs by wave (with the emulators' mean and deviation), and the pairs of outputs to show: all, or those never hit together."""
    ts = targets(z)
    d = wave_union(waves, zero_in)
    if ems is not None:
        s = EmulatorSet.of(ems)
        d = score(d, s)
        d = d.withColumns({f"{m.output}_sd": F.sqrt(f"{m.output}_var") for m in s.members})
    outs = list(ts)
    pairs = [(a, b) for i, a in enumerate(outs) for b in outs[i + 1 :]]
    if restrict and pairs:
        r = d.agg(*(F.max((ts[a].hit(F.col(a)) & ts[b].hit(F.col(b))).cast("int")).alias(str(i)) for i, (a, b) in enumerate(pairs))).first()
        pairs = [p for i, p in enumerate(pairs) if not r[str(i)]]
    return d, pairs


def wave_dependencies(waves: list[DataFrame], inputs: list[str], outputs: list[str], zero_in: bool = True) -> DataFrame:
    """(wave, input, x, output, y)."""
    d = wave_union(waves, zero_in).select("wave", *(F.col(c).cast("double").alias(c) for c in [*inputs, *outputs]))
    return d.unpivot(["wave", *outputs], inputs, "input", "x").unpivot(["wave", "input", "x"], outputs, "output", "y")


def simulator_plot(waves: list[DataFrame], z: dict, normalise: bool = False, log: bool = False, by_hit: bool = False, zero_in: bool = True) -> DataFrame:
    """(wave, run, output, value, hits): outputs under one another, on the log scale and scaled to their targets if asked."""
    ts = targets(z)
    d = wave_union(waves, zero_in).withColumn("run", F.monotonically_increasing_id())
    d = d.withColumn("hits", sum((t.hit(F.col(o)).cast("int") for o, t in ts.items()), F.lit(0)))
    cols = []
    for o, t in ts.items():
        c, (lo, hi) = F.col(o).cast("double"), t.bounds()
        if log:
            c, lo, hi = logged(c), float(np.log(max(lo, 1e-4))), float(np.log(max(hi, 1e-4)))
        cols.append((normalised(c, lo, hi) if normalise else c).alias(o))
    keys = ["wave", "run"] + (["hits"] if by_hit else [])
    return d.select(*keys, *cols).unpivot(keys, list(ts), "output", "value")


def diagnostic_wrap(waves: list[DataFrame], z: dict, inputs: list[str], zero_in: bool = True) -> dict[str, DataFrame]:
    """All of the tables by wave."""
    from .stats import hit_by_wave

    return {
        "points": wave_points(waves, inputs, zero_in),
        "values": wave_values(waves, z, zero_in=zero_in)[0],
        "dependencies": wave_dependencies(waves, inputs, list(targets(z)), zero_in),
        "simulator": simulator_plot(waves, z, zero_in=zero_in),
        "hits": hit_by_wave(wave_union(waves, zero_in), z, inputs),
    }
