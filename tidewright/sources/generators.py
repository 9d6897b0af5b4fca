"""Generated tables of candidate points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.targets import Ranges

MAX_GRID = 50_000


def grid(spark: SparkSession, ranges: Ranges, ppd: int, fixed: dict[str, float] | None = None) -> DataFrame:
    """The cartesian grid of ``ppd`` values in each range, by digits of the row number: no join, no shuffle."""
    fixed = fixed or {}
    free = [n for n in ranges if n not in fixed]
    cols = []
    for n, (lo, hi) in ranges.items():
        if n in fixed:
            cols.append(F.lit(float(fixed[n])).alias(n))
            continue
        k = free.index(n)
        digit = F.floor(F.col("point_id") / (ppd**k)) % ppd
        cols.append((F.lit(lo) + digit * F.lit((hi - lo) / max(1, ppd - 1))).cast("double").alias(n))
    return spark.range(ppd ** len(free)).withColumnRenamed("id", "point_id").select("point_id", *cols)


def uniform(spark: SparkSession, ranges: Ranges, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "point_id").select("point_id", *((F.lit(lo) + F.rand(seed + k) * F.lit(hi - lo)).alias(name) for k, (name, (lo, hi)) in enumerate(ranges.items())))


def grid_or_uniform(spark: SparkSession, ranges: Ranges, ppd: int, max_points: int = MAX_GRID, seed: int = 0) -> DataFrame:
    """The grid, or ``max_points`` random points where the grid would have more."""
    return grid(spark, ranges, ppd) if ppd ** len(ranges) <= max_points else uniform(spark, ranges, max_points, seed)


def lhs_array(n: int, ranges: Ranges, rng: np.random.Generator) -> np.ndarray:
    """A random Latin hypercube on the driver."""
    u = np.stack([(rng.permutation(n) + rng.random(n)) / n for _ in ranges], axis=1) if n else np.empty((0, len(ranges)))
    lo, hi = (np.array([r[i] for r in ranges.values()]) for i in (0, 1))
    return lo + u * (hi - lo)


def lhs(spark: SparkSession, ranges: Ranges, n: int, seed: int = 0) -> DataFrame:
    """A Latin hypercube of any size: each input's strata are dealt by a keyed permutation of the row numbers."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    cols = []
    for k, (name, (lo, hi)) in enumerate(ranges.items()):
        stratum = _permuted(F.col("point_id"), n, half, seed * 1009 + k)
        cols.append((F.lit(lo) + (stratum + F.rand(seed + k)) / n * F.lit(hi - lo)).alias(name))
    return spark.range(n).withColumnRenamed("id", "point_id").select("point_id", *cols)


def _permuted(x, n: int, half: int, key: int, rounds: int = 4):
    """A permutation of 0..n-1 as an expression: a Feistel network on 2 * half bits, walked until it lands below n."""
    mask = (1 << half) - 1

    def once(v):
        a, b = F.shiftright(v, half), v.bitwiseAND(F.lit(mask))
        for r in range(rounds):
            a, b = b, a.bitwiseXOR(F.xxhash64(b, F.lit(key), F.lit(r)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(a, half).bitwiseOR(b)

    # values at or above n go round again; a cycle that returns from below n needs few steps on average
    start = once(x.cast("long"))
    steps = F.sequence(F.lit(1), F.lit(64))
    return F.aggregate(steps, start, lambda v, _: F.when(v < n, v).otherwise(once(v)))


def lattice_lhs(spark: SparkSession, ranges: Ranges, n: int, generators: list[int]) -> DataFrame:
    """A rank-one lattice: stratum (g * i + k) mod n in dimension k; g coprime to n makes it a Latin hypercube."""
    cols = []
    for k, (name, (lo, hi)) in enumerate(ranges.items()):
        if math.gcd(generators[k], n) != 1:
            raise ValueError("a generator shares a factor with n")
        cols.append((F.lit(lo) + ((F.col("point_id") * generators[k] + k) % n + 0.5) / n * F.lit(hi - lo)).cast("double").alias(name))
    return spark.range(n).withColumnRenamed("id", "point_id").select("point_id", *cols)


def halves(df: DataFrame, share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the whole row."""
    h = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 20)) / float(1 << 20)
    return df.filter(h < share), df.filter(h >= share)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``point_id`` counted in an order, without one task for all: ranks within ranges plus their offsets."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    part = part.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).cache()
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return part.join(F.broadcast(before), "_p").withColumn("point_id", (F.col("_at") + F.col("_k")).cast("long")).drop("_p", "_k", "_at")
