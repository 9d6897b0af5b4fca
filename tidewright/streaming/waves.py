"""Structured Streaming over arriving runs: scoring under fixed emulators, windowed hit rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.score import nth_implausible
from ..plans.targets import targets


def score_stream(stream: DataFrame, ems, z: dict, cutoff: float | None = None) -> DataFrame:
    """The implausibility of arriving points: stateless, one pass, no shuffle."""
    return nth_implausible(stream, ems, z, cutoff=cutoff, sequential=False)


def hit_rates(stream: DataFrame, z: dict, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Hit rates of each output by time window; runs later than ``late`` are left out."""
    cols = [F.avg(t.hit(F.col(o)).cast("double")).alias(f"rate_{o}") for o, t in targets(z).items()]
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), *cols).select(F.col("window.start").alias("start"), "n", *(f"rate_{o}" for o in z))


def each_wave(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``handle`` on every batch of arriving runs (a wave)."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
