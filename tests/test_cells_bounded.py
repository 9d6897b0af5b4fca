"""Cells and blocks: no task holds a dense cell or a whole label, thinning makes no table of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import queries as engine
from tidewright.operators import cells


def _points(spark, n, d=3, seed=0):
    x = np.random.default_rng(seed).normal(0, 0.1, (n, d))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"x{i} double" for i in range(d))), x


def test_dense_cells_go_to_parts_and_shares(spark, monkeypatch):
    df, x = _points(spark, 300)
    for k, v in (("SPLIT", 7), ("ASK", 11), ("ROWS", 500)):
        monkeypatch.setattr(cells, k, v)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = cells.pairs_within(df, ["x0", "x1", "x2"], 0.1, "k")
    assert {(r.key, r.other) for r in got.collect()} == {(i, j) for i, j in zip(*np.nonzero(dist <= 0.1)) if i < j}
    assert got.rdd.getNumPartitions() > 8
    np.fill_diagonal(dist, 9)
    assert {r.key: r.other for r in cells.nearest(df, ["x0", "x1", "x2"], "k").collect()} == dict(enumerate(dist.argmin(1).tolist()))


@pytest.mark.parametrize("d", [1, 2, 4])
def test_thinning_is_greedy_without_all_pairs(spark, monkeypatch, d):
    df, x = _points(spark, 250, d)
    rank = np.round(-(x**2).sum(1), 2)
    seen, near = [], cells._near
    monkeypatch.setattr(cells, "_near", lambda asking, *a, **k: seen.append(asking.count()) or near(asking, *a, **k))
    got = {r.key for r in cells.thinned(df.withColumn("r", F.round(-sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(d)), F.lit(0.0)), 2)), [f"x{i}" for i in range(d)], 0.15, "k", F.col("r")).collect()}
    want = []
    for i in sorted(range(len(x)), key=lambda i: (-rank[i], i)):
        if all(np.sqrt(((x[i] - x[j]) ** 2).sum()) > 0.15 for j in want):
            want.append(i)
    assert got == set(want)
    assert d > 2 or max(seen) < 100


def test_pairs_of_a_label_go_in_blocks(spark, sf, monkeypatch):
    of = lambda: engine.QUERIES["pairwise_dist"](spark, sf)
    want = sorted(map(tuple, of().collect()))
    monkeypatch.setattr(engine, "BLOCK", 9)
    got = of()
    assert got.rdd.getNumPartitions() > 100 and sorted(map(tuple, got.collect())) == want
