"""Longest lines and fuzzy groups against brute force, with nulls, copies, ties and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import clusters, lines


def cloud(kind: str, n: int = 160) -> np.ndarray:
    r = np.random.default_rng(3)
    if kind == "two clumps":
        return np.concatenate([r.normal(0, 0.01, (n // 2, 2)), r.normal(9, 0.01, (n // 2, 2))])
    if kind == "sphere":
        x = r.normal(size=(n, 4))
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lattice":
        return np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0), np.arange(1.0)), -1).reshape(-1, 3)
    return np.concatenate([r.normal(size=(n, 1)), [[40.0]]])


@pytest.mark.parametrize("kind", ["two clumps", "sphere", "lattice", "outlier"])
@pytest.mark.parametrize("k", [1, 30])
def test_longest_lines(spark, kind, k, monkeypatch):
    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(lines, "ROUNDS", 4)
    monkeypatch.setattr(lines, "SPLIT", 5)
    x = cloud(kind)
    names = [f"a{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000 + i, *map(float, v)) for i, v in enumerate(x[:9])] + [(2000, *[None] * len(names)), (2001, *[float("nan")] * len(names))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).withColumns({c: F.lit(1) for c in ("key", "cell", "x0", "part", "dist")})
    d = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        d += (x[:, None, c] - x[None, :, c]) ** 2
    d = np.sqrt(d)
    want = sorted((-d[i, j], i, j) for i in range(len(x)) for j in range(i))
    want = sorted((a, min(i, j), max(i, j)) for a, i, j in want)[:k]
    got = [(-r.dist, r.key, r.other) for r in lines.longest(df, names, k, "id").collect()]
    assert got == want


def test_few_points_and_many_lines(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 0.0), (4, 0.0, 1.0)], "id long, a double, b double")
    assert [(r.key, r.other, r.dist) for r in lines.longest(df, ["a", "b"], 9, "id").collect()] == [(1, 2, 5.0), (2, 4, np.sqrt(18.0)), (1, 4, 1.0)]
    for few in (df.limit(0), df.filter("id in (1, 3)")):
        assert lines.longest(few, ["a", "b"], 9, "id").collect() == []
        assert lines.along_longest(few, ["a", "b"], 9, 8, "id").collect() == []
    with pytest.raises(ValueError):
        lines.longest(df, ["a", "b"], 0, "id")
    walk = sorted((r.step, r.a, r.b) for r in lines.along_longest(df, ["a", "b"], 1, 8, "id").collect())
    assert walk[2] == (2, 0.0, 0.0) and walk[6] == (6, 3.0, 4.0) and len(walk) == 9


MIXED = [(i, float(i % 5) if i % 11 else None, float(i % 3) * 10 if i % 7 else float("nan"), "ab"[i % 2] if i % 9 else None, 4.0) for i in range(120)]


def brute(rows, k, m, steps):
    """Dense fuzzy c-means over scaled values and indicators, row by row."""
    num = np.array([[np.nan if v is None else v for v in (r[1], r[2], r[4])] for r in rows], float)
    width = np.nanmax(num, 0) - np.nanmin(num, 0)
    z = num[:, width > 0] / width[width > 0]
    lev = sorted({r[3] for r in rows if r[3] is not None})
    hot = np.array([[np.nan if r[3] is None else float(r[3] == v) for v in lev] for r in rows]) / np.sqrt(2)
    full, there = np.concatenate([z, hot], 1), (~np.isnan(z)).sum(1) + np.array([r[3] is not None for r in rows])
    seen = ~np.isnan(full)
    d2 = lambda c: np.where(seen, (full - c) ** 2, 0.0).sum(1) / there
    mean = lambda w: (np.where(seen, full, 0.0) * (w / there)[:, None]).sum(0) / (seen * (w / there)[:, None]).sum(0)
    middle, cs = mean(np.ones(len(rows))), []
    for _ in range(k):
        near = np.round(np.min([d2(c) for c in cs or [middle]], 0), 9)
        at = int(np.argmax(near))
        cs.append(np.where(seen[at], full[at], middle))
    def member():
        inv = np.array([np.maximum(d2(c), 1e-12) ** (-1 / (m - 1)) for c in cs])
        return inv / inv.sum(0)
    cost = []
    for _ in range(steps):
        u = member()
        cost.append(sum((v**m * d2(c)).sum() for v, c in zip(u, cs, strict=True)))
        cs = [mean(v**m) for v in u]
    return member().T, cost


@pytest.mark.parametrize(("k", "m"), [(1, 2.0), (2, 2.0), (3, 1.5)])
def test_groups_agree_with_a_dense_form(spark, k, m):
    df = spark.createDataFrame([*MIXED, (500, None, float("nan"), None, None)], "id long, a double, b double, c string, same double").withColumns({n: F.lit(7) for n in ("level", "z", "s", "_w0")})
    g = clusters.fuzzy_groups(df, ["a", "b", "same"], ["c"], k, "id", m=m, steps=6, tolerance=0.0)
    got = {r.id: r for r in g.assigned(df).collect()}
    some = [r for r in MIXED if r[0]]
    want, cost = brute(some, k, m, 6)
    assert got[0].u0 is None and len(want) == len(MIXED) - 1  # nothing but a column without spread
    for i, u in enumerate(want, start=1):
        assert [got[i][f"u{j}"] for j in range(k)] == pytest.approx(list(u), abs=1e-9)
        assert u[got[i].label] == pytest.approx(u.max(), abs=1e-9)
    assert got[500].label is None and got[500].u0 is None and got[500].z == 7
    assert g.objective == pytest.approx(cost[-1], rel=1e-9) and all(a >= b - 1e-12 for a, b in zip(cost, cost[1:], strict=False))


def test_groups_find_clear_ones_and_stop(spark):
    df = spark.createDataFrame([(i, (i % 2) * 100.0 + i % 10 / 10, "xy"[i % 2]) for i in range(200)] * 3, "id long, a double, c string")
    g = clusters.fuzzy_groups(df, ["a"], ["c"], 2, "id")
    assert g.assigned(df).groupBy("label").agg(F.count_distinct("c").alias("n"), F.count("*").alias("r")).orderBy("label").collect() == [(0, 1, 300), (1, 1, 300)]
    empty = clusters.fuzzy_groups(df.limit(0), ["a"], ["c"], 2, "id")
    assert empty.assigned(df.limit(0)).collect() == [] and empty.objective == 0.0
    with pytest.raises(ValueError, match="levels"):
        clusters.fuzzy_groups(spark.range(3000).withColumn("c", F.col("id").cast("string")), [], ["c"], 2, "id")
    with pytest.raises(ValueError):
        clusters.fuzzy_groups(df, [], [], 2, "id")
