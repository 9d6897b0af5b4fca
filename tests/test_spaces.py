"""Cells, spreads, tiles, joint hits and joint refinement against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright import queries as engine
from tidewright.functions.kernels import Correlator
from tidewright.operators import cells, design, diagnostics, stats, tiles, train


@pytest.fixture(scope="module", params=[(1, 50), (2, 250), (4, 150)], ids=str)
def points(spark, request):
    """Points with copies, ties, far outliers and a row without inputs; (table, names, ids of distinct points, their places)."""
    d, n = request.param
    r = np.random.default_rng(d)
    x = np.round(r.normal(size=(n, d)), 1 if d < 3 else 2)
    x[:5] = 50 + r.random((5, d))
    x[6:9] = x[5]
    names = [f"a{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, x[i])) for i in range(n)] + [(n, *([None] * d)), (n + 1, *([float("nan")] * d))], "id long, " + ", ".join(f"{c} double" for c in names)).withColumns({c: F.lit(0) for c in ("key", "cell", "part", "x0", "dist")})
    first: dict = {}
    for i in range(n):
        first.setdefault(tuple(x[i]), i)
    ids = sorted(first.values())
    return df, names, ids, x


def apart(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("split", [7, 2000])
def test_pairs_and_nearest(points, split, monkeypatch):
    monkeypatch.setattr(cells, "SPLIT", split)
    df, names, ids, x = points
    d = apart(x[ids])
    for radius in (0.05, 0.3):
        got = [(r.key, r.other) for r in cells.pairs_within(df, names, radius, "id").collect()]
        assert sorted(got) == [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and d[i, j] <= radius]
    np.fill_diagonal(d, np.inf)
    got = {r.key: r for r in cells.nearest(df, names, "id").collect()}
    assert sorted(got) == ids and sum(r.copies for r in got.values()) == len(x)
    for i, k in enumerate(ids):
        assert got[k].dist == pytest.approx(d[i].min(), abs=1e-12) and got[k].other == min(b for j, b in enumerate(ids) if d[i, j] == d[i].min())


def test_thinning_is_greedy(points):
    df, names, ids, x = points
    d = apart(x[ids])
    kept = {r.key for r in cells.thinned(df, names, 0.5, "id", F.pmod(F.col("id") * 7, F.lit(20))).collect()}
    rank = {k: max(i * 7 % 20 for i in range(len(x)) if (x[i] == x[k]).all()) for k in ids}
    want: list = []
    for k in sorted(ids, key=lambda k: (-rank[k], k)):
        if all(d[ids.index(k), ids.index(w)] > 0.5 for w in want):
            want.append(k)
    assert kept == set(want)


def test_cover_counts(spark, points):
    df, names, _, x = points
    y = np.round(np.random.default_rng(9).normal(size=(40, len(names))), 1)
    ask = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, " + ", ".join(f"{c} double" for c in names))
    got = {r.id: r.cover for r in cells.counted_within(ask, names, df, 0.4, "id").collect()}
    assert got == {i: int((np.sqrt(((x - v) ** 2).sum(1)) <= 0.4).sum()) for i, v in enumerate(y)}


def test_empty_and_single(points):
    df, names, *_ = points
    for d in (df.limit(0), df.filter("id = 0")):
        n = d.count()
        assert cells.pairs_within(d, names, 0.1, "id").count() == 0 and cells.thinned(d, names, 0.1, "id", F.col("id")).count() == n
        assert [(r.other, r.dist) for r in cells.nearest(d, names, "id").collect()] == [(None, None)] * n


# ------------------------------------------------------------------ spreads


def test_maximin_reads_all_rows(spark, sf, monkeypatch):
    """Further apart than the best of a thousand random subsets, also where the table is dealt to groups; the same on each run."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    x = np.unique(p.toPandas().to_numpy(float), axis=0)
    z = (x - x.mean(0)) / x.std(0)
    best = design._least_distance(z[design.maximin(z, 12, 1000)])
    scaled = lambda d: (d.toPandas().to_numpy(float) - x.mean(0)) / x.std(0)
    whole = design.maximin_sample(p, 12, ["s", "r"], 200)
    assert design._least_distance(scaled(whole)) >= best and whole.join(p.distinct(), ["s", "r"], "left_semi").count() == 12
    monkeypatch.setattr(design, "GROUP_ROWS", 100)
    got = [design.maximin_sample(d, 12, ["s", "r"], 200).toPandas() for d in (p, p.repartition(7))]
    assert got[0].equals(got[1]) and design._least_distance((got[0].to_numpy() - x.mean(0)) / x.std(0)) >= best
    assert design.maximin_sample(p.limit(0), 5, ["s", "r"]).count() == 0 and design.farthest_points(p.limit(0), 5, ["s", "r"]).count() == 0


def test_exchanges_never_lose():
    r = np.random.default_rng(2)
    x = r.random((300, 3))
    for n in (2, 5, 20):
        start = design.farthest(x, n)
        assert design._least_distance(x[design.exchanged(x, start, 50)]) >= design._least_distance(x[start]) - 1e-12
    assert design.farthest(np.array([[0.0], [1.0], [1.0], [-1.0]]), 3).tolist() == [1, 3, 0]


# ------------------------------------------------------------------ tiles


@pytest.fixture(scope="module")
def runs(spark):
    r = np.random.default_rng(1)
    return spark.createDataFrame(pd.DataFrame({"id": range(70), "l_discount": r.random(70) * 0.1, "l_tax": r.random(70) * 0.08, "r": 10 + r.normal(size=70)}))


@pytest.mark.parametrize("trained", [False, True])
@pytest.mark.parametrize("tile", [16, 35, 512])
def test_blocked_factor(spark, runs, tile, trained):
    em = engine.EMS["r"] if trained else engine._em("r", lambda a, b: 0.0, [10.0, 0.0, 0.5], 1.0, Correlator.of("rat_quad", nugget=0.05, theta=0.7, alpha=1.5), trained=False)
    pdf = runs.toPandas().sort_values("id")
    got = tiles.uncorrelated_errors(runs.repartition(3), em, "id", tile).toPandas().sort_values("id")["error"].to_numpy()
    assert np.allclose(got, diagnostics.individual_errors(em, pdf, "chol")["error"].to_numpy(), atol=1e-7)
    m, s = tiles.mahalanobis(runs, em, "id", tile).first(), diagnostics.summary_diag(em, pdf)
    assert m.m == 70 and m.chi == pytest.approx(s["chi"]) and m.mahalanobis == pytest.approx(s["mahalanobis"], rel=1e-5)


def test_covariance_of_two_tables(runs):
    em = engine.EMS["q"]
    x = runs.toPandas().sort_values("id")[["l_discount", "l_tax"]].to_numpy(float)
    got = tiles.covariance_between(runs.filter("id < 30"), runs.filter("id >= 25").withColumnRenamed("id", "other"), em, "id", "other", tile=7).toPandas()
    want = em.get_cov(x[:30], x[25:])
    assert len(got) == 30 * 45 and len(got.drop_duplicates(["id", "other"])) == 30 * 45
    assert np.abs(got["cov"].to_numpy() - want[got["id"], got["other"] - 25]).max() < 1e-12


def test_tiles_take_empty_tables_and_nulls(spark, runs):
    em, none = engine.EMS["r"], runs.limit(0)
    assert tiles.uncorrelated_errors(none, em, "id").count() == 0 and tiles.mahalanobis(none, em, "id").first().m == 0
    assert tiles.covariance_between(none, runs.withColumnRenamed("id", "o"), em, "id", "o").count() == 0
    more = runs.unionByName(spark.createDataFrame([(99, None, 0.0, 1.0), (100, 0.05, 0.01, None)], runs.schema))
    assert tiles.uncorrelated_errors(more, em, "id", 16).count() == 70


def test_driver_takes_few_points(runs, monkeypatch):
    monkeypatch.setattr(diagnostics, "MAX_WHOLE", 50)
    for f in (diagnostics.summary_diag, diagnostics.individual_errors):
        with pytest.raises(ValueError, match="tiles"):
            f(engine.EMS["r"], runs.toPandas())


# ------------------------------------------------------------------ joint hits


@pytest.mark.parametrize("k", [3, 40, 65])
def test_joint_counts(spark, k):
    b = (np.random.default_rng(k).random((300, k)) < 0.4).astype(int)
    b[:, 1] = b[:, 0]
    names = [f"h{i}" for i in range(k)]
    rows, got = stats.joint_counts(spark.createDataFrame([tuple(map(int, v)) for v in b], ", ".join(f"{c} int" for c in names)).repartition(5), names)
    assert rows == 300
    for s in list(itertools.combinations(range(k), 1)) + list(itertools.combinations(range(k), 2)) + list(itertools.combinations(range(k), 3))[:: max(1, k**3 // 5000)]:
        assert got.get(frozenset(names[i] for i in s), 0) == int(b[:, list(s)].all(1).sum())


def test_preflight_of_forty_outputs(spark):
    r = np.random.default_rng(0)
    y = r.random((500, 40))
    y[:, 7] = y[:, 3]
    y[:, 9] += 5
    df = spark.createDataFrame(pd.DataFrame(y, columns=[f"o{i}" for i in range(40)]))
    got = stats.preflight(df, {f"o{i}": (0.2, 0.6) for i in range(40)})
    assert got["missed"] == {"o9": "over"} and [p[:2] for p in got["pairs"]] == [("o3", "o7")] and got["triples"] == []


# ------------------------------------------------------------------ kernel parameters


def _likelihood(x, y, h, theta, nugget):
    a = (1 - nugget) * np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / theta**2) + nugget * np.eye(len(x))
    inv = np.linalg.inv(a)
    b = np.linalg.solve(h.T @ inv @ h, h.T @ inv @ y)
    return -len(y) / 2 * math.log((y - h @ b) @ inv @ (y - h @ b) / len(y)) - np.linalg.slogdet(a)[1] / 2


def test_joint_refinement_finds_the_maximum(spark, sf):
    """On part's mean prices by size: at least the grid's likelihood, and that of a dense search over length scale and nugget."""
    p = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).orderBy("p_size").toPandas()
    x, y = ((p["p_size"].to_numpy(float) - 25.5) / 24.5)[:, None], p["y"].to_numpy(float)
    for y in (y, np.sin(3 * x[:, 0]) + 0.05 * np.cos(40 * x[:, 0])):
        h = np.column_stack([np.ones(len(x)), x])
        job = (x, y, h, np.array([True]))
        ((start, _),) = train.estimate_hyper(spark, [job], "exp_sq", 1)
        ((c, sigma),) = train.refine_hyper(spark, [job], [start], 1)
        top = _likelihood(x, y, h, c.params["theta"], c.nugget)
        assert sigma > 0 and top >= _likelihood(x, y, h, start.params["theta"], start.nugget) - 1e-9
        dense = max(_likelihood(x, y, h, t, g) for t in np.linspace(1 / 3, 2, 60) for g in np.linspace(1e-4, 0.2, 60))
        assert top >= dense - 1e-3


def test_best_by_likelihood_before_the_gap(spark):
    """A gap wider than the range's top leaves the length scale as it is; a smaller one raises it afterwards."""
    r = np.random.default_rng(4)
    for far, limit in ((5.0, False), (1.0, True)):
        x = np.concatenate([r.random((20, 1)) * 0.3, [[0.3 + far]]])
        y = np.sin(8 * x[:, 0])
        job = (x, y, np.ones((21, 1)), np.array([True]))
        ((c, _),) = train.estimate_hyper(spark, [job], "exp_sq", 1)
        grid = np.linspace(1 / 3, 2, 30)
        best = max(grid, key=lambda t: _likelihood(x, y, np.ones((21, 1)), t, 0.01))
        d = apart(x)
        np.fill_diagonal(d, np.inf)
        gap = d.min(1).max()
        assert (gap < 2) == limit and c.params["theta"] == pytest.approx(max(best, gap) if limit else best)


def test_climb_respects_bounds():
    f = lambda v: -((v[0] - 3) ** 2) - (v[1] + 1) ** 2 - v[0] * v[1] / 2
    z, top = train.climb(f, np.array([0.5, 0.5]), np.array([0.0, 0.0]), np.array([2.0, 2.0]))
    assert np.allclose(z, [2.0, 0.0], atol=1e-4) and top == pytest.approx(f(z))
    z, _ = train.climb(f, np.array([0.5, 0.5]), np.array([-9.0, -9.0]), np.array([9.0, 9.0]))
    assert np.allclose(z, np.linalg.solve([[2, 0.5], [0.5, 2]], [6, -2]), atol=1e-3)
