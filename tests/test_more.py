"""Operators that the other tests do not reach."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions.basis import Basis
from tidewright.functions.kernels import Kernel, register
from tidewright.functions.scalar import Pca, ball_columns, logged
from tidewright.operators import design, diagnostics, idemc, plotdata, score, stats, train
from tidewright.plans.collections import EmulatorSet
from tidewright.plans.emulator import Emulator, ProtoEmulator
from tidewright.queries import EMS, INPUTS, RANGES, Z
from tidewright.sources import generators, models, simulators

warnings.simplefilter("ignore")


@pytest.fixture(scope="module")
def runs(spark):
    p = generators.lattice_lhs(spark, RANGES, 61, [7, 13]).drop("point_id")
    x = p.toPandas()[INPUTS].to_numpy()
    d = pd.DataFrame(x, columns=INPUTS)
    for k, e in EMS.items():
        d[k] = e.get_exp(x) + 0.01
    return spark.createDataFrame(d).cache()


def test_diagnostics(spark, runs):
    for k, e in EMS.items():
        assert diagnostics.residual_diag(e, runs).count() >= 0
        assert diagnostics.standard_errors(e, Z[k], runs).count() <= 61
    assert diagnostics.points_of_concern(list(EMS.values()), Z, runs).count() <= 61
    assert diagnostics.structured_error_check(runs.withColumn("bad", F.col("l_tax") > 0.04), F.col("bad"), INPUTS) == ["l_tax"]
    fixed = diagnostics.diagnostic_pass(EMS, Z, runs)
    assert set(fixed) <= set(EMS)
    for k, e in fixed.items():
        assert diagnostics.classification_diag(e, Z[k], runs).isEmpty()
    for how in ("obs", "var", "hp", "disc"):
        r = diagnostics.space_removed(spark, list(EMS.values()), Z, 6, (0.5, 2.0), (1.0, 3.0), how).toPandas()
        assert len(r) == 4 and r["removed"].between(0, 1).all()
    obs = diagnostics.space_removed(spark, list(EMS.values()), Z, 6, (0.5, 2.0), (3.0,), "obs").toPandas().set_index("u_mod")["removed"]
    assert obs[0.5] >= obs[2.0]  # larger errors rule out less
    assert diagnostics.space_removal(spark, list(EMS.values()), Z, ppd=6, individual=False).first().removed <= 1
    with pytest.raises(ValueError):
        diagnostics.get_diagnostic(EMS["q"], runs, "zz")


def test_folds_in_parallel_agree(spark):
    a, b = diagnostics.k_fold_measure(EMS["q"], 3), diagnostics.k_fold_measure(EMS["q"], 3, spark)
    assert np.allclose(a.to_numpy(), b.to_numpy())
    with pytest.warns(UserWarning):
        assert len(diagnostics.k_fold_measure(EMS["q"], 2)) == 9


def test_bootstrap_of_variances(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(float(i % 3), float(v)) for i, v in enumerate(rng.normal(0, 2, 900))], "x double, y double")
    r = diagnostics.clean_data_variance(d, ["x"], "y").toPandas()
    assert len(r) == 3 and np.allclose(r["mean"], 4, atol=1)
    assert np.allclose(r["var"], 2 * 16 / 300, rtol=0.6)  # the variance of a normal sample's variance


def test_design_options(spark):
    ems = list(EMS.values())
    for o, m in ((design.Options(pca_lhs=True, corners=True), ("lhs",)), (design.Options(cluster=True, imp_distro="normal"), ("lhs", "importance")), (design.Options(seek=3), ("lhs", "line"))):
        d = design.generate_new_design(spark, ems, 12, Z, m, opts=o)
        assert len(d.points) == 12
    first = design.generate_new_design(spark, ems, 12, Z, ("lhs",))
    again = design.generate_new_design(spark, ems, 12, Z, ("line", "importance"), plausible=first.points)
    assert len(again.points) == 12
    with pytest.warns(UserWarning):
        far = design.generate_new_design(spark, ems, 12, {"q": {"val": 9000.0, "sigma": 0.1}}, ("lhs",))
    assert len(far.points) == 0 and far.cutoff > 3
    with pytest.raises(ValueError):
        design.generate_new_design(spark, ems, 12, Z, ("line",))


def test_old_names(spark):
    with pytest.warns(DeprecationWarning):
        assert len(design.generate_new_runs(spark, list(EMS.values()), 8, Z, method=("lhs",)).points) == 8
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(float(x), float(x * 3 + e)) for x in np.linspace(0, 1, 12) for e in rng.normal(0, 0.1, 8)], "x double, y double")
    with pytest.warns(DeprecationWarning):
        assert "variance" in train.variance_emulator_from_data(d, ["y"], {"x": (0.0, 1.0)}, order=1, nsteps=5)
    with pytest.warns(DeprecationWarning):
        assert "expectation" in train.bimodal_emulator_from_data(d, ["y"], {"x": (0.0, 1.0)}, order=1, nsteps=5)


def test_clusters_of_inputs():
    a, b = EMS["q"], EMS["p"]
    from dataclasses import replace

    s = EmulatorSet.of([replace(a, active=np.array([True, False])), replace(b, active=np.array([False, True]))])
    assert len(design.active_clusters(s)) == 2 and len(design.active_clusters(EmulatorSet.of([a, b]))) == 1


def test_custom_kernel(spark):
    register(Kernel("hat", lambda s, hp, order: np.maximum(0, 1 - np.sqrt(s) / hp["theta"]), lambda s, hp: F.greatest(F.lit(0.0), 1 - F.sqrt(s) / hp["theta"]), 0))
    d = spark.createDataFrame([(float(x), float(np.sin(3 * x))) for x in np.linspace(0, 1, 12)], "x double, y double")
    em = train.train(d, ["y"], {"x": (0.0, 1.0)}, corr_name="hat", theta_ranges={"theta": (0.2, 1.0)}, nsteps=5)["y"]
    assert em.corr.name == "hat"
    with pytest.raises(ValueError):
        train.train(d, ["y"], {"x": (0.0, 1.0)}, corr_name="hat")


def test_missing_outputs_train_on_their_own_rows(spark):
    d = spark.createDataFrame([(float(x), float(x**2) if k % 2 else None, float(x)) for k, x in enumerate(np.linspace(0, 1, 24))], "x double, y double, w double")
    ems = train.train(d, ["y", "w"], {"x": (0.0, 1.0)}, nsteps=5)
    assert len(ems["y"].x) == 12 and len(ems["w"].x) == 24


def test_proto_in_spark(spark):
    p = ProtoEmulator(RANGES, "q", lambda x: 24 + x[:, 0] * 10, lambda x: np.full(len(x), 0.01))
    d = score.nth_implausible(generators.uniform(spark, RANGES, 50), [p, EMS["r"]], {"q": Z["q"], "r": Z["r"]})
    assert d.filter("I is null").count() == 0


def test_more_than_ten_outputs(spark):
    from dataclasses import replace

    ems = [replace(EMS["q"], name=f"o{i}") for i in range(12)]
    z = {f"o{i}": {"val": 20.0 + i, "sigma": 0.5} for i in range(12)}
    pts = generators.uniform(spark, RANGES, 40).cache()
    two = score.nth_implausible(pts, ems, z, 2).orderBy("point_id").toPandas()["I"]
    assert np.allclose(score.nth_implausible(pts, ems, z).orderBy("point_id").toPandas()["I"], two)
    early = score.nth_implausible(pts, ems, z, cutoff=3.0).orderBy("point_id").toPandas()["I"]
    assert (early == (two <= 3)).all()


def test_sources(spark, tmp_path):
    pts = generators.uniform(spark, RANGES, 20, 2)
    models.checkpoint_points(pts, str(tmp_path / "a"))
    models.checkpoint_points(pts, str(tmp_path / "b"), "parquet")
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 20
    ids = pts.limit(3).select(models.uid(*INPUTS).alias("uid"))
    assert models.rows_by_uid(pts, INPUTS, ids).count() == 3
    with pytest.raises(ValueError):
        models.export_emulators([EMS["q"].set_sigma(lambda x: x[:, 0])], spark, str(tmp_path / "x.json"))
    models.export_emulators([EMS["q"]], spark, str(tmp_path / "q.json"))
    back = models.import_emulators(spark, str(tmp_path / "q.json"))["q"]
    x = pts.toPandas()[INPUTS].to_numpy()
    assert np.allclose(back.get_exp(x), EMS["q"].get_exp(x)) and np.allclose(back.get_var(x), EMS["q"].get_var(x), atol=1e-8)
    a, b = generators.halves(pts, 0.7, 1)
    assert a.count() + b.count() == 20


def test_scalars(spark):
    d = spark.range(4000).select(*(c.alias(k) for k, c in ball_columns(["x", "y"], 2.0, 3).items())).toPandas()
    r = np.hypot(d["x"], d["y"])
    assert r.max() <= 2 and abs((r <= 1).mean() - 0.25) < 0.03  # uniform in the disc
    p = Pca.fit(spark.createDataFrame(d), ["x", "y"])
    x = d.to_numpy()
    assert np.allclose(p.transform(p.transform(x), forward=False), x) and np.allclose(np.cov(p.transform(x).T), np.eye(2), atol=1e-6)
    got = spark.createDataFrame(d).select(*(c.alias(f"p{i}") for i, c in enumerate(p.columns()))).toPandas()
    assert np.allclose(got, p.transform(x))
    assert spark.range(1).select(logged(F.lit(-1.0)).alias("v")).first().v == pytest.approx(np.log(1e-4))


def test_sirs_check_value():
    assert np.allclose(simulators.sirs(np.array([[0.45, 0.25, 0.025]]))[0], [618.5768, 148.7652, 232.6580], atol=1e-3)
    assert np.isclose(simulators.sine(np.array([0.25]))[0], 0.212987, atol=1e-6)
    assert np.allclose(simulators.trig(0.1, 0.4), [1.277779, -2.957667], atol=1e-6)


def test_slices(spark, runs):
    d = plotdata.emulator_plot(spark, list(EMS.values()), ("l_discount", "l_tax"), "var", ppd=4)
    assert set(d.columns) == {"point_id", "l_discount", "l_tax", "q", "p", "r"}
    with pytest.raises(ValueError):
        plotdata.emulator_plot(spark, list(EMS.values()), ("l_discount", "l_tax"), "other")
    assert plotdata.behaviour_plot(runs, INPUTS, ["q"], {"q": Z["q"]}, [EMS["q"]]).count() == 122
    s = plotdata.simulator_plot([runs], {"q": (20.0, 30.0)}, normalise=True, log=True, by_hit=True)
    assert set(s.columns) == {"wave", "run", "hits", "output", "value"}
    assert stats.hits(runs, Z).filter("hit_q = 1").count() <= 61


def test_clusters_are_of_all_rows():
    import numpy as np

    from tidewright.operators.idemc import obtain_clusters

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (600, 2)), rng.normal(5, 0.1, (600, 2))])
    centres = sorted(c["centre"][0] for c in obtain_clusters(x, most=2))
    assert len(centres) == 2 and abs(centres[0]) < 0.1 and abs(centres[1] - 5) < 0.1


def test_design_options_take_effect(spark):
    """Each option changes what it is for."""
    x = np.linspace(0.005, 0.095, 30)
    pts = np.column_stack([x, 0.8 * x + np.random.default_rng(0).normal(0, 0.002, 30)])
    em = EMS["q"].set_sigma(2.0).adjust(pts, 25 + 40 * x)
    p = {k: design.Proposer(spark, [em], {"q": (20.0, 32.0)}, design.Options(pca_lhs=k)) for k in (False, True)}
    got = {k: v.lhs_stage(40, 3.0)[0] for k, v in p.items()}
    assert abs(np.corrcoef(got[False].T)[0, 1]) < 0.2 < 0.8 < np.corrcoef(got[True].T)[0, 1]
    seeds = got[True][:60]
    slices = {k: design.Proposer(spark, [em], {"q": (20.0, 32.0)}, design.Options(pca_slice=k)).slice_stage(seeds, 400, 3.0) for k in (False, True)}
    assert all(len(v) == 400 for v in slices.values())
    assert np.corrcoef(slices[True].T)[0, 1] > np.corrcoef(slices[False].T)[0, 1] + 0.2
    order = [EMS["r"], EMS["q"], EMS["p"]]
    assert design.Proposer(spark, order, Z, design.Options(use_collect=False)).ems.outputs == ["r", "q", "p"]
    at = np.array([[0.03, 0.02], [0.08, 0.07]])
    probs = {k: design.hit_probability([EMS["q"]], at, {"q": Z["q"]}, k) for k in design.DISTROS}
    assert len({tuple(np.round(v, 6)) for v in probs.values()}) == len(probs)
    with pytest.raises(ValueError):
        design.hit_probability([EMS["q"]], at, {"q": Z["q"]}, "none")
    wide = {f"x{i}": (0.0, 1.0) for i in range(30)}
    many = Emulator(basis=Basis.constant(wide), beta_mu=np.zeros(1), sigma=1.0, ranges=wide, name="q")
    c = design.Proposer(spark, [many], {"q": (-1.0, 1.0)}, design.Options(points_factor=2)).corners()
    assert c.shape == (200, 30) and set(np.unique(c)) == {0.0, 1.0} and c.mean() > 0.4


def test_normal_proposals_weigh_all_seeds(spark):
    """Seeds beyond the first hundreds count: a second cluster of them is not proposed from more often."""
    rng = np.random.default_rng(0)
    seeds = np.concatenate([rng.normal(0, 0.1, (600, 2)), rng.normal(8, 0.1, (600, 2))])
    p = design.Proposer(spark, [EMS["q"]], {"q": Z["q"]}, design.Options(imp_distro="normal"))
    y = np.concatenate([p.propose(seeds, 20_000, 1.0) for _ in range(3)])
    assert 0.3 < (y[:, 0] > 4).mean() < 0.7


def test_ladder_ends_honestly():
    far = {"q": {"val": 60.0, "sigma": 0.1}}
    with pytest.warns(UserWarning, match="out of reach"):
        idemc.idemc([EMS["q"]], 10, far, s=60, mutations=2, max_rungs=2)
    burnt = idemc.idemc([EMS["q"]], 10, {"q": Z["q"]}, s=80, mutations=2, get_burnt=True)
    again = idemc.idemc([EMS["q"]], 10, {"q": Z["q"]}, s=80, mutations=2, burnt=burnt)
    assert burnt["rungs"][-1] <= 3.0 and len(again) == 10
    assert (EMS["q"].implausibility(again.to_numpy(), Z["q"]) <= 3.0).all()


def test_refined_length_scale_is_likelier(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (40, 2))
    job = (x, np.sin(3 * x[:, 0]) + x[:, 1], np.ones((40, 1)), np.array([True, True]))
    ((c, _),) = train.estimate_hyper(spark, [job], "exp_sq", 1, 8)
    best, _ = train.refine_theta(job, c, (c.params["theta"] * 0.7, c.params["theta"] * 1.3))
    assert train._profile(*job[:3], best, job[3])[0] >= train._profile(*job[:3], c, job[3])[0]


def test_driver_and_tasks_choose_the_same_kernel(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (30, 2))
    job = (x, np.sin(3 * x[:, 0]) + x[:, 1], np.ones((30, 1)), np.array([True, True]))
    here = train.estimate_hyper(spark, [job], "matern", 1, 5)
    monkeypatch.setattr(train, "DRIVER_WORK", 0)
    there = train.estimate_hyper(spark, [job], "matern", 1, 5)
    assert here[0][0] == there[0][0] and np.isclose(here[0][1], there[0][1])


def test_modes_of_many_replicates(spark):
    """Folded replicates give the modes and shares of the replicates themselves."""
    rng = np.random.default_rng(1)
    rows = [(float(k), float(v), float(v * 2 + rng.normal())) for k in range(3) for v in np.concatenate([rng.normal(0, 1, 3000), rng.normal(40 if k else 0, 1, 1500)])]
    d = spark.createDataFrame(rows, "x double, y double, w double")
    got = {(r.x, r.output): r for r in train.detect_modes(d, ["x"], ["y", "w"]).collect()}
    assert {k: r.bimodal for k, r in got.items()} == {(x, o): x > 0 for x in (0.0, 1.0, 2.0) for o in ("y", "w")}
    assert all(np.isclose(r.prop, 2 / 3) for k, r in got.items() if k[0]) and all(r.n == 4500 for r in got.values())
    split = train.split_modes(d, ["x"], ["y", "w"])
    n = {(r.x, r.mode): r["count"] for r in split.groupBy("x", "mode").count().collect()}
    assert n == {(0.0, 1): 4500, (0.0, 2): 4500, (1.0, 1): 3000, (1.0, 2): 1500, (2.0, 1): 3000, (2.0, 2): 1500}


def test_poor_emulators_are_trained_anew(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 0.1, 60), rng.uniform(0, 0.08, 60)])
    y = 25 + 300 * (x[:, 0] - 0.05) + 400 * x[:, 1] * x[:, 0]
    bad = EMS["q"].set_sigma(0.01).adjust(x[:6], y[:6] + 3)
    runs = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(x, y, strict=True)], "l_discount double, l_tax double, q double")
    calls = []

    def retrain(o, rows):
        calls.append(rows.count())
        t = rows.toPandas()
        return EMS["q"].set_sigma(5.0).adjust(t[["l_discount", "l_tax"]].to_numpy(), t[o].to_numpy())

    out = diagnostics.diagnostic_pass({"q": bad}, {"q": (20.0, 40.0)}, runs, retrain=retrain, resamples=2)
    assert 1 <= len(calls) <= 2 and out["q"].sigma == 5.0


def test_large_table_for_maximin(spark, monkeypatch):
    monkeypatch.setattr(design, "MAX_KEPT", 400)
    d = spark.range(5000).select((F.col("id") / 5000.0).alias("a"), F.rand(1).alias("b"))
    assert design.maximin_sample(d, 12, ["a", "b"], 20).count() == 12


def test_emulators_cluster_by_active_inputs(spark):
    """Groups that share an input, found by fuzzy clusters; a design for each, combined."""
    box = {k: (-1.0, 1.0) for k in "abcde"}

    def em(name, act):
        terms = ((0,) * 5, *(tuple(int(i == "abcde".index(a)) for i in range(5)) for a in act))
        return Emulator(basis=Basis(tuple("abcde"), terms), beta_mu=np.array([0.0, *[1.0] * len(act)]), sigma=0.3, ranges=box, name=name)

    ems = [em("u", "abc"), em("v", "abc"), em("w", "cde"), em("x", "cde")]
    groups = design.active_clusters(EmulatorSet.of(ems))
    assert sorted(groups) == [(["u", "v"], ["a", "b", "c"]), (["w", "x"], ["c", "d", "e"])]
    assert len(design.active_clusters(EmulatorSet.of([em("u", "abc"), em("v", "abd"), em("w", "bcd")]))) == 1
    z = {k: (-1.0, 1.0) for k in "uvwx"}
    d = design.generate_new_design(spark, ems, 20, z, ("lhs",), opts=design.Options(cluster=True))
    assert len(d.points) == 20
    assert (idemc.implausibility_nth(EmulatorSet.of(ems), z, d.points[list("abcde")].to_numpy(), 1) <= 3).all()
