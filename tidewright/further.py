"""More registered queries: operators whose results are a fitted model, a plan or a sample, with SQL where it can check them.

Samplers are checked by what their results must satisfy; fitted values by an
independent search in plain numpy when the SQL is asked for.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import tempfile
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .functions import kernels
from .functions.basis import Basis, parse_term, term_text
from .functions.kernels import Correlator
from .functions.scalar import Pca, ball_columns, logged, scale_columns, truncated_t
from .operators import design, diagnostics, idemc, plotdata, score, stats, train
from .operators.saving import new_path
from .plans.collections import EmulatorSet
from .plans.emulator import EmulatedMatrix, Emulator, HierarchicalEmulator, ProtoEmulator
from .plans.targets import Target, convert_ranges
from .queries import (
    _A, _B, _BASE, _KEYS, _PAIRS, _POINTS_SQL, _S, _VAL, EMS, INPUTS, LATE, LT, OUTPUTS, PLACES, PRIOR, RANGES, SIRS_Z, WAVE2, Z, ZP, ZQ, ZR, _em, _imp_sql, _lit, _moments_sql, _pairs, _points, _runs, _scored_sql, _validation, query, rounded, table,
)
from .sources import generators, models, simulators

_QV = f"WITH {_VAL},\n{_scored_sql('q')}"


def values(names: str, rows) -> str:
    """SQL for a table of given values."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(f"CAST({lit(v)} AS DOUBLE)" if isinstance(v, float) else lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def quiet(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return f(spark, sf_dir)

    return run


# ------------------------------------------------------------------ sources and sinks


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'p')}\nSELECT l_discount, l_tax, round(q_e, 6) AS q_exp, round(q_v, 6) AS q_var, round(p_e, 6) AS p_exp, round(p_v, 6) AS p_var FROM q JOIN p USING (l_discount, l_tax)")
def model_json(spark, sf_dir):
    """Emulators written as JSON and read again."""
    with tempfile.TemporaryDirectory() as d:  # the driver writes it and reads it
        path = os.path.join(d, "models.json")
        models.export_emulators([EMS["q"], EMS["p"]], spark, path)
        ems = models.import_emulators(spark, path)
    d = score.score(_points(spark, sf_dir), list(ems.values()))
    return rounded(d, "q_exp", "q_var", "p_exp", "p_var")


@query("SELECT DISTINCT l_discount, l_tax FROM lineitem")
def points_checkpoint(spark, sf_dir):
    """Points written as CSV and read again."""
    path = f"{new_path(spark, 'points')}.csv"
    models.checkpoint_points(_points(spark, sf_dir), path)
    return spark.read.option("header", True).schema("l_discount double, l_tax double").csv(path)


@query("SELECT CAST(5000 AS BIGINT) AS n, true AS inside, true AS even")
def uniform_points(spark, sf_dir):
    d = generators.uniform(spark, {"x": (2.0, 4.0), "y": (-1.0, 1.0)}, 5000, 3)
    mid = (F.abs(F.avg("x") - 3.0) < 0.05) & (F.abs(F.avg("y")) < 0.05) & (F.abs(F.var_samp("x") - 1 / 3) < 0.02)
    return d.agg(F.count("*").alias("n"), F.bool_and((F.col("x") >= 2) & (F.col("x") <= 4) & (F.col("y") >= -1) & (F.col("y") <= 1)).alias("inside"), mid.alias("even"))


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS strata_x, CAST(1000 AS BIGINT) AS strata_y")
def keyed_lhs(spark, sf_dir):
    """Every stratum of every input holds one point."""
    d = generators.lhs(spark, {"x": (0.0, 1.0), "y": (-1.0, 1.0)}, 1000, 5)
    return d.agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("x") * 1000)).alias("strata_x"), F.countDistinct(F.floor((F.col("y") + 1) * 500)).alias("strata_y"))


@query("SELECT CAST(2000 AS BIGINT) AS n, true AS inside, true AS even")
def ball_points(spark, sf_dir):
    """Uniform points of a disc: the inner half of its area holds half of them."""
    d = spark.range(2000).select(*(c.alias(k) for k, c in ball_columns(["x", "y"], 2.0, 11).items()))
    r2 = F.col("x") ** 2 + F.col("y") ** 2
    return d.agg(F.count("*").alias("n"), F.bool_and(r2 <= 4.0).alias("inside"), (F.abs(F.avg((r2 <= 2.0).cast("double")) - 0.5) < 0.04).alias("even"))


@query("SELECT (SELECT count(*) FROM lineitem) AS n, CAST(0 AS BIGINT) AS shared, true AS share")
def validation_split(spark, sf_dir):
    """Training and validation rows: together all, none in both."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS)
    a, b = generators.halves(d, 0.7, 1)
    shared = a.join(b, d.columns, "left_semi").agg(F.count("*").alias("shared"))
    both = a.withColumn("t", F.lit(1.0)).unionByName(b.withColumn("t", F.lit(0.0))).agg(F.count("*").alias("n"), (F.abs(F.avg("t") - 0.7) < 0.02).alias("share"))
    return both.crossJoin(shared).select("n", "shared", "share")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def rows_by_uid(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ids = d.filter("l_quantity > 45").select(models.uid(*d.columns).alias("uid"))
    return models.rows_by_uid(d, d.columns, ids).drop("uid")


@query("SELECT a.part_size, b.width, round(a.part_size * b.width, 6) AS product FROM (SELECT DISTINCT p_size AS part_size FROM part) a CROSS JOIN (SELECT i / 4.0 AS width FROM range(5) AS t(i)) b")
def design_product(spark, sf_dir):
    """Two designs on different inputs combined."""
    a = table(spark, sf_dir, "part").select(F.col("p_size").alias("part_size")).distinct()
    b = generators.grid(spark, {"width": (0.0, 1.0)}, 5).drop("point_id")
    return a.crossJoin(F.broadcast(b)).withColumn("product", F.round(F.col("part_size") * F.col("width"), PLACES))


# ------------------------------------------------------------------ names, ranges, scalars


_TERM_TEXTS = ["a:b", "I(a^2)", "b:I(a^2)", "(Intercept)"]


@query("SELECT l_discount, l_tax, t AS term, round(CASE t WHEN 'a:b' THEN l_discount * l_tax WHEN 'I(a^2)' THEN l_discount * l_discount WHEN 'I(a^2):b' THEN l_discount * l_discount * l_tax ELSE 1 END, 8) AS v FROM (SELECT DISTINCT l_discount, l_tax FROM lineitem), (VALUES ('a:b'), ('I(a^2)'), ('I(a^2):b'), ('(Intercept)')) AS t(t)")
def term_names(spark, sf_dir):
    """Terms parsed from text, evaluated and named again."""
    terms = tuple(parse_term(t, ["a", "b"]) for t in _TERM_TEXTS)
    cols = Basis(("a", "b"), terms).columns([F.col("l_discount"), F.col("l_tax")])
    each = F.explode(F.array(*(F.struct(F.lit(term_text(t, ("a", "b"))).alias("term"), F.round(c, 8).alias("v")) for t, c in zip(terms, cols, strict=True)))).alias("x")
    return _points(spark, sf_dir).select(*INPUTS, each).select(*INPUTS, "x.term", "x.v")


@query(values("kind, input, lo, hi", [("list", "x", -1.0, 2.0), ("frame", "x", 0.0, 4.0), ("least", "l_discount", 0.02, 0.08), ("least", "l_tax", 0.0, 0.08), ("most", "l_discount", 0.0, 0.1), ("most", "l_tax", 0.0, 0.08)]))
def range_forms(spark, sf_dir):
    """Ranges from several forms; the narrowest and the widest over waves."""
    narrow = _em("q", lambda a, b: a, [1.0, 0.0, 0.0], 1.0, Correlator.of("exp_sq", theta=1.0), trained=False)
    narrow = Emulator(basis=narrow.basis, beta_mu=narrow.beta_mu, sigma=1.0, ranges={"l_discount": (0.02, 0.08), "l_tax": (0.0, 0.08)}, name="q")
    s = EmulatorSet.of([[EMS["q"]], [narrow]])
    rows = [("list", k, *v) for k, v in convert_ranges([("x", 2, -1)]).items()] + [("frame", k, *v) for k, v in convert_ranges(pd.DataFrame([[4.0, 0.0]], index=["x"])).items()]
    rows += [(n, k, *v) for n, m in (("least", True), ("most", False)) for k, v in s.ranges(m).items()]
    return spark.createDataFrame(rows, "kind string, input string, lo double, hi double")


@query(values("name, label, time", [("I10", "I", 10), ("R25", "R", 25), ("x", "x", None), ("aa1b2", "aa1b", 2)]))
def output_names(spark, sf_dir):
    names = ["I10", "R25", "x", "aa1b2"]
    by = {n: (lab, t) for n in names for lab, t in [stats.split_name(n)]}
    assert stats.partition_by_output(names) == {10: ["I10"], 25: ["R25"], None: ["x"], 2: ["aa1b2"]}
    return spark.createDataFrame([(n, lab, t) for n, (lab, t) in by.items()], "name string, label string, time int")


_TT = [(0.5, 1.0), (-0.5, 2.0), (2.0, 0.3), (-1.0, 0.5)]


@query(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({e} AS DOUBLE), CAST({v} AS DOUBLE))" for e, v in _TT) + ") AS t(e, v)), "
    "x AS (SELECT e, v, sqrt(v * 4 / 6) AS s, (i + 0.5) * 0.002 * sqrt(v * 4 / 6) AS y FROM p, range(200000) AS r(i)), w AS (SELECT e, v, y, pow(1 + pow((y - e) / s, 2) / 6, -3.5) AS d FROM x), "
    "m AS (SELECT e, v, sum(y * d) / sum(d) AS a, sum(y * y * d) / sum(d) AS b FROM w GROUP BY e, v) SELECT e, v, round(a, 3) AS mean, round(b - a * a, 3) AS var FROM m"
)
def truncated_moments(spark, sf_dir):
    """Moments of a t variable cut at 0, against numerical integration."""
    e, v = (np.array(x) for x in zip(*_TT, strict=True))
    m, w = truncated_t(e, v)
    return rounded(spark.createDataFrame([tuple(map(float, r)) for r in zip(e, v, m, w, strict=True)], "e double, v double, mean double, var double"), "mean", "var", places=3)


@query("SELECT o_orderkey, round(ln(greatest(o_totalprice - 50000.0, 1e-4)), 6) AS x FROM orders")
def logged_outputs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(logged(F.col("o_totalprice") - 50000.0), PLACES).alias("x"))


@query("""WITH m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS t, corr(l_quantity, l_extendedprice) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - a) / s AS u, (l_extendedprice - b) / t AS w, r FROM lineitem, m)
SELECT l_orderkey, l_linenumber, round(pow(u + sign(r) * w, 2) / 2 / (1 + abs(r)), 4) AS c1, round(pow(u - sign(r) * w, 2) / 2 / (1 - abs(r)), 4) AS c2 FROM z""")
def pca_whitened(spark, sf_dir):
    """Squares of the whitened principal components of two outputs."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(o).cast("double").alias(o) for o in OUTPUTS))
    c = Pca.fit(d, OUTPUTS).columns()
    return d.select("l_orderkey", "l_linenumber", *(F.round(x * x, 4).alias(f"c{i + 1}") for i, x in enumerate(c)))


@query(values("name, parameter, value", [("matern", "theta", 0.4), ("matern", "nu", 1.5), ("matern", "nugget", 0.2), ("before", "theta", 0.9)]))
def kernel_parameters(spark, sf_dir):
    c = Correlator.of("matern", theta=0.9, nu=2.5)
    d = c.set_hyper_p(0.2, theta=0.4, nu=1.5)
    rows = [(d.name, k, float(v)) for k, v in d.params.items()] + [(d.name, "nugget", d.nugget), ("before", "theta", float(c.params["theta"]))]
    return spark.createDataFrame(rows, "name string, parameter string, value double")


query(_PAIRS.format(k=f"round(5 / (3 * 0.36) * (1 + sqrt(5 * {_S}) / 0.6 - 5 / 0.36 * (p.a - q.a) * (p.a - q.a)) * exp(-sqrt(5 * {_S}) / 0.6), 5)"), "kernel_matern52_d2")(
    lambda spark, sf_dir: rounded(_pairs(spark, sf_dir, lambda x, y: F.round(Correlator.of("matern", theta=0.6, nu=2.5).column_d(x, y, 0, 0), 5)), "k", places=5)
)
query(_PAIRS.format(k=f"round(1 / 0.36 * pow(1 + {_S} / (2 * 1.7 * 0.36), -2.7) - 2.7 / (1.7 * 0.1296) * (p.b - q.b) * (p.b - q.b) * pow(1 + {_S} / (2 * 1.7 * 0.36), -3.7), 5)"), "kernel_rat_quad_d2")(
    lambda spark, sf_dir: rounded(_pairs(spark, sf_dir, lambda x, y: F.round(Correlator.of("rat_quad", theta=0.6, alpha=1.7).column_d(x, y, 1, 1), 5)), "k", places=5)
)


@query("WITH c AS (SELECT i, j, exp(-pow(i - j, 2) / 400.0) * 0.9 AS r FROM (VALUES (10), (25), (50)) AS a(i), (VALUES (10), (25), (50)) AS b(j) WHERE i < j) SELECT round(avg(sqrt(-pow(i - j, 2) / ln(r / 0.9))), 6) AS theta FROM c")
def theta_estimate(spark, sf_dir):
    t = np.array([10.0, 25.0, 50.0])
    c = np.exp(-((t[:, None] - t[None, :]) ** 2) / 400.0) * 0.9
    return spark.createDataFrame([(round(stats.theta_estimate(c, list(t), 0.9), 6),)], "theta double")


@query("SELECT l_discount, l_tax, var_samp(l_quantity) IS NOT NULL AS ok, round(var_samp(l_quantity), 6) AS mean, round(greatest(0, (kurtosis_pop(l_quantity) + 3 - (count(*) - 3) / (count(*) - 1)) * pow(var_pop(l_quantity), 2) / count(*)), 5) AS var, count(*) AS n FROM lineitem GROUP BY l_discount, l_tax HAVING count(*) > 1")
def bootstrap_variance(spark, sf_dir):
    d = stats.clean_data_variance(table(spark, sf_dir, "lineitem"), INPUTS, "l_quantity")
    return d.select(*INPUTS, F.col("mean").isNotNull().alias("ok"), F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "n")


# ------------------------------------------------------------------ covariances, derivatives, matrices

_OTHERS = [(0.02, 0.03), (0.05, 0.05), (0.1, 0.0)]


def _cov_sql(em: Emulator) -> str:
    s2 = em.sigma**2
    o = ", ".join(f"({k}, {(a - 0.05) / 0.05!r}, {(b - 0.04) / 0.04!r})" for k, (a, b) in enumerate(_OTHERS))
    t = ", ".join(f"({i}, {float(x[0])!r}, {float(x[1])!r})" for i, x in enumerate(em.x))
    inv = ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(em.k_inv))
    k = lambda a, b, x, y: f"{s2!r} * exp(-(({a} - {x}) * ({a} - {x}) + ({b} - {y}) * ({b} - {y})) / {em.corr.params['theta'] ** 2!r})"
    return f"""WITH {_POINTS_SQL}, o AS (SELECT * FROM (VALUES {o}) AS o(k, u, w)), t AS (SELECT * FROM (VALUES {t}) AS t(i, x, y)), v AS (SELECT * FROM (VALUES {inv}) AS v(i, j, v)),
l AS (SELECT l_discount, l_tax, i, {k('a', 'b', 'x', 'y')} AS c FROM pts, t), r AS (SELECT k, i, {k('u', 'w', 'x', 'y')} AS c FROM o, t), rv AS (SELECT k, v.j, sum(r.c * v.v) AS c FROM r JOIN v USING (i) GROUP BY k, v.j),
s AS (SELECT l_discount, l_tax, k, sum(l.c * rv.c) AS c FROM l JOIN rv ON l.i = rv.j GROUP BY ALL)
SELECT l_discount, l_tax, k, round({k('a', 'b', 'u', 'w')} - s.c, 5) AS c FROM s JOIN pts USING (l_discount, l_tax) JOIN o USING (k)"""


@query(_cov_sql(EMS["q"]))
def covariance_pairs(spark, sf_dir):
    """Covariances of all points with three others."""
    d = score.covariance_with(_points(spark, sf_dir), EMS["q"], np.array(_OTHERS))
    each = F.posexplode(F.array(*(f"q_cov_{k}" for k in range(len(_OTHERS))))).alias("k", "c")
    return d.select(*INPUTS, each).withColumn("c", F.round("c", 5))


def _grad_sql(em: Emulator) -> str:
    th = em.corr.params["theta"] ** 2
    t = ", ".join(f"({float(x[0])!r}, {float(x[1])!r}, {float(w)!r})" for x, w in zip(em.x, em.weights, strict=True))
    k = f"w * {em.sigma**2!r} * (-2 / {th!r}) * exp(-((a - x) * (a - x) + (b - y) * (b - y)) / {th!r})"
    return f"g AS (SELECT l_discount, l_tax, ({float(em.beta_mu[1])!r} + sum((a - x) * {k})) / 0.05 AS d1, ({float(em.beta_mu[2])!r} + sum((b - y) * {k})) / 0.04 AS d2 FROM pts, (VALUES {t}) AS t(x, y, w) GROUP BY l_discount, l_tax)"


@query(f"WITH {_POINTS_SQL}, {_grad_sql(EMS['q'])} SELECT l_discount, l_tax, round(d1, 4) AS d_l_discount, round(d2, 4) AS d_l_tax FROM g")
def expected_gradient(spark, sf_dir):
    return _points(spark, sf_dir).select(*INPUTS, *(F.round(c, 4).alias(k) for k, c in score.gradient_columns(EMS["q"]).items()))


@query(f"WITH {_POINTS_SQL}, {_grad_sql(EMS['q'])} SELECT l_discount, l_tax, round((3 * d1 + 4 * d2) / 5 / sqrt(d1 * d1 + d2 * d2), 5) AS cosine FROM g")
def directional_derivative(spark, sf_dir):
    return _points(spark, sf_dir).select(*INPUTS, F.round(score.direction_column(EMS["q"], {"l_discount": 3.0, "l_tax": 4.0}), 5).alias("cosine"))


def _cov_d_sql(em: Emulator) -> str:
    s2, th = em.sigma**2, em.corr.params["theta"] ** 2
    t = ", ".join(f"({i}, {float(x[0])!r}, {float(x[1])!r})" for i, x in enumerate(em.x))
    inv = ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(em.k_inv))
    return f"""WITH {_POINTS_SQL}, c AS (SELECT l_discount, l_tax, i, {s2!r} * (-2 / {th!r}) * (a - x) * exp(-((a - x) * (a - x) + (b - y) * (b - y)) / {th!r}) AS c FROM pts, (VALUES {t}) AS t(i, x, y)),
s AS (SELECT p.l_discount, p.l_tax, sum(p.c * v.v * o.c) AS s FROM c p JOIN (VALUES {inv}) AS v(i, j, v) ON p.i = v.i JOIN c o ON o.l_discount = p.l_discount AND o.l_tax = p.l_tax AND o.i = v.j GROUP BY ALL)
SELECT l_discount, l_tax, round(({2 * s2 / th!r} - s) / 0.0025, 2) AS cov_d FROM s"""


@query(_cov_d_sql(EMS["q"]))
def derivative_variance(spark, sf_dir):
    return rounded(score.derivative_covariance(_points(spark, sf_dir), EMS["q"], "l_discount"), "cov_d", places=2)


_MATRIX = EmulatedMatrix(((EMS["q"], EMS["r"]), (EMS["r"], EMS["p"])))


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'p', 'r')}\nSELECT l_discount, l_tax, round(q_e, 5) AS m_0_0, round(r_e, 5) AS m_0_1, round(p_e, 5) AS m_1_1 FROM q JOIN p USING (l_discount, l_tax) JOIN r USING (l_discount, l_tax)")
def emulated_matrix(spark, sf_dir):
    """A matrix that has no negative eigenvalue comes back as its entries."""
    return rounded(score.score_matrix(_points(spark, sf_dir), _MATRIX), "m_0_0", "m_0_1", "m_1_1", places=5)


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'p', 'r')}\nSELECT l_discount, l_tax, round(q_v, 5) AS m_0_0, round(r_e / sqrt(q_e * p_e) * sqrt(q_v * p_v), 4) AS m_0_1, round(p_v, 5) AS m_1_1 FROM q JOIN p USING (l_discount, l_tax) JOIN r USING (l_discount, l_tax)")
def matrix_uncertainty(spark, sf_dir):
    d = score.score_matrix(_points(spark, sf_dir), _MATRIX, [EMS["q"], EMS["p"]])
    return d.select(*INPUTS, F.round("m_0_0", 5).alias("m_0_0"), F.round("m_0_1", 4).alias("m_0_1"), F.round("m_1_1", 5).alias("m_1_1"))


# ------------------------------------------------------------------ emulators: updates, hooks, hierarchy

_Q13 = EMS["q"].set_sigma(2.0 * 1.3)
_P15 = EMS["p"].set_hyperparams(theta=0.5, nu=1.5)


def _two_moments(em, name="q"):
    return f"WITH {_POINTS_SQL},\n{_moments_sql(em, 'pts', _KEYS, name)}\nSELECT l_discount, l_tax, round({name}_e, 6) AS e, round({name}_v, 6) AS v FROM {name}"


def _scored_as(em):
    def run(spark, sf_dir):
        d = score.score(_points(spark, sf_dir), [em])
        return d.select(*INPUTS, F.round(f"{em.name}_exp", PLACES).alias("e"), F.round(f"{em.name}_var", PLACES).alias("v"))

    return run


query(_two_moments(_Q13), "sigma_multiplied")(_scored_as(EMS["q"].mult_sigma(1.3)))
query(_two_moments(_P15, "p"), "hyperparams_changed")(_scored_as(_P15))
_ADJUSTED = Emulator(basis=EMS["q"].basis, beta_mu=EMS["q"].beta_mu, sigma=2.0, ranges=RANGES, corr=EMS["q"].corr, name="q", active=np.array([True, True])).adjust(np.array([(0.02, 0.02), (0.08, 0.06)]), np.array([24.0, 27.0]))


def _adjust_sql(em: Emulator) -> str:
    """Two training points: the inverse in closed form."""
    x, y, th = em.x, em.y, em.corr.params["theta"] ** 2
    pr = lambda a, b: f"(25.0 + 1.5 * {a} - 3.0 * {b})"
    c = lambda i: f"4.0 * exp(-((a - {float(x[i][0])!r}) * (a - {float(x[i][0])!r}) + (b - {float(x[i][1])!r}) * (b - {float(x[i][1])!r})) / {th!r})"
    k12 = f"4.0 * exp(-{float(((x[0] - x[1]) ** 2).sum())!r} / {th!r})"
    r = [f"({float(y[i])!r} - {pr(f'({float(x[i][0])!r})', f'({float(x[i][1])!r})')})" for i in (0, 1)]
    return f"""WITH {_POINTS_SQL}, c AS (SELECT l_discount, l_tax, {pr('a', 'b')} AS m, {c(0)} AS c1, {c(1)} AS c2, {k12} AS k, {r[0]} AS r1, {r[1]} AS r2 FROM pts)
SELECT l_discount, l_tax, round(m + (c1 * (4 * r1 - k * r2) + c2 * (4 * r2 - k * r1)) / (16 - k * k), 6) AS e, round(4 - (4 * c1 * c1 - 2 * k * c1 * c2 + 4 * c2 * c2) / (16 - k * k), 6) AS v FROM c"""


query(_adjust_sql(_ADJUSTED), "bayes_adjustment")(_scored_as(_ADJUSTED))


def _wave_sd(x):
    return 1.0 + 0.5 * x[:, 0] ** 2


@query(f"SELECT DISTINCT l_discount, l_tax, round(25.0 + 1.5 * {_A} - 3.0 * {_B}, 6) AS e, round(pow(1 + 0.5 * {_A} * {_A}, 2), 6) AS v FROM lineitem")
def varying_sigma(spark, sf_dir):
    """A prior whose deviation is a function of the inputs."""
    em = Emulator(basis=Basis.linear(INPUTS), beta_mu=np.array([25.0, 1.5, -3.0]), sigma=_wave_sd, ranges=RANGES, corr=Correlator.of("exp_sq", theta=0.8), name="q")
    return _scored_as(em)(spark, sf_dir)


def _noise(x, n):
    return 4.0 / np.asarray(n, float)


_HIER = HierarchicalEmulator(basis=EMS["q"].basis, beta_mu=EMS["q"].beta_mu, sigma=2.0, ranges=RANGES, corr=EMS["q"].corr, name="q", active=np.array([True, True]), noise=_noise).adjust(np.array([(a, b) for a in (0.01, 0.05, 0.09) for b in (0.01, 0.04, 0.07)]), np.linspace(22, 29, 9), np.arange(10, 19))


@query(f"WITH {_POINTS_SQL},\n{_moments_sql(_HIER, 'pts', _KEYS, 'q')}\nSELECT l_discount, l_tax, round(q_e, 6) AS e, round(q_v, 6) AS v, round(abs(24.0 - q_e) / sqrt(q_v + {4.0 / 14!r} + 0.36 + 1.44), 6) AS I FROM q")
def hierarchical_scores(spark, sf_dir):
    """Training outputs with their own noise; an average run's noise and a 5 % discrepancy join the implausibility."""
    d = score.score(_points(spark, sf_dir), [_HIER]).withColumnsRenamed({"q_exp": "e", "q_var": "v"})
    return rounded(score.nth_implausible(d, [_HIER], {"q": Z["q"]}, 1), "e", "v", "I")


def _predict(x, slope):
    return 20.0 + slope * x[:, 0]


def _spread(x):
    return 1.0 + 10 * x[:, 1]


@query("SELECT DISTINCT l_discount, l_tax, round(abs(24.0 - (20.0 + 60.0 * l_discount)) / sqrt(1 + 10 * l_tax + 0.36), 6) AS I FROM lineitem")
def proto_scores(spark, sf_dir):
    """A predictor of the user's behind the emulator interface."""
    em = ProtoEmulator(RANGES, "q", _predict, _spread, args={"slope": 60.0})
    return rounded(score.nth_implausible(_points(spark, sf_dir), [em], {"q": Z["q"]}, 1), "I")


def _tent(s, hp, order):
    return np.maximum(0.0, 1 - np.sqrt(s) / hp["theta"])


@query(_PAIRS.format(k=f"round(greatest(0, 1 - sqrt({_S}) / 0.7), 6)"))
def custom_kernel(spark, sf_dir):
    """A kernel that the user registers."""
    kernels.register(kernels.Kernel("tent", _tent, lambda s, hp: F.greatest(F.lit(0.0), 1 - F.sqrt(s) / F.lit(hp["theta"])), 0))
    return _pairs(spark, sf_dir, Correlator.of("tent", theta=0.7).column)


@query(values("output, input, active", [("q", "l_discount", True), ("q", "l_tax", False), ("k", "l_discount", True), ("k", "l_tax", True)]))
def active_inputs(spark, sf_dir):
    one = Emulator(basis=Basis(tuple(INPUTS), ((0, 0), (1, 0), (2, 0))), beta_mu=np.zeros(3), sigma=1.0, ranges=RANGES, name="q")
    none = Emulator(basis=Basis.constant(INPUTS), beta_mu=np.zeros(1), sigma=1.0, ranges=RANGES, name="k")
    return plotdata.plot_actives(spark, [one, none])


@query(values("kind, wave, output", [("recent", 0, "q"), ("recent", 1, "p"), ("recent", 1, "r"), ("rest", 1, "q"), ("subset", 0, "q"), ("subset", 1, "q"), ("subset", 1, "r")]))
def emulator_sets(spark, sf_dir):
    """The latest emulator of each output, the others, and those of some outputs."""
    s = EmulatorSet.of([[WAVE2["q"]], list(EMS.values())])
    rows = [(k, m.wave, m.output) for k, x in (("recent", s.recent()), ("rest", s.recent(True)), ("subset", s.subset(["q", "r"]))) for m in x.members]
    return spark.createDataFrame(rows, "kind string, wave int, output string")


@query(_BASE + "SELECT l_discount, l_tax, round(least(q, p, r), 6) AS I FROM imp")
@quiet
def nth_clamped(spark, sf_dir):
    """A level beyond the number of outputs is the least implausibility."""
    return rounded(score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 10), "I")


# ------------------------------------------------------------------ training


@query(f"""WITH d AS (SELECT p_size AS s, {_lit(1.0)} * avg(p_retailprice) AS y, (p_size - 25.5) / 24.5 AS x FROM part GROUP BY 1, 3),
m AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, var_pop(y) AS v, avg(y) AS mean FROM d)
SELECT n, CASE WHEN n * ln(1 - r2) + ln(n) < 0 THEN 2 ELSE 1 END AS terms, round(CASE WHEN n * ln(1 - r2) + ln(n) < 0 THEN a ELSE mean END, 5) AS intercept, round(CASE WHEN n * ln(1 - r2) + ln(n) < 0 THEN b ELSE 0 END, 5) AS slope FROM m""")
def stepwise_line(spark, sf_dir):
    """BIC keeps the linear term of one input, or drops it."""
    d = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("p_size")).agg(F.avg("p_retailprice").alias("y"))
    f = train.coefficient_model(d, {"p_size": (1.0, 50.0)}, "y", 1)
    b = [float(v) for v in f.beta] + [0.0]
    return spark.createDataFrame([(f.n, len(f.beta), round(b[0], 5), round(b[1], 5))], "n long, terms int, intercept double, slope double")


def _trained(spark):
    return train.train(_runs(spark), ["nS", "nI", "nR"], simulators.SIRS_RANGES, order=1, check_ranges=False)


def _own_fit() -> list[tuple]:
    """All subsets of linear terms by BIC, then all thetas by profile likelihood, from the formulas alone."""
    ranges = simulators.SIRS_RANGES
    x = generators.lhs_array(60, ranges, np.random.default_rng(3))
    ys = simulators.sirs(x)
    u = np.column_stack([(x[:, i] - (a + b) / 2) / ((b - a) / 2) for i, (a, b) in enumerate(ranges.values())])
    rows = []
    for name, y in zip(("nS", "nI", "nR"), ys.T, strict=True):
        best = None
        for k in range(4):
            for act in itertools.combinations(range(3), k):
                h = np.column_stack([np.ones(60), *(u[:, i] for i in act)])
                beta = np.linalg.lstsq(h, y, rcond=None)[0]
                bic = 60 * math.log(((y - h @ beta) ** 2).sum() / 60) + (k + 2) * math.log(60)
                best = min(best or (math.inf,), (bic, act, beta, h), key=lambda v: v[0])
        _, act, beta, h = best
        cols = list(act) or [0, 1, 2]
        d = np.sqrt(((u[:, None, cols] - u[None, :, cols]) ** 2).sum(-1))
        far = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1)) + np.where(np.eye(60) > 0, np.inf, 0)

        def likelihood(th, nug, d=d, h=h, y=y):
            a = (1 - nug) * np.exp(-((d / th) ** 2)) + nug * np.eye(60)
            inv = np.linalg.inv(a)
            b = np.linalg.solve(h.T @ inv @ h, h.T @ inv @ y)
            s2 = (y - h @ b) @ inv @ (y - h @ b) / 60
            return -30 * math.log(s2) - np.linalg.slogdet(a)[1] / 2, math.sqrt(s2)

        # the best of the grid at the nugget 0.01; then the gap, if it is within the range, and the nugget that stays
        th = max(np.linspace(1 / 3, 2.0, 30), key=lambda t: likelihood(t, 0.01)[0])
        th = max(th, far.min(1).max()) if far.min(1).max() < 2.0 else th
        top = (None, th, likelihood(th, 1e-10 if len(cols) == 3 else 0.05)[1])
        names = ["(Intercept)", *(list(ranges)[i] for i in act)]
        rows.append((name, " ".join(names), round(float(beta[0]), 4), round(float(top[1]), 6), round(max(top[2], 1e-3 * float(y.max() - y.min())) / float(y.std()), 2)))
    return rows


LATE["trained_parameters"] = lambda: values("output, terms, intercept, theta, sigma", _own_fit())


@query()
@quiet
def trained_parameters(spark, sf_dir):
    """Regression terms, kernel and deviation of emulators trained on a simulator's runs."""
    rows = []
    y = dict(zip(("nS", "nI", "nR"), simulators.sirs(generators.lhs_array(60, simulators.SIRS_RANGES, np.random.default_rng(3))).T, strict=True))
    for o, em in _trained(spark).items():
        rows.append((o, " ".join(em.basis.text()), round(float(em.beta_mu[0]), 4), round(float(em.corr.params["theta"]), 6), round(float(em.sigma) / float(y[o].std()), 2)))
    return spark.createDataFrame(rows, "output string, terms string, intercept double, theta double, sigma double")


@query(values("output, n, meets", [("nS", 60, True), ("nI", 60, True), ("nR", 60, True)]))
@quiet
def trained_interpolates(spark, sf_dir):
    """At its training points an emulator gives the runs back, to within its nugget's deviation."""
    runs = _runs(spark).toPandas()
    rows = []
    for o, em in _trained(spark).items():
        x, y = runs[em.inputs].to_numpy(float), runs[o].to_numpy(float)
        slack = 1e-3 * (y.max() - y.min()) if em.corr.nugget < 1e-6 else 3 * em.sigma
        rows.append((o, len(x), bool((np.abs(em.get_exp(x) - y) <= slack).all() and (em.get_var(x) <= (em.corr.nugget + 1e-3) * em.sigma**2 * 1.1).all())))
    return spark.createDataFrame(rows, "output string, n int, meets boolean")


@query(values("asked, got, kernel", [("variance", "Emulator", "exp_sq"), ("nonsense", "Emulator", "exp_sq"), ("default", "Emulator", "exp_sq"), ("by output", "Emulator", "exp_sq")]))
@quiet
def type_demotion(spark, sf_dir):
    """Types that the data cannot carry, unknown types and kernels, a table for each output."""
    d = _runs(spark)
    rows = []
    for kind, opts in (("variance", {}), ("nonsense", {}), ("default", {"corr_name": "no_kernel"})):
        got = train.emulator_from_data(d, ["nS"], simulators.SIRS_RANGES, kind, order=1, **opts)
        em = (got["expectation"] if "expectation" in got else got)["nS"]
        rows.append((kind, type(em).__name__, em.corr.name))
    em = train.emulator_from_data({"nS": d.select(*simulators.SIRS_RANGES, "nS")}, ["nS"], simulators.SIRS_RANGES, order=1)["nS"]
    rows.append(("by output", type(em).__name__, em.corr.name))
    return spark.createDataFrame(rows, "asked string, got string, kernel string")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber <> 3) AS used FROM (SELECT DISTINCT ON (l_discount, l_tax) l_discount, l_tax, 1 AS l_linenumber FROM lineitem)")
@quiet
def rows_without_output(spark, sf_dir):
    """Rows with no value of an output are left out of its training, and only of its."""
    p = _points(spark, sf_dir).withColumn("y", F.col("l_discount") * 3 + F.col("l_tax"))
    holes = p.unionByName(spark.createDataFrame([(0.0333, 0.04, None)], "l_discount double, l_tax double, y double"))
    em = train.train(holes, ["y"], RANGES, order=1)["y"]
    return p.agg(F.count("*").alias("rows")).withColumn("used", F.lit(len(em.x)).cast("long"))


@query("SELECT l_tax, 'y' AS output, true AS bimodal, round(avg(CAST(l_orderkey % 3 <> 0 AS INT)), 6) AS prop, count(*) AS n FROM lineitem GROUP BY l_tax")
def two_modes(spark, sf_dir):
    """Outputs of a third of the runs lie 500 higher: two modes, the lower one with two thirds."""
    d = table(spark, sf_dir, "lineitem").select("l_tax", F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity") + 500).otherwise(F.col("l_quantity")).alias("y"))
    return rounded(train.detect_modes(d, ["l_tax"], ["y"]), "prop")


# ------------------------------------------------------------------ diagnostics


@query("SELECT 'l_linenumber' AS output, 'under' AS how")
def preflight(spark, sf_dir):
    r = stats.preflight(table(spark, sf_dir, "lineitem"), LT | {"l_linenumber": (90.0, 99.0)})
    return spark.createDataFrame(list(r["missed"].items()), "output string, how string")


@query("WITH h AS (SELECT CAST(l_quantity <= 25 AS DOUBLE) AS a, CAST(l_quantity >= 25.5 AS DOUBLE) AS b FROM lineitem) SELECT 'l_quantity' AS a, 'q2' AS b, round(corr(a, b), 6) AS c FROM h WHERE abs((SELECT corr(a, b) FROM h)) > 0.95 GROUP BY ALL")
def preflight_pairs(spark, sf_dir):
    """Outputs whose hits exclude each other."""
    d = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_quantity").alias("q2"))
    r = stats.preflight(d, {"l_quantity": (-1.0, 25.0), "q2": (25.5, 100.0)})
    return spark.createDataFrame([(a, b, round(c, 6)) for a, b, c in r["pairs"]], "a string, b string, c double")


def _principal_sql(cols: list[str]) -> str:
    """Greedy steps on the correlation matrix, one after another."""
    n = len(cols)
    r = ", ".join(f"corr({a}, {b}) AS r{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols))
    out = f"WITH m AS (SELECT {r} FROM lineitem), c0 AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, r{i}_{j} AS r FROM m" for i in range(n) for j in range(n)) + ")"
    for k in range(n):
        out += f",\nv{k} AS (SELECT i FROM c{k} GROUP BY i ORDER BY sum(r * r) DESC, i LIMIT 1), c{k + 1} AS (SELECT a.i, a.j, a.r - b.r * d.r / e.r AS r FROM c{k} a JOIN v{k} v ON a.i <> v.i AND a.j <> v.i JOIN c{k} b ON b.i = a.i AND b.j = v.i JOIN c{k} d ON d.i = v.i AND d.j = a.j JOIN c{k} e ON e.i = v.i AND e.j = v.i)"
    steps = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT i FROM v{k}) AS i, 1 - coalesce((SELECT sum(r) FROM c{k + 1} WHERE i = j), 0) / {n} AS share" for k in range(n))
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cols))
    return out + f",\ns AS ({steps}) SELECT CASE i {names} END AS name, round(share, 6) AS share FROM s WHERE k = 0 OR (SELECT max(share) FROM s t WHERE t.k < s.k) < 0.95"


_PV = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query(_principal_sql(_PV), "principal_variables")(lambda spark, sf_dir: rounded(spark.createDataFrame(stats.prin_vars(table(spark, sf_dir, "lineitem"), _PV), "name string, share double"), "share"))


@query("WITH d AS (SELECT CAST(l_quantity > 40 AS DOUBLE) AS f, l_extendedprice AS a, l_linenumber AS b FROM lineitem), c AS (SELECT count(*) AS n, corr(f, a) AS r1, corr(f, b) AS r2, corr(a, b) AS r12 FROM d), r AS (SELECT n, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS r2 FROM c) SELECT n, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 8) AS adj_r2 FROM r")
def structured_error_all(spark, sf_dir):
    """Failures against two predictors together."""
    n, r2, adj = stats.structured_error_all(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 40, ["l_extendedprice", "l_linenumber"])
    return spark.createDataFrame([(n, round(float(r2), 8), round(float(adj), 8))], "n long, r2 double, adj_r2 double")


_EQ = EMS["q"]
_LOO = ", ".join(f"({i}, {float(y)!r}, {float(w)!r}, {float(k)!r})" for i, (y, w, k) in enumerate(zip(_EQ.y, _EQ.weights, np.diag(_EQ.k_inv), strict=True)))


@query(f"SELECT CAST(i AS BIGINT) AS point, round(y, 6) AS y, round(y - w / k, 5) AS e, round(1 / k, 5) AS v FROM (VALUES {_LOO}) AS t(i, y, w, k)")
def leave_one_out(spark, sf_dir):
    """Refits without each training point, against the closed form from the inverse covariance."""
    d = spark.createDataFrame(diagnostics.k_fold_measure(EMS["q"], 1, spark))
    return d.select("point", F.round("y", 6).alias("y"), F.round("e", 5).alias("e"), F.round("v", 5).alias("v"))


@query(f"WITH {_VAL} SELECT l_discount, l_tax, round((y - (25.0 + 1.5 * a - 3.0 * b)) / 2, 6) AS residual FROM pts JOIN val USING (l_discount, l_tax) WHERE abs((y - (25.0 + 1.5 * a - 3.0 * b)) / 2) > 1")
def residuals(spark, sf_dir):
    return diagnostics.residual_diag(EMS["q"], _validation(spark, sf_dir), 1.0).select(*INPUTS, F.round("residual", 6).alias("residual"))


@query("SELECT * FROM (VALUES ('chol', true), ('cholpivot', true), ('eigen', true), ('normal', true)) AS t(errtype, meets)")
def error_types(spark, sf_dir):
    """Uncorrelated errors keep the Mahalanobis distance; plain ones the sum over deviations."""
    v = _validation(spark, sf_dir).withColumnRenamed("q", "r").toPandas()
    em = _em("r", lambda a, b: 0.0, [25.0, 0.0, 0.5], 1.0, Correlator.of("rat_quad", nugget=0.05, theta=0.7, alpha=1.5), trained=False)
    s = diagnostics.summary_diag(em, v)
    rows = []
    for k in ("normal", "eigen", "chol", "cholpivot"):
        total = float((diagnostics.individual_errors(em, v, k)["error"] ** 2).sum())
        rows.append((k, bool(abs(total - (s["chi"] if k == "normal" else s["mahalanobis"])) <= 1e-3 * abs(total))))
    return spark.createDataFrame(rows, "errtype string, meets boolean")


@query(values("kind, output, l_discount, l_tax", [("linear", "q", 1.5, -3.0), ("linear", "p", 1.0, 4.0), ("linear", "r", 0.0, 0.5), ("quadratic", "q", 0.0, 0.0), ("quadratic", "p", 0.0, 0.0), ("quadratic", "r", 0.0, 0.0)]))
def effects(spark, sf_dir):
    rows = [(k, r.output, float(r.l_discount), float(r.l_tax)) for k, quad in (("linear", False), ("quadratic", True)) for r in diagnostics.effect_strength(list(EMS.values()), quad).itertuples()]
    return spark.createDataFrame(rows, "kind string, output string, l_discount double, l_tax double")


@query("SELECT f AS failed, n, f <= n * 4.0 / 81 + 3 * sqrt(n * 4.0 / 81 * (1 - 4.0 / 81)) AS ok FROM (VALUES (0, 99), (5, 99), (11, 99), (12, 99), (40, 99)) AS t(f, n)")
def binomial_test(spark, sf_dir):
    return spark.createDataFrame([(f, 99, diagnostics.binomial_diagnostic_test(f, 99)) for f in (0, 5, 11, 12, 40)], "failed int, n int, ok boolean")


_CE = f"{_imp_sql('q', ZQ)} > 3 AND abs(24.0 - y) / 0.6 <= 3"


@query(f"{_QV}, d AS (SELECT * FROM q JOIN val USING (l_discount, l_tax)) SELECT 'ce' AS kind, l_discount, l_tax FROM d WHERE {_CE} UNION ALL SELECT 'cd', l_discount, l_tax FROM d WHERE q_v > 1e-5 AND abs(y - q_e) > 3 * sqrt(q_v) AND y BETWEEN 20.4 AND 27.6 UNION ALL SELECT 'se', l_discount, l_tax FROM d WHERE q_v > 1e-5 AND abs(y - q_e) > 3 * sqrt(q_v)")
def diagnostic_shorthands(spark, sf_dir):
    v = _validation(spark, sf_dir)
    parts = {"ce": diagnostics.classification_diag(EMS["q"], Z["q"], v), "cd": diagnostics.comparison_diag(EMS["q"], Z["q"], v).filter("v > 1e-5"), "se": diagnostics.standard_errors(EMS["q"], None, v).filter("v > 1e-5")}
    out = None
    for k, d in parts.items():
        d = d.select(F.lit(k).alias("kind"), *INPUTS)
        out = d if out is None else out.unionByName(d)
    return out


@query(f"WITH {_VAL},\n{_scored_sql('q', 'r')}, d AS (SELECT *, {_imp_sql('q', ZQ)} AS iq, {_imp_sql('r', ZR)} AS ir FROM q JOIN r USING (l_discount, l_tax) JOIN val USING (l_discount, l_tax)) SELECT l_discount, l_tax FROM d WHERE iq > 3 AND abs(24.0 - y) / 0.6 <= 3 AND ir < 3 UNION SELECT l_discount, l_tax FROM d WHERE ir > 3 AND abs(11.0 - (y - 13)) / 0.4 <= 3 AND iq < 3")
def concern_points(spark, sf_dir):
    v = _validation(spark, sf_dir).withColumn("r", F.col("q") - 13)
    return diagnostics.points_of_concern([EMS["q"], EMS["r"]], {"q": Z["q"], "r": Z["r"]}, v)


@query(f"WITH {_VAL},\n{_scored_sql('q')}, d AS (SELECT * FROM q JOIN val USING (l_discount, l_tax)) SELECT l_discount, l_tax, round(abs(y - q_e) / sqrt(greatest(q_v, 1e-12)), 3) AS max_error, round({_imp_sql('q', ZQ)}, 5) AS I FROM d WHERE q_v > 1e-4")
def validation_errors(spark, sf_dir):
    d = diagnostics.validation_pairs([EMS["q"]], _validation(spark, sf_dir), {"q": Z["q"]})
    return score.score(d, [EMS["q"]]).filter("q_var > 1e-4").select(*INPUTS, F.round("max_error", 3).alias("max_error"), F.round("I", 5).alias("I"))


# ------------------------------------------------------------------ plots

_G30 = "pts AS (SELECT i AS point_id, 0.1 * (i % {n}) / {m}.0 AS l_discount, 0.08 * ((i // {n}) % {n}) / {m}.0 AS l_tax, -1 + 2.0 * (i % {n}) / {m}.0 AS a, -1 + 2.0 * ((i // {n}) % {n}) / {m}.0 AS b FROM range({n} * {n}) AS t(i))"


def _grid_sql(n: int) -> str:
    m = ",\n".join(_moments_sql(EMS[k], "pts", "point_id", k) for k in "qpr")
    return f"WITH {_G30.format(n=n, m=n - 1)},\n{m},\nimp AS (SELECT point_id, l_discount, l_tax, {_imp_sql('q', ZQ)} AS q, {_imp_sql('p', ZP, EMS['p'].disc)} AS p, {_imp_sql('r', ZR)} AS r, q_e, q_v, p_e, p_v, r_e, r_v FROM q JOIN p USING (point_id) JOIN r USING (point_id) JOIN pts USING (point_id))\n"


_BAND = "CASE " + " ".join(f"WHEN I <= {b} THEN {i}" for i, b in enumerate(plotdata.BREAKS[:-1])) + f" ELSE {len(plotdata.BREAKS) - 1} END"


@query(_grid_sql(30) + f"SELECT point_id, round(l_discount, 8) AS l_discount, round(l_tax, 8) AS l_tax, round(I, 5) AS I, {_BAND} AS band FROM (SELECT *, greatest(q, p, r) AS I FROM imp)")
def implausibility_slice(spark, sf_dir):
    d = plotdata.emulator_plot(spark, list(EMS.values()), tuple(INPUTS), "nimp", Z, 30)
    return rounded(rounded(d, *INPUTS, places=8), "I", places=5)


@query(_grid_sql(12) + f"SELECT point_id, output, round(I, 5) AS I, {_BAND} AS band FROM (SELECT point_id, 'q' AS output, q AS I FROM imp UNION ALL SELECT point_id, 'p', p FROM imp UNION ALL SELECT point_id, 'r', r FROM imp)")
def slice_imp(spark, sf_dir):
    return plotdata.emulator_plot(spark, list(EMS.values()), tuple(INPUTS), "imp", Z, 12).select("point_id", "output", F.round("I", 5).alias("I"), "band")


@query(_grid_sql(12) + "SELECT point_id, round(q_e, 5) AS q_exp, round(p_e, 5) AS p_exp, round(q_v, 5) AS q_var, round(p_v, 5) AS p_var, round(sqrt(p_v), 4) AS p_sd FROM imp")
def slice_moments(spark, sf_dir):
    ems = [EMS["q"], EMS["p"]]
    e, v, s = (plotdata.emulator_plot(spark, ems, tuple(INPUTS), k, None, 12) for k in ("exp", "var", "sd"))
    j = e.select("point_id", F.round("q", 5).alias("q_exp"), F.round("p", 5).alias("p_exp")).join(v.select("point_id", F.round("q", 5).alias("q_var"), F.round("p", 5).alias("p_var")), "point_id")
    return j.join(s.select("point_id", F.round("p", 4).alias("p_sd")), "point_id")


_BIN = "CAST(least(29, greatest(0, floor({c} / ({w} / 30)))) AS INT)"
_B1, _B2 = _BIN.format(c="l_discount", w="0.1"), _BIN.format(c="l_tax", w="0.08")
_DEPTH = "round(min(I), 5) AS min_I, round(avg(CAST(I <= 3 AS INT)), 6) AS depth, count(*) AS n"


@query(_grid_sql(30) + f", l AS (SELECT greatest(q, p, r) AS I, {_B1} AS x, {_B2} AS y FROM imp) SELECT 'l_discount' AS x, CAST(NULL AS VARCHAR) AS y, x AS bin_x, CAST(NULL AS INT) AS bin_y, {_DEPTH} FROM l GROUP BY l.x UNION ALL SELECT 'l_tax', NULL, y, NULL, {_DEPTH} FROM l GROUP BY l.y UNION ALL SELECT 'l_tax', 'l_discount', y, x, {_DEPTH} FROM l GROUP BY l.x, l.y")
def lattice_all(spark, sf_dir):
    return rounded(rounded(plotdata.plot_lattice(spark, list(EMS.values()), Z, 30), "min_I", places=5), "depth")


@query(_grid_sql(15) + ", u AS (SELECT * FROM (VALUES (0.8), (1.0), (1.2)) AS u(u)), c AS (SELECT (i + 1) * 0.5 AS c FROM range(10) AS t(i)), s AS (SELECT point_id, u, greatest(abs(24.0 - q_e) / sqrt(q_v + pow(0.6 * u, 2)), (CASE WHEN p_e < 53 - 2 * u THEN 53 - 2 * u - p_e WHEN p_e > 53 + 2 * u THEN p_e - 53 - 2 * u ELSE 0 END) / sqrt(greatest(p_v + 0.05, 1e-4)), abs(11.0 - r_e) / sqrt(r_v + pow(0.4 * u, 2))) AS I FROM imp, u) SELECT CAST(u AS DOUBLE) AS u_mod, CAST(c AS DOUBLE) AS cutoff, round(avg(CAST(I > c AS INT)), 6) AS removed FROM s, c GROUP BY ALL")
def space_by_uncertainty(spark, sf_dir):
    return rounded(diagnostics.space_removed(spark, list(EMS.values()), Z, 15, (0.8, 1.0, 1.2)), "removed")


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'r')}\nSELECT 'q' AS output, round(q_e, 6) AS value, 22.2 AS lower, 25.8 AS upper FROM q UNION ALL SELECT 'r', round(r_e, 6), 9.8, 12.2 FROM r")
def output_bars(spark, sf_dir):
    d = plotdata.output_plot([EMS["q"], EMS["r"]], _points(spark, sf_dir), {k: Z[k] for k in "qr"})
    return d.select("output", F.round("value", 6).alias("value"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("SELECT DISTINCT l_discount, l_tax, false AS frame FROM lineitem UNION ALL SELECT 0.0, 0.0, true UNION ALL SELECT 0.1, 0.08, true")
def wrapped_points(spark, sf_dir):
    return plotdata.plot_wrap(_points(spark, sf_dir), RANGES)


@query("SELECT CAST(l_linenumber % 3 AS INT) AS wave, l_discount, l_tax FROM lineitem")
def points_by_wave(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return plotdata.wave_points([d.filter(f"l_linenumber % 3 = {k}") for k in range(3)], INPUTS)


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q')} SELECT CAST(l_linenumber % 2 AS INT) AS wave, l_orderkey, l_quantity AS q, round(q_e, 5) AS q_exp, round(sqrt(q_v), 4) AS q_sd, true AS apart FROM lineitem JOIN q USING (l_discount, l_tax)")
def values_by_wave(spark, sf_dir):
    """Outputs of the waves with the emulator's prediction; the pair that is never hit together is kept."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS, F.col("l_quantity").cast("double").alias("q"), F.col("l_quantity").cast("double").alias("s"))
    got, pairs = plotdata.wave_values([d.filter(f"l_linenumber % 2 = {k}") for k in (0, 1)], {"q": (0.0, 10.0), "s": (20.0, 30.0)}, [EMS["q"]], restrict=True)
    return got.select("wave", "l_orderkey", "q", F.round("q_exp", 5).alias("q_exp"), F.round("q_sd", 4).alias("q_sd"), F.lit(pairs == [("q", "s")]).alias("apart"))


@query("WITH w AS (SELECT count(*) AS n FROM lineitem) SELECT 'points' AS name, n FROM w UNION ALL SELECT 'values', n FROM w UNION ALL SELECT 'dependencies', 4 * n FROM w UNION ALL SELECT 'simulator', 2 * n FROM w UNION ALL SELECT 'hits', (SELECT count(*) FROM (SELECT DISTINCT l_linenumber % 2, CAST(l_quantity BETWEEN 13 AND 37 AS INT) + CAST(l_extendedprice BETWEEN 20000 AND 60000 AS INT) FROM lineitem))")
def wrapped_diagnostics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(*INPUTS, *OUTPUTS, "l_linenumber")
    frames = plotdata.diagnostic_wrap([d.filter(f"l_linenumber % 2 = {k}").drop("l_linenumber") for k in (0, 1)], LT, INPUTS)
    out = None
    for k, f in frames.items():
        r = f.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n")
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ design


def _logis(m: str, v: str, t: Target) -> str:
    lo, hi = t.bounds(3.0)
    f = lambda x: f"(1 / (1 + exp(-({x!r} - {m}) / sqrt(greatest({v}, 1e-12)) * {math.pi / math.sqrt(3)!r})))"
    return f"({f(hi)} - {f(lo)})"


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'r')}\nSELECT l_discount, l_tax, round({_logis('q_e', 'q_v', ZQ)} * {_logis('r_e', 'r_v', ZR)}, 4) AS p_hit FROM q JOIN r USING (l_discount, l_tax) WHERE q_v > 1e-4")
def hit_probability(spark, sf_dir):
    """How likely the targets are hit, each emulator's distribution taken as logistic."""
    d = score.hit_probabilities(_points(spark, sf_dir), [EMS["q"], EMS["r"]], {k: Z[k] for k in "qr"}, "logis")
    return score.score(d, [EMS["q"]]).filter("q_var > 1e-4").select(*INPUTS, F.round("p_hit", 4).alias("p_hit"))


def _meets(spark, points: pd.DataFrame, n: int, cutoff: float = 3.0):
    """One row: how many points, and whether all lie in the ranges, differ, and are not ruled out."""
    x = points[INPUTS].to_numpy(float)
    imp = idemc.implausibility_nth(EmulatorSet.of(list(EMS.values())), Z, x, 1)
    inside = all(bool(((x[:, i] >= lo) & (x[:, i] <= hi)).all()) for i, (lo, hi) in enumerate(RANGES.values()))
    return (len(x), inside, bool((imp <= cutoff + 1e-9).all()), len(np.unique(np.round(x, 12), axis=0)) == len(x))


_OPTIONS = {
    "usual": (("lhs", "line", "importance"), {}),
    "pca_lhs": (("lhs", "line"), {"pca_lhs": True}),
    "slice": (("lhs", "slice"), {}),
    "pca_slice": (("lhs", "slice"), {"pca_slice": True}),
    "normal": (("lhs", "importance"), {"imp_distro": "normal"}),
    "seek": (("lhs", "line"), {"seek": 4, "seek_distro": "logis"}),
    "uncollected": (("lhs", "line"), {"use_collect": False, "corners": True}),
    "clustered": (("lhs", "line"), {"cluster": True}),
}


@query(values("name, n, inside, plausible, distinct_", [(k, 24, True, True, True) for k in _OPTIONS]))
@quiet
def design_options(spark, sf_dir):
    """Points proposed with each option: as many as asked for, in the ranges, not ruled out, all different."""
    rows = []
    for k, (method, opts) in _OPTIONS.items():
        d = design.generate_new_design(spark, list(EMS.values()), 24, Z, method, opts=design.Options(**opts))
        rows.append((k, *_meets(spark, d.points, 24)))
    return spark.createDataFrame(rows, "name string, n int, inside boolean, plausible boolean, distinct_ boolean")


def _accept(df, ems, z, cutoff, n):
    return score.nth_implausible(df, ems, z, 1, cutoff=cutoff).withColumn("I", F.col("I") & (F.col("l_tax") < 0.05))


@query("SELECT 15 AS n, true AS inside, true AS plausible, true AS distinct_, true AS accepted")
@quiet
def own_acceptance(spark, sf_dir):
    """Points by an acceptance measure of the user's."""
    d = design.generate_new_design(spark, list(EMS.values()), 15, Z, opts=design.Options(accept=_accept))
    return spark.createDataFrame([(*_meets(spark, d.points, 15), bool((d.points["l_tax"] < 0.05).all()))], "n int, inside boolean, plausible boolean, distinct_ boolean, accepted boolean")


@query("SELECT 200 AS n, true AS inside, true AS plausible")
@quiet
def idemc_checked(spark, sf_dir):
    """Evolutionary Monte Carlo: its points are below the cutoff; chains may stand still."""
    d = idemc.idemc_runs(spark, EmulatorSet.of(list(EMS.values())), 50, Z, runs=4, s=200, mutations=4).toPandas()
    return spark.createDataFrame([_meets(spark, d, 200)[:3]], "n int, inside boolean, plausible boolean")


@query("SELECT 20 AS n, true AS rows, true AS apart")
def maximin_checked(spark, sf_dir):
    """The chosen rows are rows of the table, and lie further apart than its first random choice."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    got = design.maximin_sample(p, 20, ["p_size", "p_retailprice"], 200)
    there = got.join(p.distinct(), ["p_size", "p_retailprice"], "left_semi").count()
    m = p.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in p.columns for f in (F.avg, F.stddev_pop))).first()
    z = lambda d: np.column_stack([(d[c].to_numpy(float) - m[f"avg_{c}"]) / m[f"stddev_pop_{c}"] for c in p.columns])
    one = design.maximin_sample(p, 20, ["p_size", "p_retailprice"], 1)
    far = design._least_distance(z(got.toPandas())) >= design._least_distance(z(one.toPandas()))
    return spark.createDataFrame([(got.count(), there == 20, bool(far))], "n int, rows boolean, apart boolean")


@query("SELECT 3 AS emulators, 45 AS n, true AS inside, true AS plausible")
@quiet
def whole_wave(spark, sf_dir):
    """Split, train, diagnose, inflate and propose."""
    x = generators.lhs_array(120, simulators.SIRS_RANGES, np.random.default_rng(8))
    runs = spark.createDataFrame(pd.DataFrame(np.hstack([x, simulators.sirs(x)]), columns=[*simulators.SIRS_RANGES, "nS", "nI", "nR"]))
    w = diagnostics.full_wave(spark, runs, simulators.SIRS_RANGES, SIRS_Z, n_points=45, seed=2)
    p = w["points"][list(simulators.SIRS_RANGES)].to_numpy(float)
    inside = all(bool(((p[:, i] >= lo) & (p[:, i] <= hi)).all()) for i, (lo, hi) in enumerate(simulators.SIRS_RANGES.values()))
    imp = idemc.implausibility_nth(EmulatorSet.of(list(w["emulators"].values())), SIRS_Z, p, 1)
    return spark.createDataFrame([(len(w["emulators"]), len(p), inside, bool((imp <= w["cutoff"] + 1e-9).all()))], "emulators int, n int, inside boolean, plausible boolean")


@query(values("mode, surface, outputs", [("mode1", "expectation", 1), ("mode1", "variance", 1), ("mode2", "expectation", 1), ("mode2", "variance", 1), ("prop", "expectation", 1)]))
@quiet
def multistate_trained(spark, sf_dir):
    """Runs of two modes: emulators of both, and of their proportion."""
    d = table(spark, sf_dir, "lineitem").select(*INPUTS, F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity") + 500).otherwise(F.col("l_quantity")).alias("y"))
    got = train.emulator_from_data(d, ["y"], RANGES, "multistate", order=1)
    rows = [(m, s, len(v)) for m in ("mode1", "mode2") for s, v in got[m].items()] + [("prop", "expectation", int(got["prop"].name == "prop"))]
    return spark.createDataFrame(rows, "mode string, surface string, outputs int")
