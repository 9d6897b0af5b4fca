"""Registered queries of the emulation engine, each with the SQL that DuckDB checks it by where SQL can say it.

``lineitem`` is read as an ensemble: inputs l_discount and l_tax, replicated
outputs l_quantity and l_extendedprice. Emulators with fixed priors and nine
fixed training points score its rows as candidate points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.basis import Basis
from .functions.kernels import Correlator
from .functions.scalar import inside_ellipsoid, kurtosis_column, normalised, scale_input, significant
from .operators import cells, design, diagnostics, idemc, plotdata, score, stats, train
from .plans.collections import EmulatorSet
from .plans.emulator import Emulator
from .plans.targets import Target
from .sources import generators, simulators
from .streaming import waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: SQL that is made when it is asked for.
LATE: dict[str, Callable[[], str]] = {}

RANGES = {"l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}
INPUTS = list(RANGES)
OUTPUTS = ["l_quantity", "l_extendedprice"]
PLACES = 6


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, places: int = PLACES) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


# ------------------------------------------------------------------ fixed emulators

_GRID = np.array([(a, b) for a in (0.01, 0.05, 0.09) for b in (0.01, 0.04, 0.07)])


def _em(name: str, f: Callable, beta: list[float], sigma: float, corr: Correlator, basis: Basis | None = None, trained: bool = True, **more) -> Emulator:
    em = Emulator(basis=basis or Basis.linear(INPUTS), beta_mu=np.array(beta), sigma=sigma, ranges=RANGES, corr=corr, name=name, active=np.array([True, True]), **more)
    return em.adjust(_GRID, np.array([f(a, b) for a, b in _GRID])) if trained else em


EMS = {
    "q": _em("q", lambda a, b: 25 + 40 * a - 90 * b + 300 * a * b, [25.0, 1.5, -3.0], 2.0, Correlator.of("exp_sq", theta=0.8)),
    "p": _em("p", lambda a, b: 50 + math.sin(40 * a) * 6 + 100 * b, [52.0, 1.0, 4.0], 3.0, Correlator.of("matern", theta=0.9, nu=2.5), disc=(0.2, 0.1)),
    "r": _em("r", lambda a, b: 10 + 200 * (a - 0.05) ** 2 * 10 + b, [10.0, 0.0, 0.5], 1.0, Correlator.of("rat_quad", nugget=0.05, theta=0.7, alpha=1.5)),
}
WAVE2 = {k: e.set_sigma(e.sigma * 0.7) for k, e in EMS.items()}
PRIOR = _em("q", lambda a, b: 0.0, [25.0, 1.5, -3.0], 2.0, Correlator.of("exp_sq", theta=0.8), trained=False, beta_sigma=np.array([[0.5, -0.1, 0.2], [-0.1, 1.0, 0.0], [0.2, 0.0, 1.5]]))
Z = {"q": {"val": 24.0, "sigma": 0.6}, "p": (51.0, 55.0), "r": {"val": 11.0, "sigma": 0.4}}
ZQ, ZP, ZR = (Target.of(Z[k]) for k in "qpr")


def _lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


_A, _B = "((l_discount - 0.05) / 0.05)", "((l_tax - 0.04) / 0.04)"


def _kernel_sql(c: Correlator, s: str) -> str:
    hp = c.params
    t = hp["theta"]
    if c.name == "exp_sq":
        k = f"exp(-({s}) / {_lit(t * t)})"
    elif c.name == "orn_uhl":
        k = f"exp(-sqrt({s}) / {_lit(t)})"
    elif c.name == "gamma_exp":
        k = f"exp(-pow(sqrt({s}) / {_lit(t)}, {_lit(hp['gamma'])}))"
    elif c.name == "rat_quad":
        k = f"pow(1 + ({s}) / {_lit(2 * hp['alpha'] * t * t)}, {_lit(-hp['alpha'])})"
    else:
        r = f"(sqrt({s}) * {_lit(math.sqrt(2 * hp['nu']) / t)})"
        poly = {0.5: "1", 1.5: f"(1 + {r})", 2.5: f"(1 + {r} + {r} * {r} / 3)"}[hp["nu"]]
        k = f"{poly} * exp(-{r})"
    if c.nugget:
        k = f"({_lit(1 - c.nugget)} * ({k}) + CASE WHEN ({s}) < 1e-20 THEN {_lit(c.nugget)} ELSE 0 END)"
    return k


def _moments_sql(em: Emulator, src: str, keys: str, name: str) -> str:
    """(keys, <name>_e, <name>_v) for rows of ``src`` with scaled inputs a and b."""
    s2 = em.sigma**2
    train = ", ".join(f"({i}, {float(x[0])!r}, {float(x[1])!r}, {float(w)!r})" for i, (x, w) in enumerate(zip(em.x, em.weights, strict=True)))
    inv = ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(em.k_inv))
    k = _kernel_sql(em.corr, "(a - x) * (a - x) + (b - y) * (b - y)")
    prior = " + ".join(f"{_lit(v)} * {t}" for v, t in zip(em.beta_mu, ("1", "a", "b"), strict=True))
    return f"""{name}_c AS (SELECT {keys}, a, b, i, w, {s2!r} * ({k}) AS c FROM {src}, (VALUES {train}) AS t(i, x, y, w)),
{name}_m AS (SELECT {keys}, {prior} + sum(c * w) AS e FROM {name}_c GROUP BY {keys}, a, b),
{name}_s AS (SELECT {', '.join('p.' + c for c in keys.split(', '))}, {s2!r} - sum(p.c * v.v * o.c) AS v FROM {name}_c p JOIN (VALUES {inv}) AS v(i, j, v) ON p.i = v.i JOIN {name}_c o ON {' AND '.join(f'o.{c} = p.{c}' for c in keys.split(', '))} AND o.i = v.j GROUP BY {', '.join('p.' + c for c in keys.split(', '))}),
{name} AS (SELECT {', '.join('m.' + c for c in keys.split(', '))}, m.e AS {name}_e, CASE WHEN round(s.v, 10) < 0 THEN 1e-6 ELSE round(s.v, 10) END AS {name}_v FROM {name}_m m JOIN {name}_s s USING ({keys}))"""


def _imp_sql(name: str, t: Target, disc: tuple[float, float] = (0.0, 0.0)) -> str:
    d2 = sum(x * x for x in disc)
    if t.interval:
        return f"(CASE WHEN {name}_e < {t.lo} THEN {t.lo} - {name}_e WHEN {name}_e > {t.hi} THEN {name}_e - {t.hi} ELSE 0 END) / sqrt(greatest({name}_v + {d2!r}, 1e-4))"
    return f"abs({t.val!r} - {name}_e) / sqrt({name}_v + {t.sigma**2 + d2!r})"


#: The distinct input points of the ensemble, as SQL.
_POINTS_SQL = f"pts AS (SELECT DISTINCT l_discount, l_tax, {_A} AS a, {_B} AS b FROM lineitem)"
_KEYS = "l_discount, l_tax"


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*INPUTS).distinct()


def _scored_sql(*names: str, ems: dict | None = None, suffix: str = "") -> str:
    ems = ems or EMS
    return ",\n".join(_moments_sql(ems[n], "pts", _KEYS, n + suffix) for n in names)


# ------------------------------------------------------------------ projections


@query(f"SELECT l_orderkey, l_linenumber, round({_A}, 6) AS l_discount, round({_B}, 6) AS l_tax FROM lineitem")
def scale_inputs(spark, sf_dir):
    d = scale_input(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS), RANGES)
    return rounded(d, *INPUTS)


@query("SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem")
def scale_back(spark, sf_dir):
    d = scale_input(scale_input(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS), RANGES), RANGES, forward=False)
    return rounded(d, *INPUTS)


@query(f"SELECT DISTINCT l_discount, l_tax, round({_A}, 6) AS t1, round({_B}, 6) AS t2, round({_A} * {_A}, 6) AS t3, round({_A} * {_B}, 6) AS t4, round({_B} * {_B}, 6) AS t5 FROM lineitem")
def basis_terms(spark, sf_dir):
    p = _points(spark, sf_dir)
    b = Basis.full(INPUTS, 2)
    xs = score.scaled_inputs(PRIOR)
    cols = b.columns(xs)
    return p.select(*INPUTS, *(F.round(c, PLACES).alias(f"t{i}") for i, c in enumerate(cols) if i))


@query("SELECT p_partkey, CASE WHEN pow((p_size - 25.0) / 15.0, 2) + pow((p_retailprice - 950.0) / 40.0, 2) <= 1 THEN 1 ELSE 0 END AS inside FROM part")
def ellipsoid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", inside_ellipsoid([F.col("p_size"), F.col("p_retailprice")], [25.0, 950.0], [15.0, 40.0]).alias("inside"))


@query("SELECT round(sum(a * a), 4) AS s00, round(sum(a * b), 4) AS s01, round(sum(b * b), 4) AS s11, round(sum(a * y), 2) AS s02, round(sum(b * y), 2) AS s12 FROM (SELECT " + _A + " AS a, " + _B + " AS b, l_quantity AS y FROM lineitem)")
def gram_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    xs = score.scaled_inputs(PRIOR)
    g = stats.gram(d, [*xs, F.col("l_quantity")])
    return spark.createDataFrame([tuple(round(float(v), k) for v, k in ((g[0, 0], 4), (g[0, 1], 4), (g[1, 1], 4), (g[0, 2], 2), (g[1, 2], 2)))], "s00 double, s01 double, s11 double, s02 double, s12 double")


# ------------------------------------------------------------------ statistics


@query("SELECT greatest(0.0, min(l_discount) - 0.05 * (max(l_discount) - min(l_discount))) AS d_lo, least(0.1, max(l_discount) + 0.05 * (max(l_discount) - min(l_discount))) AS d_hi, greatest(-1.0, min(l_tax) - 0.05 * (max(l_tax) - min(l_tax))) AS t_lo, least(1.0, max(l_tax) + 0.05 * (max(l_tax) - min(l_tax))) AS t_hi FROM lineitem")
def range_shrink(spark, sf_dir):
    r = stats.shrink_ranges(table(spark, sf_dir, "lineitem"), {"l_discount": (0.0, 0.1), "l_tax": (-1.0, 1.0)})
    return spark.createDataFrame([(*r["l_discount"], *r["l_tax"])], "d_lo double, d_hi double, t_lo double, t_hi double")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0.01 AND 0.05")
def in_range_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS).filter(stats.in_range({"l_discount": (0.02, 0.06), "l_tax": (0.01, 0.05)}))


_REP = """SELECT l_discount, l_tax, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v, stddev_samp(l_quantity) AS sd, kurtosis_pop(l_quantity) + 3 AS k FROM lineitem GROUP BY ALL"""


@query(f"SELECT l_discount, l_tax, n, round(m, 6) AS l_quantity_mean, round(v, 6) AS l_quantity_var, round(sd, 6) AS l_quantity_sd, round(k, 6) AS l_quantity_kurt, round(CASE WHEN n > 1 THEN v * v * (k - 1 + 2.0 / (n - 1)) / n END, 4) AS l_quantity_vofv FROM ({_REP})")
def replicate_stats(spark, sf_dir):
    r = stats.replicates(table(spark, sf_dir, "lineitem"), INPUTS, ["l_quantity"])
    r = rounded(r, "l_quantity_mean", "l_quantity_var", "l_quantity_sd", "l_quantity_kurt").withColumn("l_quantity_vofv", F.round("l_quantity_vofv", 4))
    return r.select(*INPUTS, "n", "l_quantity_mean", "l_quantity_var", "l_quantity_sd", "l_quantity_kurt", "l_quantity_vofv")


@query("SELECT l_returnflag, round(kurtosis_pop(l_extendedprice) + 3, 6) AS kurt FROM lineitem GROUP BY 1")
def kurtosis(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(kurtosis_column("l_extendedprice"), PLACES).alias("kurt"))


@query(f"SELECT round(CASE WHEN sum(kk) < 2 THEN 3.0 ELSE coalesce(avg(kk), 3.0) END, 6) AS l_quantity FROM (SELECT CASE WHEN n > 1 AND (k - 1 + 2.0 / (n - 1)) / n <= 1 THEN k END AS kk FROM ({_REP}))")
def mean_kurtosis(spark, sf_dir):
    r = stats.replicates(table(spark, sf_dir, "lineitem"), INPUTS, ["l_quantity"])
    return rounded(stats.mean_kurtosis(r, ["l_quantity"]), "l_quantity")


@query("SELECT l_discount, l_tax, count(*) AS n, round(var_samp(l_quantity), 6) AS l_quantity_l_quantity, round(covar_samp(l_quantity, l_extendedprice), 3) AS l_quantity_l_extendedprice, round(var_samp(l_extendedprice), 1) AS l_extendedprice_l_extendedprice FROM lineitem GROUP BY ALL")
def replicate_cov(spark, sf_dir):
    c = stats.covariances(table(spark, sf_dir, "lineitem"), INPUTS, OUTPUTS)
    return c.withColumns({"l_quantity_l_quantity": F.round("l_quantity_l_quantity", 6), "l_quantity_l_extendedprice": F.round("l_quantity_l_extendedprice", 3), "l_extendedprice_l_extendedprice": F.round("l_extendedprice_l_extendedprice", 1)})


@query("""WITH v AS (SELECT l_discount, l_tax, var_samp(l_quantity) AS q1, var_samp(l_extendedprice) AS p1, var_samp(l_quantity * (1 + l_linenumber)) AS q2, var_samp(l_extendedprice * l_linenumber) AS p2 FROM lineitem GROUP BY ALL)
SELECT 'q' AS a, 'p' AS b, round((corr(q1, p1) + corr(q2, p2)) / 2, 6) AS rho FROM v""")
def rho_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(*INPUTS, F.col("l_quantity").alias("q1"), F.col("l_extendedprice").alias("p1"), (F.col("l_quantity") * (1 + F.col("l_linenumber"))).alias("q2"), (F.col("l_extendedprice") * F.col("l_linenumber")).alias("p2"))
    return rounded(stats.rho_estimate(d, INPUTS, ["q1", "p1", "q2", "p2"]), "rho")


@query("SELECT l_discount, l_tax, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity) / count(*), 6) AS var, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def clean_data(spark, sf_dir):
    return rounded(stats.clean_data(table(spark, sf_dir, "lineitem"), INPUTS, "l_quantity"), "mean", "var")


@query("WITH p AS (SELECT l_discount, l_tax, avg(l_quantity) AS q, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_discount, l_tax, round(q, 6) AS l_quantity, (SELECT round(avg(v), 6) FROM p) AS l_quantity_rep FROM p")
def collapse_default(spark, sf_dir):
    return rounded(stats.collapse(table(spark, sf_dir, "lineitem"), INPUTS, ["l_quantity"]), "l_quantity", "l_quantity_rep")


LT = {"l_quantity": {"val": 25.0, "sigma": 4.0}, "l_extendedprice": (20000.0, 60000.0)}
_HQ, _HP = "CAST(l_quantity BETWEEN 13.0 AND 37.0 AS INT)", "CAST(l_extendedprice BETWEEN 20000.0 AND 60000.0 AS INT)"


@query(f"SELECT l_orderkey, l_linenumber, {_HQ} AS hit_l_quantity, {_HP} AS hit_l_extendedprice FROM lineitem")
def target_hits(spark, sf_dir):
    return stats.hits(table(spark, sf_dir, "lineitem"), LT).select("l_orderkey", "l_linenumber", "hit_l_quantity", "hit_l_extendedprice")


@query("""SELECT l_discount, l_tax, CAST(avg(l_quantity) - 3 * stddev_samp(l_quantity) / sqrt(count(*)) <= 25.5 AND avg(l_quantity) + 3 * stddev_samp(l_quantity) / sqrt(count(*)) >= 25.0 AS INT) AS hit_l_quantity FROM lineitem GROUP BY ALL""")
def overlap_hits(spark, sf_dir):
    return stats.overlap_hits(table(spark, sf_dir, "lineitem"), INPUTS, {"l_quantity": (25.0, 25.5)})


_WAVE = "CAST(year(l_shipdate) - 1992 AS INT)"


def _waves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("wave", (F.year("l_shipdate") - 1992).cast("int"))


@query(f"SELECT {_WAVE} AS wave, {_HQ} + {_HP} AS hits, count(*) AS count FROM lineitem GROUP BY ALL")
def hit_by_wave(spark, sf_dir):
    return stats.hit_by_wave(_waves(spark, sf_dir), LT, INPUTS)


@query(f"SELECT wave, o AS output, c AS count FROM (SELECT {_WAVE} AS wave, 'l_quantity' AS o, sum({_HQ}) AS c FROM lineitem GROUP BY ALL UNION ALL SELECT {_WAVE}, 'l_extendedprice', sum({_HP}) FROM lineitem GROUP BY ALL)")
def hit_by_output(spark, sf_dir):
    return stats.hit_by_wave(_waves(spark, sf_dir), LT, INPUTS, by_hit=False)


@query(f"WITH p AS (SELECT {_WAVE} AS wave, l_discount, l_tax, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY ALL) SELECT wave, CAST(q BETWEEN 24.0 AND 26.0 AS INT) + CAST(e BETWEEN 30000.0 AND 50000.0 AS INT) AS hits, count(*) AS count FROM p GROUP BY ALL")
def hit_by_wave_mean(spark, sf_dir):
    return stats.hit_by_wave(_waves(spark, sf_dir), {"l_quantity": (24.0, 26.0), "l_extendedprice": (30000.0, 50000.0)}, INPUTS, "mean")


@query(f"WITH p AS (SELECT {_WAVE} AS wave, l_discount, l_tax, avg(l_quantity) AS m, coalesce(stddev_samp(l_quantity), 0) / sqrt(count(*)) AS s FROM lineitem GROUP BY ALL) SELECT wave, CAST(m - 3 * s <= 24.5 AND m + 3 * s >= 24.0 AS INT) AS hits, count(*) AS count FROM p GROUP BY ALL")
def hit_by_wave_stoch(spark, sf_dir):
    return stats.hit_by_wave(_waves(spark, sf_dir), {"l_quantity": (24.0, 24.5)}, INPUTS, "stoch")


@query(f"SELECT max({_HQ}) AS hit_q, max({_HP}) AS hit_p, round(corr({_HQ}, {_HP}), 6) AS c FROM lineitem")
def hit_pair_corr(spark, sf_dir):
    d = stats.hits(table(spark, sf_dir, "lineitem"), LT)
    return d.agg(F.max("hit_l_quantity").alias("hit_q"), F.max("hit_l_extendedprice").alias("hit_p"), F.round(stats.corr("hit_l_quantity", "hit_l_extendedprice"), PLACES).alias("c"))


@query("SELECT count(*) AS n, round(regr_r2(CAST(l_quantity > 40 AS INT), l_extendedprice), 6) AS r2, round(1 - (1 - regr_r2(CAST(l_quantity > 40 AS INT), l_extendedprice)) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2 FROM lineitem")
def structured_error(spark, sf_dir):
    return rounded(stats.structured_error(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 40, "l_extendedprice"), "r2", "adj_r2")


# ------------------------------------------------------------------ kernels

_PAIRS = f"WITH pts AS (SELECT DISTINCT l_discount, l_tax, {_A} AS a, {_B} AS b FROM lineitem) SELECT p.l_discount AS d1, p.l_tax AS t1, q.l_discount AS d2, q.l_tax AS t2, {{k}} AS k FROM pts p, pts q"
_S = "((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))"


def _pairs(spark, sf_dir, column: Callable) -> DataFrame:
    """All pairs of the 99 (at most) design points; both sides are the small design."""
    p = scale_input(_points(spark, sf_dir).withColumns({"d": F.col("l_discount"), "t": F.col("l_tax")}), RANGES)
    x = p.toDF("a1", "b1", "d1", "t1")
    y = p.toDF("a2", "b2", "d2", "t2")
    return x.crossJoin(F.broadcast(y)).select("d1", "t1", "d2", "t2", F.round(column([F.col("a1"), F.col("b1")], [F.col("a2"), F.col("b2")]), PLACES).alias("k"))


def _add_kernel(name: str, c: Correlator) -> None:
    query(_PAIRS.format(k=f"round({_kernel_sql(c, _S)}, 6)"), f"kernel_{name}")(lambda spark, sf_dir, c=c: _pairs(spark, sf_dir, c.column))


for _n, _c in {
    "exp_sq": Correlator.of("exp_sq", theta=0.6),
    "matern12": Correlator.of("matern", theta=0.6, nu=0.5),
    "matern32": Correlator.of("matern", theta=0.6, nu=1.5),
    "matern52": Correlator.of("matern", theta=0.6, nu=2.5),
    "orn_uhl": Correlator.of("orn_uhl", theta=0.6),
    "gamma_exp": Correlator.of("gamma_exp", theta=0.6, gamma=1.3),
    "rat_quad": Correlator.of("rat_quad", theta=0.6, alpha=1.7),
    "nugget": Correlator.of("exp_sq", 0.1, theta=0.6),
}.items():
    _add_kernel(_n, _c)

query(_PAIRS.format(k="round(exp(-(p.a - q.a) * (p.a - q.a) / 0.36 - (p.b - q.b) * (p.b - q.b) / 0.81), 6)"), "kernel_exp_sq_vector")(lambda spark, sf_dir: _pairs(spark, sf_dir, Correlator("exp_sq", (("theta", np.array([0.6, 0.9])),)).column))
query(_PAIRS.format(k=f"round(sqrt({_S}), 6)"), "point_distance")(lambda spark, sf_dir: _pairs(spark, sf_dir, lambda x, y: F.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2)))
query(_PAIRS.format(k=f"round(-2 / 0.36 * (p.a - q.a) * exp(-{_S} / 0.36), 6)"), "kernel_exp_sq_d")(lambda spark, sf_dir: _pairs(spark, sf_dir, lambda x, y: Correlator.of("exp_sq", theta=0.6).column_d(x, y, 0)))
query(_PAIRS.format(k=f"round((2 / 0.36 - 4 / 0.1296 * (p.a - q.a) * (p.a - q.a)) * exp(-{_S} / 0.36), 6)"), "kernel_exp_sq_d2")(lambda spark, sf_dir: _pairs(spark, sf_dir, lambda x, y: Correlator.of("exp_sq", theta=0.6).column_d(x, y, 0, 0)))
query(_PAIRS.format(k=f"round(-5 / (3 * 0.36) * (p.a - q.a) * (1 + sqrt(5 * {_S}) / 0.6) * exp(-sqrt(5 * {_S}) / 0.6), 6)"), "kernel_matern52_d")(lambda spark, sf_dir: _pairs(spark, sf_dir, lambda x, y: Correlator.of("matern", theta=0.6, nu=2.5).column_d(x, y, 0)))
query(_PAIRS.format(k=f"round(-(p.b - q.b) / 0.36 * pow(1 + {_S} / (2 * 1.7 * 0.36), -2.7), 6)"), "kernel_rat_quad_d")(lambda spark, sf_dir: _pairs(spark, sf_dir, lambda x, y: Correlator.of("rat_quad", theta=0.6, alpha=1.7).column_d(x, y, 1)))


#: Rows of a block of a label's vectors, at least.
BLOCK = 1_000


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings) SELECT a.vec_id AS v1, b.vec_id AS v2, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))), 5) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""")
def pairwise_dist(spark, sf_dir):
    """All pairs of a label: quadratic by nature; vectors are dealt to pairs of blocks, so no task holds a label and few copies of a vector move."""
    d = cells.pairs_of_groups(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", BLOCK)
    return d.select(F.col("key").alias("v1"), F.col("other").alias("v2"), F.round("distance", 5).alias("d"))


# ------------------------------------------------------------------ scoring


@query(f"SELECT DISTINCT l_discount, l_tax, round(25.0 + 1.5 * {_A} - 3.0 * {_B}, 6) AS e, round(4.0 + 0.5 + 2 * -0.1 * {_A} + 2 * 0.2 * {_B} + {_A} * {_A} + 1.5 * {_B} * {_B}, 6) AS v FROM lineitem")
def prior_moments(spark, sf_dir):
    return _points(spark, sf_dir).select(*INPUTS, F.round(score.prior_mean(PRIOR), PLACES).alias("e"), F.round(score.prior_var(PRIOR), PLACES).alias("v"))


def _mean(name: str):
    def run(spark, sf_dir):
        return _points(spark, sf_dir).select(*INPUTS, F.round(score.mean_column(EMS[name]), PLACES).alias("e"))

    return run


for _n in EMS:
    query(f"WITH {_POINTS_SQL},\n{_scored_sql(_n)}\nSELECT l_discount, l_tax, round({_n}_e, 6) AS e FROM {_n}", f"adjusted_mean_{_n}")(_mean(_n))


@query(f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'p', 'r')}\nSELECT l_discount, l_tax, round(q_e, 6) AS q_exp, round(q_v, 6) AS q_var, round(p_e, 6) AS p_exp, round(p_v, 6) AS p_var, round(r_e, 6) AS r_exp, round(r_v, 6) AS r_var FROM q JOIN p USING (l_discount, l_tax) JOIN r USING (l_discount, l_tax)")
def adjusted_moments(spark, sf_dir):
    d = score.score(_points(spark, sf_dir), list(EMS.values()))
    return rounded(d, *(c for c in d.columns if c not in INPUTS))


_BASE = f"WITH {_POINTS_SQL},\n{_scored_sql('q', 'p', 'r')},\nimp AS (SELECT l_discount, l_tax, {_imp_sql('q', ZQ)} AS q, {_imp_sql('p', ZP, EMS['p'].disc)} AS p, {_imp_sql('r', ZR)} AS r FROM q JOIN p USING (l_discount, l_tax) JOIN r USING (l_discount, l_tax))\n"


@query(_BASE + "SELECT l_orderkey, l_linenumber, round(greatest(q, p, r), 6) AS I FROM lineitem JOIN imp USING (l_discount, l_tax)")
def nth_1(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *INPUTS)
    return rounded(score.nth_implausible(d, list(EMS.values()), Z, 1), "I").select("l_orderkey", "l_linenumber", "I")


@query(_BASE + "SELECT l_discount, l_tax, round(list_sort([q, p, r])[2], 6) AS I FROM imp")
def nth_2(spark, sf_dir):
    return rounded(score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 2), "I")


@query(_BASE + "SELECT l_discount, l_tax, round(least(greatest(q, p, r), 4.0), 6) AS I FROM imp")
def nth_capped(spark, sf_dir):
    return rounded(score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1, max_imp=4.0), "I")


@query(_BASE + "SELECT l_discount, l_tax, round(q, 6) AS q, round(p, 6) AS p, round(r, 6) AS r FROM imp")
def implausibility_raw(spark, sf_dir):
    return rounded(score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, get_raw=True), "q", "p", "r")


@query(_BASE + "SELECT l_discount, l_tax, CAST(q <= 3 AS INT) + CAST(p <= 3 AS INT) + CAST(r <= 3 AS INT) > 1 AS I FROM imp")
def votes(spark, sf_dir):
    return score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 2, cutoff=3.0)


@query(_BASE + "SELECT l_discount, l_tax, q <= 3 AND p <= 2 AND r <= 2.5 AS I FROM imp")
def votes_by_cutoff(spark, sf_dir):
    return score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1, cutoff=[3.0, 2.0, 2.5])


@query(_BASE + "SELECT l_discount, l_tax, q <= 3 AND p <= 3 AND r <= 3 AS I FROM imp")
def sequential(spark, sf_dir):
    return score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1, cutoff=3.0, sequential=True)


_TWO = _BASE.rstrip() + ",\n" + _scored_sql("q", ems=WAVE2, suffix="2") + f",\nimp2 AS (SELECT l_discount, l_tax, {_imp_sql('q2', ZQ)} AS q2 FROM q2)\n"


@query(_TWO + "SELECT l_discount, l_tax, round(greatest(q, p, r, q2), 6) AS I FROM imp JOIN imp2 USING (l_discount, l_tax)")
def multi_wave_max(spark, sf_dir):
    return rounded(score.nth_implausible(_points(spark, sf_dir), [[WAVE2["q"]], list(EMS.values())], Z, 1), "I")


@query(_TWO + "SELECT l_discount, l_tax, round(least(q, q2), 6) AS I FROM imp JOIN imp2 USING (l_discount, l_tax)")
def mode_min(spark, sf_dir):
    return rounded(score.nth_implausible(_points(spark, sf_dir), {"mode1": [EMS["q"]], "mode2": [WAVE2["q"]]}, {"q": Z["q"]}, 1), "I")


@query(_TWO + "SELECT l_discount, l_tax, round(greatest(q, q2), 6) AS I FROM imp JOIN imp2 USING (l_discount, l_tax)")
def variance_surfaces(spark, sf_dir):
    z = {"expectation": {"q": Z["q"]}, "variance": {"q": Z["q"]}}
    return rounded(score.nth_implausible(_points(spark, sf_dir), {"expectation": [EMS["q"]], "variance": [WAVE2["q"]]}, z, 1), "I")


@query(f"WITH {_POINTS_SQL}, t AS (SELECT * FROM (VALUES " + ", ".join(f"({float(x[0])!r}, {float(x[1])!r}, {float(w)!r})" for x, w in zip(EMS["q"].x, EMS["q"].weights, strict=True)) + f") AS t(x, y, w)) SELECT l_discount, l_tax, round((1.5 + sum(w * 4.0 * (-2 / 0.64) * (a - x) * exp(-((a - x) * (a - x) + (b - y) * (b - y)) / {0.8 * 0.8!r}))) / 0.05, 4) AS d FROM pts, t GROUP BY l_discount, l_tax")
def expected_derivative(spark, sf_dir):
    return _points(spark, sf_dir).select(*INPUTS, F.round(score.mean_d_column(EMS["q"], "l_discount"), 4).alias("d"))


@query(_BASE + "SELECT 'q' AS output, round(1 - avg(CAST(q <= 3 AS INT)), 6) AS removed FROM imp UNION ALL SELECT 'p', round(1 - avg(CAST(p <= 3 AS INT)), 6) FROM imp UNION ALL SELECT 'r', round(1 - avg(CAST(r <= 3 AS INT)), 6) FROM imp")
def space_removal(spark, sf_dir):
    return rounded(diagnostics.space_removal(spark, list(EMS.values()), Z, _points(spark, sf_dir)), "removed")


# ------------------------------------------------------------------ diagnostics

#: Validation runs: the mean quantity of each point as output q.
_VAL = f"{_POINTS_SQL}, val AS (SELECT l_discount, l_tax, avg(l_quantity) AS y FROM lineitem GROUP BY ALL)"


def _validation(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(*INPUTS).agg(F.avg("l_quantity").alias("q"))


_DIAG = f"WITH {_VAL},\n{_scored_sql('q')}\nSELECT l_discount, l_tax, "


@query(_DIAG + "round((q_e - y) / sqrt(q_v), 4) AS error FROM q JOIN val USING (l_discount, l_tax) WHERE q_v > 1e-5")
def diagnostic_se(spark, sf_dir):
    d = diagnostics.get_diagnostic(EMS["q"], _validation(spark, sf_dir), "se")
    return d.filter("v > 1e-5").select(*INPUTS, F.round("error", 4).alias("error"))


@query(_DIAG + "round(q_e, 5) AS e, round(3 * sqrt(q_v), 5) AS unc FROM q JOIN val USING (l_discount, l_tax)")
def diagnostic_cd(spark, sf_dir):
    return diagnostics.get_diagnostic(EMS["q"], _validation(spark, sf_dir), "cd").select(*INPUTS, F.round("e", 5).alias("e"), F.round("unc", 5).alias("unc"))


@query(_DIAG + f"round({_imp_sql('q', ZQ)}, 5) AS em_imp, round(abs(24.0 - y) / 0.6, 5) AS sim_imp FROM q JOIN val USING (l_discount, l_tax)")
def diagnostic_ce(spark, sf_dir):
    return diagnostics.get_diagnostic(EMS["q"], _validation(spark, sf_dir), "ce", Z["q"]).select(*INPUTS, F.round("em_imp", 5).alias("em_imp"), F.round("sim_imp", 5).alias("sim_imp"))


@query(f"WITH {_VAL},\n{_scored_sql('q')}, d AS (SELECT * FROM q JOIN val USING (l_discount, l_tax)) SELECT DISTINCT l_discount, l_tax FROM d WHERE (abs(y - q_e) > 3 * sqrt(q_v) AND y BETWEEN {24 - 6 * 0.6} AND {24 + 6 * 0.6}) OR ({_imp_sql('q', ZQ)} > 3 AND abs(24.0 - y) / 0.6 <= 3)")
def failing_points(spark, sf_dir):
    return diagnostics.validation_diagnostics([EMS["q"]], {"q": Z["q"]}, _validation(spark, sf_dir), ("cd", "ce"))


@query(f"WITH {_VAL},\n{_scored_sql('q')} SELECT count(*) AS m, round(sum((y - q_e) * (y - q_e) / greatest(q_v, 0.01)), 2) AS chi FROM q JOIN val USING (l_discount, l_tax)")
def chi_squared(spark, sf_dir):
    d = diagnostics.scored_validation(EMS["q"], _validation(spark, sf_dir))
    return d.agg(F.count("*").alias("m"), F.round(F.sum((F.col("y") - F.col("e")) ** 2 / F.greatest("v", F.lit(0.01))), 2).alias("chi"))


# ------------------------------------------------------------------ generated points and plot data


@query("SELECT i AS point_id, round((i % 7) / 6.0, 6) AS x, round(-1 + 2 * ((i // 7) % 7) / 6.0, 6) AS y, round(5 + 5 * (i // 49) / 6.0, 6) AS z FROM range(343) AS t(i)")
def grid_expand(spark, sf_dir):
    return rounded(generators.grid(spark, {"x": (0.0, 1.0), "y": (-1.0, 1.0), "z": (5.0, 10.0)}, 7), "x", "y", "z")


@query("SELECT i AS point_id, round((i * 7 % 1009 + 0.5) / 1009, 6) AS x, round(-1 + 2 * ((i * 103 + 1) % 1009 + 0.5) / 1009, 6) AS y FROM range(1009) AS t(i)")
def lattice_lhs(spark, sf_dir):
    return rounded(generators.lattice_lhs(spark, {"x": (0.0, 1.0), "y": (-1.0, 1.0)}, 1009, [7, 103]), "x", "y")


@query(_BASE + "SELECT CAST(least(4, greatest(0, floor(l_discount / 0.02))) AS INT) AS b_l_discount, CAST(least(4, greatest(0, floor(l_tax / 0.016))) AS INT) AS b_l_tax, round(min(greatest(q, p, r)), 6) AS min_I, round(avg(CAST(greatest(q, p, r) <= 3 AS INT)), 6) AS depth, count(*) AS n FROM imp GROUP BY ALL")
def lattice_2d(spark, sf_dir):
    d = score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1)
    d = plotdata.depth(plotdata.lattice_bins(d, RANGES, 5, tuple(INPUTS)), ["b_l_discount", "b_l_tax"], 3.0)
    return rounded(d, "min_I", "depth")


@query(_BASE + "SELECT CAST(least(4, greatest(0, floor(l_discount / 0.02))) AS INT) AS b_l_discount, round(min(greatest(q, p, r)), 6) AS min_I, round(avg(CAST(greatest(q, p, r) <= 3 AS INT)), 6) AS depth, count(*) AS n FROM imp GROUP BY ALL")
def lattice_1d(spark, sf_dir):
    d = score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1)
    return rounded(plotdata.depth(plotdata.lattice_bins(d, RANGES, 5, ("l_discount",)), ["b_l_discount"], 3.0), "min_I", "depth")


@query(_BASE + "SELECT round(max(i), 6) AS cutoff FROM (SELECT greatest(q, p, r) AS i FROM imp ORDER BY i LIMIT 10)")
def kth_cutoff(spark, sf_dir):
    k = design.kth_smallest(score.nth_implausible(_points(spark, sf_dir), list(EMS.values()), Z, 1), 10)
    return spark.createDataFrame([(round(k, PLACES),)], "cutoff double")


@query("""WITH w AS (SELECT l_orderkey AS line, l_linenumber AS step, l_quantity > 20 AS ok FROM lineitem), d AS (SELECT line, step, bool_or(ok) AS ok FROM w GROUP BY ALL),
e AS (SELECT line, step, ok, coalesce(lag(ok) OVER (PARTITION BY line ORDER BY step), false) AS before, coalesce(lead(ok) OVER (PARTITION BY line ORDER BY step), false) AS after FROM d) SELECT line, step FROM e WHERE ok AND NOT (before AND after)""")
def line_boundary(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") > 20).alias("ok"))
    return design.boundary(d.groupBy("line", "step").agg(F.bool_or("ok").alias("ok")))


@query("SELECT count(*) AS n, round(sum(k), 2) AS s FROM (SELECT DISTINCT round_even(l_extendedprice * pow(10, 1 - floor(log10(l_extendedprice))), 0) / pow(10, 1 - floor(log10(l_extendedprice))) AS k FROM lineitem)")
def sig_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(significant(F.col("l_extendedprice"), 2).alias("k"))
    d = design.dedupe(d, ["k"])
    return d.agg(F.count("*").alias("n"), F.round(F.sum("k"), 2).alias("s"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def rows_semi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT 0 AS wave, event_type, value FROM events WHERE day(ts) <= 10 UNION ALL SELECT 1, event_type, value FROM events WHERE day(ts) > 10 AND day(ts) <= 20 UNION ALL SELECT 2, event_type, value FROM events WHERE day(ts) > 20")
def wave_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.dayofmonth("ts"))
    parts = [e.filter("d <= 10"), e.filter("d > 10 and d <= 20"), e.filter("d > 20")]
    return stats.wave_union([p.select("event_type", "value") for p in parts])


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n, round(avg(CAST(value BETWEEN 20.0 AND 80.0 AS INT)), 6) AS rate_value FROM events GROUP BY 1")
def windowed_hit_rates(spark, sf_dir):
    return rounded(waves.hit_rates(table(spark, sf_dir, "events"), {"value": (20.0, 80.0)}), "rate_value")


@query("SELECT i AS input, x, o AS output, y, CASE o WHEN 'l_quantity' THEN 13.0 ELSE 20000.0 END AS lower, CASE o WHEN 'l_quantity' THEN 37.0 ELSE 60000.0 END AS upper FROM (SELECT 'l_discount' AS i, l_discount AS x, 'l_quantity' AS o, l_quantity AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax, 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_tax', l_tax, 'l_extendedprice', l_extendedprice FROM lineitem)")
def behaviour(spark, sf_dir):
    return plotdata.behaviour_plot(table(spark, sf_dir, "lineitem"), INPUTS, OUTPUTS, LT)


@query("SELECT wave, CAST(l_discount AS DOUBLE) AS x, 'l_discount' AS input, 'l_quantity' AS output, CAST(l_quantity AS DOUBLE) AS y FROM (SELECT CAST(l_linenumber % 2 AS INT) AS wave, * FROM lineitem)")
def wave_dependencies(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return plotdata.wave_dependencies([d.filter("l_linenumber % 2 = 0"), d.filter("l_linenumber % 2 = 1")], ["l_discount"], ["l_quantity"])


@query("SELECT wave, o AS output, round(sum(v), 3) AS total, count(*) AS n FROM (SELECT CAST(l_linenumber % 2 AS INT) AS wave, 'l_quantity' AS o, (2 * l_quantity - 50.0) / 24.0 AS v FROM lineitem UNION ALL SELECT CAST(l_linenumber % 2 AS INT), 'l_extendedprice', (2 * l_extendedprice - 80000.0) / 40000.0 FROM lineitem) GROUP BY ALL")
def simulator_values(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    s = plotdata.simulator_plot([d.filter("l_linenumber % 2 = 0"), d.filter("l_linenumber % 2 = 1")], LT, normalise=True)
    return s.groupBy("wave", "output").agg(F.round(F.sum("value"), 3).alias("total"), F.count("*").alias("n"))


@query("SELECT o_orderkey, round((2 * o_totalprice - 100000.0) / 80000.0, 8) AS x FROM orders")
def normalised_outputs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(normalised(F.col("o_totalprice"), 10000.0, 90000.0), 8).alias("x"))


# ------------------------------------------------------------------ not SQL


def _runs(spark) -> DataFrame:
    x = generators.lhs_array(60, simulators.SIRS_RANGES, np.random.default_rng(3))
    y = simulators.sirs(x)
    return spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=[*simulators.SIRS_RANGES, "nS", "nI", "nR"]))


SIRS_Z = {"nS": (580.0, 651.0), "nI": {"val": 169.0, "sigma": 8.45}, "nR": (199.0, 221.0)}


@query()
def trained_sirs(spark, sf_dir):
    ems = train.train(_runs(spark), ["nS", "nI", "nR"], simulators.SIRS_RANGES)
    return score.nth_implausible(generators.lhs(spark, simulators.SIRS_RANGES, 20_000, 1), list(ems.values()), SIRS_Z)


@query()
def proposed_design(spark, sf_dir):
    ems = train.train(_runs(spark), ["nS", "nI", "nR"], simulators.SIRS_RANGES)
    d = design.generate_new_design(spark, list(ems.values()), 60, SIRS_Z)
    return spark.createDataFrame(d.points)


@query()
def part_emulator(spark, sf_dir):
    """Retail price by size, replicates averaged."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    em = train.train(p, ["p_retailprice"], {"p_size": (1.0, 50.0)})
    return score.score(generators.grid(spark, {"p_size": (1.0, 50.0)}, 200), list(em.values()))


@query()
def stochastic_emulator(spark, sf_dir):
    """Mean and variance surfaces of the quantity from its replicates."""
    ems = train.train_variance(table(spark, sf_dir, "lineitem").select(*INPUTS, "l_quantity"), ["l_quantity"], RANGES, order=1)
    return score.score(generators.grid(spark, RANGES, 30), train.emulator_set(ems))


@query()
def maximin(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return design.maximin_sample(p, 20, ["p_size", "p_retailprice"], 200)


@query()
def idemc_points(spark, sf_dir):
    return idemc.idemc_runs(spark, EmulatorSet.of(list(EMS.values())), 50, Z, runs=4, s=200, mutations=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLE | {k: f() for k, f in LATE.items()}


from . import further, spaces  # noqa: E402, F401  register their queries
