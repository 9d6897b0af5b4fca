"""Registered queries of distances, spreads and covariances of tables, with SQL that works the results out by itself."""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import functions as F

from .functions.kernels import Correlator
from .operators import cells, clusters, design, lines, score, stats, tiles, train
from .queries import _GRID, _POINTS_SQL, _VAL, EMS, INPUTS, LATE, _em, _kernel_sql, _points, _validation, query, table

# ------------------------------------------------------------------ cells

_XYZ = [f"x{i}" for i in range(3)]
_VEC = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), p AS (SELECT x, y, z, min(vec_id) AS k, count(*) AS copies FROM v WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY x, y, z)"
_D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _vectors(spark, sf_dir):
    """The first three coordinates of the embeddings, as inputs."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_XYZ)))


@query(f"WITH {_VEC} SELECT a.k AS v1, b.k AS v2, round({_D2}, 6) AS d FROM p a JOIN p b ON a.k < b.k WHERE {_D2} <= 0.04")
def close_pairs(spark, sf_dir):
    d = cells.pairs_within(_vectors(spark, sf_dir), _XYZ, 0.04, "vec_id")
    return d.select(F.col("key").alias("v1"), F.col("other").alias("v2"), F.round("dist", 6).alias("d"))


@query(f"WITH {_VEC}, d AS (SELECT a.k, a.copies, b.k AS other, {_D2} AS d FROM p a JOIN p b ON a.k <> b.k) SELECT k AS vec_id, copies, arg_min(other, (d, other)) AS nearest, round(min(d), 6) AS d FROM d GROUP BY k, copies")
def nearest_points(spark, sf_dir):
    d = cells.nearest(_vectors(spark, sf_dir), _XYZ, "vec_id")
    return d.select(F.col("key").alias("vec_id"), "copies", F.col("other").alias("nearest"), F.round("dist", 6).alias("d"))


_PARTS = ["size", "price"]
_PART_SQL = "q AS (SELECT p_partkey AS k, (p_size - 25.5) / 24.5 AS x, (p_retailprice - 950.0) / 50.0 AS y FROM part)"


def _parts(spark, sf_dir):
    """Parts as points: size and price scaled to -1..1."""
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25.5) / 24.5).alias("size"), ((F.col("p_retailprice") - 950.0) / 50.0).alias("price"))


@query(f"WITH {_PART_SQL}, s AS (SELECT * FROM q WHERE k % 7 = 0) SELECT a.k AS p_partkey, count(b.k) AS cover FROM q a LEFT JOIN s b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.15 GROUP BY a.k")
def seed_cover(spark, sf_dir):
    """How many seeds (every seventh part) cover each proposal (every part): the weights of importance sampling."""
    p = _parts(spark, sf_dir)
    return cells.counted_within(p, _PARTS, p.filter("p_partkey % 7 = 0"), 0.15, "p_partkey").select("p_partkey", "cover")


def _thinned_sql() -> str:
    """One round after the other: open points that no open neighbour comes before are kept, and their neighbours go."""
    return f"""WITH RECURSIVE {_PART_SQL}, r AS (SELECT k, x, y, round(-(x - 0.3) * (x - 0.3) - y * y, 9) AS rank FROM q), f AS (SELECT x, y, min(k) AS k, max(rank) AS rank FROM r GROUP BY x, y),
l AS MATERIALIZED (SELECT a.k, b.k AS other, a.rank > b.rank OR (a.rank = b.rank AND a.k < b.k) AS first FROM f a JOIN f b ON a.k <> b.k AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.2),
s AS (SELECT 0 AS step, (SELECT list(k ORDER BY k) FROM f) AS open, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT step + 1, list_filter(open, lambda k: NOT list_contains(now, k) AND NOT list_contains(gone, k)), list_concat(kept, now) FROM (
    SELECT step, open, kept, now, (SELECT coalesce(list(DISTINCT other), []) FROM l WHERE list_contains(now, l.k)) AS gone FROM (
      SELECT step, open, kept, list_filter(open, lambda k: NOT list_contains(blocked, k)) AS now FROM (
        SELECT step, open, kept, (SELECT coalesce(list(DISTINCT other), []) FROM l WHERE first AND list_contains(open, l.k)) AS blocked FROM s WHERE len(open) > 0))))
SELECT unnest(kept) AS p_partkey FROM s WHERE len(open) = 0"""


@query(_thinned_sql())
def thinned_points(spark, sf_dir):
    """Parts near a target first, no two within 0.2 of each other: greedy thinning, in rounds over the cell grid."""
    rank = F.round(-(F.col("size") - 0.3) * (F.col("size") - 0.3) - F.col("price") * F.col("price"), 9)
    return cells.thinned(_parts(spark, sf_dir), _PARTS, 0.2, "p_partkey", rank).select(F.col("key").alias("p_partkey"))


# ------------------------------------------------------------------ spreads


def _farthest_sql(n: int) -> str:
    """Greedily farthest points of part's sizes and prices, one common table a step."""
    out = "WITH d AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS s, p_retailprice AS r FROM part), m AS (SELECT avg(s) AS ms, stddev_pop(s) AS ss, avg(r) AS mr, stddev_pop(r) AS sr FROM d), z AS MATERIALIZED (SELECT s, r, (s - ms) / ss AS x, (r - mr) / sr AS y FROM d, m),\np0 AS MATERIALIZED (SELECT * FROM z ORDER BY round(x * x + y * y, 9) DESC, s, r LIMIT 1), n0 AS MATERIALIZED (SELECT z.*, (z.x - p.x) * (z.x - p.x) + (z.y - p.y) * (z.y - p.y) AS near FROM z, p0 p)"
    for k in range(1, n):
        out += f",\np{k} AS MATERIALIZED (SELECT * FROM n{k - 1} ORDER BY round(near, 9) DESC, s, r LIMIT 1), n{k} AS MATERIALIZED (SELECT z.* REPLACE (least(z.near, (z.x - p.x) * (z.x - p.x) + (z.y - p.y) * (z.y - p.y)) AS near) FROM n{k - 1} z, p{k} p)"
    return out + "\n" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, s AS p_size, r AS p_retailprice FROM p{k}" for k in range(n))


@query(_farthest_sql(12))
def farthest_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return design.farthest_points(p, 12, ["p_size", "p_retailprice"])


# ------------------------------------------------------------------ long lines

_LINES_SQL = f"{_PART_SQL}, f AS (SELECT x, y, min(k) AS k FROM q GROUP BY x, y), l AS (SELECT a.k AS p1, b.k AS p2, {{d}} AS d, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM f a JOIN f b ON a.k < b.k ORDER BY d DESC, p1, p2 LIMIT {{k}})"
_D_XY = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {_LINES_SQL.format(d=_D_XY, k=50)} SELECT p1, p2, round(d, 6) AS d FROM l")
def longest_lines(spark, sf_dir):
    """The fifty longest lines between parts, by pairs of boxes whose bounds reach them."""
    d = lines.longest(_parts(spark, sf_dir), _PARTS, 50, "p_partkey")
    return d.select(F.col("key").alias("p1"), F.col("other").alias("p2"), F.round("dist", 6).alias("d"))


@query(f"WITH {_LINES_SQL.format(d=_D_XY, k=20)}, s AS (SELECT step, (step - 12.5) / 25.0 AS w FROM range(51) AS r(step)) SELECT p1 || ' ' || p2 AS line, CAST(step AS INTEGER) AS step, round(x1 + (x2 - x1) * w, 6) + 0.0 AS size, round(y1 + (y2 - y1) * w, 6) + 0.0 AS price FROM l, s")
def line_walks(spark, sf_dir):
    """Points along the twenty longest lines between parts, past both ends."""
    d = lines.along_longest(_parts(spark, sf_dir), _PARTS, 20, 50, "p_partkey")
    return d.select("line", "step", *((F.round(c, 6) + 0.0).alias(c) for c in _PARTS))


# ------------------------------------------------------------------ fuzzy groups


def _groups_sql(k: int, steps: int) -> str:
    """Starting rows, then steps of memberships and centres, one common table each."""
    sq = lambda j, m: f"((p.z1 - {j}.z1) * (p.z1 - {j}.z1) + (p.z2 - {j}.z2) * (p.z2 - {j}.z2) + (1 + {m}.qb - 2 * coalesce(sb.s, 0)) / 2 + (1 + {m}.qt - 2 * coalesce(st.s, 0)) / 2) / 4"

    def centres(i: int, u: str) -> str:
        return f"""u{i} AS MATERIALIZED ({u}), w{i} AS (SELECT j, sum(u * u) AS w FROM u{i} GROUP BY j),
sb{i} AS MATERIALIZED (SELECT j, b, sum(u * u) / any_value(w) AS s FROM u{i} JOIN p USING (k) JOIN w{i} USING (j) GROUP BY j, b), st{i} AS MATERIALIZED (SELECT j, t, sum(u * u) / any_value(w) AS s FROM u{i} JOIN p USING (k) JOIN w{i} USING (j) GROUP BY j, t),
m{i} AS MATERIALIZED (SELECT j, sum(u * u * z1) / sum(u * u) AS z1, sum(u * u * z2) / sum(u * u) AS z2, (SELECT sum(s * s) FROM sb{i} s WHERE s.j = u{i}.j) AS qb, (SELECT sum(s * s) FROM st{i} s WHERE s.j = u{i}.j) AS qt FROM u{i} JOIN p USING (k) GROUP BY j),
d{i} AS MATERIALIZED (SELECT p.k, m.j, {sq('m', 'm')} AS d FROM p CROSS JOIN m{i} m LEFT JOIN sb{i} sb ON sb.j = m.j AND sb.b = p.b LEFT JOIN st{i} st ON st.j = m.j AND st.t = p.t)"""

    out = ["p AS MATERIALIZED (SELECT p_partkey AS k, p_size / CAST((SELECT max(p_size) - min(p_size) FROM part) AS DOUBLE) AS z1, p_retailprice / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS z2, p_brand AS b, p_type AS t FROM part)"]
    out.append(centres(0, "SELECT k, 0 AS j, 1.0 AS u FROM p"))
    for i in range(1, k + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT k FROM d{i - 1} GROUP BY k ORDER BY round(min(d), 9) DESC, k LIMIT 1)")
        out.append(centres(i, " UNION ALL ".join(f"SELECT k, {j} AS j, 1.0 AS u FROM r{j + 1}" for j in range(i))))
    for i in range(k + 1, k + steps + 1):
        out.append(centres(i, f"SELECT k, j, (1 / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) OVER (PARTITION BY k) AS u FROM d{i - 1}"))
    last = f"(SELECT k, j, (1 / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) OVER (PARTITION BY k) AS u FROM d{k + steps})"
    return "WITH " + ",\n".join(out) + "\nSELECT k AS p_partkey, " + ", ".join(f"round(max(CASE WHEN j = {j} THEN u END), 5) AS u{j}" for j in range(k)) + f" FROM {last} GROUP BY k"


@query(_groups_sql(3, 4))
def part_groups(spark, sf_dir):
    """Memberships of parts in three fuzzy groups by size, price, brand and type, after four steps."""
    p = table(spark, sf_dir, "part")
    g = clusters.fuzzy_groups(p, ["p_size", "p_retailprice"], ["p_brand", "p_type"], 3, "p_partkey", steps=4, tolerance=0.0)
    return g.assigned(p).select("p_partkey", *(F.round(f"u{j}", 5).alias(f"u{j}") for j in range(3)))


# ------------------------------------------------------------------ tiles


@functools.cache
def _known() -> np.ndarray:
    """The inverse covariance of the nine training points of the emulator ``q``, from its formula alone."""
    x = np.array([((a - 0.05) / 0.05, (b - 0.04) / 0.04) for a, b in _GRID])
    return np.linalg.inv(4.0 * np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 0.64))


def _tables_sql() -> str:
    t = ", ".join(f"({i}, {(float(a) - 0.05) / 0.05!r}, {(float(b) - 0.04) / 0.04!r})" for i, (a, b) in enumerate(_GRID))
    inv = ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(_known()))
    k = lambda a, b, x, y: f"4.0 * exp(-(({a} - {x}) * ({a} - {x}) + ({b} - {y}) * ({b} - {y})) / 0.64)"
    return f"""WITH {_POINTS_SQL}, o AS (SELECT p_size, (CAST(p_size AS DOUBLE) / 500 - 0.05) / 0.05 AS u, ((avg(p_retailprice) - 900) / 1250 - 0.04) / 0.04 AS w FROM part GROUP BY p_size),
t AS (SELECT * FROM (VALUES {t}) AS t(i, x, y)), v AS (SELECT * FROM (VALUES {inv}) AS v(i, j, v)),
l AS (SELECT l_discount, l_tax, i, {k('a', 'b', 'x', 'y')} AS c FROM pts, t), r AS (SELECT p_size, i, {k('u', 'w', 'x', 'y')} AS c FROM o, t), rv AS (SELECT p_size, v.j, sum(r.c * v.v) AS c FROM r JOIN v USING (i) GROUP BY ALL),
s AS (SELECT l_discount, l_tax, p_size, sum(l.c * rv.c) AS c FROM l JOIN rv ON l.i = rv.j GROUP BY ALL)
SELECT l_discount * 1000 + l_tax AS point, p_size, round({k('a', 'b', 'u', 'w')} - s.c, 4) + 0.0 AS cov FROM s JOIN pts USING (l_discount, l_tax) JOIN o USING (p_size)"""


@query()
def covariance_tables(spark, sf_dir):
    """Covariances of the ensemble's points with those of another table: parts by size."""
    left = _points(spark, sf_dir).withColumn("point", F.col("l_discount") * 1000 + F.col("l_tax"))
    right = table(spark, sf_dir, "part").groupBy("p_size").agg(((F.avg("p_retailprice") - 900) / 1250).alias("l_tax")).withColumn("l_discount", F.col("p_size").cast("double") / 500)
    d = tiles.covariance_between(left, right, EMS["q"], "point", "p_size", tile=32)
    return d.select("point", "p_size", (F.round("cov", 4) + 0.0).alias("cov"))


LATE["covariance_tables"] = _tables_sql

_PLAIN = _em("q", lambda a, b: 0.0, [25.0, 0.0, 0.5], 1.0, Correlator.of("rat_quad", nugget=0.05, theta=0.7, alpha=1.5), trained=False)


def _cholesky_sql() -> str:
    """Row by row: the covariance as lists, each row of the factor from those before."""
    em = _PLAIN
    k = _kernel_sql(em.corr, "(p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)")
    return f"""WITH RECURSIVE {_VAL}, n AS (SELECT l_discount, l_tax, a, b, y, row_number() OVER (ORDER BY l_discount, l_tax) AS i FROM pts JOIN val USING (l_discount, l_tax)),
c AS MATERIALIZED (SELECT q.i, list({k} + CASE WHEN p.i = q.i THEN 1e-12 ELSE 0 END ORDER BY p.i) AS v FROM n p, n q WHERE p.i <= q.i GROUP BY q.i),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[][]) AS rows, CAST([] AS DOUBLE[]) AS errors
  UNION ALL SELECT i, list_append(rows, list_append(w, d)), list_append(errors, (y - (25.0 + 0.5 * b) - coalesce(list_sum(list_transform(list_zip(w, errors), lambda x: x[1] * x[2])), 0)) / d)
  FROM (SELECT i, y, b, rows, errors, w, sqrt(v[i] - coalesce(list_sum(list_transform(w, lambda x: x * x)), 0)) AS d FROM (
    SELECT n.i, n.y, n.b, rows, errors, c.v, list_reduce(range(1, n.i), lambda w, j: list_append(w, (c.v[j] - coalesce(list_sum(list_transform(list_zip(w, rows[j][1 : j - 1]), lambda x: x[1] * x[2])), 0)) / rows[j][j]), CAST([] AS DOUBLE[])) AS w FROM f JOIN n ON n.i = f.i + 1 JOIN c ON c.i = n.i)))
SELECT l_discount, l_tax, round(errors[n.i], 4) + 0.0 AS error FROM n, (SELECT errors FROM f ORDER BY len(errors) DESC LIMIT 1)"""


@query(_cholesky_sql())
def uncorrelated_errors(spark, sf_dir):
    """Errors of the validation points by a blocked Cholesky factor of their covariance."""
    d = tiles.uncorrelated_errors(_validation(spark, sf_dir), _PLAIN, INPUTS, tile=32)
    return d.select(*INPUTS, (F.round("error", 4) + 0.0).alias("error"))


@query(f"SELECT count(*) AS m, round(sum(error * error), 1) AS mahalanobis FROM ({_cholesky_sql().replace('round(errors[n.i], 4) + 0.0', 'errors[n.i]')})")
def mahalanobis_distance(spark, sf_dir):
    d = tiles.mahalanobis(_validation(spark, sf_dir), _PLAIN, INPUTS, tile=32)
    return d.select("m", F.round("mahalanobis", 1).alias("mahalanobis"))


# ------------------------------------------------------------------ joint hits

#: Indicators of a line item, as SQL that both engines read.
_HITS = {"qty": "l_quantity BETWEEN 10 AND 30", "price": "l_extendedprice < 30000", "disc": "l_discount >= 0.05", "tax": "l_tax <= 0.04", "flag": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "first": "l_linenumber = 1", "never": "l_quantity < 0"}
_SETS = [s for n in (1, 2, 3) for s in itertools.combinations(_HITS, n)]


@query("WITH h AS (SELECT " + ", ".join(f"CASE WHEN {v} THEN 1 ELSE 0 END AS {k}" for k, v in _HITS.items()) + " FROM lineitem)\n" + " UNION ALL ".join(f"SELECT '{' '.join(s)}' AS hits, CAST(coalesce(sum({' * '.join(s)}), 0) AS BIGINT) AS n FROM h" for s in _SETS))
def joint_hits(spark, sf_dir):
    """In how many rows one, two or three indicators hold together, from one fold to packed words."""
    d = table(spark, sf_dir, "lineitem").select(*(F.expr(f"CASE WHEN {v} THEN 1 ELSE 0 END").alias(k) for k, v in _HITS.items()))
    _, n = stats.joint_counts(d, list(_HITS))
    return spark.createDataFrame([(" ".join(s), n.get(frozenset(s), 0)) for s in _SETS], "hits string, n long")


# ------------------------------------------------------------------ a trained emulator, on a table


def _trained_sql() -> str:
    """Least squares for the line; for each length scale of the grid a Cholesky factor, row by row, and the profile likelihood; then the mean between the points."""
    forward = lambda v: f"list_reduce(range(1, CAST(len(rows) AS BIGINT) + 1), lambda w, j: list_append(w, ({v}[j] - coalesce(list_sum(list_transform(list_zip(w, rows[j][1 : j - 1]), lambda x: x[1] * x[2])), 0)) / rows[j][j]), CAST([] AS DOUBLE[]))"
    dot = lambda a, b: f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2])), 0)"

    def factor(name: str, grid: str, nugget: float, y: str) -> str:
        return f"""{name}c AS MATERIALIZED (SELECT t, q.i, list({1 - nugget!r} * exp(-(p.u - q.u) * (p.u - q.u) / (t * t)) + CASE WHEN p.i = q.i THEN {nugget!r} ELSE 0 END ORDER BY p.i) AS v FROM {grid}, n p, n q WHERE p.i <= q.i GROUP BY t, q.i),
{name} AS (SELECT t, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[][]) AS rows, CAST([] AS DOUBLE[]) AS zy, CAST([] AS DOUBLE[]) AS z1, CAST([] AS DOUBLE[]) AS zu, CAST(0 AS DOUBLE) AS half FROM {grid}
  UNION ALL SELECT t, i, list_append(rows, list_append(w, d)), list_append(zy, (y - {dot('w', 'zy')}) / d), list_append(z1, (1 - {dot('w', 'z1')}) / d), list_append(zu, (u - {dot('w', 'zu')}) / d), half + ln(d)
  FROM (SELECT t, i, y, u, rows, zy, z1, zu, half, w, sqrt(v[i] - {dot('w', 'w')}) AS d FROM (
    SELECT f.t, n.i, {y} AS y, n.u, rows, zy, z1, zu, half, c.v, {forward('c.v')} AS w FROM {name} f JOIN n ON n.i = f.i + 1 JOIN {name}c c ON c.i = n.i AND c.t = f.t, line)))"""

    return f"""WITH RECURSIVE n AS (SELECT (s - 25.5) / 24.5 AS u, y, row_number() OVER (ORDER BY s) AS i FROM (SELECT CAST(p_size AS DOUBLE) AS s, avg(p_retailprice) + 10 * p_size AS y FROM part GROUP BY p_size)),
line AS (SELECT regr_intercept(y, u) AS b0, regr_slope(y, u) AS b1, count(*) AS m FROM n), grid AS (SELECT 1.0 / 3 + (2.0 - 1.0 / 3) * k / 29 AS t FROM range(30) AS r(k)),
{factor('f', 'grid', 0.01, 'n.y')},
l AS (SELECT t, -(m / 2.0) * ln((yy - (y1 * (y1 * uu - yu * u1) + yu * (yu * ii - y1 * u1)) / (ii * uu - u1 * u1)) / m) - half AS ll FROM (
  SELECT t, m, half, {dot('zy', 'zy')} AS yy, {dot('zy', 'z1')} AS y1, {dot('zy', 'zu')} AS yu, {dot('z1', 'z1')} AS ii, {dot('zu', 'zu')} AS uu, {dot('z1', 'zu')} AS u1 FROM f JOIN line ON f.i = m)),
one AS (SELECT t FROM l ORDER BY ll DESC LIMIT 1),
{factor('g', 'one', 0.05, 'n.y - b0 - b1 * n.u')},
k AS (SELECT x.i, x.u + 0.5 / 24.5 AS u, list(0.95 * exp(-(x.u + 0.5 / 24.5 - n.u) * (x.u + 0.5 / 24.5 - n.u) / (t * t)) ORDER BY n.i) AS v FROM n x, n, one GROUP BY x.i, x.u)
SELECT '(Intercept) p_size' AS terms, round(b0, 4) AS intercept, round(b1, 4) AS slope, round(t, 6) AS theta, CAST(round(u * 24.5 + 25.5, 1) AS DOUBLE) AS p_size, round(b0 + b1 * u + {dot('w', 'zy')}, 3) AS e
FROM (SELECT k.u, t, b0, b1, zy, {forward('k.v')} AS w FROM k, g JOIN line ON g.i = m)"""


@query(_trained_sql())
def trained_on_parts(spark, sf_dir):
    """An emulator of mean prices by size, trained on the table: its terms, line, length scale, and its mean half-way between the sizes."""
    d = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("p_size")).agg((F.avg("p_retailprice") + 10 * F.first("p_size")).alias("y"))
    em = train.emulator_from_data(d, ["y"], {"p_size": (1.0, 50.0)}, order=1, check_ranges=False, priors={"y": train.Priors(nugget=0.05)})["y"]
    got = score.score(d.select((F.col("p_size") + 0.5).alias("p_size")), [em])
    fixed = {"terms": " ".join(em.basis.text()), "intercept": round(float(em.beta_mu[0]), 4), "slope": round(float(em.beta_mu[1]), 4), "theta": round(float(em.corr.params["theta"]), 6)}
    return got.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "p_size", F.round("y_exp", 3).alias("e"))
