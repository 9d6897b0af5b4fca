"""Covariances of whole tables, in tiles: no task and no driver holds an n x n array.

Points are dealt to blocks of at most ``TILE`` rows; a tile is the covariance of
two blocks. Between two tables every (row block, column block) meets once, and
its entries are rows. Of one table's own covariance the lower tiles are kept as
rows of a table and factored by a blocked Cholesky: the first open diagonal tile
is factored in every task of its column, the tiles below it are solved against
it, and what remains of the matrix loses their products (two joins on tile
numbers a step). The errors go along as one more row of tiles, so that when the
factor is done they are uncorrelated, and their squares sum to the Mahalanobis
distance.

Defined results: rows with a null input (or output, for errors) are left out;
keys should be unique, rows with one key are all kept, in any order; an empty
table gives an empty result; extra columns are ignored. Results for n points
take n^2 / 2 numbers on disk and n / TILE steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.emulator import Emulator
from ..sources.generators import numbered
from .saving import saved

TILE = 512
#: Added to variances, so that points that the emulator knows do not stop the factor.
JITTER = 1e-12


def _points(df: DataFrame, em: Emulator, *more: str) -> DataFrame:
    return df.select(*more, *(F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(em.inputs))).dropna()


def _x(pdf: pd.DataFrame, em: Emulator) -> np.ndarray:
    return pdf[[f"x{i}" for i in range(len(em.inputs))]].to_numpy(float)


def covariance_between(left: DataFrame, right: DataFrame, em: Emulator, key: str, other: str, tile: int = TILE) -> DataFrame:
    """(key, other, cov): the covariance of each row of ``left`` with each of ``right``, which is the result asked for: n x m rows."""
    a, b = (saved(_points(d, em, F.col(k).alias("k")), "points") for d, k in ((left, key), (right, other)))
    parts = [max(1, -(-d.count() // tile)) for d in (a, b)]
    deal = lambda d, n: d.withColumn("_own", F.pmod(F.xxhash64("k", *(f"x{i}" for i in range(len(em.inputs)))), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    a = deal(a, parts[0]).withColumnRenamed("_own", "i").withColumn("j", every(parts[1]))
    b = deal(b, parts[1]).withColumnRenamed("_own", "j").withColumn("i", every(parts[0]))
    shared = left.sparkSession.sparkContext.broadcast(em)
    kinds = [d.schema[k].dataType.simpleString() for d, k in ((left, key), (right, other))]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        em = shared.value
        c = em.get_cov(_x(p, em), _x(q, em)) if len(p) and len(q) else np.empty((len(p), len(q)))
        return pd.DataFrame({key: np.repeat(p["k"].to_numpy(), len(q)), other: np.tile(q["k"].to_numpy(), len(p)), "cov": c.ravel()})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, f"`{key}` {kinds[0]}, `{other}` {kinds[1]}, cov double")


def _array(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(rows, -1)


_TILE_SCHEMA = "i long, j long, rows long, a binary"


def _lower_tiles(points: DataFrame, em: Emulator, blocks: int) -> DataFrame:
    """The lower tiles of the covariance of (p, b, y, x0, ...), and as block row ``blocks`` the errors."""
    shared = points.sparkSession.sparkContext.broadcast(em)
    down = points.withColumn("j", F.col("b")).withColumn("i", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1).cast("bigint"))))
    over = points.withColumn("i", F.col("b")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b"))))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        em, i, j = shared.value, int(p["i"].iloc[0]), int(p["j"].iloc[0])
        p, q = p.sort_values("p"), q.sort_values("p")
        c = em.get_cov(_x(p, em)) + JITTER * np.eye(len(p)) if i == j else em.get_cov(_x(p, em), _x(q, em))
        out = [(i, j, len(p), np.ascontiguousarray(c).tobytes())]
        if i == j:
            r = p["y"].to_numpy(float) - em.get_exp(_x(p, em))
            out.append((blocks, j, 1, r.tobytes()))
        return pd.DataFrame(out, columns=["i", "j", "rows", "a"])

    return down.groupBy("i", "j").cogroup(over.groupBy("i", "j")).applyInPandas(run, _TILE_SCHEMA)


def _column(tiles: DataFrame, k: int) -> DataFrame:
    """The tiles of column ``k`` below its diagonal, solved against that one's factor."""
    top = tiles.filter((F.col("i") == k) & (F.col("j") == k)).select("j", F.col("a").alias("top"), F.col("rows").alias("n"))

    def run(parts):
        for pdf in parts:
            new = []
            for t in pdf.itertuples():
                factor = np.linalg.cholesky(_array(t.top, t.n))
                new.append(np.ascontiguousarray(np.linalg.solve(factor, _array(t.a, t.rows).T).T).tobytes())
            yield pdf.assign(a=new)[["i", "j", "rows", "a"]]

    # one diagonal tile, at most TILE x TILE numbers
    return tiles.filter((F.col("j") == k) & (F.col("i") > k)).join(F.broadcast(top), "j").select("i", "j", "rows", "a", "top", "n").mapInPandas(run, _TILE_SCHEMA)


def _rest(tiles: DataFrame, column: DataFrame, k: int) -> DataFrame:
    """The open tiles, less the products of the solved column's."""
    c = column.drop("j")
    left = c.select("i", F.col("a").alias("l"))
    right = c.select(F.col("i").alias("j"), F.col("a").alias("r"), F.col("rows").alias("m"))

    def run(parts):
        for pdf in parts:
            new = [np.ascontiguousarray(_array(t.a, t.rows) - _array(t.l, t.rows) @ _array(t.r, t.m).T).tobytes() for t in pdf.itertuples()]
            yield pdf.assign(a=new)[["i", "j", "rows", "a"]]

    return tiles.filter(F.col("j") > k).join(left, "i").join(right, "j").select("i", "j", "rows", "a", "l", "r", "m").mapInPandas(run, _TILE_SCHEMA)


def uncorrelated_errors(df: DataFrame, em: Emulator, key: str | list[str], tile: int = TILE) -> DataFrame:
    """(key, error): the errors of ``df``'s output by the Cholesky factor of their covariance, in the order of the key."""
    keys = [key] if isinstance(key, str) else list(key)
    points = _points(df, em, *(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), F.col(em.name).cast("double").alias("y"))
    points = saved(numbered(points, *(f"k{n}" for n in range(len(keys)))).withColumnRenamed("point_id", "p").withColumn("b", F.floor(F.col("p") / tile)), "points")
    blocks = -(-points.count() // tile)
    names = points.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(keys)), "p", "b")
    if not blocks:
        return names.select(*keys, F.lit(0.0).alias("error"))
    tiles, done = saved(_lower_tiles(points, em, blocks), "tiles"), None
    for k in range(blocks):
        column = saved(_column(tiles, k), "column")
        mine = column.filter(F.col("i") == blocks)
        done = mine if done is None else done.unionByName(mine)
        tiles = saved(_rest(tiles, column, k), "tiles")

    def rows(parts):
        for pdf in parts:
            for t in pdf.itertuples():
                v = np.frombuffer(t.a, np.float64)
                yield pd.DataFrame({"p": t.j * tile + np.arange(len(v)), "error": v})

    errors = done.mapInPandas(rows, "p long, error double")
    return names.join(errors, "p").select(*keys, "error")


def mahalanobis(df: DataFrame, em: Emulator, key: str | list[str], tile: int = TILE) -> DataFrame:
    """One row (m, chi, mahalanobis): the number of points, the sum of squared standardised errors, and the squared Mahalanobis distance of the errors."""
    from .diagnostics import scored_validation

    s = scored_validation(em, df.dropna(subset=[em.name, *em.inputs])).agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("y") - F.col("e")) ** 2 / F.greatest("v", F.lit(1e-12))).alias("chi"))
    return s.crossJoin(uncorrelated_errors(df, em, key, tile).agg(F.coalesce(F.sum(F.col("error") ** 2), F.lit(0.0)).alias("mahalanobis")))  # one row each


__all__ = ["covariance_between", "mahalanobis", "uncorrelated_errors"]
