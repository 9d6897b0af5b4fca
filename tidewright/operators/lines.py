"""The longest lines between the points of a table, without all pairs of them.

Points stand in boxes. A pair of boxes bounds the distances between their
points from above and below; the bounds of all pairs and the distances of one
far point of each box say what the k-th longest line is at least, and pairs of
boxes that cannot reach it go, with the points that stand in no other pair. The
boxes that are left are split along their widest inputs, until few pairs of
points are left; these meet by an equi-join. Boxes with more than ``SPLIT``
points are dealt in parts.

The driver sees one row for each box: boxes are split only while that stays
below ``BOXES`` boxes and ``PAIRS`` pairs of them. Points that are all about as
far from each other (a sphere in many dimensions) leave more to the join; the
result is the same.

Defined results: rows with a null or NaN input are left out; rows at one point
count once, under their smallest key; ties of length go to the smallest keys;
fewer than two points give no lines; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import SPLIT, distance, folded
from .saving import saved

AXES = 3
CHILDREN = 64
ROUNDS = 12
BOXES = 2_000
PAIRS = 4_000_000
FEW = 1_000_000


def _children(lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], int]:
    """The inputs that split a box, and into how many parts each."""
    wide = [int(i) for i in np.argsort(lo - hi, kind="stable")[:AXES] if hi[i] > lo[i]] or [0]
    return wide, round(CHILDREN ** (1 / len(wide)))


def _split(points: DataFrame, boxes: list[tuple], d: int) -> DataFrame:
    """Points of the boxes (cell, number, axes, parts, lo, hi) with the cell of the next round."""
    t = points.sparkSession.createDataFrame(boxes, "cell long, number long, axes array<int>, parts int, lo array<double>, width array<double>")
    x = F.array(*(F.col(f"x{i}") for i in range(d)))
    part = lambda a, i: F.least(F.col("parts") - 1, F.floor((F.get(x, a) - F.get("lo", i)) / F.get("width", i) * F.col("parts")).cast("int"))
    index = F.lit(0)
    for i in range(AXES):
        index = F.when(F.size("axes") > i, index * F.col("parts") + F.greatest(F.lit(0), part(F.get("axes", F.lit(i)), F.lit(i)))).otherwise(index)
    return points.join(F.broadcast(t), "cell").select("key", *(f"x{i}" for i in range(d)), (F.col("number") * CHILDREN + index).alias("cell"))


def _looked_at(points: DataFrame, d: int) -> dict[str, np.ndarray]:
    """Of each cell: its rows, its box, and its point that is farthest from the middle of all."""
    xs = [F.col(f"x{i}") for i in range(d)]
    far = F.max_by(F.array(*xs), F.struct(distance(xs, [F.col(f"_c{i}") for i in range(d)]), F.xxhash64("key")))
    rows = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.min, xs)).alias("lo"), F.array(*map(F.max, xs)).alias("hi"), far.alias("far")).orderBy("cell").collect()
    return {"cell": np.array([r.cell for r in rows]), **{c: np.array([r[c] for r in rows], float) for c in ("n", "lo", "hi", "far")}}


def _bounds(b: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of cells: the least and greatest distance of their boxes, the distance of their far points, their pairs of rows."""
    least, most, far = (np.zeros(len(i)) for _ in range(3))
    for a in range(b["lo"].shape[1]):
        lo, hi, f = b["lo"][:, a], b["hi"][:, a], b["far"][:, a]
        least += np.maximum(0.0, np.maximum(lo[i] - hi[j], lo[j] - hi[i])) ** 2
        most += np.maximum(hi[i] - lo[j], hi[j] - lo[i]) ** 2
        far += (f[i] - f[j]) ** 2
    return np.sqrt(least), np.sqrt(most), np.sqrt(far), np.where(i == j, b["n"][i] * (b["n"][i] - 1) / 2, b["n"][i] * b["n"][j])


def _reached(least: np.ndarray, far: np.ndarray, rows: np.ndarray, k: int) -> float:
    """What the k-th longest line is at least: k pairs of rows are as far apart as that."""
    order = np.argsort(-least, kind="stable")
    at = int(np.searchsorted(np.cumsum(rows[order]), k))
    known = float(least[order[at]]) if at < len(order) else 0.0
    return max(known, float(np.partition(far, len(far) - k)[len(far) - k])) if len(far) >= k else known


def longest(df: DataFrame, names: list[str], k: int, key: str) -> DataFrame:
    """(key, other, dist): the k longest lines between different points, the smaller key first; all of them where there are fewer."""
    if k < 1:
        raise ValueError("k must be at least 1")
    d = len(names)
    flat = saved(folded(df, names, key).drop("copies"), "points")
    whole = flat.agg(F.count(F.lit(1)).alias("n"), *(f(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    lo, hi = np.array([[whole[f"{n}{i}"] for i in range(d)] for n in ("lo", "hi")], dtype=float) if whole.n else (np.zeros(d), np.zeros(d))
    middle = [F.lit(float(c)).alias(f"_c{i}") for i, c in enumerate((lo + hi) / 2)]
    points = flat.withColumn("cell", F.lit(0).cast("long"))
    b = {"cell": np.array([0]), "n": np.array([float(whole.n)]), "lo": lo[None], "hi": hi[None]}
    i = j = np.array([0])
    at_least = 0.0
    for _ in range(ROUNDS):
        ends = np.unique(np.concatenate([i, j]))
        open_ = (b["hi"][ends] > b["lo"][ends]).any()
        left = np.where(i == j, b["n"][i] * (b["n"][i] - 1) / 2, b["n"][i] * b["n"][j]).sum()
        if left <= FEW or not open_ or len(ends) > BOXES:
            break
        boxes = []
        for e in ends:
            axes, parts = _children(b["lo"][e], b["hi"][e])
            width = [float(b["hi"][e][a] - b["lo"][e][a]) or 1.0 for a in axes]
            boxes.append((int(b["cell"][e]), int(e), axes, parts, [float(b["lo"][e][a]) for a in axes], width))
        nearer = saved(_split(points, boxes, d), "points")
        new = _looked_at(nearer.select("*", *middle), d)
        parent = new["cell"] // CHILDREN
        first, last = np.searchsorted(parent, i), np.searchsorted(parent, i, "right")
        first2, last2 = np.searchsorted(parent, j), np.searchsorted(parent, j, "right")
        if ((last - first) * (last2 - first2)).sum() > PAIRS:
            break
        pairs = [np.stack(np.meshgrid(np.arange(a, e), np.arange(a2, e2), indexing="ij")).reshape(2, -1) for a, e, a2, e2 in zip(first, last, first2, last2, strict=True)]
        i, j = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
        least, most, far, rows = _bounds(new, i, j)
        at_least = max(at_least, _reached(least, far[i != j], rows, k))
        keep = (most >= at_least * (1 - 1e-9)) & (rows > 0)  # a hair below: no rounding loses a line
        points, b, i, j = nearer, new, i[keep], j[keep]
    t = points.sparkSession.createDataFrame([(int(b["cell"][x]), int(b["cell"][y]), int(-(-b["n"][y] // SPLIT))) for x, y in zip(i, j, strict=True)], "a long, b long, parts long")
    left = points.join(F.broadcast(t), F.col("cell") == F.col("a")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0)))))
    right = points.join(F.broadcast(t), F.col("cell") == F.col("b")).withColumn("part", F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))))
    p, q = left.alias("p"), right.alias("q")
    on = (F.col("p.a") == F.col("q.a")) & (F.col("p.b") == F.col("q.b")) & (F.col("p.part") == F.col("q.part"))
    dist = distance([F.col(f"p.x{c}") for c in range(d)], [F.col(f"q.x{c}") for c in range(d)])
    met = p.join(q, on).filter((F.col("p.a") != F.col("p.b")) | (F.col("p.key") < F.col("q.key")))
    met = met.select(F.least("p.key", "q.key").alias("key"), F.greatest("p.key", "q.key").alias("other"), dist.alias("dist"))
    return met.orderBy(F.col("dist").desc(), "key", "other").limit(k)


def walked(ends: DataFrame, names: list[str], ppl: int) -> DataFrame:
    """(line, step, inputs): lines from ``a_`` to ``b_`` places, walked past both ends by a half of their length."""
    s = (F.col("step") - F.lit(ppl / 4)) / F.lit(ppl / 2)
    walk = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(ppl))))
    return walk.select("line", "step", *((F.col(f"a_{n}") + (F.col(f"b_{n}") - F.col(f"a_{n}")) * s).alias(n) for n in names))


def along_longest(df: DataFrame, names: list[str], k: int, ppl: int, key: str) -> DataFrame:
    """(line, step, inputs): points along the k longest lines of a table, longest first; a line is ``key other``."""
    found = longest(df, names, k, key)
    at = folded(df, names, key).drop("copies")
    places = lambda p, by: at.select(F.col("key").alias(by), *(F.col(f"x{i}").alias(f"{p}{n}") for i, n in enumerate(names)))
    found = found.withColumn("line", F.concat_ws(" ", "key", "other"))
    return walked(found.join(places("a_", "key"), "key").join(places("b_", "other"), "other"), names, ppl)


__all__ = ["along_longest", "longest", "walked"]
