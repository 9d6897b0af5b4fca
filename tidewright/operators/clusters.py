"""Fuzzy groups of a table's rows over mixed measures.

Two rows differ in a numeric column by the share of its range that lies between
them, in a categorical one by 0 or 1 (Gower's partial dissimilarities); their
distance is the root of the mean of the squares over the columns that both
have. A centre holds the mean of each numeric column and the share of each level
of each categorical one, so that the weighted means lower the objective (the sum
over rows and centres of membership^m times squared distance) at each step.

Rows are folded to distinct ones first. A step is one aggregation with partial
sums: each row gives, for each of its columns, its level or value and its
memberships to the power m; a result row for each numeric column and each level
comes back. Centres start at the row farthest from the mean of all, then at the
row farthest from those before, so that reruns agree.

Defined results: a null or NaN is left out of its row's mean; rows without any
value have null memberships and do not count; a column without spread or values
says nothing and does not count; ties of memberships go to the first centre, ties of rows when
starting to the smallest key; fewer distinct rows than centres give centres
that coincide; extra columns stay as they are. A categorical column may have at
most ``LEVELS`` levels, as the centres are part of each task's plan; above that
the fit says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .saving import saved

LEVELS = 1_000
#: Squared distances below this count as this: a row at a centre belongs to it all but wholly.
LEAST = 1e-12


@dataclass(frozen=True)
class Centre:
    means: dict[str, float]
    shares: dict[str, dict[str, float]]


@dataclass(frozen=True)
class Groups:
    """Centres of fuzzy groups; ``widths`` are the ranges of the numeric columns, ``objective`` is that of the last step's start."""

    widths: dict[str, float]
    levels: tuple[str, ...]
    centres: tuple[Centre, ...]
    m: float
    objective: float = float("nan")

    def squared(self, c: Centre) -> Column:
        """Squared distance of a row from a centre; null for rows without values."""
        parts, there = [], []
        for n, w in self.widths.items():
            x = _number(n)
            if n in c.means:
                z = (x - F.lit(c.means[n])) / F.lit(w)
                parts.append(F.coalesce(z * z, F.lit(0.0)))
            there.append(x.isNotNull().cast("int"))
        for n in self.levels:
            if s := c.shares.get(n):
                held = F.create_map(*(F.lit(v) for item in sorted(s.items()) for v in item))
                q = float(sum(v * v for v in s.values()))
                part = (F.lit(1.0 + q) - 2.0 * F.coalesce(F.try_element_at(held, F.col(n).cast("string")), F.lit(0.0))) / 2.0
                parts.append(F.when(F.col(n).isNotNull(), part).otherwise(F.lit(0.0)))
            there.append(F.col(n).isNotNull().cast("int"))
        return sum(parts, F.lit(0.0)) / F.nullif(sum(there, F.lit(0)), F.lit(0))

    def near(self, df: DataFrame) -> DataFrame:
        """``df`` with its squared distances and memberships as ``_fuzzy_d0``, ..., ``_fuzzy_u0``, ...: each worked out once a row."""
        k = range(len(self.centres))
        out = df.withColumns({f"_fuzzy_d{j}": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))) for j, d in enumerate(map(self.squared, self.centres))})
        # greatest() drops nulls, and a row without values must stay without memberships
        out = out.withColumns({f"_fuzzy_v{j}": F.when(F.col(f"_fuzzy_d{j}").isNotNull(), F.pow(F.greatest(f"_fuzzy_d{j}", F.lit(LEAST)), F.lit(-1.0 / (self.m - 1.0)))) for j in k})
        total = sum((F.col(f"_fuzzy_v{j}") for j in k), F.lit(0.0))
        return out.withColumns({f"_fuzzy_u{j}": F.col(f"_fuzzy_v{j}") / total for j in k}).drop(*(f"_fuzzy_v{j}" for j in k))

    def assigned(self, df: DataFrame, prefix: str = "u", label: str = "label") -> DataFrame:
        """``df`` with the memberships ``u0``, ``u1``, ... and the number of the group of the greatest one."""
        k = range(len(self.centres))
        own = F.array(*(F.col(f"_fuzzy_u{j}") for j in k))
        best = (F.array_position(own, F.array_max(own)) - 1).cast("int")
        out = self.near(df).withColumns({**{f"{prefix}{j}": F.col(f"_fuzzy_u{j}") for j in k}, label: best})
        return out.drop(*(f"_fuzzy_{c}{j}" for j in k for c in "du"))


def _number(n: str) -> Column:
    x = F.col(n).cast("double")
    return F.when(~F.isnan(x), x)


def _folded(df: DataFrame, numeric: list[str], levels: list[str], key: str) -> DataFrame:
    own = [_number(n).alias(n) for n in numeric] + [F.col(n).cast("string").alias(n) for n in levels]
    some = F.lit(False)
    for n in numeric + levels:
        some = some | (_number(n).isNotNull() if n in numeric else F.col(n).isNotNull())
    return df.filter(some).groupBy(*own).agg(F.min(key).alias("_key"), F.count(F.lit(1)).alias("_n"))


def _moved(rows: DataFrame, g: Groups, weights: list[Column], cost: Column) -> tuple[list[Centre], float]:
    """Centres as weighted means, and the sum of weights times squared distances: one aggregation."""
    names = [*g.widths, *g.levels]
    there = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    seen = [F.struct(F.lit(n).alias("c"), F.lit(None).cast("string").alias("level"), F.col(n).alias("z")) for n in g.widths]
    seen += [F.struct(F.lit(n).alias("c"), F.col(n).alias("level"), F.when(F.col(n).isNotNull(), 1.0).alias("z")) for n in g.levels]
    seen.append(F.struct(F.lit("").alias("c"), F.lit(None).cast("string").alias("level"), (cost * there).alias("z")))
    long = rows.filter(there > 0).select(*((w * F.col("_n") / there).alias(f"_w{j}") for j, w in enumerate(weights)), (F.col("_n") / there).alias("_one"), F.explode(F.array(*seen)).alias("s"))
    long = long.select("s.c", "s.level", "s.z", "_one", *(f"_w{j}" for j in range(len(weights)))).filter("z is not null")
    sums = [f for j in range(len(weights)) for f in (F.sum(F.col(f"_w{j}") * F.col("z")).alias(f"s{j}"), F.sum(f"_w{j}").alias(f"t{j}"))]
    got = long.groupBy("c", "level").agg(F.sum(F.col("_one") * F.col("z")).alias("all"), *sums).collect()
    for n in g.levels:
        if sum(r.c == n for r in got) > LEVELS:
            raise ValueError(f"{n} has more than {LEVELS} levels")
    out = []
    for j in range(len(weights)):
        means = {r.c: r[f"s{j}"] / r[f"t{j}"] for r in got if r.c in g.widths and r[f"t{j}"] > 0}
        total = {n: sum(r[f"s{j}"] for r in got if r.c == n) for n in g.levels}
        out.append(Centre(means, {n: {r.level: r[f"s{j}"] / total[n] for r in got if r.c == n} for n in g.levels if total[n] > 0}))
    return out, sum(r["all"] for r in got if r.c == "")


def fuzzy_groups(df: DataFrame, numeric: list[str], levels: list[str], k: int, key: str, m: float = 2.0, steps: int = 50, tolerance: float = 1e-6) -> Groups:
    """Fuzzy c-means of a table: ``k`` centres after at most ``steps`` steps, or when no centre moves by more than ``tolerance``."""
    if k < 1 or m <= 1 or not numeric + levels:
        raise ValueError("at least one centre, one column and an exponent above 1 are needed")
    rows = saved(_folded(df, numeric, levels, key), "rows")
    r = rows.agg(F.count(F.lit(1)).alias("_rows"), *((F.max(n) - F.min(n)).alias(n) for n in numeric), *(F.approx_count_distinct(n).alias(n) for n in levels)).first()
    for n in levels:
        if r[n] > 2 * LEVELS:
            raise ValueError(f"{n} has more than {LEVELS} levels")
    g = Groups({n: float(r[n]) for n in numeric if r[n]}, tuple(levels), (), float(m))
    if not r["_rows"]:
        return Groups(g.widths, g.levels, (Centre({}, {}),) * k, g.m, 0.0)
    (middle,), _ = _moved(rows, g, [F.lit(1.0)], F.lit(0.0))
    started: list[Centre] = []
    for _ in range(k):
        near = F.array_min(F.array(*(g.squared(c) for c in started or [middle])))
        at = rows.orderBy(F.round(near, 9).desc(), "_key").first()
        started.append(Centre({n: middle.means[n] if at[n] is None else at[n] for n in middle.means}, {n: s if at[n] is None else {at[n]: 1.0} for n, s in middle.shares.items()}))
    g = Groups(g.widths, g.levels, tuple(started), g.m)
    for _ in range(steps):
        own = [F.pow(f"_fuzzy_u{j}", F.lit(g.m)) for j in range(k)]
        cost = sum((w * F.col(f"_fuzzy_d{j}") for j, w in enumerate(own)), F.lit(0.0))
        new, objective = _moved(g.near(rows), g, own, cost)
        new = [c if c.means or c.shares else old for c, old in zip(new, g.centres, strict=True)]
        moved = max(_change(a, b, g.widths) for a, b in zip(new, g.centres, strict=True))
        g = Groups(g.widths, g.levels, tuple(new), g.m, objective)
        if moved <= tolerance:
            break
    return g


def _change(a: Centre, b: Centre, widths: dict[str, float]) -> float:
    """The largest change of a mean, in shares of its range, or of a level's share."""
    means = [abs(v - b.means.get(n, np.inf)) / widths[n] for n, v in a.means.items()]
    return max([*means, *(abs(v - b.shares.get(n, {}).get(x, 0.0)) for n, s in a.shares.items() for x, v in s.items())], default=0.0)


__all__ = ["Centre", "Groups", "fuzzy_groups"]
