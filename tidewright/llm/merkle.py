"""Merkle manifest of a table: a tree for each source, and one over their roots.

Leaves are digests of rows; within a source they stand in the order of the key.
While a source has several nodes, each run of ``fanout`` of them becomes the
digest of their digests; the roots of the sources, in the sources' order, are
reduced in the same way.

Superblock reduction: nodes are dealt into buckets by index // fanout^k, and
``applyInPandas`` collapses the k levels of a bucket in one go, so that a level
of the recursion leaves one node in fanout^k. Bucket roots are reduced
likewise until each source has one node. Proofs come back down: a bucket's
siblings on its way to the root (the upper proof) join its members, which put
their own siblings within the bucket (the lower proof) before them. A task has
one bucket at a time, whatever share of the rows a source holds; texts are
digested where they are read and are not shuffled.

The places of rows in their source come from one range sort by source, key and
leaf, with a number of the row behind them: rows equal in all columns are
interchangeable, so that any order of them gives the same tree, and they may
fall into any partition. Counts by partition and source are summed to offsets.

Defined results: a null field is ``-``; null keys come first, the null source
too; rows with the same key stand in the order of their leaves; an empty table
has no rows (and no root); a table of one row has its leaf as root, with an
empty proof; null ids count as the empty text for tampering; extra columns are
not part of a leaf.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, saved

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For each level from a node to the root: the digests of its run to the left and to the right of it, joined.
_SIBLINGS = "array<struct<l: string, r: string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def tampered(c: Column, key: Column) -> Column:
    """The text as the query tampers with it: in rows whose key's crc32 five divides, A-Z are lower-cased."""
    hit = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return F.when(hit, F.translate(c, _UPPER, _LOWER)).otherwise(c)


# ------------------------------------------------------------------ the tree


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _collapse(level: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """The nodes of a bucket, level by level, the given ones first.

    ``alone``: the bucket holds all nodes of its tree, which ends at one node; else all levels are made.
    """
    out = [level]
    for _ in range(levels):
        if alone and len(level) == 1:
            break
        level = [_digest(level[i : i + fanout]) for i in range(0, len(level), fanout)]
        out.append(level)
    return out


def _siblings(made: list[list[str]], fanout: int, at: int) -> list[tuple[str, str]]:
    """What stands left and right of node ``at`` in its run, at each level of its bucket but the last."""
    out = []
    for level in made[:-1]:
        a = at // fanout * fanout
        out.append(("".join(level[a:at]), "".join(level[at + 1 : a + fanout])))
        at //= fanout
    return out


def fold(node: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a node and its proof lead to."""
    for left, right in siblings:
        node = _digest([left, node, right])
    return node


def _roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, b, at, digest, n) of the buckets of nodes (g, b, at, digest, n): their roots are nodes again."""
    size = fanout**levels

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = int(d["n"].iloc[0])
        made = _collapse(d.sort_values("at")["digest"].tolist(), fanout, levels, n <= size)
        at = int(d["at"].iloc[0]) // size
        return pd.DataFrame({"g": d["g"].iloc[:1], "b": [at // size], "at": [at], "digest": made[-1], "n": [-(-n // size)]})

    return nodes.select("g", "b", "at", "digest", "n").groupBy("g", "b").applyInPandas(run, "g string, b long, at long, digest string, n long")


def _proofs(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, schema: str, of) -> DataFrame:
    """``of(members, their siblings up to the root, what above has of the bucket)`` for each bucket.

    ``above`` has (g, b, siblings, ...) of each bucket's root.
    """
    size = fanout**levels

    def run(d: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("at")
        made = _collapse(d["digest"].tolist(), fanout, levels, int(d["n"].iloc[0]) <= size)
        row = up.iloc[0]
        upper = [(x["l"], x["r"]) for x in row["siblings"]]
        return of(d, (_siblings(made, fanout, i) + upper for i in range(len(d))), row)

    return nodes.groupBy("g", "b").cogroup(above.groupBy("g", "b")).applyInPandas(run, schema)


def _paths(nodes: DataFrame, tops: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """(g, at, siblings, subroot, root) of nodes (g, b, at, digest, n); ``tops``: those of the trees' own roots, by g (none: they end there)."""
    size = fanout**levels
    if nodes.filter(F.col("n") > 1).limit(1).count() == 0:
        own = nodes.select("g", "at", F.col("digest").alias("subroot"))
        if tops is None:
            return own.select("g", "at", F.array().cast(_SIBLINGS).alias("siblings"), "subroot", F.col("subroot").alias("root"))
        return own.join(tops, own["g"].eqNullSafe(tops["_g"])).select(own["g"], "at", "siblings", "subroot", "root")
    roots = saved(_roots(nodes, fanout, levels), "merkle-roots")
    above = saved(_paths(roots, tops, fanout, levels), "merkle-above").withColumnRenamed("at", "b")

    def of(d, siblings, row):
        mine = [[{"l": a, "r": b} for a, b in s] for s in siblings]
        return pd.DataFrame({"g": d["g"], "at": d["at"], "siblings": mine, "subroot": row["subroot"], "root": row["root"]})

    return _proofs(nodes, above, fanout, levels, f"g string, at long, siblings {_SIBLINGS}, subroot string, root string", of)


def _places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (place in its group, from 0) and ``n`` (rows of the group); ``rows`` is a saved table."""
    low = (1 << 33) - 1
    lined = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id())
    lined = saved(lined.withColumn("_p", F.shiftright("_m", 33)).withColumn("_m", F.col("_m").bitwiseAND(F.lit(low))), "merkle-sorted")
    parts = lined.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")
    parts = saved(parts.select("_g", "_q", (F.coalesce(F.sum("_c").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_off"), F.sum("_c").over(w).alias("n")), "merkle-offsets")
    return lined.join(parts, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g"))).select(*rows.columns, (F.col("_m") + F.col("_off")).alias("at"), "n")


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple = FIELDS, changed: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """For each row its leaf, its tree's root, the root, and whether it is verified.

    ``changed`` gives columns another value before verification: the fold of
    that leaf with the proof of the original one is ``folded_root``. With
    ``proofs`` the siblings themselves come too (``proof``: for each level what
    stands left and right of the node in its run).
    """
    size = fanout**levels
    kind = df.schema[key].dataType.simpleString()
    now = leaf([(changed or {}).get(f, F.col(f)) for f in fields]) if changed else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), leaf([F.col(f) for f in fields]).alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))  # null: unchanged
    rows = saved(rows, "merkle-leaves")
    nodes = saved(_places(rows, "g", ["k", "digest", "i"]).withColumn("b", F.floor(F.col("at") / size)), "merkle-nodes")
    dropped(rows)
    roots = saved(_roots(nodes, fanout, levels), "merkle-roots")
    if roots.limit(1).count() == 0:
        above = df.sparkSession.createDataFrame([], f"g string, b long, siblings {_SIBLINGS}, subroot string, root string")
    else:
        trees = roots
        while trees.filter(F.col("n") > 1).limit(1).count():
            done = trees.filter(F.col("n") == 1)
            trees = saved(_roots(trees.filter(F.col("n") > 1), fanout, levels).unionByName(done), "merkle-roots")
        # the trees' roots, in the order of the groups, are one more tree
        tops = saved(trees.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "merkle-tops")
        tops = saved(_places(tops.select("g", "name", "digest"), "g", ["name"]).withColumn("b", F.floor(F.col("at") / size)), "merkle-tops")
        paths = saved(_paths(tops, None, fanout, levels).select("at", "siblings", "root"), "merkle-paths")
        tops = saved(tops.join(paths, "at").select(F.col("name").alias("_g"), "siblings", "root"), "merkle-tops")
        above = saved(_paths(roots, tops, fanout, levels), "merkle-above").withColumnRenamed("at", "b")
    schema = f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {_SIBLINGS}" * proofs

    def of(d, siblings, row):
        root, out = row["root"], []
        for one, now, path in zip(d["digest"].tolist(), d["now"].tolist(), siblings, strict=True):
            folded = fold(now or one, path)
            out.append((_digest([x for p in path for x in p]), folded, folded == root, *([[{"l": a, "r": b} for a, b in path]] if proofs else [])))
        got = pd.DataFrame(out, columns=["proof_sha256", "folded_root", "verified", *(["proof"] if proofs else [])])
        got.insert(0, key, d["k"].values)
        for at, (name, v) in enumerate((("leaf", d["digest"].values), ("subroot", row["subroot"]), ("root", root)), 1):
            got.insert(at, name, v)
        return got

    return _proofs(nodes, above, fanout, levels, schema, of)


__all__ = ["fold", "leaf", "manifest", "tampered"]
