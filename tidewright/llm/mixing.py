"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source's documents, shuffled by hash and laid end to end,
are cut into blocks of equally many words. A golden-ratio sequence of points
in [0, 1) runs through the cumulative target weights: each point gives a slot
to the source in whose interval it falls. The slots of a source are ranked, and
the r-th takes the source's r-th block, starting over after the last. Slots
end where the source's target is reached (the last may take part of a block),
and slots that the finite sequence left out follow at its end.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
``total`` times all words; none gets more than ``most`` times its own words, and
the excess is shared by weight among the others until none is above.

Defined results: null and empty texts have size 0 and are never taken; an empty
table gives an empty mix; repeated rows and ids are documents of their own;
extra columns are ignored. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, saved

BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
#: Documents of a source in one bucket of the shuffled order, on average.
BUCKET_ROWS = 2_000
PHI = (math.sqrt(5) - 1) / 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def allot(sizes: list[tuple[str | None, int]], total: float = TOTAL, most: float = MOST, weights: tuple = WEIGHTS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by water-filling; ``sizes`` has a row for each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, target = total * sum(n for _, n in order), {}
    open_ = [(s, n) for s, n in order]
    while open_:
        w = sum(weight[s] for s, _ in open_)
        full = [(s, n) for s, n in open_ if left * weight[s] / w > most * n]
        if not full:
            target |= {s: left * weight[s] / w for s, _ in open_}
            break
        target |= {s: most * n for s, n in full}
        left -= sum(most * n for _, n in full)
        open_ = [x for x in open_ if x[0] not in target]
    return [(s, n, target[s]) for s, n in order]


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of known size where it has few rows; else Spark's own choice."""
    return F.broadcast(df) if rows <= 100_000 else df


def _point(i: Column) -> Column:
    """frac(i * PHI), by parts so that large i keep their digits."""
    step = 1 << 20
    frac = lambda x: x - F.floor(x)
    return frac(frac((i / step).cast("long") * F.lit((PHI * step) % 1.0)) + (i % step) * F.lit(PHI))


def slots_for(n: int, take: int, block: int) -> int:
    """Slots that take ``take`` words from a source of ``n``: the last block of each pass is short."""
    return take // n * -(-n // block) + -(-(take % n) // block)


def schedule(spark, quota: dict[int, int]) -> DataFrame:
    """The slots: (slot, s, r), r the rank of the slot in source number s, which gets ``quota[s]`` of them.

    Ranks are counts over buckets of slots, then within a bucket, so no
    source's slots meet in one task.
    """
    quota = {s: q for s, q in quota.items() if q > 0}
    n, total = sum(quota.values()), float(sum(quota.values()) or 1)
    if not n:
        return spark.range(0).selectExpr("id as slot", "0 as s", "id as r")
    rows, lo = [], 0.0
    for s, q in quota.items():
        rows.append((s, lo, lo + q / total, q))
        lo += q / total
    cells = 4 * len(rows)
    spread = [(c, *r) for r in rows for c in range(int(r[1] * cells), min(cells - 1, int(r[2] * cells)) + 1)]
    ranges = spark.createDataFrame(spread, "c int, s int, lo double, hi double, q long")
    last = rows[-1][0]
    points = spark.range(n).select(F.col("id").alias("slot"), _point(F.col("id")).alias("x")).withColumn("c", F.least(F.floor(F.col("x") * cells).cast("int"), F.lit(cells - 1)))
    inside = (F.col("x") >= F.col("lo")) & ((F.col("x") < F.col("hi")) | (F.col("s") == last))
    own = points.join(_small(ranges, len(spread)), "c").filter(inside).select("slot", "s", "q").withColumn("g", F.floor(F.col("slot") / 50_000))
    before = own.groupBy("s", "g").agg(F.count("*").alias("k")).withColumn("at", F.coalesce(F.sum("k").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("s", "g").orderBy("slot")) - 1).join(before.select("s", "g", "at"), ["s", "g"]).select("slot", "s", (F.col("at") + F.col("k")).alias("r"), "q").filter("r < q")
    have = before.groupBy("s").agg(F.sum("k").alias("n"))
    every = spark.createDataFrame([(s, q) for s, q in quota.items()], "s int, q long")
    short = every.join(have, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < q")
    rest = short.select("s", F.explode(F.sequence(F.col("n").cast("long"), F.col("q") - 1)).alias("r"))
    return ranked.select("slot", "s", "r").unionByName(rest.select((F.lit(n) + F.col("r")).alias("slot"), "s", "r"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first slot that takes from the document."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("src"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    d = saved(d, "mix")
    sizes = [(r.src, r.n or 0, r.k) for r in d.groupBy("src").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()]
    rows = sum(k for _, _, k in sizes)
    allotted = allot([(s, n) for s, n, _ in sizes])
    if not allotted:
        return spark.createDataFrame([], f"doc_id {docs.schema[key].dataType.simpleString()}, size long, source_size long, target double, taken long, first_slot long")
    # a source's blocks are no longer than a hundredth of its target, so that small sources mix finely too
    lengths = [max(1, min(block, int(t // 100))) for _, _, t in allotted]
    table = spark.createDataFrame([(i, s, n, t, lengths[i]) for i, (s, n, t) in enumerate(allotted)], "s int, src string, source_size long, target double, block long")
    d = d.join(_small(table, len(allotted)), d["src"].eqNullSafe(table["src"])).select("doc_id", "s", "size", "h", "source_size", "target", "block")
    # the shuffled order: buckets of hashes, summed up by bucket first
    buckets = max(1, -(-rows // BUCKET_ROWS))
    d = d.withColumn("g", F.shiftrightunsigned("h", 34) % buckets)
    base = d.groupBy("s", "g").agg(F.sum("size").alias("n"))
    base = base.withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("s", "g", "at")
    run = F.sum("size").over(Window.partitionBy("s", "g").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("to", run).join(base, ["s", "g"]).withColumn("b", F.col("at") + F.col("to")).withColumn("a", F.col("b") - F.col("size")).drop("g", "at", "to")
    d = d.withColumn("row", F.monotonically_increasing_id())
    d = saved(d, "mix-laid")
    # what the schedule takes of each block: whole times, and once a part
    take = [(i, n, int(t), lengths[i]) for i, (_, n, t) in enumerate(allotted) if n]
    slots = schedule(spark, {s: slots_for(n, t, b) for s, n, t, b in take})
    per = spark.createDataFrame([(s, n, -(-n // b), t, b) for s, n, t, b in take] or [(-1, 1, 1, 0, 1)], "s int, n long, blocks long, take long, block long")
    cut = slots.join(_small(per, len(take)), "s").withColumn("blk", F.col("r") % F.col("blocks")).withColumn("epoch", F.floor(F.col("r") / F.col("blocks")))
    length = F.least(F.col("block"), F.col("n") - F.col("blk") * F.col("block"))
    cut = cut.withColumn("len", length).withColumn("use", F.least("len", F.col("take") - F.col("epoch") * F.col("n") - F.col("blk") * F.col("block"))).filter("use > 0")
    blocks = cut.groupBy("s", "blk").agg(F.sum((F.col("use") == F.col("len")).cast("long")).alias("whole"), F.max(F.when(F.col("use") < F.col("len"), F.col("use"))).alias("part"), F.min("slot").alias("slot"))
    pieces = d.filter("size > 0").select("row", "s", "a", "b", "block", F.explode(F.sequence(F.floor(F.col("a") / F.col("block")), F.floor((F.col("b") - 1) / F.col("block")))).alias("blk"))
    start = F.col("blk") * F.col("block")
    lo, hi = F.greatest("a", start), F.least("b", start + F.col("block"))
    got = pieces.join(blocks, ["s", "blk"]).select("row", (F.col("whole") * (hi - lo) + F.greatest(F.lit(0), F.least(hi, start + F.coalesce("part", F.lit(0))) - lo)).alias("taken"), "slot")
    got = got.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    return d.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
