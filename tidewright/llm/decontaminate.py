"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

Tokens are the runs of a text between ASCII characters that are no letters or
digits, in lower case. An item is found in a text where, the two laid over each
other at some shift, of ``WINDOW`` successive tokens (or of all that overlap, if
they are fewer, at least ``SPAN``) a share of ``MATCH`` agree. Items with fewer
than ``SPAN`` tokens are found where all of them stand in a row.

Fixed masks lay over every position and hash only the tokens that they keep, so
a seed survives substitutions elsewhere. Whichever two of ``SPAN`` successive
tokens are replaced, one of the masks fits beside them; windows of up to
``WINDOW`` tokens allow no more than two, so no overlap is missed. A bitmap of
the test seeds, bounded in size, sorts out nearly all training seeds in the
scan; the rest are joined with the test seeds, and the hits fold to diagonals
(text, item, shift). Around each the tokens of both are compared, once for each
distinct text.

Seeds that more than ``HOT_ITEMS`` items share (stock phrases) would give a
candidate for every such item and every text with the phrase. They are not
joined: around each, whole windows of item and text are hashed instead, with
every choice of two positions left out, so that equal hashes are windows that
agree as asked for. Windows of ``WINDOW`` tokens serve where the two overlap by
so many; shorter overlaps (a text's edge against an item's, a whole short item,
a whole short text) have windows of their own. So candidates follow the items
found, not the square of a phrase's spread, and nothing is missed.

Defined results: null and empty texts hold nothing, null and empty items match
nothing; repeated rows and repeated ids fold to one row for each (doc_id,
item_id); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dropped, saved

SPAN = 10
#: Positions that each mask keeps: with any two of SPAN tokens replaced, one of these fits between them.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6))
WINDOW = 13
MATCH = 0.8
#: Items that may share a seed that is joined as it is.
HOT_ITEMS = 8
#: Rows of a table that is broadcast.
MAX_BROADCAST = 500_000
#: Bits of the bitmap for each test seed, and at most: 2^28 are 32 MB.
BITS_PER_SEED = 128
MAX_BITMAP_POWER = 28
_BREAK = r"[\x00-/:-@\[-`{-\x7f]+"


def tokens(text: Column) -> Column:
    """64-bit hashes of a text's tokens."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), ""), lambda t: F.xxhash64(t))


def _once(c: Column, name: str) -> Column:
    """A column that is computed before what uses it, where projections would else be merged into lambdas and run again for each element."""
    return F.explode(F.array(c)).alias(name)


def seeds(df: DataFrame, h: str, masks: tuple, *keep: str) -> DataFrame:
    """One row for each position that a mask fits at: ``keep``, the position ``p``, and the masks' seeds (null where one does not fit)."""
    least, width = min(m[-1] for m in masks) + 1, max(m[-1] for m in masks) + 1
    n = F.size(h) - least + 1
    cols = [F.sequence(F.lit(0), n - 1).alias("p"), *(F.slice(h, k + 1, n).alias(f"t{k}") for k in range(width))]
    w = df.filter(n > 0).select(*keep, F.inline(F.arrays_zip(*cols)))
    w = w.toDF(*keep, "p", *(f"t{k}" for k in range(width)))
    return w.select(*keep, "p", *(F.when(F.col(f"t{m[-1]}").isNotNull(), F.xxhash64(F.lit(",".join(map(str, m))), *(f"t{k}" for k in m))).alias(f"s{i}") for i, m in enumerate(masks)))


def _bitmap(test: DataFrame, total: int) -> tuple[DataFrame, int]:
    """One row with an array of longs, 64 bits each, where the bits of the seeds ``k`` are set; the power of its bits."""
    power = min(MAX_BITMAP_POWER, max(12, (BITS_PER_SEED * total).bit_length()))
    word = F.shiftrightunsigned("k", 64 - power + 6).cast("int")
    some = test.groupBy(word.alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(63).cast("int"))).alias("w"))
    every = test.sparkSession.range(1 << (power - 6)).select(F.col("id").cast("int").alias("i")).join(some, "i", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("x"))
    return saved(one.select(F.col("x.w").alias("bits")), "bitmap"), power


def _hits(d: DataFrame, bench: DataFrame) -> DataFrame:
    """th, item_id, shift, lo and hi (first and last position in the item): the diagonals on which a seed is shared."""
    short = sorted(r[0] for r in bench.filter(F.size("ih") < SPAN).select(F.size("ih")).distinct().collect())
    masks = (*MASKS, *(tuple(range(n)) for n in short))
    own = [*(F.when(F.size("ih") >= SPAN, F.col(f"s{i}")) for i in range(len(MASKS))), *(F.when(F.size("ih") == n, F.col(f"s{i}")) for i, n in enumerate(short, len(MASKS)))]
    some = lambda cols: F.explode(F.filter(F.array(*cols), lambda s: s.isNotNull())).alias("k")
    whole = F.when(F.size("ih") < SPAN, True).alias("whole")
    test = saved(seeds(bench, "ih", masks, "item_id", "ih").select("item_id", F.col("p").alias("ip"), whole, some(own)), "seeds")
    total = test.count()
    hot = saved(test.filter("whole is null").groupBy("k").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") > HOT_ITEMS).select("k"), "hot-seeds")
    many = hot.limit(1).count() > 0
    bits, power = _bitmap(test.select("k"), total)
    inside = _inside(bits, power)
    w = seeds(d.select("th", _once(tokens(F.col("text")), "dh")), "dh", masks, "th")
    w = w.select("th", "p", *(F.when(inside(F.col(f"s{i}")), F.col(f"s{i}")).alias(f"s{i}") for i in range(len(masks))))
    w = w.filter(F.coalesce(*(f"s{i}" for i in range(len(masks)))).isNotNull()).select("th", "p", some([f"s{i}" for i in range(len(masks))]))
    w = saved(w, "seen") if many else w
    cold = test.join(F.broadcast(hot) if total <= MAX_BROADCAST else hot, "k", "left_anti") if many else test
    met = w.join(F.broadcast(cold) if total <= MAX_BROADCAST else cold, "k").select("th", "item_id", (F.col("p") - F.col("ip")).alias("shift"), "ip")
    if many:
        met = met.unionByName(_window_hits(d, bench, w, test, hot))
    fold = met.groupBy("th", "item_id", "shift").agg(F.min("ip").alias("lo"), F.max("ip").alias("hi"))
    out = saved(fold, "hits")
    for t in (test, bits, hot, *([w] if many else [])):
        dropped(t)
    return out


def _inside(bits: DataFrame, power: int):
    """Whether a seed's bit is set."""
    return lambda s: F.getbit(F.get(bits.scalar(), F.shiftrightunsigned(s, 64 - power + 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1


def _starts(p: str, n: Column, size: int) -> Column:
    """The first positions of windows of ``size`` of ``n`` tokens that may hold a seed at one of the positions ``p``."""
    least = max(0, size - min(m[-1] for m in MASKS) - 1)
    near = F.flatten(F.transform(p, lambda x: F.sequence(x - least, x)))
    return F.array_distinct(F.filter(near, lambda s: (s >= 0) & (s <= n - size)))


def _windows(h: str, plans: list[tuple[str, int, Column, Column]], *keep: str):
    """For each plan (tag, size, starts, condition) the windows of ``h``: ``keep``, the position ``p``, and ``k``, a hash for each choice of two positions left out."""

    def some(tag: str, size: int, starts: Column, ok: Column) -> Column:
        return F.when(ok, F.transform(starts, lambda s: F.struct(s.cast("int").alias("p"), F.lit(tag).alias("tag"), F.slice(h, s + 1, size).alias("t")))).otherwise(F.array())

    parts = [some(*plan) for plan in plans]

    def of(df: DataFrame) -> DataFrame:
        w = df.select(*keep, F.explode(F.concat(*parts)).alias("w")).select(*keep, "w.p", "w.tag", F.transform("w.t", lambda t, i: F.xxhash64(i, t)).alias("m"))
        w = w.select(*keep, "p", "tag", _once(F.col("m"), "m")).withColumn("all", F.aggregate("m", F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x)))
        place = F.sequence(F.lit(0), F.size("m") - 1)
        pairs = F.flatten(F.transform(place, lambda i: F.transform(F.filter(place, lambda j: j > i), lambda j: F.xxhash64(F.col("all").bitwiseXOR(F.get("m", i)).bitwiseXOR(F.get("m", j)), i, j, F.col("tag")))))
        return w.select(*keep, "p", F.explode(pairs).alias("k"))

    return of


def _window_hits(d: DataFrame, bench: DataFrame, seen: DataFrame, test: DataFrame, hot: DataFrame) -> DataFrame:
    """th, item_id, shift, ip: windows around hot seeds in which item and text agree but for two tokens."""
    sizes = range(SPAN, WINDOW)  # of shorter overlaps; all of them, and WINDOW, allow two tokens to differ
    mine = test.join(hot, "k", "left_semi").groupBy("item_id").agg(F.collect_set("ip").alias("ps"))
    items = bench.join(mine, "item_id").select("item_id", "ih", "ps", F.size("ih").alias("n"))
    n, always = F.col("n"), F.lit(True)
    one = lambda c: F.array(c.cast("int"))
    plans = [("F", WINDOW, _starts("ps", n, WINDOW), n >= WINDOW)]
    for size in sizes:
        plans += [(f"S{size}", size, one(n - size), n >= size), (f"E{size}", size, one(F.lit(0)), n >= size), (f"W{size}", size, one(F.lit(0)), n == size), (f"D{size}", size, _starts("ps", n, size), always)]
    keys = saved(_windows("ih", plans, "item_id")(items).withColumnRenamed("p", "ip"), "window-keys")
    total = keys.count()
    bits, power = _bitmap(keys.select("k"), total)
    at = saved(seen.join(F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot, "k", "left_semi").groupBy("th").agg(F.collect_set("p").alias("ps")), "hot-texts")
    few = at.count() <= MAX_BROADCAST
    text = d.join(F.broadcast(at.select("th")) if few else at.select("th"), "th", "left_semi").groupBy("th").agg(F.max("text").alias("text"))
    texts = text.join(at, "th").select("th", "ps", _once(tokens(F.col("text")), "dh")).withColumn("n", F.size("dh"))
    plans = [("F", WINDOW, _starts("ps", n, WINDOW), n >= WINDOW)]
    for size in sizes:
        plans += [(f"S{size}", size, one(F.lit(0)), n >= size), (f"E{size}", size, one(n - size), n >= size), (f"W{size}", size, _starts("ps", n, size), always), (f"D{size}", size, one(F.lit(0)), n == size)]
    seen_keys = _windows("dh", plans, "th")(texts).filter(_inside(bits, power)(F.col("k")))
    met = seen_keys.join(F.broadcast(keys) if total <= MAX_BROADCAST else keys, "k")
    return met.select("th", "item_id", (F.col("p") - F.col("ip")).alias("shift"), "ip").distinct()


def _some(df: DataFrame) -> DataFrame:
    """A table of distinct rows without texts, broadcast where it is small."""
    t = saved(df.distinct(), "keys")
    return F.broadcast(t) if t.count() <= MAX_BROADCAST else t


def _best(agree: Column, w: Column) -> Column:
    """(agree, at): the most agreements in ``w`` successive positions, and minus the first of those."""
    ones = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(agree) - w), lambda i: F.struct(ones(F.slice(agree, i + 1, w)).alias("agree"), (-i).alias("at"))))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, th (hash of its text), item_id, and of its best window agree (tokens), window (its length) and doc_start."""
    bench = saved(benchmark.select(F.col(item).alias("item_id"), tokens(F.col(item_text)).alias("ih")).filter(F.size("ih") > 0).distinct(), "items")
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    hits = _hits(d.select("th", "text"), bench)
    mine = saved(d.join(_some(hits.select("th")), "th", "left_semi"), "suspects")
    one = mine.groupBy("th").agg(F.max("text").alias("text")).select("th", _once(tokens(F.col("text")), "dh"))
    # compared from WINDOW tokens before the first seed to WINDOW after the last, within both texts
    c = hits.join(one, "th").join(bench, "item_id")
    full = F.size("ih") < SPAN
    a = F.greatest(F.lit(0), F.col("lo") - WINDOW, -F.col("shift"))
    z = F.least(F.size("ih"), F.col("hi") + SPAN + WINDOW, F.size("dh") - F.col("shift"))
    c = c.withColumn("a", a).withColumn("n", z - a).withColumn("w", F.when(full, F.size("ih")).otherwise(F.least(F.lit(WINDOW), F.col("n"))))
    c = c.filter(F.col("n") >= F.least(F.lit(SPAN), F.size("ih")))
    agree = F.zip_with(F.slice("ih", F.col("a") + 1, F.col("n")), F.slice("dh", F.col("a") + F.col("shift") + 1, F.col("n")), lambda x, y: (x == y).cast("int"))
    need = F.when(full, F.col("w")).otherwise(F.ceil(F.col("w") * MATCH))
    c = c.select("th", "item_id", (F.col("a") + F.col("shift")).alias("from"), "w", need.alias("need"), _once(agree, "agree"))
    c = c.select("th", "item_id", "from", "w", "need", _once(_best(F.col("agree"), F.col("w")), "x")).filter("x.agree >= need")
    found = c.groupBy("th", "item_id").agg(F.max(F.struct("x.agree", "w", (F.col("x.at") - F.col("from")).alias("at"))).alias("x"))
    out = found.select("th", "item_id", F.col("x.agree").alias("agree"), F.col("x.w").alias("window"), (-F.col("x.at")).alias("doc_start"))
    return mine.select("doc_id", "th").join(out, "th").select("doc_id", "th", "item_id", "agree", "window", "doc_start")


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row for each document and item found in it, with the best window: most agreements, then the longest, then the first."""
    best = F.max(F.struct("agree", "window", (-F.col("doc_start")).alias("at"))).alias("x")
    found = find(docs, benchmark, **names).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", F.col("x.agree").cast("long").alias("agree"), F.col("x.window").cast("long").alias("window"), (-F.col("x.at")).cast("long").alias("doc_start"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    bad = _some(find(docs, benchmark, key=key, text=text, **names).select(F.col("th").alias("__tw_t")))
    return docs.join(bad, F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__tw_t"), "left_anti")
