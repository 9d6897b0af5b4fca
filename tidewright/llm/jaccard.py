"""N-gram Jaccard join: rare-first prefix filtering, every pair verified once.

A document is the set of its distinct ``n``-word shingles. All shingles are
counted into a table of hashed counters that grows with the corpus; its counts,
then the hashes, order every set from rare to frequent. Sets with similarity ``num/den`` share a
shingle among their first m - ceil(num*m/den) + 1, so only those prefixes are
joined. Equal sets are one node.

* Members of a shingle's group are compared to its hub, the member with the
  most common shingles; groups of more than ``GROUP`` members go no further
  than that, smaller ones also give their pairs, less those that length or position
  rule out, those already connected, and those whose sketches (counts of hashed
  ranges, two to four shingles each, so they grow with the set) differ by more
  than a linked pair can.
* In a larger group a member's difference to the hub (its added, then its
  missing shingles) is a set itself. Two members that are not both linked to
  the hub can link only if their differences overlap by more than half the
  smaller one, or by the excess of an unlinked one: a second, exact prefix join
  on differences. So no group's pairs are enumerated and no link is lost. Only
  the prefixes of differences are kept, and of these only what two members share
  is joined.
* Only the texts of the pairs that are left are read again, through a bitmap of
  their ids. They are brought to their hub (in shares, if it has many) and the
  similarity is computed from the shingles, in rounds of bounded size.

Links are folded to components. Shingles whose counter is above ``COLD`` are
grouped by a pre-aggregation and a join that Spark splits where it is skewed;
the others by one shuffle, in groups no larger than that.

Defined results: null texts and texts without a word have the empty set and
link to nothing; texts shorter than ``n`` words are one shingle; repeated rows
and equal texts share a component; a component is named by its smallest id;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import doc_word_hashes, dropped, map_rows, mix, saved, signed, small_batches
from .decontaminate import _bitmap, _inside
from .graph import components

#: There are from 2^19 to 2^23 counters, each for about so many shingles (words are taken to have six characters).
SKETCH_BITS = (19, 23)
SHINGLES = 256
SLICES = 64
GROUP = 32
#: A sketch has from 2^5 to 2^14 ranges.
RANGE_BITS = (5, 14)
SHARE = 400
#: Pairs are verified in rounds that move half the needed nodes' texts each, or so many; sketches in rounds of two pairs a document.
ROUND = 20_000
#: Shingles whose counter is above go by aggregation and join; the others' groups are windows, no larger than this.
COLD = 5_000
_U = np.uint64


def shingle_sets(texts: list[str | None], n: int):
    """The sorted distinct shingle hashes of each text."""
    for at, to, h, offs in doc_word_hashes(texts):
        size = max(0, len(h) - n + 1)
        acc = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[k : k + size] + _U(k + 1))
        for i in range(to - at):
            a, b = int(offs[i]), int(offs[i + 1])
            if b - a >= n:
                yield np.unique(acc[a : b - n + 1])
            elif b > a:
                one = _U(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        one = mix(np.array([one * _U(0xD1342543DE82EF95) + x]))[0]
                yield np.array([one], dtype=np.uint64)
            else:
                yield np.empty(0, np.uint64)


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each hashed range occur in all documents: ``counter_bits`` says how many counters.

    Each task sums up its own; slices of them are added up as streams, in two
    rounds, so that no task reads more than some hundred of them.
    """
    small_batches(docs.sparkSession)
    bits = counter_bits(docs.agg(F.sum(F.length(docs.columns[0]))).first()[0] or 0)
    size = 1 << bits
    step = size // SLICES
    most = 0xFFFFFFFF

    def count(batches):
        total, got, held = np.zeros(size, dtype=np.uint32), [], 0

        def put():
            np.add(total, np.bincount((np.concatenate(got) >> _U(64 - bits)).astype(np.int64), minlength=size), out=total, casting="unsafe")
            got.clear()

        for b in batches:
            for u in shingle_sets(b.column(0).to_pylist(), n):
                if len(u):
                    got.append(u)
                    held += len(u)
                if held > size // 2:
                    put()
                    held = 0
        if got:
            put()
        if total.any():
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() // 128
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "part", "counts"])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k, v = (k[0], k[1] // 128), np.frombuffer(v, np.uint32).astype(np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([np.minimum(v, most).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], ["slice", "part", "counts"])

    kind = "slice int, part int, counts binary"
    rows = docs.mapInArrow(count, kind).repartition("slice", "part").mapInArrow(add, kind).repartition(SLICES // 4, "slice").mapInArrow(add, kind).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r.slice * step : (r.slice + 1) * step] += np.frombuffer(r.counts, np.uint32)
    return np.minimum(out, most).astype(np.uint32)


def counter_bits(chars: int) -> int:
    """The power of the number of counters for texts of so many characters: with fixed ones, those of a large corpus would all be about as high, and common shingles pass as rare."""
    return min(max(round(np.log2(max(1, chars / 6 / SHINGLES))), SKETCH_BITS[0]), SKETCH_BITS[1])


def sketch(u: np.ndarray) -> bytes:
    """How many shingles of a set each hashed range holds (255: as many or more); ranges are the low bits, from a quarter to half as many as shingles."""
    bits = min(max(len(u).bit_length() - 2, RANGE_BITS[0]), RANGE_BITS[1])
    return np.minimum(np.bincount((u & _U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def gap(x: bytes, y: bytes) -> int:
    """What the symmetric difference of two sets is at least, by their sketches; the finer one is folded."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    size = min(len(a), len(b))
    a, b = (np.minimum(v.reshape(-1, size).sum(axis=0), 255) for v in (a, b))
    return int(np.abs(a - b).sum())


def _prefixes(docs: DataFrame, counts: np.ndarray, n: int, num: int, den: int, kind: str) -> DataFrame:
    """doc_id, th (hash of the text), key (hash of the set), m (its size), score, sig (its sketch), toks (the prefix), hot (how many at its end may be very frequent)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    drop = _U(64 - (len(counts).bit_length() - 1))

    def make():
        table = shared.value

        def f(cols):
            out = [[] for _ in range(6)]
            for u in shingle_sets(cols[2], n):
                m = len(u)
                out[1].append(m)
                if not m:
                    for c in (0, 2, 3, 4, 5):
                        out[c].append(None)
                    continue
                c = table[(u >> drop).astype(np.int64)]
                k = m - -(-num * m // den) + 1
                first = np.lexsort((u, c))[:k]
                out[0].append(int(signed(mix(np.array([mix(u).sum() + _U(m)])))[0]))
                out[2].append(float(np.log2(c + 1.0).mean()))
                out[3].append(sketch(u))
                out[4].append(signed(u[first]).tolist())
                out[5].append(int((c[first] > COLD).sum()))
            return [*cols[:2], *out]

        return f

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), f"doc_id {kind}, th long, key long, m int, score float, sig binary, toks array<long>, hot int", make)


def _groups(nodes: DataFrame) -> DataFrame:
    """t, key, pos, m, cnt (members of the shingle's group), hub, hub_m: of groups of two or more."""
    first = F.size("toks") - F.col("hot")
    lead = F.max(F.struct("score", "key", "m"))
    # equal sets are one node; of the few with frequent shingles in the prefix only those move a second time
    cold = nodes.select("key", "m", "score", F.slice("toks", F.lit(1), first).alias("toks")).dropDuplicates(["key"])
    cold = cold.select("key", "m", "score", F.posexplode("toks").alias("pos", "t"))
    w = Window.partitionBy("t")
    cold = cold.withColumn("cnt", F.count("*").over(w)).withColumn("lead", lead.over(w)).filter("cnt > 1")
    warm = nodes.filter("hot > 0").select("key", "m", "score", first.alias("at"), F.slice("toks", first + 1, F.col("hot")).alias("toks")).dropDuplicates(["key"])
    warm = warm.select("key", "m", "score", "at", F.posexplode("toks").alias("p", "t")).select("t", "key", (F.col("at") + F.col("p")).alias("pos"), "m", "score")
    by = warm.groupBy("t").agg(F.count("*").alias("cnt"), lead.alias("lead")).filter("cnt > 1")
    both = cold.unionByName(warm.join(by, "t"))
    return both.select("t", "key", "pos", "m", "cnt", F.col("lead.key").alias("hub"), F.col("lead.m").alias("hub_m"))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b, linked, m (of a), m_b, k (size of the difference), delta (where asked for by ``big``: the prefix of the difference that ``_delta_pairs`` joins): of distinct pairs (a, b, big)."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    p = pairs.join(sizes, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")))
    hubs = sizes.select(F.col("b").alias("key"), F.col("b").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(False).alias("big"), F.lit(0).alias("role"))
    need = p.select(F.col("a").alias("key"), F.col("b").alias("home"), "share", "big", F.lit(1).alias("role")).unionByName(hubs)
    placed = need.join(texts, "key").repartition("home", "share").sortWithinPartitions("home", "share", "role", "key").select("home", "share", "role", "key", "big", "text")

    def run(batches):
        hub, where = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                home, share, role, key, big, text = (c.to_pylist() for c in batch.slice(at, 512).columns)
                out = [[] for _ in range(7)]
                for i, u in enumerate(shingle_sets(text, n)):
                    if role[i] == 0:
                        hub, where = u, (home[i], share[i])
                        continue
                    if where != (home[i], share[i]):
                        raise ValueError("a hub's text is missing")
                    spot = np.minimum(np.searchsorted(hub, u), len(hub) - 1)
                    inside = hub[spot] == u
                    both = int(inside.sum())
                    union = len(u) + len(hub) - both
                    near, k, delta = den * both >= num * union, union - both, None
                    if big[i]:
                        there = np.zeros(len(hub), dtype=bool)
                        there[spot[inside]] = True
                        delta = signed(np.concatenate([u[~inside], hub[~there]])[: _cut(near, k, len(u) + len(hub), num, den)]).tolist()
                    for o, v in zip(out, (key[i], home[i], near, len(u), len(hub), k, delta), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["a", "b", "linked", "m", "m_b", "k", "delta"])

    return placed.mapInArrow(run, "a long, b long, linked boolean, m int, m_b int, k int, delta array<long>")


def _cut(linked: bool, k: int, sizes: int, num: int, den: int) -> int:
    """How many of a difference's ``k`` shingles its prefix has; ``sizes``: of the set and its hub together."""
    s = num + den
    least = -(-num * k // s) if linked else -(-(s * k - (den - num) * sizes) // (2 * den))
    return max(0, k - max(1, least) + 1)


def _verified(pairs: DataFrame, texts: DataFrame, nodes: int, n: int, num: int, den: int, linked: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """``_verify`` in rounds, and the saved tables: shuffled texts of one round are gone before the next, so disk does not follow the pairs a text has."""
    pairs = saved(pairs, "pairs")
    rounds = max(1, -(-2 * pairs.count() // max(nodes, ROUND)))
    parts = []
    for i in range(rounds):
        got = _verify(pairs.filter(F.pmod(F.xxhash64("b"), F.lit(rounds)) == i), texts, n, num, den)
        parts.append(saved(got.filter("linked").select("a", "b") if linked else got, "verified"))
    dropped(pairs)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, parts


def _delta_pairs(done: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of members of one large group, not both linked to its hub, whose differences to the hub may overlap enough; and the saved tables."""
    post = done.filter("size(delta) > 0").select("b", "a", "m", "k", "linked", F.posexplode("delta").alias("pos", "t"))
    s = num + den
    # what one member alone has, or only linked ones, goes no further than this count
    spot = F.xxhash64("b", "t")
    twice = post.groupBy(spot.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("near")).filter("n > 1 and not near")
    twice = saved(twice.select("k"), "shared")
    post, bits = _few(post, spot, twice)
    # of each pair one at least is not linked to the hub, so only those look for partners
    x = post.filter(~F.col("linked")).select("b", "t", *(F.col(c).alias(f"{c}1") for c in ("a", "m", "k", "linked", "pos")))
    y = post.select("b", "t", *(F.col(c).alias(f"{c}2") for c in ("a", "m", "k", "linked", "pos")))
    need = (F.col("k1") + F.col("k2") - F.lit(den - num) * (F.col("m1") + F.col("m2")) / s) / 2
    # holds for the first token that a linked pair shares: all others come after it in both
    able = F.least(F.col("k1") - F.col("pos1"), F.col("k2") - F.col("pos2"))
    both = x.join(y, ["b", "t"]).filter((F.col("a1") != F.col("a2")) & (F.col("linked2") | (F.col("a1") < F.col("a2"))) & (able >= need - 1e-6))
    return both.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b")), [twice, bits]


def _small_pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs within groups of at most GROUP members that length and position leave."""
    g = groups.filter(F.col("cnt") <= GROUP)
    x = g.select("t", F.col("key").alias("a"), F.col("m").alias("m1"), F.col("pos").alias("p1"))
    y = g.select("t", F.col("key").alias("b"), F.col("m").alias("m2"), F.col("pos").alias("p2"))
    need = F.lit(num) * (F.col("m1") + F.col("m2")) / (num + den)
    # holds for the first shingle that a linked pair shares (or that one's group is a larger one)
    able = F.least(F.col("m1") - F.col("p1"), F.col("m2") - F.col("p2"))
    ok = (F.col("a") < F.col("b")) & (F.least("m1", "m2") * den >= F.greatest("m1", "m2") * num) & (able >= need - 1e-6)
    return x.join(y, "t").filter(ok).select("a", "b")


def _few(df: DataFrame, by: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``by`` is one of the 64-bit hashes ``keys`` (k), with a few others: a bitmap of 32 bits or more a key is asked; and the bitmap, saved."""
    bits, power = _bitmap(keys, -(-keys.count() // 4))
    return df.filter(_inside(bits, power)(by)), bits


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("k"))


def _sieved(pairs: DataFrame, rows: DataFrame, docs: int, num: int, den: int) -> DataFrame:
    """a, b: the pairs (a saved table) whose sketches do not already differ too much."""
    got, bits = _few(rows, F.col("key"), _ends(pairs))
    own = saved(got.select("key", "m", "sig").dropDuplicates(["key"]), "sketches")
    rounds = max(1, -(-pairs.count() // (2 * max(docs, ROUND))))

    def run(batches):
        for batch in batches:
            m1, m2, s1, s2 = (batch.column(c).to_pylist() for c in ("m1", "m2", "s1", "s2"))
            keep = [gap(x, y) * (num + den) <= (den - num) * (m + o) for m, o, x, y in zip(m1, m2, s1, s2, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = None
    for i in range(rounds):
        p = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == i).select("a", "b")
        p = p.join(own.toDF("a", "m1", "s1"), "a").join(own.toDF("b", "m2", "s2"), "b").select("a", "b", "m1", "m2", "s1", "s2")
        part = saved(p.mapInArrow(run, "a long, b long"), "sieved")
        out = part if out is None else out.unionByName(part)
    for t in (bits, own):
        dropped(t)
    return out


def _texts(docs: DataFrame, rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """key, text (saved) of the nodes of ``pairs``: any document of a node lends its text."""
    got, bits = _few(rows, F.col("key"), _ends(pairs))
    want = saved(got.select("key", F.col("doc_id").alias("_id")).dropDuplicates(["key"]), "wanted")
    near, ids = _few(docs, F.xxhash64("doc_id"), want.select(F.xxhash64("_id").alias("k")))
    # an id may stand for several texts, the key tells them apart
    out = saved(_own_text(near.join(want, near["doc_id"].eqNullSafe(want["_id"])).select("key", "text"), n), "texts", "zstd")
    for t in (bits, want, ids):
        dropped(t)
    return out


def join(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``; see the module's text."""
    rows, named = _components(docs, n, percent, key, text)
    out = rows.join(named.select("key", "name"), "key", "left")
    out = saved(out.select("doc_id", F.col("m").cast("long").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id")), "joined")
    for t in (rows, named):
        dropped(t)
    return out


def _components(docs: DataFrame, n: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, key, m, ...) with the key of their set, and for each key the name of its component and the key that lends it."""
    num, den = percent, 100
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    counts = shingle_counts(d.select("text"), n)
    rows = saved(_prefixes(d, counts, n, num, den, kind), "prefixes")
    # one node for each distinct set
    nodes = rows.filter("key is not null")
    size = nodes.count()
    groups = saved(_groups(nodes.select("key", "m", "score", "hot", "toks")), "groups")
    stars = groups.filter("key != hub").groupBy(F.col("key").alias("a"), F.col("hub").alias("b")).agg(F.max(F.col("cnt") > GROUP).alias("big"), F.first("m").alias("m"), F.first("hub_m").alias("hub_m"))
    near = F.least("m", "hub_m") * den >= F.greatest("m", "hub_m") * num
    stars = saved(stars.filter(F.col("big") | near).select("a", "b", "big"), "stars")
    small = _sieved(stars.filter(~F.col("big")), rows, size, num, den)
    asked = saved(stars.filter("big").unionByName(small.withColumn("big", F.lit(False))), "asked")
    texts = _texts(d, rows, asked, n)
    done, stars_saved = _verified(asked, texts, texts.count(), n, num, den)
    dropped(texts)
    links = done.filter("linked").select("a", "b")
    comp = saved(components(links), "components")
    far, far_saved = _delta_pairs(done, num, den)
    rest = _small_pairs(groups, num, den).unionByName(far).distinct()
    roots = comp.select("node", "root")
    rest = rest.join(roots.toDF("a", "_ra"), "a", "left").join(roots.toDF("b", "_rb"), "b", "left")
    rest = rest.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")
    # a pair of a star is settled, whether its sketches or its texts were compared
    rest = rest.join(stars.select(F.greatest("a", "b").alias("_x"), F.least("a", "b").alias("_y")).distinct(), (F.greatest("a", "b") == F.col("_x")) & (F.least("a", "b") == F.col("_y")), "left_anti")
    rest = saved(rest, "rest")
    left = saved(_sieved(rest, rows, size, num, den).withColumn("big", F.lit(False)), "asked")
    texts = _texts(d, rows, left, n)
    more, more_saved = _verified(left, texts, texts.count(), n, num, den, linked=True)
    dropped(texts)
    if not more.isEmpty():
        first = comp.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        comp, before = saved(components(first.unionByName(more)), "components"), comp
        dropped(before)
    # components are named on nodes, so a large one is no group of rows
    low = nodes.groupBy("key").agg(F.min("doc_id").alias("low"))
    rooted = low.join(comp.select(F.col("node").alias("key"), "root"), "key", "left")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("g"))
    named = rooted.join(least, "root", "left").select("key", F.coalesce("g.low", "low").alias("name"), F.coalesce("g.key", "key").alias("lead"))
    named = saved(named, "named")
    for t in (groups, stars, asked, rest, left, *stars_saved, *more_saved, *far_saved, comp):
        dropped(t)
    return rows, named


def _own_text(fetched: DataFrame, n: int) -> DataFrame:
    """One text for each key: rows whose shingle set does not hash to the key go."""

    def make():
        def f(cols):
            keep = [(k, t) for k, t, u in zip(cols[0], cols[1], shingle_sets(cols[1], n), strict=True) if len(u) and int(signed(mix(np.array([mix(u).sum() + _U(len(u))])))[0]) == k]
            return [[k for k, _ in keep], [t for _, t in keep]]

        return f

    return map_rows(fetched, "key long, text string", make).dropDuplicates(["key"])


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, or any one of rows repeated with that id.

    Rows with the empty set link to nothing: all with different ids or texts
    stay, and so do repeated ones. A component of rows without ids keeps one.
    """
    rows, named = _components(docs, n, percent, key, text)
    # one (id, text) of each component: of the key that lends the name
    lead = rows.join(named.filter("key = lead").select("key", "name"), "key").filter(F.col("doc_id").eqNullSafe(F.col("name")))
    lead = lead.groupBy("key").agg(F.min("th").alias("th"), F.first("doc_id").alias("id"), F.count("*").alias("rows"))
    blank = rows.filter("key is null").groupBy("doc_id", "th").agg(F.lit(0).cast("long").alias("rows"))
    stay = saved(lead.select(F.col("id").alias("__tw_id"), F.col("th").alias("__tw_th"), F.col("rows").alias("__tw_rows")).unionByName(blank.select(F.col("doc_id").alias("__tw_id"), F.col("th").alias("__tw_th"), F.col("rows").alias("__tw_rows"))), "stay")
    for t in (rows, named):
        dropped(t)
    kept = docs.join(stay, docs[key].eqNullSafe(stay["__tw_id"]) & (F.xxhash64(docs[text]) == stay["__tw_th"]))
    many = F.col("__tw_rows") > 1
    if stay.filter(many).isEmpty():
        return kept.select(docs["*"])
    # only rows that may be repeats of each other meet
    once = kept.filter(many).dropDuplicates(["__tw_id", "__tw_th"])
    return kept.filter(~many).select(docs["*"]).unionByName(once.select(*docs.columns))
