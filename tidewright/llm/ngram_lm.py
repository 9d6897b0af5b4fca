"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs are quantised to levels (exact to six, then a
quarter apart) and stored in unary: an n-gram of level q is put in the filter
with each of 1..q. A count is read by membership probes at levels 1, 2, ...
until one misses; all bits of an entry lie in one 64-bit word, so a probe is one
access. The filter is built in blocks, one for each range of n-gram hashes, from
counts merged in that range, with ``BITS`` bits for each entry at any corpus
size. Blocks of together at most ``MAX_FILTER_BYTES`` are broadcast; beyond that
no block leaves the task that holds it: the n-grams of chunks of texts travel to
the blocks, and one byte for each comes back to meet its chunk's texts.

A word's probability interpolates c(prev, word)/c(prev) with
(c(word)+1)/(N+V+1), all from probes; the weights depend on the level of
c(prev) and maximise the leave-one-out likelihood of all training texts;
a level that none of them has takes the nearest one's. As counts are rounded
down to their levels, and a probe may hit by chance, the probabilities of all
words after a word add up to one only nearly. The base score uses exact counts: those of at most
``MAX_COMMON`` frequent words are broadcast, the others are joined.

Defined results: null and empty texts are one end token; with no training rows
N = V = 0 and every base probability is 1; repeated rows are rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import _arrow_schema, doc_word_hashes, dropped, map_rows, mix, saved, signed

_U = np.uint64
END, START = _U(0x0E0D5E17A11CE5ED), _U(0x57A27000000000B5)
BITS, PROBES = 11, 4
MAX_FILTER_BYTES = 16 << 20
MAX_COMMON = 500_000
FLUSH = 1 << 19
#: Text bytes of a chunk that asks the blocks together.
ASK_TEXT = 3 << 20
#: Ranges of n-gram hashes hold so much text each, more where they would be more than MANY_RANGES, but never over MOST_TEXT.
RANGE_TEXT, MOST_TEXT, MANY_RANGES = 8 << 20, 32 << 20, 1 << 13
GRID = np.array([0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995])


def _levels() -> np.ndarray:
    out, v = [1], 1
    while v < 1 << 40:
        v = max(v + 1, int(v * 1.25))
        out.append(v)
    return np.array(out, dtype=np.int64)


LEVELS = _levels()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def word_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _U(0xA5A5_0001_F00D_CAFE))


def pair_key(prev: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(prev + _U(0x51ED_270B_7F4A_7C15)) * _U(0x9E3779B97F4A7C15) + h)


def sequences(texts: list[str | None]):
    """(first row, row after the last, tokens with an end for each text, starts of the texts, previous tokens)."""
    for at, to, h, offs in doc_word_hashes(texts):
        seq = np.insert(h, offs[1:], END)
        starts = offs[:-1] + np.arange(to - at)
        prev = np.empty_like(seq)
        prev[1:] = seq[:-1]
        prev[starts] = START
        yield at, to, seq, starts, prev


def _entries(keys: np.ndarray, q: int, words: np.ndarray, first: np.ndarray):
    """(index of the word, its bits) of (key, level q), in blocks of so many words that start at ``first``."""
    x = mix(keys + _U(q * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    at = first + (((x >> _U(32)) * words) >> _U(32))
    bits = _U(1) << (x & _U(63))
    for i in range(1, PROBES):
        bits |= _U(1) << ((x >> _U(6 * i)) & _U(63))
    return at.astype(np.int64), bits


class Filter:
    """Blocks of a Bloom filter: ``sizes`` in bits, whole 64-bit words, one after another in ``data``."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.data, self.sizes = data, sizes.astype(np.uint64)

    def __getstate__(self):
        return self.data, self.sizes

    def __setstate__(self, state):
        self.data, self.sizes = state

    def open(self) -> Filter:
        self.raw = np.frombuffer(self.data, dtype=np.uint64)
        self.words = self.sizes >> _U(6)
        self.firsts = np.concatenate([[0], np.cumsum(self.words)]).astype(np.uint64)
        self.shift = _U(64 - int(len(self.sizes)).bit_length() + 1)
        return self

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the keys by probing level after level."""
        out = np.zeros(len(keys), dtype=np.int64)
        block = (keys >> self.shift).astype(np.int64) if len(self.sizes) > 1 else np.zeros(len(keys), np.int64)
        words, firsts = self.words[block], self.firsts[block]
        alive = np.flatnonzero(words)
        k, w, f = keys[alive], words[alive], firsts[alive]
        q = 0
        while len(alive) and q < len(LEVELS):
            q += 1
            at, bits = _entries(k, q, w, f)
            hit = np.flatnonzero((self.raw[at] & bits) == bits)
            alive, k, w, f = alive[hit], k[hit], w[hit], f[hit]
            out[alive] = q
        return out


def block_of(keys: np.ndarray, counts: np.ndarray, bits_each: float) -> tuple[bytes, int, int]:
    """A filter block for n-grams and their counts: (bytes, its bits, entries)."""
    q = level(counts)
    entries = int(q.sum())
    if not entries:
        return b"", 0, 0
    words = max(1, -(-int(entries * bits_each) // 64))
    data = np.zeros(words, dtype=np.uint64)
    order = np.argsort(-q, kind="stable")
    keys, q = keys[order], q[order]
    for j in range(1, int(q[0]) + 1):
        at, bits = _entries(keys[: np.searchsorted(-q, -j, "right")], j, _U(words), _U(0))
        np.bitwise_or.at(data, at, bits)
    return data.tobytes(), 64 * words, entries


MERGED = "range int, words binary, counts binary, n long, entries long, bits long, block binary"


def count(train: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Per range of n-gram hashes: the words' hashes and counts, and the filter's block.

    Tasks sum up chunks of tokens and send sorted arrays, so a frequent n-gram
    is one entry of a chunk; a range holds a bounded part of the corpus.
    The number of ranges comes with the table.
    """
    size = train.agg(F.sum(F.octet_length(text))).first()[0] or 0
    power = max(2, (size // max(RANGE_TEXT, min(MOST_TEXT, size // MANY_RANGES))).bit_length())
    ranges, shift = 1 << power, _U(64 - power)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            seq = np.concatenate([x for x, _ in held])
            prev = np.concatenate([x for _, x in held])
            words, c = np.unique(seq, return_counts=True)
            pairs, d = np.unique(pair_key(prev, seq), return_counts=True)
            # words travel by their own hash, dealt by their key
            r = (word_key(words) >> shift).astype(np.int64)
            order = np.argsort(r, kind="stable")
            words, c, r = words[order], c[order], r[order]
            cut = np.searchsorted(r, np.arange(ranges + 1))
            cut2 = np.searchsorted((pairs >> shift).astype(np.int64), np.arange(ranges + 1))
            blob = lambda x, a, b: x[a:b].tobytes()
            c, d = c.astype(np.uint32), d.astype(np.uint32)
            some = np.flatnonzero(np.diff(cut) + np.diff(cut2)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *(pa.array([blob(x, k[i], k[i + 1]) for i in some], pa.binary()) for x, k in ((words, cut), (c, cut), (pairs, cut2), (d, cut2)))],
                ["range", "w", "wc", "p", "pc"],
            )

        for b in batches:
            for _, _, seq, _, prev in sequences(b.column(0).to_pylist()):
                held.append((seq, prev))
                n += len(seq)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def summed(parts: list[tuple[bytes, bytes]]):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in parts])
        c = np.concatenate([np.frombuffer(x, np.uint32) for _, x in parts]).astype(np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        if not len(h):
            return h, c
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(c, first)

    def merge(batches):
        def made(r, words, pairs):
            w, wc = summed(words)
            p, pc = summed(pairs)
            block, bits, entries = block_of(np.concatenate([word_key(w), p]), np.concatenate([wc, pc]), BITS)
            row = [[r], [w.tobytes()], [wc.tobytes()], [int(wc.sum())], [entries], [bits], [block]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "words", "counts", "n", "entries", "bits", "block"])

        now, words, pairs = None, [], []
        for b in batches:
            for r, w, wc, p, pc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now:
                    if now is not None:
                        yield made(now, words, pairs)
                    now, words, pairs = r, [], []
                words.append((w, wc))
                pairs.append((p, pc))
        if now is not None:
            yield made(now, words, pairs)

    sent = train.select(F.col(text)).mapInArrow(run, "range int, w binary, wc binary, p binary, pc binary")
    return saved(sent.repartition(min(ranges, 20_000), "range").sortWithinPartitions("range").mapInArrow(merge, MERGED), "ngrams"), ranges


def _filter(merged: DataFrame, n: int) -> Filter:
    sizes, parts = np.zeros(n, dtype=np.uint64), []
    for r in merged.select("range", "bits", "block").orderBy("range").toLocalIterator():
        sizes[r.range] = r.bits
        parts.append(bytes(r.block))
    return Filter(b"".join(parts), sizes)


def _word_rows(merged: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])

    return merged.select("words", "counts").mapInArrow(run, "h long, c long")


def _common(merged: DataFrame, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with at least ``floor`` occurrences, sorted by hash; they come as packed arrays."""

    def run(batches):
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, k = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([h[k >= floor].tobytes()], pa.binary()), pa.array([k[k >= floor].tobytes()], pa.binary())], ["h", "c"])

    rows = merged.select("words", "counts").mapInArrow(run, "h binary, c binary").collect()
    h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r.h, np.uint64) for r in rows)])
    c = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r.c, np.int64) for r in rows)])
    order = np.argsort(h)
    return h[order], c[order]


def contexts(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Levels of the contexts' counts from those of the words: a text's first context is its end, its last word."""
    q = np.empty_like(words)
    q[1:] = words[:-1]
    q[starts] = words[np.append(starts[1:], len(words)) - 1]
    return q


class Model:
    """Probabilities from levels of words, contexts and pairs."""

    def __init__(self, n: int, v: int, weights: np.ndarray):
        self.n, self.v, self.weights = n, v, weights

    def log10(self, word: np.ndarray, q: np.ndarray, both: np.ndarray) -> np.ndarray:
        value = np.concatenate([[0], LEVELS])
        w, ctx, pair = value[word], value[q], value[both]
        lam = np.where(ctx > 0, self.weights[q], 0.0)
        ratio = np.minimum(1.0, pair / np.maximum(ctx, 1))
        return np.log10(lam * ratio + (1 - lam) * (w + 1) / (self.n + self.v + 1))


def _unpacked(texts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word levels, context levels, pair levels, starts of the texts) of texts' packed levels."""
    word, both = (np.frombuffer(b"".join(t[i] for t in texts), np.uint8) for i in (0, 1))
    starts = np.cumsum([0, *(len(t[0]) for t in texts)])[:-1].astype(np.int64)
    return word, contexts(word, starts), both, starts


def _weights(levels: DataFrame, n: int, v: int) -> np.ndarray:
    """For each level of the context's count the weight of GRID with the best leave-one-out likelihood of the texts whose levels (wl, pl) are given."""
    size = len(LEVELS) + 1

    def run(batches):
        seen = np.zeros(size**3, dtype=np.int64)
        for b in batches:
            word, q, both, _ = _unpacked(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            seen += np.bincount((q.astype(np.int64) * size + word) * size + both, minlength=size**3)
        at = np.flatnonzero(seen)
        q, word, both = at // size**2, at // size % size, at % size
        value = np.concatenate([[0], LEVELS])
        ratio = np.clip((value[both] - 1) / np.maximum(value[q] - 1, 1), 0, 1)
        uni = np.maximum(value[word], 1) / (n + v)
        total = np.zeros((size, len(GRID)))
        for g, lam in enumerate(GRID):
            total[:, g] = np.bincount(q, seen[at] * np.log(lam * ratio + (1 - lam) * uni), size)
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel().tolist(), pa.float64()), pa.array(range(total.size), pa.int32())], ["v", "i"])

    got = levels.select("wl", "pl").mapInArrow(run, "v double, i int").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size * len(GRID))
    for r in got:
        total[r.i] = r.v
    total = total.reshape(size, len(GRID))
    met = np.flatnonzero(total.any(axis=1))
    nearest = met[np.argmin(np.abs(np.arange(size)[:, None] - met), axis=1)]
    return GRID[np.argmax(total[nearest], axis=1)]


def _runs(batches):
    """Lists of the rows with the same first column, where those stand together."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[0] != now:
                yield rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield rows


def _asked(texts: list[str | None], places: bool = True):
    """(sorted distinct n-gram keys, places in them of the tokens' words, of their pairs, lengths of the texts with their ends) of a chunk; keys alone without ``places``."""
    seqs, prevs, sizes = [], [], []
    for _, _, seq, starts, prev in sequences(texts):
        seqs.append(seq)
        prevs.append(prev)
        sizes.append(np.diff(np.append(starts, len(seq))))
    seq = np.concatenate(seqs)
    if not places:
        return np.unique(np.concatenate([word_key(np.unique(seq)), pair_key(np.concatenate(prevs), seq)]))
    words, back = np.unique(seq, return_inverse=True)
    keys, place = np.unique(np.concatenate([word_key(words), pair_key(np.concatenate(prevs), seq)]), return_inverse=True)
    return keys, place[: len(words)][back], place[len(words) :], np.concatenate(sizes)


_TOLD = "n_tokens long, known long, base double"


def _probed(part: DataFrame, merged: DataFrame, ranges: int, kind: str) -> DataFrame:
    """Rows of ``part`` (chunk, rid, doc_id, learns, n_tokens, known, base, text) with the levels (wl, pl) of their texts, read where the blocks are.

    The rows of a chunk that stand together send their n-grams, each once and in
    order, to the ranges' blocks; their levels come back in that order and meet
    the texts, which work out the same order again. ``first`` names such a run.
    """
    shift = _U(64 - (ranges.bit_length() - 1))

    def ask(batches):
        for rows in _runs(batches):
            keys = _asked([r[2] for r in rows], False)
            cut = np.searchsorted((keys >> shift).astype(np.int64), np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([v] * len(some), pa.int64()) for v in rows[0][:2]), pa.array([keys[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()), pa.nulls(len(some), pa.int64())], ["range", "chunk", "first", "data", "bits"])

    def answer(batches):
        now, block = None, None
        for b in batches:
            out = []
            for r, chunk, first, data, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bits is not None:
                    now, block = r, Filter(data, np.array([bits])).open()
                    continue
                keys = np.frombuffer(data, np.uint64)
                q = block.read(keys) if r == now else np.zeros(len(keys), np.int64)
                out.append((chunk, first, r, q.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["chunk", "first", "range", "levels"])

    names = ["rid", "doc_id", "learns", "n_tokens", "known", "base"]

    def tell(batches):
        for rows in _runs(batches):
            levels: dict[int, list[bytes]] = {}
            texts = []
            for _, first, got, *row in rows:
                if got is not None:
                    levels.setdefault(first, []).append(got)
                else:
                    texts.append(row)
            firsts, at = [*levels, None], 0
            for first, after in zip(firsts, firsts[1:]):
                run = texts[at : next((i for i in range(at, len(texts)) if texts[i][0] == after), len(texts))]
                at += len(run)
                _, words, pairs, sizes = _asked([r[-1] for r in run])
                q = np.frombuffer(b"".join(levels[first]), np.uint8)
                cut = np.cumsum([0, *sizes.tolist()])
                w, p = q[words], q[pairs]
                yield [*zip(*(r[:-1] for r in run)), [w[a:b].tobytes() for a, b in zip(cut, cut[1:])], [p[a:b].tobytes() for a, b in zip(cut, cut[1:])]]

    schema = f"rid long, doc_id {kind}, learns boolean, {_TOLD}, wl binary, pl binary"
    fields = _arrow_schema(schema)

    def told(batches):
        for cols in tell(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t.type) for v, t in zip(cols, fields, strict=True)], schema=fields)

    n = min(ranges, 20_000)
    blocks = merged.filter("bits > 0").select("range", *(F.lit(None).cast("long").alias(c) for c in ("chunk", "first")), F.col("block").alias("data"), "bits")
    asked = part.select("chunk", "rid", "text").mapInArrow(ask, "range int, chunk long, first long, data binary, bits long")
    dealt = blocks.unionByName(asked).repartition(n, "range").sortWithinPartitions("range", F.col("bits").isNull())
    levels = saved(dealt.mapInArrow(answer, "chunk long, first long, range int, levels binary"), "levels")
    both = levels.unionByName(part.select("chunk", F.col("rid").alias("first"), *names, "text"), allowMissingColumns=True)
    both = both.repartition(n, "chunk").sortWithinPartitions("chunk", F.col("levels").isNull(), "first", "range")
    out = saved(both.select("chunk", "first", "levels", *names, "text").mapInArrow(told, schema), "told")
    dropped(levels)
    return out


def score(docs: DataFrame, in_training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row; learns from the rows where ``in_training`` holds."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    train = docs.filter(in_training).select(F.col(text).alias("text"))
    merged, ranges = count(train)
    sums = merged.agg(F.sum("n").alias("n"), F.sum(F.octet_length("words") / 8).cast("long").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    # frequent words: the lowest level above which at most MAX_COMMON words stand
    words = _word_rows(merged)
    by_count = words.groupBy(F.least(F.col("c"), F.lit(100_000)).alias("c")).count().collect()
    total, floor = 0, 1 << 62
    for r in sorted(by_count, key=lambda r: -r.c):
        if total + r["count"] > MAX_COMMON:
            break
        total, floor = total + r["count"], r.c
    hs, cs = _common(merged, floor)
    whole = (merged.agg(F.sum("bits")).first()[0] or 0) <= 8 * MAX_FILTER_BYTES
    shared = spark.sparkContext.broadcast((_filter(merged, ranges) if whole else None, hs, cs))

    def make():
        flt, hs, cs = shared.value
        if flt:
            flt.open()
        log_c = np.log10(cs + 1.0)
        unit = float(np.log10(n + v + 1))
        chunk, size = None, 0

        def f(cols):
            nonlocal chunk, size
            out = [[] for _ in range(9)]
            for at, to, seq, starts, prev in sequences(cols[3]):
                if chunk is None or size >= ASK_TEXT:
                    chunk, size = cols[0][at], 0
                size += sum(len(t or "") + 1 for t in cols[3][at:to])
                words, back = np.unique(seq, return_inverse=True)
                spot = np.minimum(np.searchsorted(hs, words), max(0, len(hs) - 1))
                found = hs[spot] == words if len(hs) else np.zeros(len(words), bool)
                gain = np.where(found, log_c[spot] if len(hs) else 0.0, 0.0)[back]
                known = found[back]
                sizes = np.diff(np.append(starts, len(seq)))
                out[0] += [chunk] * (to - at)
                out[1] += sizes.tolist()
                out[2] += np.add.reduceat(known.astype(np.int64), starts).tolist()
                out[3] += (np.add.reduceat(gain, starts) - sizes * unit).tolist()
                if flt:
                    word = flt.read(word_key(words)).astype(np.uint8)[back]
                    both = flt.read(pair_key(prev, seq)).astype(np.uint8)
                for a, k in zip(starts, sizes, strict=True):
                    rest = seq[a : a + k][~known[a : a + k]]
                    h, c = np.unique(rest, return_counts=True)
                    out[4].append(signed(h).tolist())
                    out[5].append(c.tolist())
                    out[6].append(word[a : a + k].tobytes() if flt else None)
                    out[7].append(both[a : a + k].tobytes() if flt else None)
                out[8] += [None] * (to - at) if flt else cols[3][at:to]
            return [*cols[:3], *out]

        return f

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.coalesce(in_training, F.lit(False)).alias("learns"), F.col(text))
    part = saved(map_rows(rows, f"rid long, doc_id {kind}, learns boolean, chunk long, n_tokens long, known long, base double, h array<long>, k array<int>, wl binary, pl binary, text string", make), "scores", "zstd")
    levels = part if whole else _probed(part, merged, ranges, kind)
    model = Model(n, v, _weights(levels.filter("learns"), n, v) if n else np.zeros(len(LEVELS) + 1))

    def finish():
        def f(cols):
            word, q, both, starts = _unpacked(list(zip(cols[-2], cols[-1], strict=True)))
            return [*cols[:-2], np.add.reduceat(model.log10(word, q, both), starts).tolist() if len(starts) else []]

        return f

    scored = map_rows(levels.select("rid", "doc_id", "n_tokens", "known", "base", "wl", "pl"), f"rid long, doc_id {kind}, n_tokens long, known long, base double, score double", finish)
    rest = part.select("rid", F.inline(F.arrays_zip("h", "k"))).join(words, "h")
    more = rest.groupBy("rid").agg(F.sum("k").alias("k2"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("g"))
    out = scored.join(more, "rid", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("g", F.lit(0.0))).alias("base_score"), "score")


__all__ = ["Filter", "Model", "block_of", "count", "level", "score"]
