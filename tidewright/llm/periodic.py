"""Periodic runs of words: heavy/light lag counting, then island scans.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words long, that no neighbouring word
extends keeping period q. At lag q it is an island of matches (word i equals
word i + q), at least ``need(q)`` long. All matches of each lag are counted
first: words that stand often in the text by an FFT autocorrelation of their
places (whole numbers, so rounding is exact), rare ones by the differences of
their places. Matches that lie inside runs already found, whose period divides
the lag, can belong to no new run and are taken off. Only lags with enough
matches left are scanned: first at every (q / 8)-th place, 24 of which in a row
lie in every island, then, where so many match, in full.

A text costs O(n log n) beside the counting, which costs O(n^1.5 log n) at the
most, and memory of a few numbers a word; texts are handled one by one inside
their batch, nothing is shuffled.

Defined results: null, empty and short texts have no run (nulls for the best
one) and keep all words; ties go to the smallest start, then period; repeated
rows give repeated results; a null id counts as the empty text in the planted
change of the query; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows

MIN_WORDS, MIN_PERIODS = 6, 4
#: Differences of places that are counted at once.
CHUNK = 1 << 20
#: Places in a period that a scan probes first.
PROBES = 8

Run = tuple[int, int, int]  # start, length, period


def need(q: int) -> int:
    """The matches in a row that a run of period q has at least."""
    return max(MIN_WORDS - q, (MIN_PERIODS - 1) * q)


def numbered(words: list) -> np.ndarray:
    """Equal words have equal numbers, counted from 0."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def lag_counts(x: np.ndarray, most: int) -> np.ndarray:
    """How many i have x[i] == x[i + q], for q from 0 (left at 0) to ``most``; exact."""
    n = len(x)
    total = np.zeros(most + 1, np.int64)
    if most < 1:
        return total
    times = np.bincount(x)
    # a pair costs about as much as one step of a transform's n log n
    heavy = times > max(8, int(np.sqrt(0.4 * n * np.log2(n + 2))))
    if heavy.any():
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy):
            f = np.fft.rfft((x == w).astype(np.float64), size)
            power += f.real**2 + f.imag**2
        total[1:] += np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype(np.int64)
    light = np.flatnonzero(~heavy[x] & (times[x] > 1))
    if len(light):
        order = light[np.argsort(x[light], kind="stable")]  # places by word, then ascending
        word = x[order]
        first = np.arange(len(order))
        step, held, size = 1, [], 0
        while len(first):
            first = first[first + step < len(order)]
            gap = order[first + step] - order[first]
            ok = (word[first + step] == word[first]) & (gap <= most)
            first, gap = first[ok], gap[ok]  # a place whose next is too far has no nearer one later
            held.append(gap)
            size += len(gap)
            if size > CHUNK or not len(first):
                total += np.bincount(np.concatenate(held), minlength=most + 1)
                held, size = [], 0
            step += 1
    return total


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    ok = end - start >= least
    return start[ok], end[ok]


def _matched(x: np.ndarray, q: int, step: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The islands at lag q that are long enough: every ``step``-th place is probed, what matches in a row is read in full."""
    n, least = len(x) - q, need(q)
    hit = x[:n:step] == x[q::step]
    for a, b in known:
        hit[-(-a // step) : -(-b // step)] = False
    out = []
    for a, b in zip(*(e.tolist() for e in _islands(hit, least // step)), strict=True):
        lo, hi = max(0, (a - 1) * step), min(n, b * step)  # the probes before and after do not match
        same = x[lo:hi] == x[lo + q : hi + q]
        for c, d in known:
            same[max(0, c - lo) : max(0, d - lo)] = False
        out += [(lo + c, lo + d) for c, d in zip(*(e.tolist() for e in _islands(same, least)), strict=True)]
    return out


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(x: np.ndarray) -> list[Run]:
    """All runs of a sequence of numbers from 0, by start, then period."""
    n = len(x)
    most = n // MIN_PERIODS
    if n < MIN_WORDS or most < 1:
        return []
    counts = lag_counts(x, most)
    lags = np.arange(most + 1)
    enough = counts >= np.maximum(MIN_WORDS - lags, (MIN_PERIODS - 1) * lags)
    enough[0] = False
    found: list[Run] = []
    inside: dict[int, list[tuple[int, int]]] = {}  # by lag: starts of the matches inside runs whose period divides it
    for q in map(int, np.flatnonzero(enough)):
        known = _joined(inside.pop(q, []))
        if counts[q] - sum(b - a for a, b in known) < need(q):
            continue
        step = max(1, q // PROBES)
        for start, end in _matched(x, q, step, known):
            size = end - start
            found.append((start, size + q, q))
            for k in range(2 * q, min(most, size + q - 1) + 1, q):
                if enough[k]:
                    inside.setdefault(k, []).append((start, end + q - k))
    return sorted(found, key=lambda r: (r[0], r[2]))


def best(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties: the smallest start, then period."""
    top = None
    for r in found:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, size, q in found:
        edge[start + q] += 1
        edge[start + size] -= 1
    return np.cumsum(edge)[:n] == 0


def collapse(words: list, found: list[Run]) -> list:
    return [w for w, k in zip(words, kept(len(words), found).tolist(), strict=True) if k] if found else words


def planted(words: list, doc_id) -> list:
    """The query's change: every tenth text (by crc32 of its id) is made periodic from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find(df: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """For each row its runs (array of start, length, period) and the text without repeats.

    ``collapsed`` holds the kept words joined by one space.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def make():
        def f(cols):
            out = [], []
            for i, t in zip(cols[0], cols[1], strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                words = planted(words, i) if plant else words
                found = runs_of(numbered(words))
                out[0].append([{"start": a, "length": b, "period": q} for a, b, q in found])
                out[1].append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
            return [cols[0], *out]

        return f

    return map_rows(df.select(F.col(key), F.col(text)), schema, make)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = True) -> DataFrame:
    """The number of runs, the best run, and digests of all runs and of the collapsed text."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def make():
        def f(cols):
            rows = []
            for i, t in zip(cols[0], cols[1], strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                words = planted(words, i) if plant else words
                found = runs_of(numbered(words))
                top = best(found)
                one = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                said = "".join(f"{a},{b},{q}\n" for a, b, q in found).encode()
                rows.append((i, len(found), *one, hashlib.sha256(said).hexdigest(), hashlib.sha256(b" ".join(collapse(words, found))).hexdigest()))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]

        return f

    return map_rows(df.select(F.col(key), F.col(text)), schema, make)


__all__ = ["collapse", "digests", "find", "lag_counts", "runs_of"]
