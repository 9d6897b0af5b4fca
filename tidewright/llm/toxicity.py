"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: whole words and word stems whose
share among toxic documents is far above that among others. A trie holds it.
Each new word runs a Levenshtein automaton (its states are rows of edit
distances) down the trie: exact terms, stems, and misspellings of every whole
word of the lexicon with five letters or more are caught, also where a stem
stands for the word; words known from clean documents are never misspellings.
A window of words around a hit separates quotation (quote marks, reporting
verbs) from abuse. A logistic model over the sums gives the score.

Fitting uses a bounded sample: the share of labelled rows, by hash of
the text, that makes ``max_rows`` of them on average (equal texts with one
label count once, as copies are no further evidence); the lexicon holds at most ``max_terms``
terms, and as many whole words beside its stems, from at most
``MAX_CANDIDATES`` terms that three toxic texts of the sample have.

Defined results: null and empty texts get the score of a text without hits;
with no labels, or only one, every score is the (smoothed) share of label 1;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, logistic, map_rows, mix, powers, saved, small_batches

MAX_ROWS = 12_000
MAX_TERMS = 2_000
#: Terms of toxic texts, the most frequent first, that the others are searched for.
MAX_CANDIDATES = 200_000
#: The share of chosen terms that may be there by chance.
FALSE_TERMS = 0.05
WINDOW = 6
STEM = range(3, 9)
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¡¿…"
QUOTES = frozenset("\"“”„«»")
# Words that report what someone else has said.
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls claimed reported allegedly term word slur sagte schrieb nannte zitat dijo escribió llamó cita dit écrit appelé".split())
#: Words whose weights a worker holds, and characters of the texts that it splits at once.
HELD_WORDS = 300_000
CHUNK_CHARS = 1 << 20
_U = np.uint64
_TABLE_BITS = 22


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _deletions(words: list[str], k: int):
    """(rows, hashes): of each word, all of one length, the hashes of what is left without up to ``k`` of its letters.

    Strings within ``k`` edits of each other have one of these in common. The
    hashes are polynomials over the letters, put together from prefix sums.
    """
    size = len(words[0])
    p, inv = powers(size + 1), powers(3, True)
    i, j = np.triu_indices(size, 1) if k == 2 else (np.empty(0, np.int64),) * 2
    step = max(1, (1 << 20) // (1 + size + len(i)))
    for at in range(0, len(words), step):
        part = words[at : at + step]
        letters = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
        sums = np.zeros((len(part), size + 1), np.uint64)
        np.cumsum(mix(letters.astype(np.uint64)) * p[:size], axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        out = [whole, sums[:, :-1] + (whole - sums[:, 1:]) * inv[1]]
        if len(i):
            out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * inv[1] + (whole - sums[:, j + 1]) * inv[2])
        yield at, np.concatenate(out, axis=1)


class _Node:
    __slots__ = ("below", "hi", "lo", "term")

    def __init__(self, lo: int):
        self.below: dict[str, _Node] = {}
        self.lo = self.hi = lo  # the numbers of the terms below
        self.term: str | None = None


class Trie:
    """Terms with (stem, weight, fuzzy).

    ``like`` finds, for many words at once, the fuzzy terms that share a
    deletion with each; ``match`` runs a word's Levenshtein automaton down the
    trie of the fuzzy terms, along the branches that lead to those.
    """

    def __init__(self, terms: dict[str, tuple[bool, float, bool]]):
        self.terms = {t: (stem, w) for t, (stem, w, _) in terms.items()}
        self.stems = {t: w for t, (stem, w) in self.terms.items() if stem}
        self.heads = {t[:3] for t in self.stems}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        self.fuzzy = sorted(t for t, (_, _, fuzzy) in terms.items() if fuzzy and edits_allowed(t))
        self.root = _Node(0)
        for n, t in enumerate(self.fuzzy):
            node = self.root
            node.hi = n + 1
            for c in t:
                node = node.below.setdefault(c, _Node(n))
                node.hi = n + 1
            node.term = t
        self.indexes = [self._index(k) for k in (1, 2)]

    def _index(self, k: int):
        """(sizes of words that may match, sorted hashes, the numbers of their terms, bitmap) of the terms that allow ``k`` edits."""
        by_size: dict[int, list[int]] = {}
        for n, t in enumerate(self.fuzzy):
            if edits_allowed(t) == k:
                by_size.setdefault(len(t), []).append(n)
        keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for ns in by_size.values():
            for at, h in _deletions([self.fuzzy[n] for n in ns], k):
                keys.append(h.ravel())
                owner.append(np.repeat(np.array(ns[at : at + len(h)]), h.shape[1]))
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        there = np.zeros(1 << _TABLE_BITS, dtype=bool)
        there[self._slot(key)] = True
        sizes = frozenset(n + d for n in by_size for d in range(-k, k + 1))
        return sizes, key, own, there

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - _TABLE_BITS)).astype(np.int64)

    def like(self, words: list[str]) -> list[list[int]]:
        """For each word the numbers of all fuzzy terms within their edits of it, and of some others, sorted."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            by_size.setdefault(len(w), []).append(n)
        for size, ns in by_size.items():
            for k, (sizes, key, own, there) in enumerate(self.indexes, 1):
                if size not in sizes:
                    continue
                for at, h in _deletions([words[n] for n in ns], k):
                    row, col = np.nonzero(there[self._slot(h)])
                    h = h[row, col]
                    a, b = np.searchsorted(key, h), np.searchsorted(key, h, "right")
                    for r, x, y in zip(row[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                        out[ns[at + r]] += own[x:y].tolist()
        return [sorted(set(x)) if x else x for x in out]

    def near(self, word: str) -> bool:
        return bool(self.like([word])[0])

    def match(self, word: str, like: list[int] | None = None) -> tuple[str, int] | None:
        """The best term: fewest edits, then the longest; None if no term is within its edits.

        The automaton is nondeterministic, its states are bits: bit i of the
        d-th mask says that i letters of the word are read with d edits. A
        dead state ends the walk.
        """
        like = self.like([word])[0] if like is None else like
        if not like:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best, end = None, 1 << len(word)
        stack = [(self.root, 0, 0, len(like), 1, 3, 7)]
        while stack:
            node, depth, at, to, r0, r1, r2 = stack.pop()
            t = node.term
            if t is not None:
                d = 0 if r0 & end else 1 if r1 & end else 2 if r2 & end else 3
                if d <= edits_allowed(t) and (best is None or (d, -len(t), t) < best):
                    best = (d, -len(t), t)
                at += like[at] == node.lo  # in sorted order it comes before the terms that it begins
            while at < to:
                c = self.fuzzy[like[at]][depth]
                child, start = node.below[c], at
                at += 1
                while at < to and like[at] < child.hi:
                    at += 1
                m = masks.get(c, 0)
                n0 = (r0 & m) << 1
                n1 = (r1 & m) << 1 | r0 | r0 << 1 | n0 << 1
                n2 = (r2 & m) << 1 | r1 | r1 << 1 | n1 << 1
                if n2 & (end << 1) - 1:
                    stack.append((child, depth + 1, start, at, n0, n1, n2))
        return None if best is None else (best[2], best[0])

    def weigh_all(self, words: list[str], known: frozenset) -> list[float]:
        """What each word counts for: 0 if it is no term."""
        out, left = [0.0] * len(words), []
        for n, w in enumerate(words):
            exact = self.terms.get(w)
            if exact:
                out[n] = exact[1]
                continue
            if w[:3] in self.heads:
                v = next((self.stems[w[:size]] for size in self.stem_sizes if w[:size] in self.stems), None)
                if v is not None:
                    out[n] = v
                    continue
            if w not in known:
                left.append(n)
        for n, like in zip(left, self.like([words[n] for n in left]), strict=True):
            m = self.match(words[n], like) if like else None
            if m:
                out[n] = self.terms[m[0]][1] * 0.8 ** m[1]
        return out

    def weigh(self, word: str, known: frozenset) -> float:
        return self.weigh_all([word], known)[0]


class Model:
    def __init__(self, terms: dict, known: frozenset, beta: np.ndarray):
        self.terms, self.known, self.beta = terms, known, beta
        self.name = uuid.uuid4().hex


N_FEATURES = 6


class Scorer:
    """Features of texts: what their hits weigh as abuse and as quotation, and how dense they are."""

    def __init__(self, terms: dict, known: frozenset):
        self.trie, self.known = Trie(terms), known
        self.memo: dict[str, float] = {}

    def weights(self, words: set[str]) -> dict[str, float]:
        """The weights of words as they stand in texts; at least of all that are asked for."""
        new = [w for w in words if w not in self.memo]
        if new:
            if len(self.memo) + len(new) > HELD_WORDS:
                self.memo, new = {}, list(words)
            bare = [w.strip(EDGE) for w in new]
            once = list(set(bare))
            of = dict(zip(once, self.trie.weigh_all(once, self.known), strict=True))
            self.memo.update(zip(new, map(of.__getitem__, bare), strict=True))
        return self.memo

    def features_of(self, texts: list[str | None]):
        """The features of each text."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (size < CHUNK_CHARS or not part):
                part.append((texts[at] or "").lower().split())
                size += len(texts[at] or "")
                at += 1
            memo = self.weights(set().union(*part))
            for words in part:
                yield self._features(words, list(map(memo.__getitem__, words)))

    def features(self, text: str | None) -> list[float]:
        return next(self.features_of([text]))

    def _features(self, words: list[str], weights: list[float]) -> list[float]:
        n = len(words)
        abuse = quoted = 0.0
        hits, kinds = 0, set()
        if any(weights):
            for i, v in enumerate(weights):
                if v:
                    hits += 1
                    kinds.add(words[i])
                    q = self.quotation(words, i)
                    abuse += v * (1 - q)
                    quoted += v * q
        rate = hits / (n + 20)
        return [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(100 * rate), math.log1p(len(kinds)), math.log1p(hits) * math.log1p(100 * rate)]

    @staticmethod
    def quotation(words: list[str], i: int) -> float:
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        opened = any(w[0] in QUOTES for w in before)
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
        reported = any(w.strip(EDGE) in REPORTING for w in before[:-1])
        return 0.9 if opened and closed else 0.5 if reported else 0.0


_HELD: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The model's scorer; a worker holds the last one over its tasks."""
    if model.name not in _HELD:
        _HELD.clear()
        _HELD[model.name] = Scorer(model.terms, model.known)
    return _HELD[model.name]


def _words(text: str | None) -> set[str]:
    words = {w.strip(EDGE) for w in (text or "").lower().split()}
    words.discard("")
    return words


def _counted(rows: DataFrame, make) -> DataFrame:
    """(term, stem, n): rows of (_t) whose text has a term, as ``make()`` lists those of a text's words; summed up in each task before the shuffle."""

    def run(batches):
        from collections import Counter

        count, terms_of = Counter(), make()
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update(terms_of(_words(t)))
        keys = list(count)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.bool_()), pa.array([count[k] for k in part], pa.int64())], ["term", "stem", "n"])

    out = rows.select("_t").mapInArrow(run, "term string, stem boolean, n long")
    return out.groupBy("term", "stem").agg(F.sum("n").alias("n"))


def _all_terms(words: set[str]) -> list[tuple[str, bool]]:
    return [(w, False) for w in words] + [(s, True) for s in {w[:n] for w in words for n in STEM if len(w) > n}]


def _some_terms(whole: frozenset, stems: frozenset):
    """What lists the terms of a text's words that are among those."""
    memo: dict[str, tuple] = {}

    def terms_of(words):
        if len(memo) > HELD_WORDS:
            memo.clear()
        out = set()
        for w in words:
            x = memo.get(w)
            if x is None:
                x = memo[w] = (*(((w, False),) if w in whole else ()), *((w[:n], True) for n in STEM if len(w) > n and w[:n] in stems))
            if x:
                out.update(x)
        return out

    return terms_of


def _like_terms(terms: dict):
    """What lists those of a text's words that count as misspelled terms."""
    of = Scorer(terms, frozenset())

    def terms_of(words):
        memo = of.weights(words)
        return [(w, False) for w in words if memo[w] and w not in terms]

    return terms_of


def _chance(a: int, b: int, n1: int, n0: int) -> float:
    """How likely at least ``a`` of a term's ``a + b`` texts are toxic, were they dealt at random (Fisher's exact test)."""
    size = a + b
    whole = _choices(n1 + n0, size)
    one = math.exp(_choices(n1, a) + _choices(n0, b) - whole)
    total = 0.0
    for k in range(a, min(size, n1) + 1):
        total += one
        if one < 1e-12 * total:
            break
        one *= (n1 - k) * (size - k) / ((k + 1) * (n0 - size + k + 1))
    return min(1.0, total)


def _choices(n: int, k: int) -> float:
    """log of n over k."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _choose(rows: list, n1: int, n0: int, most: int, tests: int = 0) -> dict[str, tuple[bool, float, bool]]:
    """Terms by falling gain; a stem of a chosen term goes, and so does a stem under a chosen stem.

    Of ``rows`` (term, stem, toxic texts, other texts) those are terms whose
    surplus among toxic texts is no chance: at most ``FALSE_TERMS`` of the
    chosen are expected to be (Benjamini and Hochberg's step), so that the bar
    does not outgrow what few labels can show. ``tests`` counts the terms that
    two toxic texts share, of which ``rows`` are those that three do.

    Whole words are sought misspelled; those under a chosen stem stay beside it for that (``most`` of them).
    """
    tested = []
    for term, stem, a, b in rows:
        lift = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if lift > 1.0:
            tested.append((_chance(a, b, n1, n0), a * lift, len(term), term, stem, lift))
    tested.sort(key=lambda x: (x[0], -x[1], -x[2], x[3]))
    passed = max((k for k, x in enumerate(tested, 1) if x[0] <= FALSE_TERMS * k / max(tests, len(rows))), default=0)
    found = [x[1:] for x in tested[:passed]]
    found.sort(key=lambda x: (-x[0], -x[1], x[2]))
    chosen: dict[str, tuple[bool, float, bool]] = {}
    covered: set[str] = set()
    under: list[tuple[str, float]] = []
    taken: set[str] = set()
    for _, _, term, stem, lift in found:
        below = any(term[:n] in taken for n in range(3, len(term) + 1))
        if below and not stem:
            under.append((term, lift))
        if term in chosen or below or (stem and term in covered) or len(chosen) == most:
            continue
        chosen[term] = (stem, lift, not stem)
        if stem:
            taken.add(term)
        covered.update(term[:n] for n in range(1, len(term) + 1))
    for term, lift in under[:most]:
        chosen[term] = (*chosen[term][:2], True) if term in chosen else (False, lift, True)
    return chosen


def fit(labelled: DataFrame, label: str = "toxic", text: str = "text", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, same: str | None = None) -> Model:
    """Learn from rows with a 0/1 label; rows without one are left out.

    ``same`` names a column with a hash of the text, where there is one: texts
    that are not in the sample then need not pass a join with the labels.

    One sample chooses the lexicon and calibrates the score.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select((F.col(same) if same else F.xxhash64(text)).alias("_k"), F.col(label).cast("int").alias("_y"), F.col(text).alias("_t"))
    total = rows.select("_k", "_y").distinct().count()
    share = F.pmod("_k", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(1, total))))
    sample = saved(rows.filter(share).dropDuplicates(["_k", "_y"]).select("_y", "_t"), "toxic-sample")
    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return Model({}, frozenset(), np.array([math.log(p / (1 - p)), *[0.0] * (N_FEATURES - 1)]))
    spark = rows.sparkSession
    # terms of toxic texts first; among the other texts only those are counted
    toxic, clean = sample.filter("_y = 1"), sample.filter("_y = 0")
    shared = saved(_counted(toxic, lambda: _all_terms).filter("n >= 2"), "toxic-terms")
    tests = shared.count()
    seen = {(r.term, r.stem): r.n for r in shared.filter("n >= 3").orderBy(F.desc("n"), "term", "stem").limit(MAX_CANDIDATES).collect()}
    able = spark.sparkContext.broadcast((frozenset(w for w, stem in seen if not stem), frozenset(w for w, stem in seen if stem)))
    other = {(r.term, r.stem): r.n for r in _counted(clean, lambda: _some_terms(*able.value)).collect()}
    terms = _choose([(*k, n, other.get(k, 0)) for k, n in seen.items()], n1, n0, max_terms, tests)
    dropped(shared)
    held = spark.sparkContext.broadcast(terms)
    known = frozenset(r.term for r in _counted(clean, lambda: _like_terms(held.value)).filter("n >= 2").collect())
    shared = spark.sparkContext.broadcast((terms, known))

    def make():
        s = Scorer(*shared.value)

        def f(cols):
            return [cols[0], list(s.features_of(cols[1]))]

        return f

    got = map_rows(sample.select("_y", "_t"), "y int, x array<double>", make).collect()
    dropped(sample)
    x, y = np.array([r.x for r in got]), np.array([float(r.y) for r in got])
    return Model(terms, known, logistic(x, y, 1.0))



def _scores(model: Model):
    s, beta = scorer(model), model.beta

    def all_of(texts: list[str | None]) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(beta, x)))))) for x in s.features_of(texts)]

    return all_of


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` and ``predicted`` for each row of ``df``."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        all_of = _scores(shared.value)

        def f(cols):
            s = all_of(cols[1])
            return [cols[0], s, [int(v >= 0.5) for v in s]]

        return f

    return map_rows(df.select(F.col(key), F.col(text)), f"{key} {kind}, score double, predicted int", make)


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score below 0.5, with all their columns."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        all_of = _scores(shared.value)
        for b in batches:
            yield b.filter(pa.array([v < 0.5 for v in all_of(b.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


__all__ = ["Model", "Trie", "fit", "keep_clean", "score"]
