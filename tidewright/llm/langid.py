"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word
falls back to character n-grams, at each position the longest that the model
knows, from ``max_n`` letters down to one.

Fitting takes a bounded sample of labelled rows: ``rows_per_lang`` of each
language on average, by hash of the id; of what that sample holds the model
keeps the ``MAX_WORDS`` most frequent words and the ``MAX_GRAMS`` most frequent
n-grams that occur at least twice. Every letter of a text counts. The score is the winner's share of the
softmax over languages of the mean log probability of a word.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, or where nothing was learned; ties go to the first language by code
point; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, saved

LETTERS = re.compile(r"[^\W\d_]+")
ROWS_PER_LANG = 1500
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
MAX_N = 5


def sample(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """Of each label the share of rows, by hash of the id, that makes ``per_label`` of them on average."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    cut = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n")) * float(1 << 30)
    kept = df.join(F.broadcast(n), df[label] == F.col("_l")) if n.count() <= 10_000 else df.join(n, df[label] == F.col("_l"))
    return kept.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < cut)


def _counts(df: DataFrame) -> DataFrame:
    """(lang, kind, item, n) over the texts of ``df`` (lang, text): words, and character n-grams of the distinct words."""

    def run(batches):
        from collections import Counter

        words: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall((t or "").lower()))
        for lang, c in words.items():
            grams = Counter()
            for w in c:
                p = f"^{w}$"
                for n in range(1, MAX_N + 1):
                    grams.update(p[i : i + n] for i in range(len(p) - n + 1))
            for kind, x in (("w", c), ("g", grams)):
                items = list(x.items())
                for at in range(0, len(items), 50_000):
                    part = items[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([kind] * len(part), pa.string()), pa.array([k for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "kind", "item", "n"])

    return df.mapInArrow(run, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies: ``words`` and ``grams`` map to a row of values, one for each language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], unknown: np.ndarray):
        self.langs, self.words, self.grams, self.unknown = langs, words, grams, unknown

    def unseen(self, word: str) -> np.ndarray:
        p = f"^{word}$"
        total, at, steps = np.zeros(len(self.langs)), 0, 0
        while at < len(p):
            for n in range(min(MAX_N, len(p) - at), 0, -1):
                v = self.grams.get(p[at : at + n])
                if v is not None:
                    total += v
                    break
            else:
                n = 1
                total += self.unknown
            at += max(1, n - 1)
            steps += 1
        return total / max(1, steps) * 2


def fit(labelled: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from the rows of ``labelled`` whose label is not null (a bounded sample of them)."""
    rows = labelled.filter(F.col(label).isNotNull())
    got = sample(rows.select(F.col(key).alias("_k"), F.col(label).cast("string").alias("_lang"), F.col(text).alias("_t")), "_lang", "_k", rows_per_lang)
    counts = saved(_counts(got.select("_lang", "_t")), "lang-counts")
    top = counts.groupBy("kind", "item").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("total"))
    sums = {(r.lang, r.kind): r.n for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in sums})
    at = {lang: i for i, lang in enumerate(langs)}
    tables = {}
    for kind, most in (("w", MAX_WORDS), ("g", MAX_GRAMS)):
        n = np.array([sums.get((lang, kind), 0) + 1.0 for lang in langs])
        table = {}
        for r in top.filter((F.col("kind") == kind) & (F.col("total") >= 2)).orderBy(F.desc("total"), "item").limit(most).select("item", "by").collect():
            c = np.full(len(langs), 0.1)
            for lang, k in r.by:
                c[at[lang]] += k
            table[r.item] = np.log(c / n)
        tables[kind] = table
    n = np.array([sums.get((lang, "g"), 0) + 1.0 for lang in langs])
    return Model(langs, tables["w"], tables["g"], np.log(0.1 / n))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` for each row of ``df``."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        n = len(m.langs)

        class Memo(dict):
            def __missing__(self, w):
                v = m.words.get(w)
                if v is None:
                    v = m.unseen(w)
                if self.used == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[self.used] = v
                if len(w) <= 1000:  # very long words are not held
                    self[w] = self.used
                self.used += 1
                return self.used - 1

        def fresh():
            memo = Memo()
            memo.rows, memo.used = np.empty((1 << 14, n)), 0
            return memo

        state = [fresh()]

        def one(t):
            words = LETTERS.findall(t.lower()) if t else []
            if not n or not any(c.isalpha() for w in words for c in w):
                return "und", 0.0
            memo = state[0]
            if memo.used > 200_000:
                memo = state[0] = fresh()
            ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            s = memo.rows[ids].mean(axis=0)
            best = int(np.argmax(s))
            return m.langs[best], float(1 / np.exp(np.minimum(s - s[best], 0)).sum())

        def f(cols):
            rows = [one(t) for t in cols[1]]
            return [cols[0], [r[0] for r in rows], [r[1] for r in rows]]

        return f

    return map_rows(df.select(F.col(key), F.col(text)), f"{key} {kind}, lang_pred string, score double", make)


def accuracy(pred: Column, truth: Column) -> Column:
    return F.avg(F.when(pred == truth, 1.0).otherwise(0.0))


__all__ = ["Model", "accuracy", "fit", "predict", "sample"]
