"""Toxicity on few labels, and its scores by brute force on the labelled documents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("toxic", "clean", "words"), [(10, 60, 400), (10, 600, 40), (25, 100, 1500), (60, 40, 100)])
def test_few_labels_are_learned(spark, toxic, clean, words):
    """From ten toxic rows on, whatever the number of words that are tried."""
    r = np.random.default_rng(words)
    vocabulary = [f"w{i}x" for i in range(3000)]
    p = 1 / np.arange(1, 3001)
    bad = ["wretched", "scoundrel", "blighter"]

    def text(is_toxic):
        w = list(r.choice(vocabulary, words, p=p / p.sum()))
        for k in r.integers(0, words, 3) if is_toxic else []:
            w[k] = str(r.choice(bad))
        return " ".join(w)

    rows = [(i, text(i < toxic), int(i < toxic)) for i in range(toxic + clean)]
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert set(bad) <= set(m.terms) and sum(t not in bad and not any(b.startswith(t) for b in bad) for t in m.terms) <= 3
    new = spark.createDataFrame([(i, text(i % 2), i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    got = {(r.toxic, r.predicted): r["count"] for r in toxicity.score(new, m).join(new, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert got.get((1, 1), 0) >= 80 and got.get((0, 1), 0) <= 5


def test_no_term_is_made_up(spark):
    """Labels by chance: hardly a term passes, however many are tried."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 5000, 300)), int(r.random() < 0.2)) for i in range(400)]
    assert len(toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).terms) <= 2


def test_chance_is_fishers():
    for a, b, n1, n0 in [(3, 0, 11, 76), (5, 2, 11, 76), (11, 76, 11, 76), (1, 0, 1, 1), (40, 3, 60, 200)]:
        want = sum(math.comb(n1, k) * math.comb(n0, a + b - k) for k in range(a, min(a + b, n1) + 1)) / math.comb(n1 + n0, a + b)
        assert toxicity._chance(a, b, n1, n0) == pytest.approx(want, rel=1e-9)


def test_copies_do_not_fill_the_sample(spark):
    d = spark.createDataFrame([(None, "w1 w2 w3", 0)] * 500 + [(i, f"w{i} wretched words", 1) for i in range(30)] + [(i, f"w{i} other words", 0) for i in range(30, 90)], "doc_id long, text string, toxic int")
    m = toxicity.fit(d, max_rows=80)
    assert set(m.terms) & {"wretched", "wretc", "wre", "wret", "wretch"}


def brute_score(text, m):
    """Every word against every term, letter by letter."""
    words = (text or "").lower().split()
    stems = sorted((t for t, (stem, _, _) in m.terms.items() if stem), key=len, reverse=True)

    def weight(w):
        w = w.strip(toxicity.EDGE)
        if w in m.terms:
            return m.terms[w][1]
        stem = next((t for t in stems if w.startswith(t)), None)
        if stem:
            return m.terms[stem][1]
        if w in m.known:
            return 0.0
        near = [(d, -len(t), t) for t, (_, _, fuzzy) in m.terms.items() if fuzzy and len(t) >= 5 and abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= (1 if len(t) < 9 else 2)]
        return m.terms[min(near)[2]][1] * 0.8 ** min(near)[0] if near else 0.0

    memo = {w: weight(w) for w in set(words)}
    hits = [i for i, w in enumerate(words) if memo[w]]
    quoted = {i: toxicity.Scorer.quotation(words, i) for i in hits}
    abuse = sum(memo[words[i]] * (1 - quoted[i]) for i in hits)
    said = sum(memo[words[i]] * quoted[i] for i in hits)
    rate, kinds = len(hits) / (len(words) + 20), len({words[i] for i in hits})
    x = [1, math.log1p(abuse), math.log1p(said), math.log1p(100 * rate), math.log1p(kinds), math.log1p(len(hits)) * math.log1p(100 * rate)]
    return 1 / (1 + math.exp(-float(np.dot(m.beta, x))))


def test_scores_by_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    y = labels.select(F.col("doc_id").alias("_id"), "toxic")
    d = docs.join(y, F.col("doc_id") == F.col("_id"))
    m = toxicity.fit(d)
    assert m.terms
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    rows = d.collect()
    for r in rows:
        assert got[r.doc_id] == pytest.approx(brute_score(r.text, m), abs=1e-9)
    toxic = [got[r.doc_id] >= 0.5 for r in rows if r.toxic]
    assert sum(toxic) >= len(toxic) / 2 and sum(got[r.doc_id] >= 0.5 for r in rows if not r.toxic) <= 0.05 * len(rows)
