"""Near copies: of the differences in large groups only prefixes are kept, counters grow with the corpus."""

import numpy as np
import pytest

from tidewright.llm import jaccard


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_unrelated_members_keep_a_prefix(spark, monkeypatch, n, percent):
    rng = np.random.default_rng(3)
    stock = words(rng, 30)
    rows = [(i, words(rng, 60)) for i in range(40)]
    # near copies of members of the stock text's group, of which one is no copy of its hub
    rows += [(100 + i, [*w[:-1], "other"]) for i, w in rows[:6]]
    docs = spark.createDataFrame([(i, " ".join(stock + w)) for i, w in rows], "doc_id long, text string")
    kept, real = [], jaccard.saved

    def watched(df, name="part", *a):
        out = real(df, name, *a)
        if name == "verified" and "delta" in out.columns:
            kept.extend((len(r.delta), r.m + r.m_b, r.linked) for r in out.filter("delta is not null").collect())
        return out

    monkeypatch.setattr(jaccard, "saved", watched)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    # all shingles count as equally rare, so the stock text's come into prefixes
    monkeypatch.setattr(jaccard, "shingle_counts", lambda *a: np.ones(1 << 8, dtype=np.uint32))
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, n, percent).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    apart = [(d, m) for d, m, linked in kept if not linked]
    assert len(apart) > 20 and all(d <= 0.4 * m for d, m in apart)


def test_prefixes_of_differences_lose_no_overlap():
    for num, den in ((85, 100), (80, 100), (1, 2)):
        for m in range(1, 30):
            for hub in range(1, 30):
                for both in range(min(m, hub) + 1):
                    k, linked = m + hub - 2 * both, den * both >= num * (m + hub - both)
                    # by the definition, in fractions of two members' differences
                    least = num * k / (num + den) if linked else ((num + den) * k - (den - num) * (m + hub)) / (2 * den)
                    assert jaccard._cut(linked, k, m + hub, num, den) == max(0, k - max(1, int(np.ceil(round(least, 9)))) + 1)


def test_counters_grow_with_the_corpus(spark):
    assert [jaccard.counter_bits(x) for x in (0, 10**6, 864 * 10**6, 10**10, 10**12)] == [19, 19, 19, 23, 23]
    docs = spark.createDataFrame([("a b c d e",), ("b c d e",), (None,)], "text string")
    few = jaccard.shingle_counts(docs, 4)
    assert len(few) == 1 << 19 and few.dtype == np.uint32 and few.sum() == 3 and few.max() == 2
