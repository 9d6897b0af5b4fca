"""Near copies: only the texts of pairs that may link are moved, and sketches rule out no link."""

import numpy as np
import pytest

from tidewright.llm import jaccard


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_texts_follow_the_pairs(spark, monkeypatch, n, percent):
    rng = np.random.default_rng(7)
    blocks = [words(rng, 100) for _ in range(61)]
    # every shingle is in two documents, none of which are near copies
    rows = [(i, " ".join(blocks[i] + blocks[i + 1])) for i in range(60)]
    rows.append((100, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved, real = [], jaccard.saved

    def watched(df, name="part", *a):
        out = real(df, name, *a)
        if name == "texts":
            moved.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", watched)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, n, percent).collect()}
    assert got == {i: 7 if i == 100 else i for i, _ in rows}
    assert 2 <= sum(moved) <= 20


def test_sketches_are_a_lower_bound():
    rng = np.random.default_rng(11)
    for m, other, shared in ((1, 1, 0), (1, 3, 1), (100, 100, 90), (127, 128, 120), (255, 300, 250), (4000, 4100, 3800), (70000, 80000, 65000)):
        base = rng.integers(0, 1 << 63, m + other, dtype=np.uint64)
        for step in (1, 1 << 15):  # of many sets all shingles fall into one range
            u, v = (base[:m] * np.uint64(step), np.concatenate([base[:shared], base[m : m + other - shared]]) * np.uint64(step))
            u, v = np.unique(u), np.unique(v)
            assert jaccard.gap(jaccard.sketch(u), jaccard.sketch(v)) <= len(np.setxor1d(u, v))
    u, v = rng.integers(0, 1 << 63, (2, 4000), dtype=np.uint64)
    # two long sets with nothing in common are told apart
    assert jaccard.gap(jaccard.sketch(u), jaccard.sketch(v)) * 185 > 15 * 8000
