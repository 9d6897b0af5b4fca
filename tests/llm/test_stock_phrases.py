"""Benchmarks whose items share phrases: candidates stay in proportion, and nothing is lost."""

import random

import pytest

from tests.llm.test_operators import brute_leaks
from tidewright.llm import decontaminate

PHRASE = "which of the following statements is"


def found(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.agree, r.window, r.doc_start) for r in decontaminate.contaminated(d, b).collect()}


@pytest.mark.parametrize("n", [200, 400])
def test_candidates_follow_what_is_found(spark, n, monkeypatch):
    """n items and n texts with one phrase: no pair is a candidate for the phrase alone."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = {i: f"{PHRASE} true about {' '.join(word() for _ in range(12))}" for i in range(n)}
    docs = {i: f"{' '.join(word() for _ in range(20))} {PHRASE} false {' '.join(word() for _ in range(20))}" for i in range(n)}
    docs[n] = "and so " + items[3] + " or not"
    docs[n + 1] = items[5].replace("true", "false") + " indeed"
    d = spark.createDataFrame([(i, t) for i, t in docs.items()], "th long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string").select("item_id", decontaminate.tokens(decontaminate.F.col("text")).alias("ih"))
    assert decontaminate._hits(d, b).count() <= 4
    assert set(found(spark, docs, items)) == {(n, 3), (n + 1, 5)}


@pytest.mark.parametrize("seed", range(4))
def test_hot_seeds_lose_nothing(spark, seed, monkeypatch):
    """Every seed hot, few words, short items and texts, edges: the same windows as by brute force, and as with no seed hot."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    phrases = [[r.choice(words) for _ in range(8)] for _ in range(3)]

    def text(n):
        out = []
        while len(out) < n:
            out += r.choice(phrases) if r.random() < 0.5 else [r.choice(words)]
        return out[:n]

    items = {i: " ".join(text(r.choice([7, 9, 10, 11, 12, 13, 14, 20]))) for i in range(40)}
    docs = {}
    for i in range(120):
        t = text(r.choice([0, 5, 10, 11, 12, 13, 30]))
        if i % 2:
            x = r.choice(list(items.values())).split()
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(words)
            cut = r.choice([0, 0, 1, 3])
            x = x[cut:] if r.random() < 0.5 else x[: len(x) - cut]
            t = r.choice([t + x, x + t, x, t + x + t])
        docs[i] = " ".join(t)
    docs[121] = None
    monkeypatch.setattr(decontaminate, "HOT_ITEMS", 0)
    hot = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "HOT_ITEMS", 10**9)
    assert hot == found(spark, docs, items)
    assert set(hot) == set(brute_leaks({k: v or "" for k, v in docs.items()}, items)) and len(hot) > 40
