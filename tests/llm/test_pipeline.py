"""The corpus pipeline: every stage on all that its predecessor kept, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_leaks
from tidewright.llm import pii


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, sf, stages):
    docs, clean, single, fresh, masked, mixed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "mixing"]
    for s in stages[1:-1]:
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = clean.join(labels, "doc_id")
    assert kept.filter("toxic = 1").count() <= 0.5 * labels.filter("toxic = 1").count()
    assert kept.filter("toxic = 0").count() >= 0.95 * labels.filter("toxic = 0").count()
    have = texts(clean)
    assert set(texts(single)) == {c for _, c in brute_components(have, 5, 80).values()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    have = texts(single)
    assert set(have) - set(texts(fresh)) == {d for d, _ in brute_leaks(have, items)}
    have = texts(fresh)
    assert texts(masked) == {i: pii.masked(t) for i, t in have.items()}
    n = masked.count()
    assert mixed.count() == n and mixed.agg(F.max(F.col("taken") - 2 * F.col("size"))).first()[0] <= 0


def test_run(spark, sf, stages):
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r.doc_id: r.taken for r in stages[-1].collect()}


def test_stages_take_empty_and_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", None, 5), (3, "", "en", "s", 0)], docs.schema)
    for d in (docs.limit(0), odd):
        n = d.count()
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf)
            assert d.count() == n
