"""Scores of op3 where the filter stays at its blocks: nothing of its size reaches the driver or a worker."""

from pyspark.sql import functions as F

from tidewright.llm import ngram_lm
from tidewright.llm._common import BATCH_BYTES, crc_mod, small_batches


def test_blocks_stay_where_they_are(spark, sf, monkeypatch):
    """Many small chunks, each split over files: equal scores, and no filter is put together on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3, "doc_id")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "\u00e9 " * 9)], "doc_id long, text string"))
    of = lambda: ngram_lm.score(docs, crc_mod(F.col("doc_id"), 7) != 2).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    want = of()
    monkeypatch.setattr(ngram_lm, "MAX_FILTER_BYTES", 1 << 10)
    monkeypatch.setattr(ngram_lm, "ASK_TEXT", 5_000)
    monkeypatch.setattr(ngram_lm, "_filter", lambda *a: (_ for _ in ()).throw(AssertionError("the filter came to the driver")))
    assert of().equals(want)


def test_filters_of_a_corpus_are_not_broadcast():
    """144 MB of filter a GB of texts were measured; the broadcast must not follow."""
    assert ngram_lm.MAX_FILTER_BYTES <= 32 << 20


def test_batches_end_by_bytes(spark):
    """Ranges of n-grams come as large binaries: a batch of 1000 of them held all of a task."""
    small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES
    rows = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("b"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["n"])

    assert rows.mapInArrow(sizes, "n int").agg(F.max("n")).first()[0] <= 10
