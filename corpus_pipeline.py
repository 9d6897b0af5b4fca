"""Corpus pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents. Null, empty and repeated rows pass every stage
by the rules in its operator's module.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import _common, decontaminate, jaccard, mixing, pii, toxicity
from tidewright.llm._common import read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels are learned from all labelled documents."""
    y = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "toxic").filter("toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(y, F.col("doc_id") == F.col("_id"))
    model = toxicity.fit(known.select("text", "_h", "toxic"), same="_h")
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are masked in place; ``n_chars``, where there, follows the text."""
    out = pii.mask_pii(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_identifiers),
    ("mixing", mix_sources),
]

#: Learned scores, similarity components and transducers are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/tidewright/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = len(_common._SAVED)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        _common.sweep(spark, before)
        docs = spark.read.parquet(f"{at}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
