"""All pairs of a group: SQL's rows on odd vectors, few copies of a vector on the way."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright import queries as engine
from tidewright.operators import cells


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, i % 3, [float((i * 7 + j * j) % 11) / 3 for j in range(5)]) for i in range(90)]
    rows += [(100, 0, None), (101, 0, []), (102, 0, [1.0, None, 2.0]), (103, 0, [None] * 5), (104, 1, [1.0] * 9), (105, 1, [float("nan")] * 5), (7, 1, [0.5] * 5), (None, 1, [1.0] * 5), (106, None, [1.0] * 5)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("block,parts,step", [(1000, 8, 1 << 16), (7, 8, 40), (4, 3, 1)])
def test_odd_vectors(spark, odd, monkeypatch, block, parts, step):
    for k, v in (("PARTS", parts), ("MOST", 9), ("STEP", step)):
        monkeypatch.setattr(cells, k, v)
    monkeypatch.setattr(engine, "BLOCK", block)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet/*.parquet'")
    order = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert order(map(tuple, engine.QUERIES["pairwise_dist"](spark, odd).collect())) == order(con.sql(engine.oracle_sql()["pairwise_dist"]).fetchall())


def test_copies_of_a_vector_do_not_follow_the_group(spark, sf, monkeypatch):
    # 500 rows in ten labels: as many blocks as PARTS, not one for each two rows
    monkeypatch.setattr(engine, "BLOCK", 2)
    got = engine.QUERIES["pairwise_dist"](spark, sf)
    assert got.rdd.getNumPartitions() <= 10 * 8 * 9 // 2
    want = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert got.count() == want
