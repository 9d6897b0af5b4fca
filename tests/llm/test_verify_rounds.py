"""Near copies: verifying in many rounds loses no link."""

from tidewright.llm import jaccard


def test_rounds_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    near = docs.limit(60).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' and one more') as text")
    docs = docs.unionByName(near)
    of = lambda: jaccard.join(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want, calls, verify = of(), [], jaccard._verify
    assert (want["component_id"] != want["doc_id"]).sum() >= 50
    monkeypatch.setattr(jaccard, "ROUND", 1)
    monkeypatch.setattr(jaccard, "_verify", lambda *a: calls.append(1) or verify(*a))
    real = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, texts, nodes, *a, **k: real(pairs, texts, 12, *a, **k))
    assert of().equals(want) and len(calls) > 4
