"""Samples for the driver stay within their bounds whatever the ids."""

from pyspark.sql import functions as F

from tidemark.llm import common, pii


def test_pii_sample_of_null_and_hot_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda texts: seen.append(texts))
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("call +44 20 "), F.col("id")).alias("text"))
    pii.fit(rows.unionByName(rows), sample=300)
    pii.fit(spark.createDataFrame([(7, "a@b.co")] * 50 + [(None, "1")] * 50, "doc_id long, text string"))
    nulls = {f"call +44 20 {i}" for i in range(0, 3000, 3)}
    assert 0 < len(seen[0]) <= 300 and len(set(seen[0])) == len(seen[0]) and not nulls & set(seen[0])
    assert seen[1] == ["a@b.co"]


def test_bounds_hold_and_large_texts_are_not_left_out(spark):
    rows = spark.createDataFrame([(1, "x" * 10)] + [(2, "y" * 10)] * 100 + [(3, "z" * 480), (4, "w" * 300), (5, "v")], "h long, t string")
    assert common.texts_by_hash(rows, 100, 500)["t"].to_pylist() == ["x" * 10, "y" * 10, "z" * 480]
    assert common.texts_by_hash(rows, 100, 330)["t"].to_pylist() == ["x" * 10, "y" * 10, "w" * 300, "v"]
    assert common.texts_by_hash(rows, 3, 10_000)["h"].to_pylist() == [1, 2, 3]
    assert common.texts_by_hash(rows.limit(0), 3, 10)["t"].to_pylist() == []


def test_labelled_sample_of_null_and_hot_ids(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic")).unionByName(spark.createDataFrame([(7, 0), (8, None)], "doc_id long, toxic int"))
    texts, y = common.labelled(docs, labels, "toxic", F.lit(True), most=100)
    assert len(texts) == len(set(texts)) == len(y) <= 100
    hot = {f"text {i}" for i in range(1, 4000, 3)}
    assert sum(t in hot for t in texts) <= 1 and not {f"text {i}" for i in range(0, 4000, 3)} & set(texts)
    texts, y = common.labelled(docs, labels, "toxic", F.col("doc_id") == 7)
    assert len(texts) == 1 and y.tolist() == [0]
