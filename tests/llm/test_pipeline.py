"""The pipeline's stages, each held against what the operators' own brute-force versions would keep."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import common, pii, queries, simhash, toxicity

from .test_models import spans_by_hand
from .test_near_copies import groups_by_hand
from .test_search_and_dedup import classes_by_hand, contamination_by_hand, fingerprints_by_hand

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs.toPandas().set_index("doc_id")]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.toPandas().set_index("doc_id"))
    return out


def test_columns(stages):
    for kept in stages[1:-1]:
        assert sorted(kept.columns) == sorted(set(corpus_pipeline.COLUMNS) - {"doc_id"})
        assert kept.index.is_unique


def test_toxic_documents_go(spark, stages):
    docs = common.table(spark, SF, "documents")
    score = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, common.table(spark, SF, "labels"))).toPandas().set_index("doc_id").score
    assert set(stages[1].index) == set(score[score < 0.5].index)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    gone = set(stages[0].index) - set(stages[1].index)
    clean = set(labels[labels == 0].index)
    assert len(gone & clean) <= 0.02 * len(clean)


def test_fingerprints_link_what_brute_force_links(spark, stages):
    before = stages[1].sort_index()
    rows = spark.createDataFrame(list(before.text.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    classes = classes_by_hand(fingerprints_by_hand(before.text), 4)
    assert got == {before.index[i]: before.index[c] for i, c in enumerate(classes)}


def test_one_document_of_each_group_stays(stages):
    """Groups by the stage's own measure, a Jaccard similarity of 0.8 of five-word shingles, over all pairs."""
    before = stages[1].sort_index()
    assert set(stages[2].index) == set(groups_by_hand(dict(before.text.items())).values())
    assert (stages[2].text == before.text[stages[2].index]).all()


def test_benchmark_passages_go(spark, stages):
    before = stages[2].sort_index()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = contamination_by_hand(list(before.text), items)
    assert set(stages[3].index) == {before.index[i] for i, v in found.items() if not v[4]}


def test_personal_data_is_replaced(stages):
    assert set(stages[4].index) == set(stages[3].index)
    for i, old in stages[3].text.items():
        new = stages[4].text[i]
        assert (new != old) or not spans_by_hand(old)
        assert not pii.base_spans(new)
        assert stages[4].n_chars[i] == len(new)


def test_what_is_left_is_encoded(stages):
    assert set(stages[5].index) == set(stages[4].index)
    assert all(stages[5].decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in stages[4].text.items())


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas().set_index("doc_id").sort_index()
    assert got.equals(stages[-1].sort_index()[got.columns])


def test_edge_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "A b c d e", None, None, None), (None, "x y", "en", "s", 3), (None, None, None, None, None), (5, long, "en", "s", len(long)), (6, "mail a@b.co", "en", "s", 11), (7, "one two three four five six seven eight nine ten", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumns({"score": F.lit(1), "hits": F.lit(2), "entities": F.lit(3), "ids": F.lit(4)}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 5, 6]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([*rows[:2], (1, "another text of five words", "en", "s", 1), (None, "x y", "fr", "t", 3), (None, "x  y", "en", "s", 3)], schema), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in kept) == [(0, "x"), (1, "a"), (1, "another")]
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.QUERIES) <= names
