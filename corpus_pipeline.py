"""The corpus pipeline: stages that each read what the one before kept.

Toxic documents go; of near-duplicates one stays; documents with a benchmark passage go; personal data is replaced by its kind;
what is left is encoded. Null, empty and very long texts pass through all stages, but for near-duplicates texts without words
are one group, of which one stays. Rows of one doc_id are different documents unless their texts are near-duplicates; rows
without a doc_id are documents like others. An empty table gives no rows; other columns than those of documents are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontaminate, near_copies, pii, simhash, toxicity
from tidemark.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay; null, empty and very long texts are scored like others, repeated rows alike; without
    labelled rows all stay."""
    docs = docs.select(*COLUMNS)
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that a Jaccard similarity of 0.8 of five-word shingles links one document stays: the one with the smallest
    doc_id, of those the one whose text has the smallest hash, of equal rows one."""
    placed, _ = common.numbered(docs.select(*COLUMNS))
    found = simhash.near_duplicates(placed, doc_id="place", shingle=near_copies.SHINGLE, similar=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "place")
    first = found.join(placed.select("place", order.alias("order")), "place").groupBy("component_id").agg(F.min("order").alias("order"))
    return placed.join(first.select("order.place"), "place", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay; null and empty texts have none, very long ones are read whole, repeated rows alike."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return found.where("size(hits) = 0").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with [KIND] for each span; n_chars follows the text; null, empty and repeated texts as pii.entities says."""
    docs = docs.select(*COLUMNS)
    found = pii.entities(docs, pii.fit(docs), redacted=True)
    return found.withColumn("n_chars", F.when(F.size("entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, by count and hash, and the hash of what they decode to; null and empty texts have no ids."""
    return bpe.digest(bpe.encode(docs.select("doc_id", "text"), *vocabulary(), decoded=True))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Learned and iterative stages: SQL cannot say them; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each but the last written to shared storage and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{name}")
    return docs
