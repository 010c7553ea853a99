"""The queries opN_<name> over the tables of a folder, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, lexical, line_dedup, media, merkle, oracles, pii, quality, sharding, simhash, substrings, toxicity, training_order
from .common import numbered, remainder, run_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.entities(docs, pii.fit(docs)))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The vocabulary that the queries encode with, of the box's public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """The rank file's path and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), decoded=True)
    return bpe.digest(found)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_columns(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = remainder(F.col("doc_id"), 5) == 0
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sequences = training_order.tokenise(docs, *vocabulary(), ids_type="<u2")  # ids under 50,257: half the bytes to shuffle
    return training_order.write_order(sequences, run_dir(spark, "shards"), placed=n, ids_type="<u2")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = line_dedup.LineIndex(spark, run_dir(spark, "lines"))
    index.insert(docs)
    return line_dedup.digest(index.clean(docs))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), altered=(tampered, {"text": merkle.lowered(F.col("text"))}))
    return merkle.digest(found.proofs())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_substrings": op3_substrings,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_training_order": op10_training_order,
    "op11_lexical": op11_lexical,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = oracles.SQL
