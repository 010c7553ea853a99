"""Who was seen before: a table of keys and their first periods, bucketed by key.

A week's batch meets years of history. The history lies in buckets of the key's hash, so only the batch is shuffled, to the same buckets;
new keys are appended, and nothing is rebuilt. A key may be stored more than once (a late batch brings an earlier period, a try was
repeated): the least period counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a history; 1 GB of keys each at about 20 billion keys.
BUCKETS = 512


def opened(spark: SparkSession, name: str, path: str, key: str = "string", period: str = "string", buckets: int = BUCKETS) -> str:
    """The history in a folder as a table of (key, first); it is created empty where there is none. Types and buckets are those of its creation."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key {key}, first {period}) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def _met(batch: DataFrame, name: str, key: str, period: str) -> DataFrame:
    """(key, _new, _old): the batch's own first period of each key and the stored one. Rows of a key are combined before the shuffle,
    so a hot key is one row for a task; null keys are left out."""
    spark = batch.sparkSession
    firsts = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(period).alias("_new")).repartition(buckets_of(spark, name), "key")
    stored = spark.table(name).groupBy("key").agg(F.min("first").alias("_old"))
    return firsts.join(stored, "key", "left")


def first_seen(batch: DataFrame, name: str, key: str, period: str) -> DataFrame:
    """Add whether a row lies in the first period of its key, over the history and the batch itself: what `relational.first_seen` gives over
    all rows together. A null key or period was never seen first."""
    least = _met(batch, name, key, period).select(F.col("key").alias("_key"), F.least("_new", "_old").alias("_first"))  # least passes over nulls
    return batch.join(least, F.col(key) == F.col("_key"), "left").withColumn("first_seen", F.coalesce(F.col(period) == F.col("_first"), F.lit(False))).drop("_key", "_first")


def append(batch: DataFrame, name: str, key: str, period: str) -> None:
    """Store the batch's keys that are new, or that it has in an earlier period. Again, it stores none."""
    news = _met(batch, name, key, period).where(F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_new") < F.col("_old"))))
    news.select("key", F.col("_new").alias("first")).write.insertInto(name)


def compacted(spark: SparkSession, name: str, into: str, path: str) -> str:
    """A history with each key once, in another folder: every bucket is read by one task, and none is shuffled."""
    types = dict(spark.table(name).dtypes)
    opened(spark, into, path, types["key"], types["first"], buckets_of(spark, name))
    spark.table(name).groupBy("key").agg(F.min("first").alias("first")).write.insertInto(into)
    return into
