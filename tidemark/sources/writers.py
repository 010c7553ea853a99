"""Writers: deliverable extracts, reports, and idempotent tables on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import insert_missing, upserted
from ..session import cut

#: Columns of a delivered extract in order, and labels of codes (fixed values).
CSV_COLUMNS = (
    "brand_name", "trademark_number", "filing_date", "publication_date", "product_category", "goods_summary", "company_name", "company_number", "company_incorporation_date", "company_region",
    "website", "website_status", "contact_page", "launch_stage", "brand_maturity", "retail_presence", "packaging_relevance", "label_relevance", "carton_relevance", "contract_manufacturing_relevance",
    "copacking_relevance", "distribution_relevance", "brokerage_relevance", "fulfilment_relevance", "marketing_relevance", "score", "score_band", "score_reasons", "other_marks", "other_brand_names", "source_url", "evidence_urls",
)
LABELS = {
    "launch_stage": {"pre_launch": "Pre-launch", "early_launch": "Early launch", "scaling": "Scaling", "established": "Established", "unknown": "Unknown"},
    "website_status": {"verified": "Confirmed", "probable": "Not confirmed", "unverified": "Not found", "conflicting": "Several possible, none confirmed", "not_attempted": "Not checked"},
    "brand_maturity": {"emerging": "Emerging", "established": "Established", "unknown": "Unknown"},
    "retail_presence": {"none_found": "None found", "direct_only": "Direct / own site only", "marketplace": "Marketplace listing found", "independent_retail": "Independent retail", "multiple_retail": "Multiple retailers", "unknown": "Unknown"},
}
#: Columns of the sample pack in order (fixed values).
SAMPLE_COLUMNS = (
    "brand_name", "product_category", "goods_summary", "company_name", "company_number", "company_incorporation_date", "company_region", "website", "launch_stage", "retail_presence", "score", "score_band", "why_selected",
    "flexible_packaging_relevance", "label_relevance", "carton_relevance", "contract_manufacturing_relevance", "copacking_relevance", "distribution_relevance", "brokerage_relevance", "fulfilment_relevance", "marketing_relevance",
    "trademark_number", "filing_date", "publication_date", "source_url",
)
BOM = "\ufeff"


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, the code itself if it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c), c)


def delivered(df: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS, labels: dict[str, dict[str, str]] = LABELS) -> DataFrame:
    """Text columns in order: codes as labels, arrays joined by ` | `, null and absent ones empty."""

    def cell(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        c = F.col(name)
        c = F.array_join(c, " | ") if df.schema[name].dataType.typeName() == "array" else c.cast("string")
        return F.coalesce(labelled(c, labels[name]) if name in labels else c, F.lit(""))

    return df.select(*[cell(c).alias(c) for c in columns])


def write_extract(df: DataFrame, path: str, *order: Column | str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """One CSV of a batch's deliverables in order, with a byte order mark for spreadsheets. Deliverables are few; the batch is not."""
    rows = delivered(df.orderBy(*order) if order else df, columns)
    rows.withColumnRenamed(columns[0], BOM + columns[0]).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_top(batches: list[DataFrame], path: str, k: int, *order: Column | str) -> None:
    """The best k over several batches."""
    union = batches[0]
    for b in batches[1:]:
        union = union.unionByName(b, allowMissingColumns=True)
    write_extract(union.orderBy(*order).limit(k), path, *order)


def write_rejections(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row JSON report."""
    report.coalesce(1).write.mode("overwrite").text(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or no rows where nothing has been stored; anything else that is wrong with it is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_once(new: DataFrame, path: str, keys: list[str], *order: Column | str) -> int:
    """Append the rows whose keys are not stored, each key once; gives how many. Running it again appends none.

    Of several new rows of a key the first in the order is taken; without one, the first by the hash of all its columns.
    """
    rows = insert_missing(new, read_or_empty(new.sparkSession, path, new.schema), keys, *(order or [F.xxhash64(*new.columns)])).persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def upsert_partition(new: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """Replace the stored rows of the same keys within the partitions that `new` touches, null being one; others are not rewritten."""
    spark = new.sparkSession
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # batches of one run
    stored = read_or_empty(spark, path, new.schema)
    within = F.col(partition).isin([x for x in touched if x is not None])
    stored = stored.where(within | F.col(partition).isNull() if None in touched else within)
    merged = upserted(new, stored, keys).select(*[c for c in new.columns if c != partition], partition)
    staged = cut(merged, "upsert")  # a partition can't be read and overwritten at once
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Events are never replaced."""
    df.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def record_deliveries(deliveries: DataFrame, path: str) -> int:
    """A delivery for each run, recipient and kind at most."""
    keyed = deliveries.withColumn("delivery_key", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("run_id", "recipient", "kind")]), 256))
    return insert_once(keyed, path, ["delivery_key"], "run_id")


def recorded_deliveries(deliveries: DataFrame, path: str) -> DataFrame:
    """The stored row of each delivery and whether this call created it; one that was recorded before comes back as it was."""
    spark = deliveries.sparkSession
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("run_id", "recipient", "kind")]), 256)
    keyed = deliveries.withColumn("delivery_key", key)
    before = cut(read_or_empty(spark, path, keyed.schema).select("delivery_key"), "deliveries")
    insert_once(keyed, path, ["delivery_key"], "run_id")
    wanted = keyed.select("delivery_key").distinct().join(before.withColumn("_old", F.lit(True)), "delivery_key", "left")
    return spark.read.schema(keyed.schema).parquet(path).join(wanted, "delivery_key").withColumn("created", F.col("_old").isNull()).drop("_old")


def record_run(run: DataFrame, messages: DataFrame, runs: str, errors: str, key: str = "run_id") -> int:
    """Store a run's row, in place of an earlier one of its id, and an error row for each message, each once; gives how many are new."""
    upsert_partition(run, runs, key, [key])
    return insert_once(messages, errors, [key, "stage", "message"])


def sorted_json(*columns: str) -> Column:
    """The columns as JSON with sorted names, nulls kept, so that equal rows have equal texts."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
