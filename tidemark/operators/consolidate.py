"""One opportunity for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import keep_first


def company_key(number, applicant, row):
    """ch:<number> where matched, name:<key> where named; filings with neither keep keys of their own."""
    return F.when(number.isNotNull() & (number != ""), F.concat(F.lit("ch:"), F.upper(number))).when(applicant != "", F.concat(F.lit("name:"), applicant)).otherwise(F.concat(F.lit("row:"), row.cast("string")))


def consolidate(df: DataFrame, key: str, order: list, members: dict[str, str], union: str | None = None) -> DataFrame:
    """The first row of each company in the order, with the number of its rows and what the others are.

    members: column to name of the list of the other rows' values, sorted; union: an array column that is united over all rows.
    The first rows are cut in each task before the shuffle and counts are summed up before it, so a company with very many rows
    burdens no task; only what is listed is gathered for it.
    """
    lists = [F.array_sort(F.collect_list(c)).alias(name) for c, name in members.items()]
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(union))))).alias(f"all_{union}")] if union else []
    gathered = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n_rows"), *lists, *unions)
    found = keep_first(df, [key], *order).join(gathered, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

    def without(name: str, value: str) -> Column:  # the first row's own value goes, once
        at = F.coalesce(F.array_position(name, F.col(value)), F.lit(0))
        return F.when(at == 0, F.col(name)).otherwise(F.concat(F.slice(name, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(name, at + 1, F.size(name))))

    return found.withColumns({name: without(name, c) for c, name in members.items()}) if members else found


def counters(df: DataFrame) -> DataFrame:
    """Companies, those with several rows, and rows folded away."""
    return df.agg(F.count("*").alias("companies"), F.count_if(F.col("n_rows") > 1).alias("with_several"), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("folded"))
