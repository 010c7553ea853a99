"""Counts and checks on a batch or on many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row: how many rows each condition holds for, in one pass."""
    return df.agg(F.count("*").alias("raw"), *[F.count_if(c).alias(n) for n, c in stages.items()])


def score_summary(df: DataFrame, score: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.bround(F.avg(score), 1).alias("mean"))


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def volume_guard(counts: DataFrame, series: str, period: str, n: str, back: int = 6, ratio: float = 3.0, least: int = 0) -> DataFrame:
    """Each period's volume against the mean of up to `back` periods before it, zeros and nulls aside."""
    before = W.partitionBy(series).orderBy(period).rowsBetween(-back, -1)
    mean = F.avg(F.nullif(F.col(n), F.lit(0))).over(before)
    apart = F.greatest(F.col(n) / mean, mean / F.greatest(F.col(n), F.lit(1)))
    return counts.withColumn("usual", F.bround(mean, 2)).withColumn("warning", F.coalesce(apart > ratio, F.lit(False))).withColumn("too_few", F.col(n) < least)


def must_hold(df: DataFrame, problem: Column, message: str) -> DataFrame:
    """The rows, unless the condition holds for one: then the job fails with the message."""
    return df.where(F.coalesce(F.when(problem, F.raise_error(F.lit(message)).cast("boolean")), F.lit(True)))


def study(df: DataFrame, period: str, stages: dict[str, Column]) -> DataFrame:
    """Counts for each period and over all, in one pass; the total's period is null."""
    return df.groupingSets([[F.col(period)], []], F.col(period)).agg(F.grouping(F.col(period)).alias("is_total"), F.count("*").alias("raw"), *[F.count_if(c).alias(n) for n, c in stages.items()])


def suspicious(df: DataFrame, key: str, rules: list[tuple[str, Column]], most: int = 30) -> DataFrame:
    """Rows that any rule finds odd, a row for each rule, the first `most` of the report."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return df.select(key, F.explode(found).alias("problem")).orderBy(key, "problem").limit(most)


def qa_report(df: DataFrame, score: Column, band: Column, reason: Column) -> DataFrame:
    """One JSON row: counts, bands, score spread and the most frequent reasons."""
    head = df.agg(F.count("*").alias("rows"), F.count_if(band == "HIGH").alias("high"), F.count_if(band == "MEDIUM").alias("medium"), F.min(score).alias("least"), F.max(score).alias("most"), F.bround(F.avg(score), 1).alias("mean"))
    why = df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where("reason is not null").orderBy(F.desc("n"), "reason").limit(12)
    why = why.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason", "n"))).alias("w")).select(F.transform("w", lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))).alias("reasons"))
    return head.crossJoin(F.broadcast(why)).select(F.to_json(F.struct("*")).alias("report"))  # one row by one row


def stage_failures(df: DataFrame, stage: Column, failed: Column, most: float = 0.5) -> DataFrame:
    """(stage, n, failed, fatal): a stage in which more than `most` of the rows failed stops a run."""
    counts = df.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return counts.withColumn("fatal", F.col("failed") / F.col("n") > most)


def band_counts(df: DataFrame, band: Column) -> DataFrame:
    """One row: rows of each band, as after consolidation."""
    return df.agg(*[F.count_if(band == b).alias(b.lower()) for _, b in R.BANDS])


def match_concerns(counts: DataFrame, least: float = 0.25) -> DataFrame:
    """The funnel's counts (food_class, packaged, matched) with the match rate and what is odd about it; null if nothing."""
    rate = F.try_divide("matched", "packaged")
    concern = F.when((F.col("food_class") > 0) & (F.col("matched") == 0), "no applicant was matched").when(rate < least, "few applicants were matched")
    return counts.withColumns({"match_rate": F.bround(rate, 3), "concern": concern})


def output_checks(*, band: Column, number: Column, confidence: Column, incorporated: Column, filed: Column, brand: Column, days: int = 180) -> list[tuple[str, Column]]:
    """What a scored row must not be, for `suspicious`."""
    high = band == "HIGH"
    return [("high_without_company", high & number.isNull()), ("high_on_weak_match", high & (confidence < 70)), ("incorporated_after_filing", F.datediff(incorporated, filed) > days), ("no_brand", F.trim(F.coalesce(brand, F.lit(""))) == "")]
