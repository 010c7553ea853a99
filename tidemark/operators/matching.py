"""Applicants to register companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .relational import best_match, blocked_lookup


def name_parts(c: Column | str) -> Column:
    """What a name is compared by: name without legal forms, key without spaces, tokens. Worked out once for a name, not once for a pair."""
    name = X.company_name(c)
    return F.struct(name.alias("name"), F.replace(name, F.lit(" "), F.lit("")).alias("key"), X.tokens(name).alias("tokens"))


def ladder(a: Column, b: Column) -> Column:
    """0 to 98 for the parts of two names, by the first rung that holds: same name, same key, same tokens, one within the other, shared share."""
    ta, tb = a["tokens"], b["tokens"]
    j = X.jaccard(ta, tb)
    part = F.floor(j * 60).cast("int")
    there = a["name"] != ""
    return (
        F.when((a["name"] == b["name"]) & there, 98)
        .when((a["key"] == b["key"]) & there, 92)
        .when((F.size(ta) == 0) | (F.size(tb) == 0), 0)
        .when(j == 1, 88)
        .when(X.subset(ta, tb, False) | X.subset(tb, ta, False), F.when(j >= 0.6, 78).otherwise(part))
        .when(j >= 0.7, 78)
        .when(j >= 0.5, 55)
        .otherwise(part)
    )


def name_score(a: Column, b: Column) -> Column:
    """The ladder for two names."""
    return ladder(name_parts(a), name_parts(b))


def match_applicants(filings: DataFrame, companies: DataFrame, applicant: str = "applicant_name", k: int = 25) -> DataFrame:
    """The best company of each distinct applicant: (applicant, company columns, score, runner_up, ambiguous, confidence).

    Each applicant is matched once, whatever its number of filings. companies has company_name and company_number.
    """
    names = filings.select(F.col(applicant)).where(X.normalise(applicant) != "").distinct().withColumn("_a", name_parts(applicant))
    register = companies.withColumn("_b", name_parts("company_name"))
    pairs = blocked_lookup(names, register, applicant, F.col("_a.name"), F.col("_b.name"), ["company_number"], k)
    scored = pairs.withColumn("score", ladder(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return best_match(scored, applicant, "score", "company_number")


def with_match(filings: DataFrame, matches: DataFrame, applicant: str = "applicant_name") -> DataFrame:
    return filings.join(matches, applicant, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0)))


def without_post_dated(df: DataFrame, filed: str, incorporated: str, cleared: list[str], days: int) -> DataFrame:
    """A match incorporated more than `days` after the filing is none: its columns are cleared and the method says why."""
    late = F.coalesce(F.datediff(incorporated, filed) > days, F.lit(False))
    return df.withColumns({**{c: F.when(late, F.lit(None)).otherwise(F.col(c)) for c in cleared}, "confidence": F.when(late, 0).otherwise(F.col("confidence")), "method": F.when(late, "post_dated").otherwise(F.col("method"))})
