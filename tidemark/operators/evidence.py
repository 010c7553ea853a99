"""Web evidence: the search results of each filing, and the classes of their domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from .relational import top_k

#: Results that a brand's and a company's query take at most.
BRAND_RESULTS, COMPANY_RESULTS = 8, 5


def evidence_for(filings: DataFrame, results: DataFrame, key: str, brand: str, company: str) -> DataFrame:
    """Results of the brand's query (8) and, where the company is named otherwise, of the company's (5), by rank.

    results: (query, rank, title, url, snippet). Queries are matched normalised, by an equi-join.
    """
    differ = F.lower(X.text(company)) != F.lower(X.text(brand))
    asked = F.array(F.struct(X.normalise(brand).alias("q"), F.lit(BRAND_RESULTS).alias("k"), F.lit(0).alias("ord")), F.when(differ, F.struct(X.normalise(company).alias("q"), F.lit(COMPANY_RESULTS).alias("k"), F.lit(1).alias("ord"))))
    queries = filings.select(key, F.explode(F.array_compact(asked)).alias("_a")).select(key, "_a.*").where("q <> ''")
    near = results.where(F.col("rank") <= max(BRAND_RESULTS, COMPANY_RESULTS))  # no query takes more: cut before the join, or each filing would meet all results of its query
    found = queries.join(near.withColumn("q", X.normalise("query")), "q").where(F.col("rank") <= F.col("k"))
    return top_k(found.withColumn("domain", X.domain(F.col("url"))), [key, "url"], 1, "ord", "rank").drop("q", "k")


def classified(df: DataFrame, domain: str = "domain", classes: tuple = R.DOMAIN_CLASS) -> DataFrame:
    """Add domain_class: the first class, in order, with a suffix of the domain. An equi-join of the domain's parents."""
    spark = df.sparkSession
    rules = spark.createDataFrame([(s, c, i) for i, (c, suffixes) in enumerate(classes) for s in suffixes], "suffix string, domain_class string, class_ord int")
    hosts = df.select(domain).distinct()
    hit = hosts.select(domain, F.explode(X.domain_suffixes(F.col(domain))).alias("suffix")).join(F.broadcast(rules), "suffix")
    first = hit.groupBy(domain).agg(F.min_by("domain_class", "class_ord").alias("domain_class"))
    return df.join(first, domain, "left").withColumn("domain_class", F.coalesce("domain_class", F.lit("own")))
