"""The flagship: orders read as filings, scored with reasons, one row for each applicant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators import relational as rel
from ..operators import scoring as S
from .registry import probe

SCALE = 1.25


@probe("""
WITH l AS (SELECT l_orderkey, count(*) AS items, min(l_shipdate)::date AS ship FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey, o_custkey, c_name, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, items, round_even((ship - o_orderdate::date) / 365.25, 2)::double AS age, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS marks, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_seen
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey),
k AS (SELECT * FROM f WHERE o_orderstatus <> 'P' AND marks < 5),
p AS (SELECT *, list_filter([
    CASE WHEN age <= 1 THEN {'t': 'incorporated ' || CASE WHEN round_even(age * 12, 0) <= 0 THEN 'in the same month as its' WHEN round_even(age * 12, 0) = 1 THEN 'a month before its' ELSE round_even(age * 12, 0)::int || ' months before its' END || ' filing', 'w': 15, 'p': 0} END,
    CASE WHEN age > 1 AND age <= 2 THEN {'t': 'incorporated ' || round_even(age * 12, 0)::int || ' months before its filing', 'w': 10, 'p': 1} END,
    CASE WHEN age > 2 AND age <= 4 THEN {'t': 'incorporated ' || round_even(age * 12, 0)::int || ' months before its filing', 'w': 5, 'p': 2} END,
    CASE WHEN first_seen THEN {'t': 'first filing by this applicant', 'w': 10, 'p': 3} END,
    CASE WHEN marks = 1 THEN {'t': 'one mark in this batch', 'w': 4, 'p': 4} END,
    CASE WHEN items BETWEEN 1 AND 3 THEN {'t': 'covers ' || items || ' classes only', 'w': 5, 'p': 5} END,
    CASE WHEN o_orderpriority < '3' THEN {'t': 'files small accounts', 'w': 4, 'p': 6} END,
    CASE WHEN marks >= 4 THEN {'t': 'files ' || marks || ' marks at once', 'w': -20, 'p': 7} END,
    CASE WHEN items >= 6 THEN {'t': 'covers ' || items || ' classes', 'w': -8, 'p': 8} END, CASE WHEN items IS NULL THEN {'t': 'no company was found', 'w': -15, 'p': 9} END], lambda x: x IS NOT NULL) AS r FROM k),
s AS (SELECT *, least(100, greatest(0, 25 + coalesce(list_sum(list_transform(r, lambda x: x.w)), 0)))::int AS raw FROM p),
c AS (SELECT *, CASE WHEN items IS NULL AND raw > 74 THEN 74 WHEN o_totalprice < 100000 AND raw > 60 THEN 60 ELSE raw END AS score, CASE WHEN items IS NULL AND raw > 74 THEN 'no_company' WHEN o_totalprice < 100000 AND raw > 60 THEN 'small_order' END AS cap FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM c)
SELECT o_custkey, o_orderkey, score, cap, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'SUPPRESS' END AS band,
  array_to_string(list_transform(list_sort(list_transform(r, lambda x: {'w': -x.w, 'p': x.p, 't': x.t}))[1:6], lambda x: x.t), '; ') AS reasons, n_rows FROM o WHERE n = 1""")
def op_r19_score(t):
    from ..functions import dates as D

    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.min("l_shipdate").cast("date").alias("ship"))
    rows = t("orders").join(t("customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate"))
    rows = rel.first_seen(rel.group_size(rows, ["o_custkey", "y"], "marks"), "o_custkey", "o_orderdate").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rel.kept(rel.decide(rows, "qualify", [("dead", F.col("o_orderstatus") == "P"), ("portfolio", F.col("marks") >= 5)]))
    rows = rows.withColumn("age", D.age_years(F.col("o_orderdate").cast("date"), F.col("ship")))
    age, marks, items = F.col("age"), F.col("marks"), F.col("items")
    conditions = {
        "company_incorporated_within_12m": age <= 1, "company_incorporated_within_24m": (age > 1) & (age <= 2), "company_incorporated_within_48m": (age > 2) & (age <= 4), "first_trademark_for_applicant": F.col("first_seen"),
        "single_mark_this_journal": marks == 1, "narrow_class_profile": items.between(1, 3), "small_company_accounts": F.col("o_orderpriority") < "3", "portfolio_filing": marks >= 4, "many_classes": items >= 6, "no_company_match": items.isNull(),
    }
    rows = rows.withColumn("found", S.fired(conditions, {"age_phrase": D.filing_phrase(age), "marks": marks, "n_classes": items}, SCALE)).withColumn("raw", S.total(F.col("found")))
    score, cap = S.capped(F.col("raw"), [("no_company", items.isNull(), 74), ("small_order", F.col("o_totalprice") < 100000, 60)])
    rows = rows.withColumns({"score": score, "cap": cap})
    best = C.consolidate(rows, "o_custkey", [F.desc("score"), "o_orderdate", "o_orderkey"], {})
    return best.select("o_custkey", "o_orderkey", "score", "cap", S.band(F.col("score")).alias("band"), F.array_join(S.top_reasons(F.col("found")), "; ").alias("reasons"), "n_rows")
