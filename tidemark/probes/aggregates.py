"""Counts, summaries, studies and windows over periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import share
from ..operators import relational as rel
from ..operators import goods, prospects, reports, sales
from ..streaming import stateful
from .registry import probe


@probe("""
SELECT count(*) AS raw, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 250000) AS large_open, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderstatus = 'P') AS dead FROM orders""")
def op_a02_funnel(t):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return reports.funnel(t("orders"), {"finished": s == "F", "large_open": (s == "O") & (p > 250000), "urgent": F.col("o_orderpriority").startswith("1"), "dead": s == "P"})


@probe("""
WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'dead' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END AS reason FROM orders)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 12""")
def op_a03_reasons(t):
    rows = rel.decide(t("orders"), "qualify", [("dead", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 50000), ("low_priority", F.col("o_orderpriority").startswith("5"))])
    return rel.reason_counts(rows, most=12)


@probe("""
SELECT l_returnflag, count(*) AS n, min(l_quantity)::double AS least, max(l_quantity)::double AS most, round_even(sum(l_quantity) / count(*), 1)::double AS mean FROM lineitem GROUP BY 1""")
def op_a05_summary(t):
    return reports.score_summary(t("lineitem"), F.col("l_quantity"), "l_returnflag")


@probe("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def op_a07_dup_counts(t):
    return reports.duplicate_keys(t("documents"), F.md5(F.col("text").cast("binary")))


@probe("""
WITH d AS (SELECT event_type, ts::date AS d, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, avg(nullif(n, 0)) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM d)
SELECT event_type, d::varchar AS day, n, round_even(m, 2)::double AS usual, coalesce(greatest(n / m, m / greatest(n, 1)) > 1.2, false) AS warning, n < 50 AS too_few FROM w""")
def op_f18_volume_guard(t):
    counts = t("events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    found = reports.volume_guard(counts, "event_type", "d", "n", 6, 1.2, 50)
    return found.select("event_type", F.col("d").cast("string").alias("day"), "n", "usual", "warning", "too_few")


@probe("""
WITH c AS (SELECT l_orderkey, l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nx, sum(n) OVER (PARTITION BY l_orderkey) AS a FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY n DESC, grp))
SELECT l_orderkey, grp AS dominant, n AS dominant_items, (coalesce(nx = n, false) OR n::double / a < 0.4) AS several, n::double / a AS part FROM r WHERE r = 1""")
def op_a10_dominant(t):
    rows = goods.dominant(t("lineitem"), "l_orderkey", "l_returnflag")
    all_ = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("a"))
    return rows.join(all_, "l_orderkey").select("l_orderkey", "dominant", "dominant_items", "several", share(F.col("dominant_items"), F.col("a")).alias("part"))


EDGES = [("80+", 480000), ("70s", 420000), ("60s", 300000), ("50s", 150000), ("40s", 900), ("<40", -1)]


@probe("""
WITH b AS (SELECT * FROM (VALUES ('80+', 0, 480000, 1e12), ('70s', 1, 420000, 480000), ('60s', 2, 300000, 420000), ('50s', 3, 150000, 300000), ('40s', 4, 900, 150000), ('<40', 5, -1, 900)) v(bucket, position, lo, hi))
SELECT bucket, position::int AS position, count(o_orderkey) AS n FROM b LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1, 2""")
def op_a17_histogram(t):
    return rel.bucketed(t("orders"), F.col("o_totalprice"), EDGES)


LEVELS = [480000, 450000, 400000, 350000, 300000, 250000, 200000, 100000]


@probe(f"SELECT t::int AS threshold, count(*) AS n FROM orders JOIN (SELECT unnest({LEVELS}) AS t) ON o_totalprice >= t GROUP BY 1")
def op_a18_sensitivity(t):
    return rel.thresholds(t("orders"), F.col("o_totalprice"), LEVELS)


@probe("""
WITH s AS (SELECT year(o_orderdate) AS y, grouping(year(o_orderdate)) AS g, count(*) AS raw, count(*) FILTER (o_totalprice >= 400000) AS good FROM orders GROUP BY GROUPING SETS ((year(o_orderdate)), ()))
SELECT coalesce(y::varchar, 'all') AS y, g::int AS is_total, raw, good, CASE WHEN good BETWEEN 500 AND 100000 THEN 'STRONG' WHEN good BETWEEN 440 AND 499 THEN 'FAIR' ELSE 'WEAK' END AS verdict FROM s""")
def op_a19_study(t):
    rows = reports.study(t("orders").withColumn("y", F.year("o_orderdate")), "y", {"good": F.col("o_totalprice") >= 400000})
    verdict = rel.band_of(F.col("good"), [("STRONG", 500, 100000), ("FAIR", 440, 499), ("WEAK", 0, 439)])
    return rows.select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("y"), F.col("is_total").cast("int").alias("is_total"), "raw", "good", verdict.alias("verdict"))


@probe("""
WITH f AS (SELECT CASE WHEN toxic = 1 THEN 'BAD_FIT' WHEN quality = 1 THEN 'USEFUL' ELSE 'UNSURE' END AS state, coalesce(nullif(source, 'src0'), 'unattributed') AS customer, coalesce(nullif(lang, 'es'), 'uncategorised') AS category FROM labels LEFT JOIN documents USING (doc_id))
SELECT state, customer, category, grouping(state, customer, category)::bigint AS "of", count(*) AS n FROM f GROUP BY GROUPING SETS ((state), (customer, state), (category, state))""")
def op_a26_feedback_sets(t):
    rows = t("labels").join(t("documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("customer"), F.nullif("lang", F.lit("es")).alias("category")), "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "BAD_FIT").when(F.col("quality") == 1, "USEFUL").otherwise("UNSURE")
    return sales.feedback_sets(rows.withColumn("state", state), "state", "customer", "category")


@probe("""
WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT quality, toxic, n, round_even(n::double / sum(n) OVER (), 3)::double AS part, (SELECT round_even(sum(quality)::double / count(*), 3)::double FROM labels) AS useful FROM c""")
def op_a27_patterns(t):
    labels = t("labels")
    useful, _ = sales.rate(F.sum("quality"), F.count("*"))
    found = sales.patterns(labels, ["quality", "toxic"]).withColumnRenamed("share", "part")
    return found.crossJoin(F.broadcast(labels.agg(useful.alias("useful"))))  # one row


@probe("""
WITH u AS (SELECT year(o_orderdate)::int AS y, count(DISTINCT date_trunc('month', o_orderdate)) AS runs, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1),
l AS (SELECT y, runs, customers, unnest([{'line': 'hosting', 'pence': 900.0::double}, {'line': 'search', 'pence': (7.5 * runs)::double}, {'line': 'mail', 'pence': (0.25 * customers)::double}], recursive := true) FROM u)
SELECT y, line, pence, greatest(1, ceil(900 / (49.0 - 0.25)))::bigint AS break_even FROM l""")
def op_a29_costs(t):
    usage = t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_distinct(F.date_trunc("month", "o_orderdate")).alias("runs"), F.count_distinct("o_custkey").alias("customers"))
    rows = sales.costs(usage, [("hosting", 900, "fixed"), ("search", 7.5, "run"), ("mail", 0.25, "customer")])
    return rows.select("y", "line", "pence", sales.break_even(F.lit(900), F.lit(49.0), F.lit(0.25)).cast("long").alias("break_even"))


@probe("""
WITH f AS (SELECT p_partkey, ((p_size % 4) * 21.0::double) + CASE p_type WHEN 'PROMO' THEN 10 WHEN 'SMALL' THEN -5 ELSE 0 END AS x FROM part)
SELECT p_partkey, x::double AS fit, CASE WHEN x >= 55 THEN 'A' WHEN x >= 38 THEN 'B' WHEN x >= 15 THEN 'C' ELSE 'D' END AS band,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 IN (0, 1, 2) ELSE p_partkey % 5 IN (0, 3) END AS moves FROM f""")
def op_r21_fit(t):
    fit = (F.col("p_size") % 4) * 21.0 + F.when(F.col("p_type") == "PROMO", 10).when(F.col("p_type") == "SMALL", -5).otherwise(0)
    k = F.col("p_partkey")
    even = k % 2 == 0
    old = F.when(even, "EMAIL_1_SENT").otherwise("RESEARCHED")
    new = F.when(k % 5 == 1, "SAMPLE_REQUESTED").when(k % 5 == 2, "NOT_NOW").when(k % 5 == 3, "READY").when(k % 5 == 4, "SUBSCRIBED").otherwise(old)
    return t("part").select("p_partkey", fit.alias("fit"), sales.fit_band(fit).alias("band"), prospects.transition_ok(old, new).alias("moves"))


@probe("""
SELECT strftime(date_trunc('week', ts - INTERVAL 4 DAY) + INTERVAL 4 DAY, '%Y-%m-%d') AS batch, event_type, count(*) AS n, round(sum(value::decimal(18,2)), 2)::double AS total FROM events GROUP BY 1, 2""")
def op_t01_weekly_window(t):
    rows = stateful.weekly(t("events"), "ts", "event_type", total=F.sum(F.col("value").cast("decimal(18,2)")).cast("double"))
    return rows.select(F.date_format("week.start", "yyyy-MM-dd").alias("batch"), "event_type", "n", "total")


@probe("""
SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS won, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 3)::double AS rate, count(*) >= 5 AS meaningful, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def op_a21_rates(t):
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    found = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("won"))
    rate, meaningful = sales.rate(F.col("won"), F.col("n"))
    return found.select("n", "won", rate.alias("rate"), meaningful.alias("meaningful"), "c_mktsegment")
