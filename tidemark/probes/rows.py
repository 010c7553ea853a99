"""Decisions, filters and rankings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rulebook
from .. import rules as R
from ..functions import text as X
from ..functions import values as V
from ..operators import goods as G
from ..operators import relational as rel
from ..operators import sales, scoring, terms
from .registry import probe
from .scalars import sql_hits

WORDS = {"first": ("thereon", "andthe", "eauque"), "second": ("tion", "ment"), "third": ("sch", "ción")}


def sql_groups(groups, item: str) -> str:
    """Points and place of each keyword as a list of structs, in SQL."""
    head = f"list_last(string_split({item}, ' '))"
    return "[" + ", ".join(f"CASE WHEN contains({item}, '{k}') THEN {{'points': {len(k)} + CASE WHEN contains({head}, '{k}') THEN 3 ELSE 0 END, 'place': {-(100 * i + j)}, 'grp': '{g}', 'matched': '{k}'}} END" for i, (g, ws) in enumerate(groups.items()) for j, k in enumerate(ws)) + "]"


@probe("""
SELECT doc_id, CASE WHEN contains(lower(text), 'thereon') THEN 'thereon' WHEN contains(lower(text), 'andthe') THEN 'andthe' WHEN contains(lower(text), 'eauque') THEN 'eauque' END AS keyword,
  (contains(lower(text), 'thereon')::int + contains(lower(text), 'andthe')::int + contains(lower(text), 'eauque')::int) AS n_first, (contains(lower(text), 'tion')::int + contains(lower(text), 'ment')::int) AS n_second FROM documents""")
def op_f07_first_keyword(t):
    low = F.lower("text")
    return t("documents").select("doc_id", X.first_of(WORDS["first"], low).alias("keyword"), X.hits(WORDS["first"], low).alias("n_first"), X.hits(WORDS["second"], low).alias("n_second"))


@probe(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark),
h AS (SELECT doc_id, list(w ORDER BY w) AS ws FROM documents, w WHERE contains(lower(text), w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ws), 0)::int AS n_terms, ws[1] AS first_term, md5(coalesce(array_to_string(ws, ','), '')) AS terms_md5 FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def op_x09_terms(t):
    words = terms.term_list(t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")), "w")
    rows = terms.with_terms(t("documents").select("doc_id", F.lower("text").alias("low")), "low", words)
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.get("terms", F.lit(0))["term"].alias("first_term"), F.md5(F.array_join("terms.term", ",").cast("binary")).alias("terms_md5"))


@probe("""
WITH c AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS c FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, len(c)::int AS n, CASE WHEN len(list_filter(c, lambda x: x <> 7)) = 0 THEN 'only_7' WHEN len(list_filter(c, lambda x: x NOT IN (5, 6))) = 0 THEN 'only_5_6' WHEN NOT list_has_any(c, [1, 2, 3]) THEN 'no_main' WHEN NOT list_has_any(c, [1, 2]) THEN 'supporting_only' END AS reason, list_has_any(c, [1, 2, 3]) AS has_main FROM c)
SELECT l_orderkey, n, reason, has_main FROM r""")
def op_f04_class_subset(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("c"))
    c = F.col("c")
    rules = [("only_7", V.all_in(c, [7])), ("only_5_6", V.all_in(c, [5, 6])), ("no_main", ~V.any_in(c, [1, 2, 3])), ("supporting_only", ~V.any_in(c, [1, 2]))]
    return rows.select("l_orderkey", F.size("c").alias("n"), rel.first_reason(rules).alias("reason"), V.any_in(c, [1, 2, 3]).alias("has_main"))


@probe("""
SELECT c_custkey, CASE WHEN n_regionkey IN (0, 1) THEN 'home' WHEN n_name IS NULL OR trim(n_name) = '' THEN 'unknown' ELSE 'abroad' END AS place,
  CASE WHEN list_has_any(string_split(lower(c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ltd' ELSE '' END), ' '), ['ltd', 'limited', 'plc']) THEN 'corporate' WHEN c_acctbal < 0 THEN 'debtor' ELSE 'person' END AS kind
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def op_f12_applicant_type(t):
    rows = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " ltd").otherwise(""))
    place = F.when(F.col("n_regionkey").isin(0, 1), "home").when(F.trim(X.text("n_name")) == "", "unknown").otherwise("abroad")
    return rows.select("c_custkey", place.alias("place"), F.when(X.has_legal_form(name), "corporate").when(F.col("c_acctbal") < 0, "debtor").otherwise("person").alias("kind"))


OUT = [w for words in R.OUT_OF_SCOPE.values() for w in words]
FOOD = [w for words in R.GROUPS.values() for w in words]


@probe(f"""
WITH h AS (SELECT doc_id, lower(text) AS x, {sql_hits(OUT, 'lower(text)')} AS o, {sql_hits(FOOD, 'lower(text)')} AS i, (contains(lower(text), 'pet food') OR contains(lower(text), 'vitamin')) AS d, doc_id % 7 = 5 AS five FROM documents),
s AS (SELECT *, CASE WHEN o + i = 0 THEN 0.0 ELSE o::double / (o + i) END AS part FROM h)
SELECT doc_id, o AS n_out, i AS n_in, ((d AND five) OR (d AND part >= 0.5) OR (o >= 2 AND part >= 0.5)) AS out_of_scope FROM s""")
def op_f08_dominance(t):
    low = F.lower("text")
    classes = F.array(F.when(F.col("doc_id") % 7 == 5, 5).otherwise(29))
    return t("documents").select("doc_id", X.hits(tuple(OUT), low).alias("n_out"), X.hits(tuple(FOOD), low).alias("n_in"), G.out_of_scope(low, classes).alias("out_of_scope"))


@probe("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS marks FROM orders)
SELECT o_orderkey, marks, CASE WHEN o_orderstatus = 'P' THEN 'dead' WHEN marks >= 5 THEN 'portfolio' END AS reason, marks BETWEEN 3 AND 4 AS noted FROM n""")
def op_f13_portfolio(t):
    orders = t("orders").withColumn("y", F.year("o_orderdate"))
    rows = rel.group_size(orders, ["o_custkey", "y"], "marks")
    rows = rel.decide(rows, "applicant", [("dead", F.col("o_orderstatus") == "P"), ("portfolio", F.col("marks") >= 5)])
    return rows.select("o_orderkey", "marks", "reason", F.col("marks").between(3, 4).alias("noted"))


@probe("""
WITH l AS (SELECT l_orderkey, min(l_shipdate)::date AS ship, max(l_shipdate)::date AS last FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey, o_orderdate::date AS o, ship, last FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, coalesce((ship - o) > 180, false) AS post_dated, CASE WHEN last <= o THEN 'dissolved' WHEN (ship - o) / 365.25 > 6.0 THEN 'too_old' WHEN ship IS NULL THEN 'unmatched' END AS reason, CASE WHEN coalesce((ship - o) > 180, false) THEN 0 ELSE 90 END AS confidence FROM a""")
def op_f16_dead_at_filing(t):
    from ..operators.matching import without_post_dated

    span = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("ship"), F.max("l_shipdate").cast("date").alias("last"))
    rows = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o")).join(span, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = rel.first_reason([("dissolved", F.col("last") <= F.col("o")), ("too_old", F.datediff("ship", "o") / 365.25 > 6.0), ("unmatched", F.col("ship").isNull())])
    rows = rows.withColumns({"confidence": F.lit(90), "method": F.lit("exact"), "kept_ship": F.col("ship"), "reason": reason})
    cleared = without_post_dated(rows, "o", "ship", ["kept_ship"], R.POST_DATED_DAYS)
    return cleared.select("o_orderkey", (F.col("method") == "post_dated").alias("post_dated"), "reason", "confidence")


@probe("""
WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'HIGH' WHEN o_totalprice >= 250000 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN o_orderpriority LIKE '5%' THEN 'SERVICE' ELSE 'PRODUCT' END AS mode, CASE WHEN c_acctbal > 8000 THEN 'press' END AS established FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, CASE WHEN band NOT IN ('HIGH', 'MEDIUM') THEN 'score_below_band' WHEN mode = 'SERVICE' THEN 'service_business' WHEN established IS NOT NULL THEN 'established_brand' END AS reason FROM b)
SELECT coalesce(reason, 'delivered') AS reason, band, count(*) AS n FROM r GROUP BY 1, 2""")
def op_f20_cascade(t):
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    price = F.col("o_totalprice")
    rows = rows.withColumns({"band": F.when(price >= 400000, "HIGH").when(price >= 250000, "MEDIUM").otherwise("LOW"), "mode": F.when(F.col("o_orderpriority").startswith("5"), "SERVICE").otherwise("PRODUCT"), "established": F.when(F.col("c_acctbal") > 8000, "press")})
    reason = scoring.final_reason(F.col("band"), F.col("mode"), F.col("established"))
    return rows.groupBy(F.coalesce(reason, F.lit("delivered")).alias("reason"), "band").agg(F.count("*").alias("n"))


@probe("""
WITH m AS (SELECT max(ts) AS now FROM events),
l AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN ts END) AS late, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1),
s AS (SELECT user_id, now, late, CASE WHEN late IS NOT NULL AND last_type IN ('error', 'view') THEN 'PAST_DUE' WHEN last_type = 'signup' THEN 'CANCELLED' ELSE 'ACTIVE' END AS status FROM l, m)
SELECT user_id, status, coalesce(status IN ('ACTIVE', 'PAST_DUE') AND NOT (status = 'PAST_DUE' AND now > late + INTERVAL 2 DAY), false) AS allowed,
  CASE WHEN coalesce(status IN ('ACTIVE', 'PAST_DUE') AND NOT (status = 'PAST_DUE' AND now > late + INTERVAL 2 DAY), false) THEN NULL WHEN status = 'PAST_DUE' THEN 'payment overdue' ELSE 'subscription ' || lower(status) END AS blocked FROM s""")
def op_f26_grace(t):
    events = t("events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("late"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    status = F.when(F.col("late").isNotNull() & F.col("last_type").isin("error", "view"), "PAST_DUE").when(F.col("last_type") == "signup", "CANCELLED").otherwise("ACTIVE")
    rows = last.crossJoin(F.broadcast(now)).withColumn("status", status)
    rows = rows.withColumn("allowed", sales.delivery_allowed(F.lit(True), F.col("status"), F.col("late"), F.col("now"), 2))
    return rows.select("user_id", "status", "allowed", sales.block_reason(F.lit(True), F.col("status"), F.col("allowed")).alias("blocked"))


@probe("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def op_w01_keep_first(t):
    return rel.keep_first(t("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@probe("""
SELECT event_id, user_id, r <= 100 AS in_budget FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events)""")
def op_w05_budget(t):
    rows = t("events").select("event_id", "user_id", "value")
    return rel.budgeted(rows, 100, "event_id", F.desc("value")).select("event_id", "user_id", "in_budget")


@probe("""
WITH RECURSIVE u AS (SELECT p_partkey, p_brand, p_name, p_type, p_size * 2 AS fit, row_number() OVER (PARTITION BY p_brand, p_name, p_type ORDER BY p_size DESC, p_partkey) AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY fit DESC, p_partkey) AS n FROM u WHERE k = 1),
a AS (SELECT DISTINCT p_brand, 0::bigint AS n, []::varchar[] AS cs, []::varchar[] AS gs, []::bigint[] AS taken FROM r
  UNION ALL SELECT a.p_brand, r.n, CASE WHEN len(taken) < 5 AND NOT list_contains(cs, p_name) AND NOT list_contains(gs, p_type) THEN list_append(cs, p_name) ELSE cs END, CASE WHEN len(taken) < 5 AND NOT list_contains(cs, p_name) AND NOT list_contains(gs, p_type) THEN list_append(gs, p_type) ELSE gs END,
    CASE WHEN len(taken) < 5 AND NOT list_contains(cs, p_name) AND NOT list_contains(gs, p_type) THEN list_append(taken, p_partkey) ELSE taken END FROM a JOIN r ON r.p_brand = a.p_brand AND r.n = a.n + 1),
b AS (SELECT p_brand, 0::bigint AS n, arg_max(cs, n) AS cs, arg_max(taken, n) AS taken FROM a GROUP BY 1
  UNION ALL SELECT b.p_brand, r.n, CASE WHEN len(taken) < 5 AND NOT list_contains(cs, p_name) THEN list_append(cs, p_name) ELSE cs END, CASE WHEN len(taken) < 5 AND NOT list_contains(cs, p_name) THEN list_append(taken, p_partkey) ELSE taken END FROM b JOIN r ON r.p_brand = b.p_brand AND r.n = b.n + 1),
c AS (SELECT p_brand, arg_max(taken, n) AS taken FROM b GROUP BY 1), d AS (SELECT unnest(taken) AS p_partkey, generate_subscripts(taken, 1) AS choice FROM c)
SELECT p_partkey, p_brand, p_name, p_type, fit, choice FROM d JOIN r USING (p_partkey)""")
def op_w06_diversify(t):
    rows = t("part").select("p_partkey", "p_brand", "p_name", "p_type", (F.col("p_size") * 2).alias("fit"))
    return sales.diversified(rows, "p_brand", "p_name", "p_type", ["-fit", "p_partkey"], 5)


@probe("""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50),
l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ',') AS top3 FROM orders GROUP BY 1)
SELECT r.o_orderkey, r.place, l.latest, l.top3 FROM r JOIN l USING (o_custkey)""")
def op_o01_rank(t):
    orders = t("orders")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # the report's top 50
    top = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))
    three = rel.top_k(orders, ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    best = three.groupBy("o_custkey").agg(F.array_join(ranked, ",").alias("top3"))
    latest = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return top.join(best, "o_custkey").join(latest, "o_custkey").select("o_orderkey", "place", "latest", "top3")


@probe(f"""
WITH p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS item FROM part), q AS (SELECT p_partkey, item || CASE WHEN p_partkey % 5 = 0 THEN ' bread cake' WHEN p_partkey % 5 = 1 THEN ' tea' WHEN p_partkey % 5 = 2 THEN ' milk tea' ELSE '' END AS item FROM p),
g AS (SELECT p_partkey, item, list_reverse_sort(list_filter({sql_groups(R.GROUPS, 'item')}, lambda v: v IS NOT NULL)) AS s FROM q)
SELECT p_partkey, s[1].grp AS grp, s[1].matched AS matched, coalesce(s[1].points, 0)::int AS points FROM g""")
def op_r06_item_group(t):
    k = F.col("p_partkey") % 5
    item = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(k == 0, " bread cake").when(k == 1, " tea").when(k == 2, " milk tea").otherwise(""))
    rows = t("part").select("p_partkey", G.group_scores(item, R.GROUPS).alias("s"))
    return rows.select("p_partkey", "s.grp", "s.matched", F.coalesce("s.points", F.lit(0)).alias("points"))


def sql_intent(supplier: str) -> str:
    """A supplier's rank by the tables of rules.py."""
    rank = ("NONE", "LOW", "MEDIUM", "HIGH").index
    own = " ".join(f"WHEN '{g}' THEN {rank(bands[supplier])}" for g, bands in R.INTENT_GROUP.items() if supplier in bands)
    by = " ".join(f"WHEN '{s}' THEN {moves[supplier]}" for s, moves in R.INTENT_SHIFT.items() if supplier in moves)
    return f"least(3, greatest(0, CASE g {own} ELSE {rank(R.INTENT_DEFAULT[supplier])} END + CASE s {by} ELSE 0 END)) AS {supplier}"


INTENT_SQL = f"""
WITH p AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'bakery' WHEN 'LARGE' THEN 'drink' WHEN 'SMALL' THEN 'sauce' END AS g, CASE p_size % 5 WHEN 0 THEN 'pre_launch' WHEN 1 THEN 'early_launch' WHEN 2 THEN 'scaling' WHEN 3 THEN 'established' ELSE 'unknown' END AS s FROM part),
c AS (SELECT p_partkey, {', '.join(map(sql_intent, R.SUPPLIERS))} FROM p)
SELECT p_partkey, {', '.join(f"['NONE', 'LOW', 'MEDIUM', 'HIGH'][{s} + 1] AS {s}" for s in R.SUPPLIERS)},
  array_to_string(list_transform(list_sort(list_filter([{', '.join(f"{{'r': -{s}, 'i': {i}, 'k': '{s}'}}" for i, s in enumerate(R.SUPPLIERS))}], lambda x: x.r <= -2))[1:3], lambda x: x.k), ',') AS top FROM c"""


@probe(INTENT_SQL)
def op_r20_intent(t):
    return suppliers(launches_of(t).withColumn("m", scoring.intent(F.col("g"), F.col("s"))))


@probe(INTENT_SQL)
def op_r20_rule_tables(t):
    return suppliers(rulebook.shipped().with_intents(launches_of(t), "g", "s", "m"))


def launches_of(t):
    kind, size = F.col("p_type"), F.col("p_size") % 5
    group = F.when(kind == "PROMO", "bakery").when(kind == "LARGE", "drink").when(kind == "SMALL", "sauce")
    stage = F.when(size == 0, "pre_launch").when(size == 1, "early_launch").when(size == 2, "scaling").when(size == 3, "established").otherwise("unknown")
    return t("part").select("p_partkey", group.alias("g"), stage.alias("s"))


def suppliers(rows):
    return rows.select("p_partkey", *[F.col("m")[s].alias(s) for s in R.SUPPLIERS], F.array_join(scoring.top_intents(F.col("m")), ",").alias("top"))


@probe("""
WITH s AS (SELECT p_partkey, p_size % 9 AS product, p_partkey % 8 AS service, p_size, p_size % 4 AS food, p_partkey % 3 AS hospitality, p_partkey % 5 AS other, p_type = 'PROMO' AS makes, p_type = 'SMALL' AS idle FROM part)
SELECT p_partkey, CASE WHEN other > 0 AND food > 0 AND other / (food + other) >= 0.5 AND NOT makes THEN 'NON_PRODUCT' WHEN product >= 4 AND service = 0 THEN 'PACKAGED_PRODUCT' WHEN product >= 4 AND product - service >= 1 THEN 'MIXED_BUT_PRODUCT_RELEVANT'
    WHEN service > product AND idle AND hospitality = 0 THEN 'NON_PRODUCT' WHEN service > product AND (hospitality > 0 OR idle) THEN 'FOOD_SERVICE' ELSE 'UNCERTAIN' END AS mode,
  round_even(least(product, 3) * (30 * 7 / 10.0::double) + service + (p_size * 2) * 0.035::double, 2)::double AS fit FROM s""")
def op_r08_mode(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    product, service, food, other = size % 9, k % 8, size % 4, k % 5
    sic = F.when(F.col("p_type") == "PROMO", F.array(F.lit("10710"))).when(F.col("p_type") == "SMALL", F.array(F.lit("64209"))).otherwise(F.array().cast("array<string>"))
    mode = scoring.commercial_mode(product, service, sic=sic, food=food, hospitality=k % 3, non_food=other, non_food_share=V.share(other, food + other))
    fit = sales.fit_score(F.least(product, F.lit(3)), 30, 7, service, size * 2)
    return t("part").select("p_partkey", mode.alias("mode"), fit.alias("fit"))


@probe("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS allowed, [ts] AS log FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END FROM (SELECT e.user_id, e.event_id, e.n, e.ts, list_filter(r.log, lambda x: e.ts - x < INTERVAL 86400 SECOND) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, allowed FROM r""")
def op_t06_limiter(t):
    return sales.limiter(t("events"), "user_id", "ts", 3, 86400, "event_id")
