"""Lookups, matches, anti-joins and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consolidate as C
from ..operators import evidence as E
from ..operators import matching as M
from ..operators import relational as rel
from ..operators import history, similar
from ..operators import sales
from ..session import run_dir
from .registry import probe

#: The rungs of a name's score in SQL, over token lists x and y and names a and b without legal forms.
LADDER = """CASE WHEN a = b THEN 98 WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 92 WHEN len(x) = 0 OR len(y) = 0 THEN 0
  WHEN xy = len(x) AND xy = len(y) THEN 88 WHEN xy = len(x) OR xy = len(y) THEN CASE WHEN j >= 0.6 THEN 78 ELSE floor(j * 60)::int END
  WHEN j >= 0.7 THEN 78 WHEN j >= 0.5 THEN 55 ELSE floor(j * 60)::int END"""


#: Customers of nations 20 and up have a longer first word, so that suppliers of these find no equal key and look by its beginning.
RIGHT_KEY = "CASE WHEN c_nationkey >= 20 THEN 'nation' || c_nationkey || 'th group' ELSE 'nation' || c_nationkey END"


@probe(f"""
WITH s AS (SELECT s_suppkey, 'nation' || s_nationkey AS k FROM supplier), c AS (SELECT c_custkey, {RIGHT_KEY} AS k FROM customer),
e AS (SELECT s_suppkey, c_custkey, c.k, 'exact' AS method FROM s JOIN c ON s.k = c.k),
p AS (SELECT s_suppkey, c_custkey, c.k, 'prefix' AS method FROM s JOIN c ON starts_with(c.k, s.k) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM e)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY k, c_custkey) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM p))
SELECT s_suppkey, c_custkey, method FROM r WHERE r <= 25""")
def op_j01_blocked_lookup(t):
    left = t("supplier").select("s_suppkey", F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("left_name"))
    nation = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    right = t("customer").select("c_custkey", F.when(F.col("c_nationkey") >= 20, F.concat(nation, F.lit("th group"))).otherwise(nation).alias("name"))
    return rel.blocked_lookup(left, right, "s_suppkey", F.col("left_name"), F.col("name"), ["c_custkey"]).select("s_suppkey", "c_custkey", "method")


@probe(f"""
WITH n AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY 1, 2),
p AS (SELECT l.k AS p_partkey, r.k AS other, l.p_name AS a, r.p_name AS b, list_distinct(string_split(l.p_name, ' ')) AS x, list_distinct(string_split(r.p_name, ' ')) AS y FROM n l JOIN n r ON l.p_brand = r.p_brand AND l.k <> r.k WHERE list_has_any(string_split(l.p_name, ' '), string_split(r.p_name, ' '))),
s AS (SELECT *, len(list_intersect(x, y)) AS xy, len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) AS j FROM p),
t AS (SELECT p_partkey, other, {LADDER} AS score FROM s),
u AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS runner_up FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, other)),
v AS (SELECT p_partkey, other, score::int AS score, runner_up::int AS runner_up, (runner_up IS NOT NULL AND score - runner_up < 5 AND score < 98) AS ambiguous FROM u WHERE r = 1)
SELECT p_partkey, other, score, runner_up, ambiguous, (score - CASE WHEN ambiguous THEN 15 ELSE 0 END)::int AS confidence FROM v WHERE score - CASE WHEN ambiguous THEN 15 ELSE 0 END >= 5""")
def op_j04_best_match(t):
    names = t("part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).withColumn("a", M.name_parts("p_name"))
    others = names.select("p_brand", F.col("a").alias("b"), F.col("p_partkey").alias("other"))
    pairs = rel.sharing(names, others, ["p_brand"], F.col("a.tokens"), F.col("b.tokens")).where("p_partkey <> other")
    scored = pairs.withColumn("score", M.ladder(F.col("a"), F.col("b")))
    return rel.best_match(scored, "p_partkey", "score", "other", least=5).select("p_partkey", "other", "score", "runner_up", "ambiguous", "confidence")


@probe("""
WITH d AS (SELECT DISTINCT o_custkey FROM orders), m AS (SELECT o_custkey, n_name FROM d JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT o_orderkey, n_name FROM orders LEFT JOIN m USING (o_custkey)""")
def op_j05_distinct_match(t):
    names = t("orders").select("o_custkey").distinct().join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return t("orders").join(names.select("o_custkey", "n_name"), "o_custkey", "left").select("o_orderkey", "n_name")


@probe("""
WITH r AS (SELECT l.doc_id, d.source, quality, row_number() OVER (PARTITION BY d.source ORDER BY quality DESC, n_chars DESC, l.doc_id) AS r FROM labels l JOIN documents d USING (doc_id))
SELECT source, array_to_string(list(doc_id ORDER BY r), ',') AS docs, count(*) AS n FROM r WHERE r <= 8 GROUP BY 1""")
def op_j06_evidence_topk(t):
    rows = t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id")
    top = rel.top_k(rows, ["source"], 8, F.desc("quality"), F.desc("n_chars"), "doc_id")
    order = F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), (-F.col("n_chars")).alias("c"), "doc_id")))
    return top.groupBy("source").agg(F.array_join(F.transform(order, lambda x: x["doc_id"].cast("string")), ",").alias("docs"), F.count("*").alias("n"))


@probe(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages)
SELECT page_id, domain, CASE WHEN domain = 'example.net' OR ends_with(domain, '.example.net') THEN 'marketplace' WHEN domain = 'example.org' OR ends_with(domain, '.example.org') THEN 'press' ELSE 'own' END AS domain_class FROM h""")
def op_j08_suffix_class(t):
    pages = t("pages").select("page_id", X.domain(F.col("url")).alias("domain"))
    classes = (("marketplace", ("example.net",)), ("press", ("example.org",)))
    return E.classified(pages, classes=classes).select("page_id", "domain", "domain_class")


@probe("""
SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, date_trunc('week', o_orderdate) = min(date_trunc('week', o_orderdate)) OVER (PARTITION BY o_custkey) AS first_seen FROM orders""")
def op_j09_first_seen(t):
    rows = t("orders").withColumn("week", F.date_trunc("week", "o_orderdate").cast("date"))
    return rel.first_seen(rows, "o_custkey", "week").select("o_orderkey", F.col("week").cast("string").alias("week"), "first_seen")


@probe("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)""")
def op_j19_anti(t):
    year = t("orders").where("o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.not_in(t("customer"), year, ["c_custkey"]).select("c_custkey", "c_name")


@probe("""
WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT *, CASE p_brand WHEN 'Brand#1' THEN 'bakery' WHEN 'Brand#2' THEN 'dairy' WHEN 'Brand#3' THEN 'drink' WHEN 'Brand#4' THEN 'snack' END AS grp FROM b)
SELECT l_orderkey, min_by(grp, (l_linenumber, p_brand)) AS grp FROM m WHERE grp IS NOT NULL GROUP BY 1""")
def op_j11_first_mapping(t):
    parts = t("part")
    table = parts.sparkSession.createDataFrame([("Brand#1", "bakery"), ("Brand#2", "dairy"), ("Brand#3", "drink"), ("Brand#4", "snack")], "p_brand string, grp string")
    rows = t("lineitem").join(parts.join(F.broadcast(table), "p_brand").select("p_partkey", "p_brand", "grp"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("l_orderkey").agg(F.min_by("grp", F.struct("l_linenumber", "p_brand")).alias("grp"))


@probe("""
WITH p(recipient, least, segments, balance) AS (VALUES (1, 'HIGH', ['BUILDING'], 0), (2, 'MEDIUM', []::varchar[], 5000), (3, 'LOW', ['AUTOMOBILE', 'FURNITURE'], 0)),
i AS (SELECT o_orderkey, c_mktsegment, c_nationkey, CASE WHEN o_totalprice >= 400000 THEN 'HIGH' WHEN o_totalprice >= 250000 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT recipient, band, count(*) AS n, sum(o_orderkey)::bigint AS s FROM i JOIN p ON list_position(['LOW', 'MEDIUM', 'HIGH'], band) >= list_position(['LOW', 'MEDIUM', 'HIGH'], least) AND (len(segments) = 0 OR list_contains(segments, c_mktsegment)) AND (balance = 0 OR c_nationkey IN (1, 2, 3)) GROUP BY 1, 2""")
def op_f22_preference(t):
    orders = t("orders")
    wants = orders.sparkSession.createDataFrame([(1, "HIGH", ["BUILDING"], []), (2, "MEDIUM", [], [1, 2, 3]), (3, "LOW", ["AUTOMOBILE", "FURNITURE"], [])], "recipient int, least_band string, categories array<string>, regions array<int>")
    price = F.col("o_totalprice")
    items = orders.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("band", F.when(price >= 400000, "HIGH").when(price >= 250000, "MEDIUM").otherwise("LOW"))
    return sales.preferred(items, F.broadcast(wants), "band", "c_mktsegment", "c_nationkey").groupBy("recipient", "band").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@probe("""
SELECT c_custkey, coalesce(max(o_orderdate)::date::varchar, 'never') AS latest, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 4900 WHEN 'MACHINERY' THEN 9900 END, 0)::int AS price
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def op_j20_overlay(t):
    state = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").cast("string").alias("latest"))
    customers = t("customer").select("c_custkey", "c_mktsegment")
    prices = customers.sparkSession.createDataFrame([("BUILDING", 4900), ("MACHINERY", 9900)], "c_mktsegment string, price int")
    rows = sales.overlaid(sales.overlaid(customers, state, "c_custkey", {"latest": "never"}), prices, "c_mktsegment", {"price": 0})
    return rows.select("c_custkey", "latest", "price")


@probe("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'key' WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 500) THEN 'nation' END AS blocked_by FROM customer""")
def op_j21_suppress(t):
    supplier = t("supplier")
    return rel.blocked(t("customer"), [("key", supplier.select(F.col("s_suppkey").alias("c_custkey")), "c_custkey"), ("nation", supplier.where("s_acctbal < 500").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey")]).select("c_custkey", "blocked_by")


@probe(r"""
WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> ''))) AS x FROM documents),
c AS (SELECT min(doc_id) AS class, x, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
p AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.x, b.x)) AS shared, a.n + b.n AS n FROM c a JOIN c b ON a.class < b.class AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)),
l AS (SELECT unnest([a, b]) AS class FROM p WHERE 10 * shared >= 7 * (n - shared)), m AS (SELECT class, count(*) AS links FROM l GROUP BY class)
SELECT s.doc_id, c.class, coalesce(m.links, 0) AS links FROM s LEFT JOIN c ON s.x = c.x LEFT JOIN m ON c.class = m.class""")
def op_x07_similar(t):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    found = similar.similar_sets(t("documents"), "doc_id", words)
    return similar.linked(found).withColumnRenamed("id", "doc_id")


@probe(r"""
WITH k AS (SELECT doc_id, md5(text) AS t, md5(lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS h FROM documents), d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS a, min(doc_id) OVER (PARTITION BY h) AS b FROM k)
SELECT doc_id, CASE WHEN a < doc_id THEN a ELSE b END AS duplicate_of, CASE WHEN a < doc_id THEN 'text' ELSE 'letters' END AS why FROM d WHERE a < doc_id OR b < doc_id""")
def op_j22_duplicates(t):
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return rel.duplicates(t("documents"), "doc_id", {"text": F.md5(F.col("text").cast("binary")), "letters": F.md5(letters.cast("binary"))})


@probe("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_custkey, max(CASE WHEN r = 1 THEN o_orderkey END) AS o_orderkey, count(*) AS n_rows, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (r > 1)), ','), '') AS related, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM m GROUP BY 1""")
def op_a14_consolidate(t):
    rows = t("orders").withColumn("p", F.array("o_orderpriority"))
    found = C.consolidate(rows, "o_custkey", [F.desc("o_totalprice"), F.desc("o_orderdate"), F.desc("o_orderkey")], {"o_orderkey": "related"}, "p")
    return found.select("o_custkey", "o_orderkey", "n_rows", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"), F.array_join("all_p", ",").alias("priorities"))


@probe("""
WITH d AS (SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS r FROM events WHERE event_type <> 'error'), s AS (SELECT DISTINCT user_id, props FROM events WHERE event_type = 'error')
SELECT event_id, user_id FROM d ANTI JOIN s USING (user_id, props) WHERE r = 1""")
def op_t02_dedupe(t):
    events = t("events")
    return rel.insert_missing(events.where("event_type <> 'error'"), events.where("event_type = 'error'"), ["user_id", "props"], "event_id").select("event_id", "user_id")


@probe("""
SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1""")
def op_t04_state_fold(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@probe("SELECT event_id, user_id, first_seen FROM (SELECT event_id, user_id, event_type, ts::date = min(ts::date) OVER (PARTITION BY user_id) AS first_seen FROM events) WHERE event_type <> 'purchase'")
def op_j09_history(t):
    """Purchases are the history; the other events are the batch that meets it."""
    events = t("events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    spark, past = events.sparkSession, F.col("event_type") == "purchase"
    path = run_dir(spark, "history")
    name = history.opened(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, dict(events.dtypes)["user_id"], "date", 64)
    history.append(events.where(past), name, "user_id", "day")
    return history.first_seen(events.where(~past), name, "user_id", "day").select("event_id", "user_id", "first_seen")
