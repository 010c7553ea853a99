"""Text, date, number, array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions import values as V
from ..operators import goods
from ..operators import relational as rel
from .registry import probe

FORMS = "|".join(X.LEGAL_FORMS)
#: Normalised text in DuckDB's SQL.
NORM = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce({0}, ''))), '&', ' and '), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"


def sql_norm(c: str) -> str:
    return NORM.format(c)


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_hits(words, c: str) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::int" for w in words) + ")"


@probe(f"""
SELECT s_suppkey AS id, {sql_norm("'The ' || s_name || ' & Sons Ltd'")} AS normal,
  regexp_replace(regexp_replace({sql_norm("'The ' || s_name || ' & Sons Ltd'")}, '( ?\\b({FORMS}))+$', ''), '^(the )+', '') AS company,
  replace(regexp_replace(regexp_replace({sql_norm("'The ' || s_name || ' & Sons Ltd'")}, '( ?\\b({FORMS}))+$', ''), '^(the )+', ''), ' ', '') AS name_key
FROM supplier
UNION ALL
SELECT c_custkey + 1000000, {sql_norm("c_name || ' Co. PLC'")},
  regexp_replace(regexp_replace({sql_norm("c_name || ' Co. PLC'")}, '( ?\\b({FORMS}))+$', ''), '^(the )+', ''),
  replace(regexp_replace(regexp_replace({sql_norm("c_name || ' Co. PLC'")}, '( ?\\b({FORMS}))+$', ''), '^(the )+', ''), ' ', '')
FROM customer""")
def op_x02_normalise_name(t):
    a = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("The "), "s_name", F.lit(" & Sons Ltd")).alias("name"))
    b = t("customer").select((F.col("c_custkey") + 1000000).alias("id"), F.concat("c_name", F.lit(" Co. PLC")).alias("name"))
    return a.unionByName(b).select("id", X.normalise("name").alias("normal"), X.company_name("name").alias("company"), X.name_key("name").alias("name_key"))


@probe(f"SELECT doc_id, md5({sql_norm('text')}) AS normal_md5, length({sql_norm('text')}) AS n FROM documents")
def op_x01_strip_accents(t):
    n = X.normalise("text")
    return t("documents").select("doc_id", F.md5(n.cast("binary")).alias("normal_md5"), F.length(n).cast("long").alias("n"))


@probe("""
WITH a AS (SELECT p_brand, p_name, min(p_partkey) AS k, list_distinct(string_split(p_name, ' ')) AS w FROM part GROUP BY p_brand, p_name),
p AS (SELECT a.p_brand, a.k AS a, b.k AS b, a.w AS x, b.w AS y FROM a JOIN a b ON a.p_brand = b.p_brand AND a.k < b.k WHERE list_has_any(a.w, b.w))
SELECT p_brand, a, b, len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) AS jaccard,
  len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS within,
  (len(list_distinct(list_concat(x, y))) - len(list_intersect(x, y)))::int AS n_missing,
  len(list_filter(x, lambda v: length(v) > 3))::int AS n_long
FROM p""")
def op_x07_jaccard(t):
    a = t("part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k")).withColumn("w", X.tokens(F.col("p_name"))).select("p_brand", "k", "w")
    b = a.select("p_brand", F.col("k").alias("b"), F.col("w").alias("y"))
    pairs = rel.sharing(a, b, ["p_brand"], F.col("w"), F.col("y")).where("k < b")
    return pairs.select("p_brand", F.col("k").alias("a"), "b", X.jaccard(F.col("w"), F.col("y")).alias("jaccard"), X.subset(F.col("w"), F.col("y"), False).alias("within"), F.size(X.missing(F.col("w"), F.col("y"))).alias("n_missing"), F.size(F.filter("w", lambda v: F.length(v) > 3)).alias("n_long"))


@probe(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 220 THEN x ELSE regexp_replace(x[1:220], ' [^ ]*$', '') || '…' END AS summary,
  list_last(string_split(CASE WHEN length(x) <= 220 THEN x ELSE regexp_replace(x[1:220], ' [^ ]*$', '') || '…' END, ' ')) AS head
FROM f""")
def op_x12_summarise(t):
    s = X.summarise("text")
    return t("documents").select("doc_id", s.alias("summary"), X.head_noun(s).alias("head"))


@probe(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path']) AS p FROM pages),
v AS (SELECT page_id, p.scheme AS scheme, p.host AS host, list_filter(string_split(p.path, '/'), lambda x: x <> '') AS parts FROM u)
SELECT page_id, regexp_replace(lower(host), '^www\.', '') AS domain, scheme || '://' || host AS root, len(parts)::int AS depth,
  (len(parts) > 1 OR list_has_any(parts, ['news', 'blog', 'article', 'story', 'press'])) AS article FROM v""")
def op_x13_url_parts(t):
    url = F.col("url")
    return t("pages").select("page_id", X.domain(url).alias("domain"), X.site_root(url).alias("root"), F.size(X.path_parts(url)).alias("depth"), X.is_article(url).alias("article"))


MARKS = ("eau", "and", "ich", "que", "the")


@probe("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'eau') THEN 'eau' WHEN contains(lower(text), 'and') THEN 'and' WHEN contains(lower(text), 'ich') THEN 'ich' WHEN contains(lower(text), 'que') THEN 'que' WHEN contains(lower(text), 'the') THEN 'the' END AS marker,
  lower(concat_ws(' ', nullif(role, ''), nullif(text, ''))) AS searchable
FROM conversations""")
def op_x22_first_marker(t):
    return t("conversations").select("conv_id", "turn", X.first_of(MARKS, F.lower("text")).alias("marker"), X.searchable(F.col("role"), F.col("text")).alias("searchable"))


@probe("""
SELECT o_orderkey, strftime(f, '%Y-%m-%d') AS friday, printf('%04d-%03d', year(f), ceil(dayofyear(f) / 7.0)::int) AS batch,
  strftime(f, '%Y-%m-%d') AS back, strftime(f + INTERVAL 7 DAY, '%Y-%m-%d') AS following
FROM (SELECT o_orderkey, (o_orderdate::date - ((isodow(o_orderdate) + 2) % 7)::int) AS f FROM orders)""")
def op_d04_batch_number(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", D.last_friday(d).cast("string").alias("friday"), D.batch_number(d).alias("batch"), D.batch_date(D.batch_number(d)).cast("string").alias("back"), D.next_friday(D.last_friday(d)).cast("string").alias("following"))


@probe("""
WITH l AS (SELECT l_orderkey, min(l_shipdate)::date AS ship FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey, o_orderdate::date AS o, ship, round_even((ship - o_orderdate::date) / 365.25, 2)::double + 0.0 AS age FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, age, CASE WHEN age < 0 THEN 0.0 ELSE age END::double AS clamped, round_even(CASE WHEN age < 0 THEN 0.0 ELSE age END * 12, 0)::int AS months,
  ((year(ship) * 12 + month(ship)) - (year(o) * 12 + month(o)))::int AS calendar, (ship - o) >= 7 AS due, (ship - o) > 21 AS stale FROM a""")
def op_d07_age(t):
    ship = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("ship"))
    rows = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o")).join(ship, F.col("l_orderkey") == F.col("o_orderkey"))
    age = D.age_years(F.col("o"), F.col("ship"))
    clamped = D.clamped_age(age)
    return rows.select("o_orderkey", age.alias("age"), clamped.alias("clamped"), F.bround(clamped * 12, 0).cast("int").alias("months"), D.calendar_months(F.col("o"), F.col("ship")).alias("calendar"), D.is_due(F.col("o"), F.col("ship")).alias("due"), D.is_stale(F.col("o"), F.col("ship")).alias("stale"))


@probe("""
SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, round_even(l_quantity / 8, 0)::double AS half_even, least(greatest(l_quantity, 5), 40)::double AS clamped,
  floor(l_discount * 600)::int AS cut, ceil(l_quantity / 7)::bigint AS packs, greatest(l_quantity / 20, 20 / greatest(l_quantity, 1))::double AS apart FROM lineitem""")
def op_m01_half_even(t):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", F.bround(q / 8, 0).alias("half_even"), V.clamp(q, 5.0, 40.0).alias("clamped"), F.floor(F.col("l_discount") * 600).cast("int").alias("cut"), V.ceil_div(q, F.lit(7)).alias("packs"), V.spread(q, F.lit(20.0)).alias("apart")).distinct()


@probe("""
WITH c AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(c, ',') AS classes, len(list_filter(c, lambda x: x NOT IN (1, 2, 3))) = 0 AS only_low, list_has_any(c, [6, 7]) AS any_high,
  array_to_string(list_filter(list_transform(c, lambda x: x::varchar), lambda x: starts_with(x, '1') OR starts_with(x, '4'))[1:3], ',') AS prefixed,
  len(list_filter(list_transform(c, lambda x: x::varchar), lambda x: NOT (starts_with(x, '1') OR starts_with(x, '2')))) = 0 AS all_prefixed FROM c""")
def op_c01_class_array(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(V.class_list(F.array_join(F.collect_set(F.col("l_linenumber").cast("string")), ", ")).alias("c"))
    codes = F.transform("c", lambda x: x.cast("string"))
    return rows.select("l_orderkey", F.array_join(codes, ",").alias("classes"), V.all_in(F.col("c"), [1, 2, 3]).alias("only_low"), V.any_in(F.col("c"), [6, 7]).alias("any_high"), V.with_prefix(codes, ["1", "4"]).alias("prefixed"), V.all_with_prefix(codes, ["1", "2"]).alias("all_prefixed"))


@probe("""
SELECT event_id, (props->>'$.k')::int AS k, coalesce(props->>'$.missing', 'none') AS missing, coalesce((props->>'$.k')::int BETWEEN 10 AND 90, false) AS in_range,
  CASE WHEN (props->>'$.k')::int >= 75 THEN 'HIGH' WHEN (props->>'$.k')::int >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events""")
def op_k04_json_props(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t("events").select("event_id", k.alias("k"), V.json_field(F.col("props"), "$.missing", "none").alias("missing"), F.coalesce(k.between(10, 90), F.lit(False)).alias("in_range"), F.when(k >= 75, "HIGH").when(k >= 50, "MEDIUM").otherwise("LOW").alias("band"))


@probe("""
WITH a AS (SELECT event_id, (props->>'$.k')::int AS k, value FROM events)
SELECT event_id, CASE WHEN k BETWEEN 5 AND 95 THEN round_even((k / 100.0::double + CASE WHEN value < 10 THEN 0.25 ELSE 0.75 END::double) / 2, 3)::double ELSE CASE WHEN value < 10 THEN 0.25 ELSE 0.75 END::double END AS probability,
  k NOT BETWEEN 5 AND 95 AS rule_only FROM a""")
def op_r26_merge(t):
    answer = F.concat(F.lit('ok {"category": "x", "is_product": true, "probability": '), (F.get_json_object("props", "$.k").cast("int") / 100).cast("string"), F.lit("}"))
    judged = V.valid_judgement(answer, ("x",))["probability"]
    rule = F.when(F.col("value") < 10, 0.25).otherwise(0.75)
    probability, alone = V.merged(rule, judged, 0.05, 0.95)
    return t("events").select("event_id", probability.alias("probability"), alone.alias("rule_only"))


ITEM = "list_filter(list_transform(regexp_split_to_array(text, '[;.]'), lambda p: " + sql_norm(r"regexp_replace(p, '[\[(][^\])]*[\])]', ' ', 'g')") + "), lambda p: p <> '')"


@probe(f"""
WITH i AS (SELECT doc_id, unnest({ITEM}) AS item, generate_subscripts({ITEM}, 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::int AS pos, md5(item) AS item_md5, list_last(string_split(item, ' ')) AS head FROM i""")
def op_c05_goods_items(t):
    rows = t("documents").select("doc_id", F.posexplode(goods.item_texts(F.col("text"))).alias("pos", "item"))
    return rows.select("doc_id", "pos", F.md5(F.col("item").cast("binary")).alias("item_md5"), X.head_noun(F.col("item")).alias("head"))
