"""Verification, indicators, commercial mode, categories, prospects and matching, each through its operator."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import rulebook
from .. import rules as R
from ..functions import dates as D
from ..functions import text as X
from ..functions import values as V
from ..operators import evidence as E
from ..operators import goods as G
from ..operators import matching as M
from ..operators import prospects as P
from ..operators import relational as rel
from ..operators import reports, sales
from ..operators import scoring as S
from ..operators import verification as VE
from ..streaming import stateful
from .registry import probe
from .scalars import FORMS, sql_list, sql_norm

COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)


def sql_any(words, c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def sql_lead(name: str, words: str) -> str:
    lead = f"string_split({name}, ' ')[1]"
    return f"(length({lead}) >= 8 AND {lead} NOT IN ({COMMON}) AND contains(' ' || {words} || ' ', ' ' || {lead} || ' '))"


def sql_company(words: str) -> str:
    return f"(legal <> '' AND legal <> brand AND (contains({words}, legal) OR {sql_lead('legal', words)}))"


def evidence_of(t):
    """Pages read as search results of filings, eight for each, which are named after their first page's domain and title. The
    snippet is the page's text; some pages say a phrase more. Two of three stand for their site's first page or a page below it."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    k = F.col("page_id") % 7
    short = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.when(F.col("page_id") % 3 == 1, F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[a-z]*)", 1)).otherwise("/"))
    url = F.when(F.col("page_id") % 3 == 2, F.col("url")).otherwise(short)
    says = F.when(k == 2, " Coming soon. Add to basket.").when(k == 3, " A household name, sold worldwide.").when(k == 5, " Our story.").otherwise("")
    pages = t("pages").select(F.floor(F.col("page_id") / 8).alias("filing"), F.col("page_id").alias("rank"), url.alias("url"), title.alias("title"), F.concat(F.regexp_replace("html", "<[^>]*>", " "), says).alias("snippet"))
    pages = pages.withColumn("domain", X.domain(F.col("url")))
    first = F.min_by(F.struct(F.split("domain", r"\.")[0].alias("brand"), F.array_join(F.slice(F.split(X.normalise("title"), " "), 1, 2), " ").alias("company")), "rank")
    filings = pages.groupBy("filing").agg(first.alias("x")).select("filing", "x.*")
    known = VE.contexts(filings, "filing", F.col("brand"), F.col("company"), F.lit(None).cast("string"), [F.lit("England")], F.array().cast("array<string>"))
    return VE.pages(E.classified(pages, classes=(("press", ("example.org",)), ("retailer", ("example.net",)))), known, "filing")


EVIDENCE_SQL = rf"""
u AS (SELECT page_id, html, CASE page_id % 3 WHEN 2 THEN url WHEN 1 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*(/[a-z]*)', 1) ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' END AS url FROM pages),
p AS (SELECT page_id // 8 AS filing, page_id AS rank, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    regexp_replace(html, '<[^>]*>', ' ', 'g') || CASE page_id % 7 WHEN 2 THEN ' Coming soon. Add to basket.' WHEN 3 THEN ' A household name, sold worldwide.' WHEN 5 THEN ' Our story.' ELSE '' END AS snippet,
    list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM u),
w AS (SELECT *, {sql_norm("title || ' ' || snippet")} AS words, {sql_norm('title')} AS head, string_split(domain, '.')[1] AS stem FROM p),
c AS (SELECT filing, {sql_norm('arg_min(stem, rank)')} AS brand, regexp_replace(regexp_replace(arg_min(array_to_string(string_split(head, ' ')[1:2], ' '), rank), '( ?\b({FORMS}))+$', ''), '^(the )+', '') AS legal FROM w GROUP BY 1),
r AS (SELECT w.*, brand, legal, brand <> '' AND contains(words, brand) AS named, {sql_company('words')} AS company FROM w JOIN c USING (filing)),
d AS (SELECT filing, domain, any_value(url) AS url, any_value(brand) AS brand, any_value(legal) AS legal, any_value(stem) AS stem, count(*) AS pages, min(rank) AS first, {sql_norm("string_agg(title || ' ' || snippet, ' ' ORDER BY rank)")} AS a, {sql_norm("string_agg(title, ' ' ORDER BY rank)")} AS heads
    FROM r WHERE NOT ends_with(domain, 'example.org') AND NOT ends_with(domain, 'example.net') AND len(path) < 2 AND NOT list_has_any(path, {sql_list(X.ARTICLE_MARKS)}) GROUP BY 1, 2),
o AS (SELECT d.*, stem = replace(brand, ' ', '') AS exact, EXISTS (SELECT 1 FROM r WHERE r.filing = d.filing AND r.domain <> d.domain AND r.named AND r.company) AS third FROM d),
s AS (SELECT *, list_filter([CASE WHEN exact THEN 'exact_domain_brand_match' END, CASE WHEN NOT exact AND (contains(stem, replace(brand, ' ', '')) OR (length(stem) > 3 AND contains(replace(brand, ' ', ''), stem))) THEN 'partial_domain_brand_match' END,
    CASE WHEN contains(heads, brand) THEN 'brand_in_title' END, CASE WHEN {sql_company('a')} THEN 'company_name_match' END, CASE WHEN {sql_any(R.SECTOR_WORDS, 'a')} THEN 'sector_match' END,
    CASE WHEN pages > 1 THEN 'multiple_pages_same_domain' END, CASE WHEN third THEN 'third_party_corroboration' END], lambda x: x IS NOT NULL) AS keys FROM o),
k AS (SELECT *, coalesce(list_sum(list_transform(keys, lambda x: CASE WHEN x IN ('company_name_match', 'exact_domain_brand_match') THEN 3 WHEN x = 'third_party_corroboration' THEN 2 ELSE 1 END)), 0)::int AS weight FROM s),
q AS (SELECT *, weight >= 4 AND list_has_any(keys, {sql_list(R.BRAND_LINKS)}) AND (list_has_any(keys, {sql_list(R.COMPANY_TIES)}) OR (length(brand) >= 8 AND brand NOT IN ({COMMON}) AND exact AND list_contains(keys, 'sector_match'))) AS ok FROM k),
v AS (SELECT filing, count(*) FILTER (ok) AS qualifying, max(weight) AS best, max_by(domain, (weight, pages, -first, domain)) AS best_domain, max_by(domain, (weight, pages, -first, domain)) FILTER (ok) AS one FROM q GROUP BY 1)"""


@probe(f"""
WITH {EVIDENCE_SQL}
SELECT filing, domain, weight, pages, array_to_string(list_sort(keys), ',') AS keys, ok FROM q""")
def op_r09_signals(t):
    found = VE.candidates(evidence_of(t), "filing")
    return found.select("filing", "domain", "weight", "pages", F.array_join(F.array_sort("keys"), ",").alias("keys"), VE.qualifies().alias("ok"))


@probe(f"""
WITH {EVIDENCE_SQL}
SELECT filing, qualifying, best, best_domain, CASE WHEN qualifying > 1 THEN 'CONFLICTING' WHEN qualifying = 1 THEN 'VERIFIED' WHEN best >= 3 THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS verdict, CASE WHEN qualifying = 1 THEN one END AS website FROM v""")
def op_r12_verdicts(t):
    return VE.verdicts(VE.candidates(evidence_of(t), "filing"), "filing").select("filing", "qualifying", "best", "best_domain", "verdict", "website")


ABOUT_SQL = f"""
x AS (SELECT r.*, qualifying FROM r LEFT JOIN v USING (filing) WHERE (CASE WHEN qualifying = 1 THEN domain = one ELSE false END) OR (legal <> '' AND (contains(legal, ' ') OR (length(legal) >= 8 AND legal NOT IN ({COMMON}))) AND contains(words, legal))
  OR (brand <> '' AND (contains(words, brand)) AND (company OR (length(brand) >= 8 AND brand NOT IN ({COMMON}) AND {sql_any(R.SECTOR_WORDS, 'words')}))))"""


@probe(f"""
WITH {EVIDENCE_SQL},
{ABOUT_SQL}
SELECT filing, count(*) AS n, min(rank) AS first, count(DISTINCT CASE WHEN ends_with(domain, 'example.org') THEN url END) AS n_press FROM x GROUP BY 1""")
def op_r13_attribution(t):
    rows = evidence_of(t)
    about = VE.attributed(rows, VE.verdicts(VE.candidates(rows, "filing"), "filing"), "filing")
    seen = VE.footprint(about, "filing").select("filing", "n_press")
    return about.groupBy("filing").agg(F.count("*").alias("n"), F.min("rank").alias("first")).join(seen, "filing").select("filing", "n", "first", "n_press")


@probe(f"""
WITH {EVIDENCE_SQL}
SELECT q.filing, count(*) AS domains, sum(weight)::bigint AS weight, count(*) FILTER (third) AS corroborated, array_to_string(list_sort(list_distinct(flatten(list(keys)))), ',') AS ties FROM q GROUP BY 1""")
def op_a13_evidence(t):
    found = VE.candidates(evidence_of(t), "filing").groupBy("filing")
    ties = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))), ",")
    return found.agg(F.count("*").alias("domains"), F.sum("weight").alias("weight"), F.count("corroborated_by").alias("corroborated"), ties.alias("ties"))


@probe(f"""
WITH {EVIDENCE_SQL},
{ABOUT_SQL},
f AS (SELECT filing, coalesce(any_value(qualifying), 0) = 1 AS site, count(DISTINCT CASE WHEN ends_with(domain, 'example.net') THEN domain END)::int AS retailers, count(DISTINCT CASE WHEN ends_with(domain, 'example.org') THEN url END) AS press,
    {sql_norm("string_agg(title || ' ' || snippet, ' ' ORDER BY rank)")} AS ws, lower(string_agg(title || ' ' || snippet, ' ' ORDER BY rank)) AS low FROM x GROUP BY 1),
g AS (SELECT *, least(6, len(list_filter({sql_list(R.LAUNCH_PHRASES)}, lambda m: contains(ws, m))))::int AS launches, least(6, len(list_filter({sql_list(R.ESTABLISHED_PHRASES)}, lambda m: contains(ws, m))))::int AS phrases, {sql_any(R.SHOP_PHRASES, 'low')} AS sells FROM f),
h AS (SELECT *, list_filter([CASE WHEN retailers >= 2 THEN 'several retailers' END, CASE WHEN press >= 3 THEN 'press' END, CASE WHEN phrases >= 2 THEN 'heritage phrases' END, CASE WHEN retailers >= 1 AND phrases >= 1 THEN 'retailer and phrase' END], lambda x: x IS NOT NULL) AS why,
    CASE WHEN retailers > 0 OR phrases >= 2 THEN 'established' WHEN site AND (launches > 0 OR phrases = 0) THEN 'early_stage' ELSE 'unknown' END AS website, CASE WHEN retailers > 0 THEN 'multiple_retail' WHEN site AND sells THEN 'direct_only' WHEN site THEN 'none_found' ELSE 'unknown' END AS presence FROM g)
SELECT filing, retailers, press, phrases, launches, website, presence, CASE WHEN len(why) > 0 THEN 'established' WHEN launches > 0 OR site THEN 'emerging' ELSE 'unknown' END AS maturity, array_to_string(why, ',') AS why,
  CASE WHEN retailers > 0 OR website = 'established' THEN 'established' WHEN site THEN CASE WHEN sells THEN 'early_launch' WHEN launches > 0 THEN 'pre_launch' ELSE 'early_launch' END WHEN filing % 5 <= 2 THEN 'pre_launch' ELSE 'unknown' END AS stage FROM h""")
def op_r16_maturity(t):
    rows = evidence_of(t)
    verdicts = VE.verdicts(VE.candidates(rows, "filing"), "filing")
    found = VE.footprint(VE.attributed(rows, verdicts, "filing"), "filing").join(verdicts.select("filing", "site"), "filing", "left")
    known, site, age = F.lit(True), F.col("site"), (F.col("filing") % 5).cast("double")
    found = found.withColumns({"website": VE.website_maturity(known, site), "presence": VE.retail_presence(known, known, site)})
    maturity, why = VE.brand_maturity(known, site)
    stage = VE.launch_stage(known, known, site, F.col("website"), F.col("presence"), age)
    return found.select("filing", F.col("n_retailers").alias("retailers"), F.col("n_press").alias("press"), F.size("boasts").alias("phrases"), F.size("launches").alias("launches"), "website", "presence", maturity.alias("maturity"), F.coalesce(F.array_join(why, ","), F.lit("")).alias("why"), stage.alias("stage"))


def sql_prefixed(codes: str, kind: str) -> str:
    return f"list_filter({codes}, lambda c: list_has_any(list_transform({sql_list(R.SIC[kind])}, lambda p: starts_with(c, p)), [true]))"


CODES_SQL = "CASE p_type WHEN 'PROMO' THEN ['10710', '46370'] WHEN 'SMALL' THEN ['56101'] WHEN 'LARGE' THEN ['64209'] WHEN 'MEDIUM' THEN ['56101', '70100'] ELSE []::varchar[] END"


def codes():
    kind = F.col("p_type")
    some = lambda *c: F.array(*map(F.lit, c))
    return F.when(kind == "PROMO", some("10710", "46370")).when(kind == "SMALL", some("56101")).when(kind == "LARGE", some("64209")).when(kind == "MEDIUM", some("56101", "70100")).otherwise(F.array().cast("array<string>"))


@probe(f"""
WITH f AS (SELECT p_partkey, {CODES_SQL} AS sic, p_name || CASE WHEN p_size % 4 = 0 THEN ' in a jar' ELSE '' END AS goods, p_size % 15 AS food, p_size % 3 AS trade, p_partkey % 4 AS hospitality, p_partkey % 9 AS non_food, p_partkey % 2 = 0 AS has43,
    CASE WHEN p_partkey % 5 = 0 THEN 'see our menu' WHEN p_partkey % 5 = 1 THEN 'find stockists at 12 mill street' ELSE '' END AS web FROM part),
g AS (SELECT *, food + trade + hospitality + non_food AS items, coalesce(food / nullif(food + hospitality + non_food, 0), 0.0) AS food_share, coalesce(non_food / nullif(food + non_food, 0), 0.0) AS other_share, len({sql_prefixed('sic', 'manufacturing')}) AS m, len({sql_prefixed('sic', 'trade')}) AS t, len({sql_prefixed('sic', 'service')}) AS s, len({sql_prefixed('sic', 'non_operating')}) AS o FROM f),
p AS (SELECT *, (3 * (m > 0)::int + 2 * (t > 0)::int + 2 * contains(goods, 'jar')::int + 2 * (food_share >= 0.6)::int + (food >= 10)::int + (trade > 0)::int + 2 * contains(web, 'stockists')::int)::int AS product,
    (3 * (s > 0)::int + CASE WHEN len(sic) > 0 AND s + o = len(sic) THEN 2 WHEN o > 0 AND m = 0 AND t = 0 THEN 2 ELSE 0 END + 2 * (hospitality > 0)::int + 2 * (items > 0 AND hospitality / greatest(food + hospitality, 1) >= 0.25)::int + has43::int + 3 * (contains(web, 'menu') OR contains(web, '12 mill street'))::int)::int AS service FROM g)
SELECT p_partkey, product, service, CASE WHEN non_food > 0 AND food > 0 AND other_share >= 0.5 AND m = 0 AND t = 0 AND food < 12 THEN 'NON_PRODUCT' WHEN product >= 4 AND service = 0 THEN 'PACKAGED_PRODUCT' WHEN product >= 4 AND product - service >= 1 THEN 'MIXED_BUT_PRODUCT_RELEVANT'
  WHEN service > product AND (hospitality > 0 OR s > 0 OR o > 0) THEN CASE WHEN o > 0 AND s = 0 AND hospitality = 0 THEN 'NON_PRODUCT' ELSE 'FOOD_SERVICE' END ELSE 'UNCERTAIN' END AS mode FROM p""")
def op_r08_points(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    goods = F.concat("p_name", F.when(size % 4 == 0, " in a jar").otherwise(""))
    web = F.when(k % 5 == 0, "see our menu").when(k % 5 == 1, "find stockists at 12 mill street").otherwise("")
    rows = t("part").select("p_partkey", codes().alias("sic"), goods.alias("goods"), (size % 15).alias("food"), (size % 3).alias("trade"), (k % 4).alias("hospitality"), (k % 9).alias("non_food"), F.array(F.when(k % 2 == 0, 43).otherwise(30)).alias("classes"), web.alias("web"))
    food, hosp, other = F.col("food"), F.col("hospitality"), F.col("non_food")
    product, service = S.mode_points(sic=F.col("sic"), goods=F.col("goods"), classes=F.col("classes"), food=food, trade=F.col("trade"), hospitality=hosp, items=food + F.col("trade") + hosp + other, food_share=V.share(food, food + hosp + other), web=F.col("web"))
    rows = rows.withColumns({"product": product, "service": service})
    mode = S.commercial_mode(F.col("product"), F.col("service"), sic=F.col("sic"), food=food, hospitality=hosp, non_food=other, non_food_share=V.share(other, food + other))
    return rows.select("p_partkey", "product", "service", mode.alias("mode"))


@probe(f"""
WITH g AS (SELECT p_partkey, {CODES_SQL} AS sic, p_name || CASE WHEN p_size % 6 = 0 THEN ' tea' WHEN p_size % 6 = 1 THEN ' bakery' ELSE '' END AS brand FROM part),
h AS (SELECT *, string_split(brand, ' ') AS w FROM g)
SELECT p_partkey, CASE WHEN list_contains(sic, '10710') THEN 'bakery' {' '.join(f"WHEN list_has_any(w, {sql_list(ws)}) THEN '{g}'" for g, ws in R.BRAND_HINTS.items())} END AS category FROM h""")
def op_j12_category(t):
    brand = F.concat("p_name", F.when(F.col("p_size") % 6 == 0, " tea").when(F.col("p_size") % 6 == 1, " bakery").otherwise(""))
    return t("part").select("p_partkey", G.inferred_category(codes(), brand).alias("category"))


@probe("""
WITH c AS (SELECT l_orderkey, CASE l_shipmode WHEN 0 THEN 'bakery' WHEN 1 THEN 'dairy' WHEN 2 THEN 'snack' ELSE 'rest' END AS grp, count(*) AS n FROM (SELECT l_orderkey, l_partkey % 4 AS l_shipmode FROM lineitem) GROUP BY 1, 2),
o AS (SELECT l_orderkey, list(grp ORDER BY n DESC, grp) AS g, list(n ORDER BY n DESC, grp) AS n, sum(n) AS a FROM c GROUP BY 1),
s AS (SELECT *, coalesce(n[1] = n[2], false) OR n[1] / a < 0.4 AS several FROM o)
SELECT l_orderkey, CASE WHEN several THEN 'Several packaged-food categories: ' || array_to_string(list_transform(g[1:3], lambda x: CASE x WHEN 'snack' THEN 'snacks' ELSE x END), ', ') ELSE CASE g[1] WHEN 'bakery' THEN 'Bakery' WHEN 'dairy' THEN 'Dairy' WHEN 'snack' THEN 'Snacks' END END AS label,
  CASE g[1] WHEN 'rest' THEN NULL ELSE g[1] END AS back FROM s""")
def op_r04_category_label(t):
    k = F.col("l_partkey") % 4
    rows = t("lineitem").select("l_orderkey", F.when(k == 0, "bakery").when(k == 1, "dairy").when(k == 2, "snack").otherwise("rest").alias("grp"))
    found = G.dominant(rows, "l_orderkey")
    own = F.concat(F.lit(" "), F.upper(G.label_of(F.get("groups", F.lit(0)))))
    return found.select("l_orderkey", G.category_label(F.col("groups"), F.col("several")).alias("label"), G.group_of(own).alias("back"))


@probe(f"""
WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS classes, min(l_shipdate)::date AS ship FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, round_even((ship - o_orderdate::date) / 3.6525, 2)::double AS age, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS first, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS marks, coalesce(classes, []) AS classes,
    CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE 'x' END AS category, CASE c_mktsegment WHEN 'BUILDING' THEN ['10710'] WHEN 'AUTOMOBILE' THEN ['56101'] WHEN 'MACHINERY' THEN ['46370', '99999'] ELSE []::varchar[] END AS sic, 60 + o_custkey % 40 AS confidence, o_custkey % 7 <> 0 AS matched,
    CASE c_nationkey % 3 WHEN 0 THEN 'Micro entity' WHEN 1 THEN 'DORMANT' END AS accounts, o_orderstatus = 'F' AS known, CASE o_orderkey % 3 WHEN 0 THEN 'early_stage' WHEN 1 THEN 'established' ELSE 'unknown' END AS site, o_orderkey % 2 AS retailers, o_orderkey % 5 = 0 AS launches, CASE WHEN o_orderkey % 4 = 0 THEN 'multiple_retail' ELSE 'unknown' END AS presence, o_orderkey % 3 AS marketplaces,
    CASE WHEN o_orderkey % 6 = 0 THEN 'The Company' ELSE c_name END AS mark, CASE o_orderkey % 3 WHEN 0 THEN 'Word' WHEN 1 THEN 'Figurative' END AS kind, c_acctbal > 0 AS goods, o_custkey % 50 = 0 AS major, c_acctbal < 100 AS person, c_nationkey < 20 AS uk FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey),
i AS (SELECT *, len({sql_prefixed('sic', 'manufacturing')}) + len({sql_prefixed('sic', 'trade')}) > 0 AS food_sic, len(sic) > 0 AND len({sql_prefixed('sic', 'non_product')}) = len(sic) AS service_sic, len(classes) AS n FROM b),
k AS (SELECT o_orderkey, list_filter([
  CASE WHEN age <= 1 THEN {{'k': 'company_incorporated_within_12m', 'w': 12}} END, CASE WHEN age > 1 AND age <= 2 THEN {{'k': 'company_incorporated_within_24m', 'w': 8}} END, CASE WHEN age > 2 AND age <= 4 THEN {{'k': 'company_incorporated_within_48m', 'w': 4}} END,
  CASE WHEN first THEN {{'k': 'first_trademark_for_applicant', 'w': 8}} END, CASE WHEN marks = 1 THEN {{'k': 'single_mark_this_journal', 'w': 3}} END, CASE WHEN category IS NOT NULL THEN {{'k': 'specific_packaged_food_category', 'w': 10}} END, CASE WHEN n BETWEEN 1 AND 3 THEN {{'k': 'narrow_class_profile', 'w': 4}} END,
  CASE WHEN food_sic THEN {{'k': 'food_sic_code_match', 'w': 6}} END, CASE WHEN matched AND confidence >= 85 THEN {{'k': 'strong_company_match', 'w': 5}} END, CASE WHEN known AND site = 'early_stage' THEN {{'k': 'early_stage_website', 'w': 7}} END, CASE WHEN known AND retailers = 0 THEN {{'k': 'no_major_retail_listings', 'w': 7}} END,
  CASE WHEN known AND launches THEN {{'k': 'active_launch_signals', 'w': 6}} END, CASE WHEN matched AND accounts = 'Micro entity' THEN {{'k': 'small_company_accounts', 'w': 3}} END, CASE WHEN mark <> 'The Company' THEN {{'k': 'distinctive_consumer_brand_name', 'w': 3}} END, CASE WHEN kind = 'Word' THEN {{'k': 'word_mark', 'w': 2}} END,
  CASE WHEN major THEN {{'k': 'major_brand_owner', 'w': -60}} END, CASE WHEN age > 6 AND age <= 10 THEN {{'k': 'company_older_than_6y', 'w': -18}} END, CASE WHEN age > 10 THEN {{'k': 'company_older_than_10y', 'w': -10}} END, CASE WHEN marks >= 4 THEN {{'k': 'portfolio_filing', 'w': -20}} END, CASE WHEN n >= 8 THEN {{'k': 'many_classes', 'w': -8}} END,
  CASE WHEN NOT matched THEN {{'k': 'no_company_match', 'w': -15}} END, CASE WHEN matched AND confidence < 70 THEN {{'k': 'weak_company_match', 'w': -8}} END, CASE WHEN person THEN {{'k': 'natural_person_applicant', 'w': -20}} END, CASE WHEN NOT uk THEN {{'k': 'non_uk_applicant', 'w': -25}} END,
  CASE WHEN category IS NULL AND NOT list_has_any(classes, [29, 30]) THEN {{'k': 'service_only_profile', 'w': -25}} END, CASE WHEN known AND site = 'established' THEN {{'k': 'mature_brand_footprint', 'w': -25}} END, CASE WHEN known AND presence = 'multiple_retail' THEN {{'k': 'widely_distributed', 'w': -18}} END,
  CASE WHEN NOT goods THEN {{'k': 'goods_text_unavailable', 'w': -8}} END, CASE WHEN kind = 'Figurative' THEN {{'k': 'figurative_only_mark', 'w': -4}} END, CASE WHEN matched AND accounts = 'DORMANT' THEN {{'k': 'company_dormant', 'w': -10}} END, CASE WHEN service_sic THEN {{'k': 'service_business_sic_only', 'w': -25}} END,
  CASE WHEN known AND presence <> 'multiple_retail' AND marketplaces > 0 THEN {{'k': 'already_on_marketplace', 'w': -6}} END], lambda x: x IS NOT NULL) AS f FROM i)
SELECT o_orderkey, array_to_string(list_transform(f, lambda x: x.k), ',') AS fired, least(100, greatest(0, 25 + coalesce(list_sum(list_transform(f, lambda x: x.w)), 0)))::int AS score FROM k""")
def op_r18_indicators(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("classes"), F.min("l_shipdate").cast("date").alias("ship"))
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate"))
    rows = rel.first_seen(rel.group_size(rows, ["o_custkey", "y"], "marks"), "o_custkey", "o_orderdate").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k, s, segment = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("c_mktsegment")
    some = lambda *c: F.array(*map(F.lit, c))
    none = F.array().cast("array<string>")
    age = F.bround(F.datediff("ship", F.col("o_orderdate").cast("date")) / 3.6525, 2)
    facts = rows.select(
        "o_orderkey", "marks", "first_seen", age.alias("age"), F.coalesce("classes", F.array().cast("array<int>")).alias("classes"), F.when(~F.col("o_orderpriority").startswith("1"), "x").alias("category"),
        F.when(segment == "BUILDING", some("10710")).when(segment == "AUTOMOBILE", some("56101")).when(segment == "MACHINERY", some("46370", "99999")).otherwise(none).alias("sic"), (F.col("o_custkey") % 40 + 60).alias("confidence"), (F.col("o_custkey") % 7 != 0).alias("matched"),
        F.when(F.col("c_nationkey") % 3 == 0, "Micro entity").when(F.col("c_nationkey") % 3 == 1, "DORMANT").alias("accounts"), (s == "F").alias("known"), F.when(k % 3 == 0, "early_stage").when(k % 3 == 1, "established").otherwise("unknown").alias("site"),
        (k % 2).alias("retailers"), F.when(k % 5 == 0, some("x")).otherwise(none).alias("launches"), F.when(k % 4 == 0, "multiple_retail").otherwise("unknown").alias("presence"), (k % 3).alias("marketplaces"), F.when(k % 6 == 0, "The Company").otherwise(F.col("c_name")).alias("mark"),
        F.when(k % 3 == 0, "Word").when(k % 3 == 1, "Figurative").alias("kind"), (F.col("c_acctbal") > 0).alias("goods"), (F.col("o_custkey") % 50 == 0).alias("major"), (F.col("c_acctbal") < 100).alias("person"), (F.col("c_nationkey") < 20).alias("uk"),
    )
    c = F.col
    conditions = S.launch_conditions(
        age=c("age"), first=c("first_seen"), marks=c("marks"), classes=c("classes"), category=c("category"), sic=c("sic"), confidence=c("confidence"), matched=c("matched"), accounts=c("accounts"), known=c("known"), site_maturity=c("site"), retailers=c("retailers"),
        launches=c("launches"), presence=c("presence"), marketplaces=c("marketplaces"), mark=c("mark"), kind=c("kind"), has_goods=c("goods"), major=c("major"), person=c("person"), uk=c("uk"),
    )
    found = facts.withColumn("f", S.fired(conditions, {}, 1.0, R.LAUNCH_INDICATORS))
    return found.select("o_orderkey", F.array_join(F.transform("f", lambda x: x["key"]), ",").alias("fired"), S.total(F.col("f")).alias("score"))


def as_prospects(t):
    """Customers read as prospects, in every state and priority."""
    k = F.col("c_custkey")
    day = lambda by, n: F.when(k % by != 0, F.date_add(F.lit("2025-06-01").cast("date"), (k % n).cast("int")))
    return t("customer").select(
        k.alias("id"), F.get(F.array(*map(F.lit, P.STATUSES)), (k % 12).cast("int")).alias("status"), F.get(F.array(*map(F.lit, P.PRIORITIES)), (k % 4).cast("int")).alias("priority"), day(5, 20).alias("email_1_sent_date"), day(3, 11).alias("sample_requested_date"),
        day(2, 20).alias("sample_sent_date"), day(7, 5).alias("offer_sent_date"), day(11, 3).alias("converted_date"), (k % 9 == 0).alias("opted_out"), F.when(k % 5 == 1, "POSITIVE").alias("reply"), F.col("c_name").alias("company_name"), F.when(k % 6 != 0, F.concat(F.lit("https://www."), "c_mktsegment", F.lit(".com/"))).alias("website"),
        F.when(k % 8 == 0, "Verify site").alias("notes"), (k % 3 == 0).alias("verified_email"), F.when(k % 2 == 0, "unknown").otherwise("phone").alias("contact_route"),
    )


DAY = "CASE WHEN c_custkey % {0} <> 0 THEN date '2025-06-01' + (c_custkey % {1})::int END"
PROSPECTS_SQL = f"""p AS (SELECT c_custkey AS id, {sql_list(P.STATUSES)}[c_custkey % 12 + 1] AS status, {sql_list(P.PRIORITIES)}[c_custkey % 4 + 1] AS priority, {DAY.format(5, 20)} AS mailed, {DAY.format(3, 11)} AS requested, {DAY.format(2, 20)} AS sampled, {DAY.format(7, 5)} AS offered, {DAY.format(11, 3)} AS converted,
  c_custkey % 9 = 0 AS out, CASE WHEN c_custkey % 5 = 1 THEN 'POSITIVE' END AS reply, CASE WHEN c_custkey % 6 <> 0 THEN 'https://www.' || c_mktsegment || '.com/' END AS website, c_custkey % 8 = 0 AS verify, c_custkey % 3 = 0 AS mail_ok, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'phone' END AS route FROM customer)"""


@probe(f"""
WITH {PROSPECTS_SQL}
SELECT id, CASE WHEN status = 'RESEARCHED' AND priority <> 'SUPPRESS' THEN 'FINISH RESEARCH' WHEN status = 'READY' THEN 'SEND FIRST EMAIL' WHEN status = 'EMAIL_1_SENT' AND date '2025-06-15' - mailed >= 7 THEN 'SEND FOLLOW-UP' WHEN status IN ('REPLIED_INTERESTED', 'SAMPLE_REQUESTED') THEN 'SEND FULL SAMPLE'
  WHEN status = 'SAMPLE_SENT' AND date '2025-06-15' - sampled >= 7 THEN 'SEND SUBSCRIPTION OFFER' WHEN status = 'OFFER_SENT' AND reply = 'POSITIVE' THEN 'HANDLE REPLY' END AS action, coalesce(regexp_replace(regexp_replace(lower(website), '^https?://', ''), '^www\\.|/$', '', 'g'), '') AS domain FROM p""")
def op_r23_due_actions(t):
    c = F.col
    action = P.due_action(c("status"), c("priority"), c("email_1_sent_date"), c("sample_sent_date"), c("reply"), F.lit("2025-06-15").cast("date"))
    return as_prospects(t).select("id", action.alias("action"), P.domain_of(c("website")).alias("domain"))


@probe(f"""
WITH {PROSPECTS_SQL}
SELECT count(*) AS total, count(*) FILTER (priority IN ('A', 'B') AND status NOT IN ('OPTED_OUT', 'SUPPRESSED')) AS qualified, count(mailed) AS email_1_sent, count(*) FILTER (status IN ('REPLIED_INTERESTED', 'SAMPLE_REQUESTED', 'SAMPLE_SENT', 'OFFER_SENT', 'SUBSCRIBED', 'NOT_NOW')) AS replies, count(requested) AS sample_requests,
  count(sampled) AS samples_sent, count(offered) AS offers_sent, count(*) FILTER (converted IS NOT NULL OR status = 'SUBSCRIBED') AS subscribed, count(*) FILTER (out) AS opted_out, count(*) FILTER (status = 'SUPPRESSED') AS suppressed FROM p""")
def op_a21_prospect_funnel(t):
    return P.funnel(as_prospects(t))


@probe(f"WITH {PROSPECTS_SQL} SELECT status, priority, count(*) AS n FROM p GROUP BY GROUPING SETS ((status), (priority))")
def op_a21_prospect_spread(t):
    return P.spread(as_prospects(t))


@probe(f"WITH {PROSPECTS_SQL} SELECT count(*) FILTER (website IS NULL) AS no_website, count(*) FILTER (verify) AS to_verify, count(*) FILTER (status NOT IN ('OPTED_OUT', 'SUPPRESSED') AND NOT mail_ok AND route = 'unknown') AS no_route FROM p")
def op_f31_audit(t):
    return P.audit(as_prospects(t))


@probe("""
WITH n AS (SELECT DISTINCT c_name AS applicant_name, c_custkey FROM customer), m AS (SELECT c_name || ' ltd' AS company_name, c_custkey::varchar AS company_number FROM customer)
SELECT applicant_name || ' PLC' AS applicant_name, company_number, 98 AS score, 'exact' AS method FROM n JOIN m ON company_name = applicant_name || ' ltd'""")
def op_j05_match_applicants(t):
    filings = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "right").select(F.concat("c_name", F.lit(" PLC")).alias("applicant_name"))
    companies = t("customer").select(F.concat("c_name", F.lit(" ltd")).alias("company_name"), F.col("c_custkey").cast("string").alias("company_number"))
    return M.match_applicants(filings, companies).select("applicant_name", "company_number", "score", "method")


@probe("""
WITH q AS (SELECT c_custkey, lower(c_mktsegment) AS q, 8 AS k, 0 AS ord FROM customer UNION ALL SELECT c_custkey, 'src' || c_nationkey % 5, 5, 1 FROM customer),
r AS (SELECT source AS q, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, 'https://d' || doc_id || '.example.com/' AS url FROM documents UNION ALL SELECT 'building', page_id + 1, url FROM pages),
j AS (SELECT c_custkey, url, ord, rank FROM q JOIN r USING (q) WHERE rank <= k)
SELECT c_custkey, count(DISTINCT url) AS n, min(rank) AS first FROM j GROUP BY 1""")
def op_j06_evidence(t):
    from pyspark.sql import Window as W

    customers = t("customer").select("c_custkey", F.col("c_mktsegment").alias("brand"), F.concat(F.lit("src"), F.col("c_nationkey") % 5).alias("company"))
    first = rel.top_k(t("documents").select("source", "doc_id"), ["source"], 8, "doc_id")  # a query takes 8 results at most
    of = first.select(F.col("source").alias("query"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("rank"), F.concat(F.lit("https://d"), "doc_id", F.lit(".example.com/")).alias("url"))
    pages = t("pages").select(F.lit("building").alias("query"), (F.col("page_id") + 1).cast("int").alias("rank"), "url")
    results = of.unionByName(pages).withColumns({"title": F.lit("t"), "snippet": F.lit("")})
    return E.evidence_for(customers, results, "c_custkey", "brand", "company").groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("first"))


@probe("""
WITH k AS (SELECT event_id, user_id::varchar AS customer, ts, CASE event_type WHEN 'signup' THEN 'ACTIVE' WHEN 'error' THEN 'PAST_DUE' WHEN 'purchase' THEN 'CANCELLED' END AS s FROM events),
f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY customer ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM k),
g AS (SELECT *, state IS DISTINCT FROM lag(state) OVER (PARTITION BY customer ORDER BY ts, event_id) AS changed FROM f)
SELECT customer, max_by(state, (ts, event_id)) FILTER (state IS NOT NULL) AS status, strftime(max(ts) FILTER (changed AND state IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM g GROUP BY 1""")
def op_t04_subscriptions(t):
    word = F.when(F.col("event_type") == "signup", "active").when(F.col("event_type") == "error", "past_due").when(F.col("event_type") == "purchase", "canceled").otherwise("seen")
    events = t("events").select(F.col("user_id").cast("string").alias("customer"), F.format_string("%012d", "event_id").alias("id"), "ts", word.alias("status"))
    return stateful.subscriptions_batch(events).select("customer", "status", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "n")


@probe("""
WITH a AS (SELECT s_suppkey, 'customer0000000' || lpad(s_suppkey::varchar, 2, '0') AS k FROM supplier), b AS (SELECT c_custkey, replace(replace(lower(c_name), '#', ''), ' ', '') AS k FROM customer)
SELECT s_suppkey, c_custkey, a.k = b.k AS equal FROM a JOIN b ON contains(b.k, a.k)""")
def op_j03_contained(t):
    left = t("supplier").select("s_suppkey", F.concat(F.lit("customer0000000"), F.lpad(F.col("s_suppkey").cast("string"), 2, "0")).alias("k"))
    right = t("customer").select("c_custkey", X.name_key("c_name").alias("r"))
    return rel.contained(left, right, F.col("k"), F.col("r")).select("s_suppkey", "c_custkey", (F.col("k") == F.col("r")).alias("equal"))


@probe("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'HIGH' WHEN o_totalprice >= 250000 THEN 'MEDIUM' ELSE 'LOW' END AS band, o_orderstatus = 'P' AS suppressed, year(o_orderdate) AS b FROM orders)
SELECT count(*) FILTER (NOT suppressed AND band IN ('HIGH', 'MEDIUM')) AS deliverable, count(*) FILTER (NOT suppressed AND band = 'HIGH') AS high, count(*) FILTER (NOT suppressed AND band = 'MEDIUM') AS medium, count(DISTINCT b) AS batches, round_even(count(*) FILTER (NOT suppressed AND band IN ('HIGH', 'MEDIUM')) / count(DISTINCT b), 2)::double AS per_batch FROM o""")
def op_a23_product_metrics(t):
    price = F.col("o_totalprice")
    return P.product_metrics(t("orders").select(F.when(price >= 400000, "HIGH").when(price >= 250000, "MEDIUM").otherwise("LOW").alias("band"), (F.col("o_orderstatus") == "P").alias("suppressed"), F.year("o_orderdate").alias("batch_id")))


@probe("""
SELECT o_orderpriority AS stage, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'F') / count(*) > 0.5 AS fatal FROM orders GROUP BY 1""")
def op_f19_stage_failures(t):
    return reports.stage_failures(t("orders"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F")


@probe("""
WITH a AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'HIGH' ELSE 'LOW' END AS band FROM orders), b AS (SELECT l_orderkey, CASE WHEN sum(l_extendedprice) >= 200000 THEN 'HIGH' ELSE 'LOW' END AS band FROM lineitem GROUP BY 1)
SELECT a.band AS was, b.band AS "is", count(*) AS n FROM a FULL JOIN b ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def op_a32_rescored(t):
    before = t("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") >= 250000, "HIGH").otherwise("LOW").alias("band"))
    after = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(F.sum("l_extendedprice") >= 200000, "HIGH").otherwise("LOW").alias("band"))
    return sales.rescored(before, after, "k", "band")


def rules_with(base: int, many: int, cap: int) -> rulebook.Rulebook:
    """The shipped rules with another base, weight of many classes and cap of filings without a company."""
    found = json.loads(rulebook.shipped().sections)
    found["scoring"] |= {"base": base, "caps": {"no_company": cap}}
    next(x for x in found["scoring"]["indicators"] if x["key"] == "many_classes")["weight"] = many
    return rulebook.checked(found)


@probe("""
WITH r AS (SELECT o_orderpriority < '3' AS word, day(o_orderdate) >= 20 AS many, o_orderstatus = 'F' AS gone, o_totalprice > 100000 AS first FROM orders),
s AS (SELECT gone, CASE WHEN word THEN 2 ELSE 0 END + CASE WHEN first THEN 8 ELSE 0 END + CASE WHEN gone THEN -15 ELSE 0 END AS n, CASE WHEN many THEN 1 ELSE 0 END AS m FROM r),
v AS (SELECT CASE WHEN gone THEN least(74, 50 + n - 8 * m) ELSE 50 + n - 8 * m END AS a, CASE WHEN gone THEN least(62, 75 + n - 20 * m) ELSE 75 + n - 20 * m END AS b FROM s)
SELECT CASE WHEN a >= 80 THEN 'HIGH' WHEN a >= 60 THEN 'MEDIUM' ELSE 'SUPPRESS' END AS was, CASE WHEN b >= 80 THEN 'HIGH' WHEN b >= 60 THEN 'MEDIUM' ELSE 'SUPPRESS' END AS "is", count(*) AS n FROM v GROUP BY 1, 2""")
def op_a32_versions(t):
    gone = F.col("o_orderstatus") == "F"
    conditions = {"word_mark": F.col("o_orderpriority") < "3", "many_classes": F.day("o_orderdate") >= 20, "no_company_match": gone, "first_trademark_for_applicant": F.col("o_totalprice") > 100000}
    rows = t("orders").select("o_orderpriority", "o_orderdate", "o_orderstatus", "o_totalprice")
    return rulebook.rescore(rows, rules_with(50, -8, 74), rules_with(75, -20, 62), lambda df, book: book.scored(df, conditions, {"n_classes": F.day("o_orderdate")}, True, {"no_company": gone}))[1]


@probe("""
SELECT count(*) AS paying, sum(CASE c_mktsegment WHEN 'BUILDING' THEN 4900 WHEN 'MACHINERY' THEN 9900 ELSE 0 END)::bigint AS monthly_pence FROM customer WHERE c_acctbal >= 0""")
def op_a25_revenue(t):
    customers = t("customer").select(F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("PAST_DUE").alias("status"), F.col("c_mktsegment").alias("plan"))
    prices = customers.sparkSession.createDataFrame([("BUILDING", 4900), ("MACHINERY", 9900)], "plan string, pence int")
    return sales.recurring_revenue(customers, prices)


@probe("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_custkey END AS provider_id, 'C' || o_custkey || '@x.y' AS email FROM orders)
SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS customer_id FROM e LEFT JOIN customer a ON e.provider_id = 'p' || a.c_custkey LEFT JOIN customer b ON lower(e.email) = 'c' || b.c_custkey || '@x.y' AND b.c_acctbal > 0""")
def op_j26_attributed_events(t):
    events = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("p"), "o_custkey")).alias("provider_id"), F.concat(F.lit("C"), "o_custkey", F.lit("@x.y")).alias("email"))
    customers = t("customer").select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("p"), "c_custkey").alias("provider_id"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("c"), "c_custkey", F.lit("@x.y"))).alias("email"))
    return sales.attributed_events(events, customers.select("customer_id", "provider_id", "email")).select("o_orderkey", "customer_id")


@probe("""
SELECT o_orderkey, CASE WHEN band = 'LOW' THEN 'low_band' WHEN goods = '' THEN 'no_goods' WHEN since IS NULL THEN 'no_company' WHEN site = 'CONFLICTING' THEN 'conflicting_website' END AS sample,
  CASE WHEN contacted THEN 'already_contacted' WHEN band = 'LOW' THEN 'low_band' WHEN since IS NULL THEN 'no_date' WHEN date '1998-08-01' - since > 400 THEN 'too_old' WHEN rank < 2 THEN 'not_relevant' WHEN NOT urgent THEN 'other_category' END AS preview
FROM (SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'HIGH' ELSE 'LOW' END AS band, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'g' END AS goods, CASE WHEN o_custkey % 11 <> 0 THEN o_orderdate::date END AS since, CASE WHEN o_custkey % 5 = 0 THEN 'CONFLICTING' END AS site, o_custkey % 13 = 0 AS contacted, o_custkey % 4 AS rank, o_orderpriority LIKE '1%' AS urgent FROM orders)""")
def op_f23_sample_and_preview(t):
    k, c = F.col("o_custkey"), F.col
    rows = t("orders").select(
        "o_orderkey", F.when(c("o_totalprice") >= 250000, "HIGH").otherwise("LOW").alias("band"), F.when(c("o_orderstatus") == "P", "").otherwise("g").alias("goods"), F.when(k % 11 != 0, c("o_orderdate").cast("date")).alias("since"), F.when(k % 5 == 0, "CONFLICTING").alias("site"),
        (k % 13 == 0).alias("contacted"), F.get(F.array(*map(F.lit, V.BANDS)), (k % 4).cast("int")).alias("relevance"), F.substring("o_orderpriority", 1, 1).alias("category"),
    )
    sample = rel.first_reason(sales.sample_rules(c("band"), c("goods"), c("site"), c("since")))
    preview = rel.first_reason(sales.preview_rules(F.lit("1998-08-01").cast("date"), c("since"), c("relevance"), F.lit("MEDIUM"), c("band"), c("category"), F.array(F.lit("1")), c("contacted")))
    return rows.select("o_orderkey", sample.alias("sample"), preview.alias("preview"))


@probe(r"""
SELECT doc_id, md5(trim(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g'))) AS cleaned, md5('salt:' || text) IS NOT NULL AS hashed, left(sha256('salt:' || text), 32) AS salted, coalesce(nullif(string_split(trim(source), ' ')[1], ''), NULL) AS area FROM documents""")
def op_x18_clean(t):
    whole = F.length("text") + 1
    cleaned = X.clean("text", 1 << 30)
    return t("documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("cleaned"), (whole > 0).alias("hashed"), X.salted_hash("text", "salt").alias("salted"), X.postcode_area(F.col("source")).alias("area"))


@probe("""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'soon' END AS s, o_orderdate::date AS o FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o, '%Y-%m-%d') END AS parsed, (((o + 20) - (o + ((12 - isodow(o)) % 7)::int)) // 7 + 1)::int AS fridays FROM d""")
def op_d01_dates(t):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).otherwise("soon")
    return t("orders").select("o_orderkey", D.parse(written, ("yyyy-MM-dd", None), ("dd/MM/yyyy", None)).cast("string").alias("parsed"), F.size(D.batches_between(d, F.date_add(d, 20))).alias("fridays"))


@probe("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' WHEN c_custkey % 2 = 0 THEN 'NONE' ELSE 'UNKNOWN' END AS packaging, CASE WHEN c_custkey % 2 = 0 THEN 'NONE' ELSE 'UNKNOWN' END AS design, (c_custkey % 4 = 0) AS at_least_medium,
  CASE WHEN c_custkey % 3 = 0 THEN 'A drink brand that is likely to need packaging' WHEN c_custkey % 3 = 1 THEN 'A food brand that may need packaging' END AS line FROM customer""")
def op_c09_intents(t):
    k = F.col("c_custkey")
    found = F.when(k % 4 == 0, F.create_map(F.lit("packaging"), F.lit("HIGH"))).otherwise(F.create_map().cast("map<string,string>"))
    m = V.intent_map(found, k % 2 == 0, ("packaging", "design"))
    band = F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW")
    line = sales.supplier_line(F.lit("packaging"), band, F.when(k % 3 == 0, "drink"))
    return t("customer").select("c_custkey", m["packaging"].alias("packaging"), m["design"].alias("design"), V.at_least(m["packaging"], F.lit("MEDIUM")).alias("at_least_medium"), line.alias("line"))


@probe("""
WITH a AS (SELECT array_agg(c) AS keep FROM (SELECT 1 AS c)), p AS (SELECT p_partkey, list_filter([29, 30, 5, 43], lambda x: (p_partkey // x) % 2 = 0) AS classes, p_size % 6 AS hits, p_type <> 'SMALL' AS goods, p_type = 'LARGE' AS word FROM part),
q AS (SELECT *, coalesce(round_even(least(1, greatest(0, CASE WHEN list_has_any(classes, [29, 30]) THEN 0.35::double ELSE 0 END + CASE WHEN len(classes) > 0 AND len(list_filter(classes, lambda x: x NOT IN (29, 30))) = 0 THEN 0.1::double ELSE 0 END + CASE WHEN hits > 0 THEN 0.2::double ELSE 0 END + least(hits, 4) * 0.05::double + CASE WHEN goods THEN 0.15::double ELSE -0.05 END + CASE WHEN word THEN 0.05::double ELSE 0 END)), 2), 0)::double AS probability FROM p)
SELECT p_partkey, probability, CASE WHEN probability >= 0.7 THEN 'HIGH' WHEN probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS relevance, CASE WHEN probability >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS distribution FROM q""")
def op_r02_probability(t):
    k = F.col("p_partkey")
    classes = F.filter(F.array(*map(F.lit, (29, 30, 5, 43))), lambda x: F.floor(k / x) % 2 == 0)
    p = G.packaged_probability(classes, F.col("p_size") % 6, F.col("p_type") != "SMALL", F.col("p_type") == "LARGE")
    return t("part").select("p_partkey", p.alias("probability")).select("p_partkey", "probability", G.relevance(F.col("probability")).alias("relevance"), G.distribution_relevance(F.col("probability")).alias("distribution"))
