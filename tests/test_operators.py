import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.operators import evidence as E
from tidemark.operators import goods as G
from tidemark.operators import matching as M
from tidemark.operators import relational as rel
from tidemark.operators import reports, sales
from tidemark.operators import scoring as S
from tidemark.operators import verification as VE


def test_first_reason_wins_and_null_does_not_fire(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, x int")
    out = rel.decide(rel.decide(df, "a", [("big", F.col("x") > 4), ("any", F.col("x") > 0)]), "b", [("late", F.lit(True))])
    assert {r["id"]: (r["stage"], r["reason"]) for r in out.collect()} == {1: ("a", "big"), 2: ("b", "late"), 3: ("a", "any")}
    assert rel.kept(out).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("Oat Foods Ltd", "OAT FOODS LIMITED", 98), ("Oat Foods", "Oatfoods Ltd", 92), ("Foods Oat", "Oat Foods", 88), ("", "Oat", 0), ("Oat", "Oat Foods Bar", 20), ("a b c", "a b c d", 78), ("a b", "a c", 20), ("a b c", "a b d", 55)],
)
def test_name_score_ladder(spark, a, b, score):
    assert spark.range(1).select(M.name_score(F.lit(a), F.lit(b))).first()[0] == score


def test_best_match_penalty_and_exact_ties(spark):
    rows = [("a", 1, 80), ("a", 2, 78), ("b", 1, 98), ("b", 2, 98), ("c", 1, 60), ("c", 2, 58), ("d", 1, 55)]
    out = {r["k"]: (r["n"], r["confidence"], r["ambiguous"]) for r in rel.best_match(spark.createDataFrame(rows, "k string, n int, s int"), "k", "s", "n").collect()}
    assert out == {"a": (1, 65, True), "b": (1, 98, False), "d": (1, 55, False)}


def test_blocked_lookup_falls_back_to_prefix_and_has_no_nested_loop(spark):
    left = spark.createDataFrame([(1, "oats"), (2, "crumb"), (3, "abc")], "id int, name string")
    right = spark.createDataFrame([("oats", "1"), ("crumble foods", "2"), ("crumbly", "3"), ("abcd", "4")], "key string, number string")
    out = rel.blocked_lookup(left, right, "id", F.col("name"), F.col("key"), ["number"])
    assert sorted((r["id"], r["number"], r["method"]) for r in out.collect()) == [(1, "1", "exact"), (2, "2", "prefix"), (2, "3", "prefix")]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_duplicates_link_to_the_first(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "", None), (5, "", None)]
    out = rel.duplicates(spark.createDataFrame(rows, "id int, n string, d string"), "id", {"n": F.col("n"), "d": F.col("d")})
    assert sorted(tuple(r) for r in out.collect()) == [(2, 1, "n"), (3, 1, "d")]


def test_buckets_keep_empty_ones_and_bands_fall_to_the_last(spark):
    df = spark.createDataFrame([(85,), (61,), (3,)], "s int")
    assert [(r["bucket"], r["n"]) for r in rel.bucketed(df, F.col("s"), [("80+", 80), ("60s", 60), ("40s", 40), ("<40", 0)]).orderBy("position").collect()] == [("80+", 1), ("60s", 1), ("40s", 0), ("<40", 1)]
    band = rel.band_of(F.col("s") / 1.0, [("A", 80, 100), ("B", 60, 79.9), ("C", 0, 59.9)])
    assert [r[0] for r in df.select(band).collect()] == ["A", "B", "C"]
    assert spark.range(1).select(rel.band_of(F.lit(79.95), [("A", 80, 100), ("B", 60, 79.9), ("C", 0, 59.9)])).first()[0] == "C"


@pytest.mark.parametrize("n", [1, 17])
def test_group_results_do_not_depend_on_partitions(spark, n):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(n)
    out = rel.keep_first(rel.first_seen(rel.group_size(df, ["k"], "size"), "k", "id"), ["k"], "id")
    assert sorted(tuple(r) for r in out.select("id", "k", "size", "first_seen").collect()) == [(i, i, 15 if i < 2 else 14, True) for i in range(7)]


def test_goods_items_and_profile(spark):
    df = spark.createDataFrame([("f", "Bread (fresh); cakes. Tea bar; toy; tea"), ("g", None), ("h", "milk; bread")], "id string, goods string")
    items = G.items(df, "id", "goods")
    got = {(r["id"], r["pos"]): (r["kind"], r["grp"]) for r in items.collect()}
    assert got[("f", 0)] == ("food", "bakery")
    assert got[("f", 2)] == ("hospitality", None)
    assert got[("f", 3)] == ("non_food", None)
    p = {r["id"]: r for r in G.profile(items, "id").collect()}
    assert (p["f"]["dominant"], p["f"]["several"], p["f"]["n_food"]) == ("bakery", False, 3)
    assert (p["h"]["dominant"], p["h"]["several"]) == ("bakery", True)
    assert "g" not in p


def test_group_with_head_noun_bonus_and_first_of_ties(spark):
    got = lambda s: spark.range(1).select(G.group_scores(F.lit(s), R.GROUPS).alias("x")).first()["x"]
    assert got("bread sauce")["grp"] == "sauce"
    assert got("cake milk tea cheese")["grp"] == "dairy"
    assert got("plain") is None


@pytest.mark.parametrize(("n", "band"), [(79, "MEDIUM"), (80, "HIGH"), (60, "MEDIUM"), (59, "SUPPRESS"), (0, "SUPPRESS")])
def test_band_edges(spark, n, band):
    assert spark.range(1).select(S.band(F.lit(n))).first()[0] == band


def test_score_clamps_caps_in_turn_and_orders_reasons(spark):
    age = F.lit(1.0)
    reasons = S.fired({"company_incorporated_within_12m": age <= 1, "company_incorporated_within_24m": (age > 1) & (age <= 2), "first_trademark_for_applicant": F.lit(True), "single_mark_this_journal": F.lit(None).cast("boolean"), "many_classes": F.lit(True)}, {"age_phrase": F.lit("12 months before its"), "n_classes": F.lit(9)}, 76 / 56)
    row = spark.range(1).select(reasons.alias("r")).select(S.total(F.col("r")).alias("n"), S.top_reasons(F.col("r")).alias("t")).first()
    assert row["n"] == 25 + 16 + 11 - 8  # halves to even, negatives as they are
    assert row["t"] == ["incorporated 12 months before its filing", "first filing by this applicant", "covers 9 classes"]
    score, why = S.capped(F.lit(90), [("a", F.lit(True), 79), ("b", F.lit(True), 74), ("c", F.lit(False), 10)])
    assert tuple(spark.range(1).select(score, why).first()) == (74, "b")


def test_scale_is_computed_from_the_rules():
    assert R.positive_scale(True) == 1.0
    assert 1.0 < R.positive_scale(False) <= R.MOST_SCALE


def test_verdicts(spark):
    one, two = ["exact_domain_brand_match", "company_name_match"], ["brand_in_title"]
    rows = [("a", "x.com", 5, one), ("a", "y.com", 6, one), ("b", "x.com", 6, one), ("c", "x.com", 3, two), ("d", "x.com", 1, two)]
    w = spark.createDataFrame(rows, "k string, domain string, weight int, keys array<string>").selectExpr("*", "1 pages", "1 first", "'oat' _brand", "'https://' || domain || '/a' url")
    got = {r["k"]: (r["verdict"], r["website"], r["site"]) for r in VE.verdicts(w, "k").collect()}
    assert got == {"a": ("CONFLICTING", None, None), "b": ("VERIFIED", "x.com", "https://x.com"), "c": ("PROBABLE", None, None), "d": ("UNVERIFIED", None, None)}


def test_domain_classes_by_suffix(spark):
    df = spark.createDataFrame([("www.amazon.co.uk".removeprefix("www."),), ("shop.etsy.com",), ("notetsy.com",), (None,)], "domain string")
    assert {r["domain"]: r["domain_class"] for r in E.classified(df).collect()} == {"amazon.co.uk": "marketplace", "shop.etsy.com": "marketplace", "notetsy.com": "own", None: "own"}


def test_evidence_takes_the_company_query_only_if_named_otherwise(spark):
    filings = spark.createDataFrame([("1", "Oat", "OAT"), ("2", "Oat", "Crumb Ltd")], "id string, brand string, company string")
    results = spark.createDataFrame([("oat", i, "t", f"https://a{i}.com/", "") for i in range(1, 11)] + [("crumb ltd", i, "t", f"https://b{i}.com/", "") for i in range(1, 11)], "query string, rank int, title string, url string, snippet string")
    got = E.evidence_for(filings, results, "id", "brand", "company").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"1": 8, "2": 13}


def test_results_that_no_query_takes_do_not_reach_the_join(spark):
    filings = spark.createDataFrame([(i, "Oat", "OAT") for i in range(50)], "id int, brand string, company string")
    results = spark.createDataFrame([("oat", i, "t", f"https://a{i}.com/", "") for i in range(1, 401)], "query string, rank int, title string, url string, snippet string")
    got = E.evidence_for(filings, results, "id", "brand", "company")
    assert got.groupBy("id").count().where("count = 8").count() == 50
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert any(re.search(r"Filter.*rank#\d+ <= 8\)", line) for line in lines[join + 1 :])


def test_post_dated_match_is_cleared_at_181_days(spark):
    filed = date(2025, 1, 1)
    rows = [(1, filed, filed + timedelta(180), "a", 90, "exact"), (2, filed, filed + timedelta(181), "a", 90, "exact"), (3, filed, None, "a", 90, "exact")]
    out = M.without_post_dated(spark.createDataFrame(rows, "id int, f date, i date, c string, confidence int, method string"), "f", "i", ["c"], 180)
    assert {r["id"]: (r["c"], r["confidence"], r["method"]) for r in out.collect()} == {1: ("a", 90, "exact"), 2: (None, 0, "post_dated"), 3: ("a", 90, "exact")}


def test_grace_is_exclusive(spark):
    from datetime import datetime

    now = datetime(2025, 1, 15)
    ok = lambda since: spark.range(1).select(sales.delivery_allowed(F.lit(True), F.lit("PAST_DUE"), F.lit(since), F.lit(now))).first()[0]
    assert ok(datetime(2025, 1, 1)) is True
    assert ok(datetime(2024, 12, 31, 23, 59, 59)) is False


def fold(rows, k):
    taken, companies, cats = [], set(), set()
    for fresh in (True, False):
        for r in rows:
            if len(taken) < k and r not in taken and r[1] not in companies and (not fresh or r[2] not in cats):
                taken.append(r)
                companies.add(r[1])
                cats.add(r[2])
    return taken


def test_diversified_equals_a_plain_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("abcdef"), rng.choice("xyz"), rng.randint(0, 9), rng.choice("pq")) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, company string, category string, fit int, g string")
    got = sales.diversified(df, "g", "company", "category", ["-fit", "id"], 5).collect()
    for g in "pq":
        want = fold(sorted([r for r in rows if r[4] == g], key=lambda r: (-r[3], r[0])), 5)
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["choice"])] == [r[0] for r in want]


def test_limiter_does_not_count_refused_hits(spark):
    from datetime import datetime

    t0 = datetime(2025, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 59, 60, 61, 62])]
    out = sales.limiter(spark.createDataFrame(rows, "k string, t timestamp, e int"), "k", "t", 2, 60, "e").collect()
    assert [r["allowed"] for r in sorted(out, key=lambda r: r["e"])] == [True, True, False, False, False, True, True, False]


def test_must_hold_stops_the_job(spark):
    df = spark.range(3)
    assert reports.must_hold(df, F.col("id") > 5, "no").count() == 3
    with pytest.raises(Exception, match="too many"):
        reports.must_hold(df, F.col("id") > 1, "too many").collect()


def test_preferences_are_an_equi_join(spark):
    items = spark.createDataFrame([(1, "HIGH", "a", 1), (2, "LOW", "b", 2)], "id int, band string, cat string, region int")
    wants = spark.createDataFrame([("x", "LOW", ["b"], []), ("y", "MEDIUM", [], []), ("z", "LOW", [], [2])], "who string, least_band string, categories array<string>, regions array<int>")
    out = sales.preferred(items, wants, "band", "cat", "region")
    assert sorted((r["id"], r["who"]) for r in out.collect()) == [(1, "y"), (2, "x"), (2, "z")]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_lookup_makes_no_pairs_of_a_group(spark):
    left = spark.range(300).select("id", F.lit("oats").alias("name"))
    right = spark.range(3000).select(F.col("id").alias("number"), F.lit("oats").alias("key"))
    out = rel.blocked_lookup(left, right, "id", F.col("name"), F.col("key"), ["number"])
    rows = out.collect()
    assert len(rows) == 300 * 25
    assert {r["number"] for r in rows} == set(range(25))
    metrics = out._jdf.queryExecution().executedPlan().toString()
    assert metrics.index("Join") < metrics.index("Window")  # the plan's top is the join: nothing is cut after it


def test_group_size_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "x", None)], "id int, k string, l string")
    assert {r["id"]: r["n"] for r in rel.group_size(df, ["k", "l"], "n").collect()} == {1: 2, 2: 2, 3: 1}


def test_pairs_that_share_a_token_or_hold_a_key(spark):
    a = spark.createDataFrame([(1, "g", ["x", "y"]), (2, "g", ["z"]), (3, "h", ["x", "y"])], "id int, k string, w array<string>")
    b = a.select(F.col("id").alias("other"), "k", F.col("w").alias("v"))
    got = rel.sharing(a, b, ["k"], F.col("w"), F.col("v")).collect()
    assert sorted((r["id"], r["other"]) for r in got) == [(1, 1), (2, 2), (3, 3)]
    names = spark.createDataFrame([("oat",), ("oatmealfactory",), ("",), (None,)], "a string")
    whole = spark.createDataFrame([("bigoatmealfactory",), ("groats",), ("rye",), (None,)], "b string")
    assert sorted(tuple(r) for r in rel.contained(names, whole, F.col("a"), F.col("b")).collect()) == [("oat", "bigoatmealfactory"), ("oat", "groats"), ("oatmealfactory", "bigoatmealfactory")]


def test_report_rules(spark):
    counts = spark.createDataFrame([(10, 20, 4), (5, 5, 0), (9, 9, 9)], "food_class int, packaged int, matched int")
    assert [r["concern"] for r in reports.match_concerns(counts).collect()] == ["few applicants were matched", "no applicant was matched", None]
    rows = [("a", "HIGH", None, 90, None, "x"), ("b", "HIGH", "1", 60, None, " "), ("c", "SUPPRESS", "1", 60, 200, "x")]
    df = spark.createDataFrame(rows, "id string, band string, number string, confidence int, late int, brand string").withColumn("filed", F.lit(date(2025, 1, 1)))
    checks = reports.output_checks(band=F.col("band"), number=F.col("number"), confidence=F.col("confidence"), incorporated=F.date_add("filed", F.col("late")), filed=F.col("filed"), brand=F.col("brand"))
    assert [tuple(r) for r in reports.suspicious(df, "id", checks).collect()] == [("a", "high_without_company"), ("b", "high_on_weak_match"), ("b", "no_brand"), ("c", "incorporated_after_filing")]
    assert tuple(reports.band_counts(df, F.col("band")).first()) == (2, 0, 1)
    levels = rel.thresholds(spark.createDataFrame([(80, "w1"), (60, "w2"), (10, "w2")], "s int, w string"), F.col("s"), [75, 50], "w")
    assert [tuple(r) for r in levels.collect()] == [(75, 1, 0.5), (50, 2, 1.0)]
    bad = rel.with_detail(rel.decide(spark.createDataFrame([(1, "FR"), (2, "GB")], "id int, c string"), "s", [("abroad", F.col("c") == "FR")]), {"abroad": F.col("c")})
    assert [tuple(r) for r in rel.rejections(bad, "id").collect()] == [(1, "s", "abroad", "FR")]
    from tidemark.functions import text as X

    text = spark.createDataFrame([("notes\n---\nDear {{NAME}}, {{REST}}\n---\nmore",)], "t string").select(X.substituted(X.template_body(F.col("t")), NAME=F.lit("Jo")).alias("b"))
    assert text.select("b", X.leftover_tokens(F.col("b"))).first()[:] == ("Dear Jo, {{REST}}", ["{{REST}}"])


def test_keys_that_begin_alike_meet_only_where_one_holds_the_other(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abü") for _ in range(rng.randint(1, n)))
    left = [(i, f"{rng.choice(['', 'customer'])}{word(9)}") for i in range(300)] + [(300, "aa"), (301, "customer")]
    right = [(i, f"{rng.choice(['', 'customer'])}{word(30)}") for i in range(300)] + [(300, "aaaa"), (301, "customercustomer"), (302, "aaaa")]
    a, b = spark.createDataFrame(left, "id int, a string"), spark.createDataFrame(right, "other int, b string")
    found = rel.contained(a, b, F.col("a"), F.col("b"))
    got = sorted((r["id"], r["other"]) for r in found.collect())
    assert got == sorted((i, j) for i, x in left for j, y in right if x in y)
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()  # joined on whole keys: no pair is made to be dropped
