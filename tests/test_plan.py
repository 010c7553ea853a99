from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counters
from tidemark.plans import delivery, early_signal
from tidemark.schemas import FILING
from tidemark.sources import ledger

CRUMB = "Crumb Foods Ltd"
F1, PUB = date(2025, 9, 1), date(2025, 12, 12)


def filing(n, mark="Crumb", applicant="", classes=(30,), goods="bread; cakes; biscuits", status="Published", country="GB", kind="Word", batch="2025-050", filed=F1):
    applicant = f"Maker {n} Ltd" if applicant == "" else applicant
    return (n, mark, kind, None, filed, PUB, applicant, country, None, None, list(classes), goods, goods is not None, 0, status, batch, None, "test", int(n[1:]))


@pytest.fixture(scope="module")
def companies(spark):
    rows = [("Crumb Foods Limited", "1", date(2025, 3, 1), None), ("Old Mill Ltd", "2", date(2000, 1, 1), None), ("Late Ltd", "3", date(2026, 6, 1), None), ("Gone Ltd", "4", date(2024, 1, 1), date(2025, 1, 1))]
    df = spark.createDataFrame(rows, "company_name string, company_number string, incorporation_date date, dissolution_date date")
    return df.selectExpr("*", "'Active' company_status", "array('10710') sic_codes", "'Kent' region", "'MICRO ENTITY' accounts_category")


@pytest.fixture(scope="module")
def result(spark, companies):
    rows = [
        filing("f1", applicant=CRUMB), filing("f2", status=" WITHDRAWN "), filing("f3", mark=" "), filing("f4", classes=(43,)), filing("f5", classes=(9,)), filing("f6", classes=(33,)), filing("f7", goods="tobacco and bread"),
        filing("f8", applicant="The Nestle Group"), filing("f9", country="FR"), filing("f10", applicant="Old Mill Ltd"), filing("f11", applicant="Late Ltd"), filing("f12", applicant="Gone Ltd"), filing("f13", mark="Other", applicant=CRUMB),
        filing("f1", mark="CRUMB ", applicant=CRUMB), *[filing(f"f{20 + i}", mark=f"M{i}", applicant="Many Marks Ltd") for i in range(8)], filing("f40", applicant=None, country=None, filed=None), filing("f41", applicant=None, goods=None),
    ]
    return early_signal.run(spark.createDataFrame(rows, FILING), companies)


def test_first_reason_of_each_filing(result):
    got = {r["filing_id"]: r["reason"] for r in result.rejections.collect()}
    assert got == {"f2": "dead_status", "f3": "no_brand_name", "f4": "services_only", "f5": "no_food_class", "f6": "supporting_class_only", "f7": "excluded_goods", "f8": "major_brand", "f9": "not_uk", "f10": "too_established", "f12": "dissolved_when_filed", **{f"f{20 + i}": "portfolio" for i in range(8)}}


def test_nothing_is_lost(result):
    counts = result.counts.first()
    assert counts["raw"] == 24
    assert counts["raw"] == result.rejections.count() + result.scored.count() + result.duplicates.count()
    assert counts["food_class"] == 22
    assert result.duplicates.count() == 1


def test_scores_and_caps(result):
    rows = {r["filing_id"]: r for r in result.scored.collect()}
    assert rows["f1"]["company_number"] == "1"
    assert rows["f1"]["score"] <= 79
    assert rows["f11"]["company_number"] is None
    assert rows["f11"]["score"] <= 74
    assert rows["f40"]["company_key"] != rows["f41"]["company_key"]
    assert all(0 <= r["score"] <= 100 for r in rows.values())


def test_one_opportunity_for_each_company(result):
    keys = [r["company_key"] for r in result.opportunities.collect()]
    assert len(keys) == len(set(keys))
    crumb = next(r for r in result.opportunities.collect() if r["company_key"] == "ch:1")
    assert crumb["n_rows"] == 2
    assert len(crumb["other_marks"]) == 1


def test_same_result_for_any_partitioning(spark, companies):
    rows = [filing(f"f{i}", mark=f"m{i % 5}", applicant=f"Maker {i % 7} Ltd") for i in range(1, 40)]
    df = spark.createDataFrame(rows, FILING)
    a, b = (sorted((r["filing_id"], r["score"], r["n_rows"]) for r in early_signal.run(df.repartition(n), companies).opportunities.select("filing_id", "score", "n_rows").collect()) for n in (1, 17))
    assert a == b


def test_empty_batch(spark, companies):
    result = early_signal.run(spark.createDataFrame([], FILING), companies)
    assert result.opportunities.count() == 0
    assert result.counts.first()["raw"] == 0


def test_a_stopped_run_publishes_nothing_and_a_run_is_published_once(spark, companies, result, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(counters.Stopped, match="enriched: far from the usual 900 rows .raw=1,"):
        delivery.publish(early_signal.run(spark.createDataFrame([filing("f1", applicant=CRUMB)], FILING), companies, guards=[counters.unusual("enriched", "raw", 900)]), root, "2025-050")
    assert ledger.entries(spark, root) == []
    assert [delivery.publish(result, root, "2025-050") for _ in range(2)] == [True, False]
    got = ledger.read(spark, root, "delivered", delivery.rows(result.opportunities).schema)
    assert sorted(r["trademark_number"] for r in got.collect()) == sorted(r["filing_id"] for r in result.opportunities.collect())
    assert ledger.read(spark, root, "counts", result.counts.schema).first()["scored"] == result.scored.count()


def test_guards():
    stop = lambda guard, **n: guard.odd(n)
    assert [stop(counters.unusual("s", "n", 9), n=n) for n in (3, 27, 2, 28, 0)] == [False, False, True, True, True]
    assert stop(counters.unusual("s", "n", 0), n=5) is False
    assert [stop(counters.failing("s", "bad", "n"), bad=b, n=n) for b, n in ((0, 0), (1, 2), (2, 3))] == [False, False, True]
    assert stop(counters.too_few("s", "n", 1), n=0)


def test_counts_of_one_pass_equal_a_scan(spark):
    df = spark.range(0, 1000, 1, 7).repartition(5).withColumn("x", F.col("id") % 3)
    rows, n = counters.counted(df, "counted", {"all": F.count("*"), "zeros": F.count_if(F.col("x") == 0), "most": F.max("id")})
    assert n == {"all": rows.count(), "zeros": rows.where("x = 0").count(), "most": 999}
    assert counters.counted(df.where("id < 0"), "none", {"all": F.count("*"), "most": F.max("id")})[1] == {"all": 0, "most": 0}


def test_web_evidence_gives_a_website(spark, companies):
    rows = [("Crumb", 1, "Crumb bakery", "https://www.crumb.com/", "Crumb Foods bread, launching soon, add to basket"), ("Crumb", 2, "Crumb news", "https://www.elsewhere.com/", "a crumb of comfort"), ("Crumb", 3, "Bread", "https://www.tesco.com/", "other bread")]
    evidence = spark.createDataFrame(rows, "query string, rank int, title string, url string, snippet string")
    row = early_signal.run(spark.createDataFrame([filing("f1", applicant=CRUMB)], FILING), companies, evidence).scored.first()
    assert (row["website"], row["site"], row["verdict"]) == ("crumb.com", "https://www.crumb.com", "VERIFIED")
    assert (row["site_maturity"], row["stage_of_launch"], row["brand_maturity"], row["retail_presence"]) == ("early_stage", "early_launch", "emerging", "direct_only")
    keys = {x["key"] for x in row["reasons"]}
    assert {"early_stage_website", "no_major_retail_listings", "active_launch_signals", "company_incorporated_within_12m", "small_company_accounts", "food_sic_code_match"} <= keys
    assert row["cap"] is None


def test_evidence_about_others_counts_for_nothing(spark, companies):
    rows = [("Crumb", i, "Crumb", f"https://shop{i}.com/", "sold nationwide, a household name") for i in range(1, 4)] + [("Crumb", 4, "Crumb", "https://www.tesco.com/", "crumb")]
    evidence = spark.createDataFrame(rows, "query string, rank int, title string, url string, snippet string")
    row = early_signal.run(spark.createDataFrame([filing("f1", applicant=CRUMB)], FILING), companies, evidence).scored.first()
    assert (row["known"], row["verdict"], row["brand_maturity"], row["cap"] in (None, "no_web")) == (False, "UNVERIFIED", "unknown", True)


def test_category_where_goods_tell_none(spark, companies):
    rows = early_signal.run(spark.createDataFrame([filing("f1", applicant=CRUMB, goods=None), filing("f2", mark="Moor Creamery", applicant="Nobody Knows Ltd", goods=None), filing("f3", mark="Plain", applicant="Nobody Else Ltd", goods=None)], FILING), companies).scored.collect()
    assert {r["filing_id"]: (r["category"], r["category_label"]) for r in rows} == {"f1": ("bakery", "Bakery"), "f2": ("dairy", "Dairy"), "f3": (None, None)}


def test_rules_of_another_version(spark, companies):
    import json

    from tidemark import rulebook

    found = json.loads(rulebook.shipped().sections)
    found["scoring"]["base"] = 0
    found["intent"]["default"] = {k: "NONE" for k in found["intent"]["suppliers"]}
    found["intent"]["groups"], found["intent"]["stages"] = {}, {}
    book = rulebook.checked(found)
    filings = spark.createDataFrame([filing("f1", applicant=CRUMB), filing("f2", goods="tea"), filing("f3", goods=None)], FILING)
    first, second = early_signal.run(filings, companies), early_signal.run(filings, companies, book=book)
    a, b = ({r["filing_id"]: r for r in x.scored.collect()} for x in (first, second))
    assert a and a.keys() == b.keys()
    assert {r["rules_version"] for r in a.values()} == {rulebook.shipped().version} and {r["rules_version"] for r in b.values()} == {book.version}
    assert all(b[k]["score"] <= a[k]["score"] for k in a) and any(b[k]["score"] < a[k]["score"] for k in a)
    assert all(set(r["intent"].values()) == {"NONE"} for r in b.values())
