import csv
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import rules as R
from tidemark.operators import scoring as S
from tidemark.plans import delivery, early_signal
from tidemark.sources import readers as readers
from tidemark.sources import writers as E

RECORD = """<TradeMark><ApplicationNumber>{n}</ApplicationNumber><ApplicationDate>2025-09-01</ApplicationDate><PublicationDate>2025-12-12</PublicationDate><MarkFeature>Word</MarkFeature>
<MarkVerbalElementText>{mark}</MarkVerbalElementText><MarkCurrentStatusCode>Published</MarkCurrentStatusCode><ApplicantDetails><Applicant><OrganizationName>{who}</OrganizationName><CountryCode>GB</CountryCode></Applicant></ApplicantDetails>
<GoodsServicesDetails><ClassDescription><ClassNumber>30</ClassNumber><GoodsServicesDescription><![CDATA[bread; cakes & biscuits]]></GoodsServicesDescription></ClassDescription></GoodsServicesDetails></TradeMark>"""


@pytest.fixture(scope="module")
def companies(spark):
    df = spark.createDataFrame([("Crumb Foods Limited", "1", date(2025, 3, 1), None), ("Rye Ltd", "2", date(2025, 1, 1), None)], "company_name string, company_number string, incorporation_date date, dissolution_date date")
    return df.selectExpr("*", "'Active' company_status", "array('10710') sic_codes", "'Kent' region", "'MICRO ENTITY' accounts_category")


@pytest.fixture(scope="module")
def opportunities(spark, companies, tmp_path_factory):
    folder = tmp_path_factory.mktemp("journal")
    marks = [("UK1", "Crumb", "Crumb Foods Ltd"), ("UK2", "Crust", "Crumb Foods Ltd"), ("UK3", "Rye", "Rye Ltd"), ("UK4", "Shop", "Nobody Knows Ltd")]
    (folder / "j.xml").write_text("<Journal>" + "".join(RECORD.format(n=n, mark=m, who=w) for n, m, w in marks) + "</Journal>")
    filings = readers.read_filings(spark, "xml", str(folder / "j.xml"), "2025-050")
    found = [("Crumb", 1, "Crumb bakery", "https://www.crumb.com/", "Crumb Foods bread, launching soon, add to basket"), ("Crumb", 2, "Crumb news", "https://www.bbc.co.uk/food", "Crumb Foods, a household name"), ("Crumb", 3, "Bread", "https://www.tesco.com/", "other bread")]
    evidence = spark.createDataFrame(found, "query string, rank int, title string, url string, snippet string")
    return early_signal.run(filings, companies, evidence).opportunities


def test_from_filings_to_the_file_and_back(spark, opportunities, tmp_path):
    assert delivery.missing_suppliers(opportunities).count() == 0
    delivery.write(opportunities, str(tmp_path / "x"))
    name = next((tmp_path / "x").glob("part-*"))
    with open(name, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == list(E.CSV_COLUMNS)
    assert len(E.CSV_COLUMNS) == 32
    crumb = next(r for r in rows if r["company_number"] == "1")
    assert (crumb["brand_name"], crumb["trademark_number"], crumb["other_marks"], crumb["other_brand_names"]) == ("Crumb", "UK1", "UK2", "Crust")
    assert (crumb["filing_date"], crumb["publication_date"], crumb["company_incorporation_date"], crumb["company_region"]) == ("2025-09-01", "2025-12-12", "2025-03-01", "Kent")
    assert (crumb["website"], crumb["website_status"], crumb["launch_stage"], crumb["retail_presence"], crumb["brand_maturity"]) == ("https://www.crumb.com", "Confirmed", "Early launch", "Direct / own site only", "Emerging")
    assert (crumb["packaging_relevance"], crumb["carton_relevance"], crumb["marketing_relevance"], crumb["distribution_relevance"]) == ("HIGH", "HIGH", "HIGH", "HIGH")
    assert all(r[c] in ("HIGH", "MEDIUM", "LOW", "NONE") for r in rows for c in delivery.RELEVANCE.values())
    assert crumb["evidence_urls"].split(" ") == ["https://www.crumb.com/", "https://www.bbc.co.uk/food"]
    assert crumb["goods_summary"].startswith("bread; cakes & biscuits")
    assert [int(r["score"]) for r in rows] == sorted((int(r["score"]) for r in rows), reverse=True)
    back = readers.read_leads(spark, str(tmp_path / "x"), ())
    assert back.columns == list(E.CSV_COLUMNS)
    assert {r["trademark_number"] for r in back.collect()} == {r["trademark_number"] for r in rows}


def test_sample_holds_back_what_it_must(spark, opportunities):
    delivered = delivery.rows(opportunities)
    kept, held = delivery.sample(delivered)
    assert kept.columns == list(E.SAMPLE_COLUMNS)
    rows = kept.collect()
    assert rows and all(r["company_number"] and r["why_selected"] for r in rows)
    assert next(r for r in rows if r["company_number"] == "1")["launch_stage"].startswith("Early launch")
    assert sum(r["n"] for r in held.collect()) + len(rows) == delivered.count()
    odd = delivered.limit(1).selectExpr("* except (company_number, score, score_band)", "cast(null as string) company_number", "cast(null as int) score", "'HIGH' score_band")
    assert [tuple(r) for r in delivery.sample(odd)[1].collect()] == [("below the minimum score", 1)]


def test_empty_run_delivers_a_header(spark, opportunities, tmp_path):
    delivery.write(opportunities.limit(0), str(tmp_path / "x"))
    assert readers.read_leads(spark, str(tmp_path / "x"), ()).count() == 0
    assert delivery.sample(delivery.rows(opportunities.limit(0)))[1].count() == 0


@pytest.mark.parametrize(
    ("group", "stage", "want"),
    [(None, "unknown", R.INTENT_DEFAULT), ("bakery", "pre_launch", {"flexible_packaging": "HIGH", "labels": "HIGH", "brokerage": "LOW", "fulfilment": "LOW"}), ("sauce", "established", {"flexible_packaging": "NONE", "labels": "MEDIUM", "marketing": "LOW"}), ("none such", None, R.INTENT_DEFAULT), (None, "established", {"cartons": "NONE", "labels": "LOW"})],
)
def test_intents(spark, group, stage, want):
    got = spark.range(1).select(S.intent(F.lit(group).cast("string"), F.lit(stage).cast("string")).alias("m")).first()["m"]
    assert set(got) == set(R.SUPPLIERS)
    assert {k: got[k] for k in want} == want
