from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("The Café & Sons Ltd.", "cafe and sons"), ("ACME  Foods LIMITED", "acme foods"), ("Co", ""), (None, ""), ("Ñandú-Bio S.A.", "nandu bio s a"), ("the the Ltd Co Ltd", "the")],
)
def test_company_name(spark, name, expected):
    assert one(spark, X.company_name(F.lit(name).cast("string"))) == expected


def test_name_key_and_legal_form(spark):
    assert one(spark, X.name_key(F.lit("The Big  Oat Co"))) == "bigoat"
    assert one(spark, X.has_legal_form(F.lit("Oat Ltd"))) is True
    assert one(spark, X.has_legal_form(F.lit("Jane Oat"))) is False


def test_jaccard_and_sets(spark):
    a, b = X.tokens(F.lit("red oat bar")), X.tokens(F.lit("oat bar bar"))
    assert one(spark, X.jaccard(a, b)) == pytest.approx(2 / 3)
    assert one(spark, X.jaccard(a, X.tokens(F.lit("")))) == 0
    assert one(spark, X.subset(b, a)) is True
    assert one(spark, X.subset(a, a)) is False
    assert one(spark, X.missing(a, b)) == ["red"]


def test_summarise(spark):
    assert one(spark, X.summarise(F.lit("a  b\nc"), 10)) == "a b c"
    assert one(spark, X.summarise(F.lit("hello wonderful world"), 10)) == "hello…"
    assert one(spark, X.summarise(F.lit("hellowonderful"), 5)) == "hello…"
    assert one(spark, X.summarise(F.lit(None).cast("string"), 5)) == ""


def test_urls(spark):
    url = F.lit("https://user@WWW.Shop.example.com:8080/news/a?x=1")
    assert one(spark, X.domain(url)) == "shop.example.com:8080"
    assert one(spark, X.is_article(url)) is True
    assert one(spark, X.is_article(F.lit("https://a.com/about"))) is False
    assert one(spark, X.domain(F.lit("not a url"))) is None
    assert one(spark, X.domain_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]


def test_emails(spark):
    assert one(spark, X.is_work_email(F.lit("a@firm.co.uk"))) is True
    assert one(spark, X.is_work_email(F.lit("a@gmail.com"))) is False
    assert one(spark, X.is_email(F.lit("a@b"))) is False
    assert one(spark, X.is_email(F.lit(None).cast("string"))) is False


def test_render_drops_bracket_of_missing_fact(spark):
    t = "matched (since {year}) in {place}"
    assert one(spark, X.render(t, year=F.lit(None).cast("string"), place=F.lit("Leeds"))) == "matched in Leeds"
    assert one(spark, X.render(t, year=F.lit(2020), place=F.lit("Leeds"))) == "matched (since 2020) in Leeds"
    assert one(spark, X.leftover_tokens(F.lit("Dear {{NAME}}, {{X}}"))) == ["{{NAME}}", "{{X}}"]


def test_evidence_clean_hash_street(spark):
    reasons = F.array(F.lit("old"), F.lit("has a Launch date"))
    assert one(spark, X.first_evidence(reasons, ("launch",), "none")) == "has a Launch date"
    assert one(spark, X.first_evidence(F.array().cast("array<string>"), ("launch",), "none")) == "none"
    assert one(spark, X.clean(F.lit(" a\x00b\x07 "), 5)) == "ab"
    assert len(one(spark, X.salted_hash(F.lit("1.2.3.4"), "s"))) == 32
    assert one(spark, X.has_street(F.lit("12 High Street"))) is True
    assert one(spark, X.hyperlink(F.lit('x http://a.b/c "'), "f")) == "https://a.b/c"
    assert one(spark, X.postcode_area(F.lit("BS1 4TR"))) == "BS1"


def test_dates(spark):
    xml = (("yyyy-MM-dd", 10), ("dd/MM/yyyy", 10))
    assert one(spark, D.parse(F.lit("2025-12-12T00:00"), *xml)) == date(2025, 12, 12)
    assert one(spark, D.parse(F.lit("31/02/2025"), *xml)) is None
    assert one(spark, D.last_friday(F.lit(date(2025, 12, 14)))) == date(2025, 12, 12)
    assert one(spark, D.last_friday(F.lit(date(2025, 12, 12)))) == date(2025, 12, 12)
    assert one(spark, D.next_friday(F.lit(date(2025, 12, 12)))) == date(2025, 12, 19)
    assert one(spark, D.batch_number(F.lit(date(2025, 12, 12)))) == "2025-050"
    assert one(spark, D.batch_date(F.lit("2025-050"))) == date(2025, 12, 12)
    assert one(spark, D.batches_between(F.lit(date(2025, 12, 6)), F.lit(date(2025, 12, 20)))) == [date(2025, 12, 12), date(2025, 12, 19)]
    assert one(spark, D.age_years(F.lit(date(2024, 1, 1)), F.lit(date(2025, 1, 1)))) == 1.0
    assert one(spark, D.age_phrase(F.lit(0.0))) == "under a month"
    assert one(spark, D.age_phrase(F.lit(0.08))) == "1 month"
    assert one(spark, D.age_phrase(F.lit(3.2))) == "3 years"
    assert one(spark, D.is_stale(F.lit(date(2025, 1, 1)), F.lit(date(2025, 1, 23)))) is True
    assert one(spark, D.is_stale(F.lit(date(2025, 1, 1)), F.lit(date(2025, 1, 22)))) is False


def test_values(spark):
    assert one(spark, V.class_list(F.lit("30, 29;5 / 99 x30 Class 7"))) == [5, 7, 29, 30]
    assert one(spark, V.class_list(F.lit(None).cast("string"))) == []
    assert one(spark, V.flags_to_classes([F.lit("1"), F.lit("0"), F.lit(None).cast("string"), F.lit("Y"), F.lit("No")])) == [1, 4]
    assert one(spark, V.at_least(F.lit("HIGH"), F.lit("MEDIUM"))) is True
    assert one(spark, V.at_least(F.lit("odd"), F.lit("NONE"))) is False
    assert one(spark, V.shifted(F.lit("HIGH"), 1)) == "HIGH"
    assert one(spark, V.shifted(F.lit("UNKNOWN"), 1)) == "UNKNOWN"
    assert one(spark, V.share(F.lit(1), F.lit(0))) == 0
    assert one(spark, V.pounds(F.lit(123456))) == "£1,234.56"
    got = one(spark, V.intent_map(F.create_map(F.lit("a"), F.lit("LOW")), F.lit(False), ("a", "b")))
    assert got == {"a": "LOW", "b": "UNKNOWN"}


@pytest.mark.parametrize(
    ("answer", "ok"),
    [
        ('{"category": "x", "probability": 0.5, "is_product": true}', True),
        ('Sure: {"category": "x", "probability": 0.5, "is_product": true} bye', True),
        ('{"category": "y", "probability": 0.5, "is_product": true}', False),
        ('{"category": "x", "probability": 1.5, "is_product": true}', False),
        ('{"category": "x", "probability": 0.5}', False),
        ("no json", False),
        ("", False),
        (None, False),
    ],
)
def test_judgement(spark, answer, ok):
    assert (one(spark, V.valid_judgement(F.lit(answer).cast("string"), ("x",))) is not None) is ok


def test_a_judgement_is_parsed_once_for_a_merged_value(spark):
    rows = [(1, '{"category": "x", "probability": 0.5, "is_product": true}'), (2, '{"category": "x", "probability": 0.01, "is_product": true}'), (3, "no json"), (4, None)]
    df = spark.createDataFrame(rows, "id int, answer string")
    probability, alone = V.merged(F.lit(0.25), V.valid_judgement(F.col("answer"), ("x",))["probability"], 0.05, 0.95)
    got = df.select("id", probability.alias("p"), alone.alias("alone"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 0.375, False), (2, 0.25, True), (3, 0.25, True), (4, 0.25, True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2  # one for each column, not one for each use of a field
