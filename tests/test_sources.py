import gzip
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.sources import readers as S
from tidemark.sources import writers as E

XML = """<?xml version="1.0"?>
<T xmlns="http://example.org/marks"><B>
<TradeMark><ApplicationNumber>A1</ApplicationNumber><ApplicationDate>2025-09-15T00:00:00</ApplicationDate><MarkVerbalElementText>RED &amp; OAT</MarkVerbalElementText>
 <PublicationDate>12/12/2025</PublicationDate><ClassNumber>30</ClassNumber><ClassNumber>99</ClassNumber><ClassNumber>29</ClassNumber>
 <GoodsServicesDescription>Bread;  cakes.</GoodsServicesDescription><GoodsServicesDescription>Tea.</GoodsServicesDescription>
 <Name>not this</Name><ApplicantDetails><Applicant><Name><FreeFormatNameLine> Oat Ltd </FreeFormatNameLine></Name><CountryCode>GB</CountryCode><PostcodeText>BS1 4TR</PostcodeText></Applicant></ApplicantDetails></TradeMark>
<TradeMark><ApplicationNumber>A2</ApplicationNumber><ApplicationDate>2025-99-99</ApplicationDate><MarkText>crossing<b></MarkText></b></TradeMark>
<TradeMark><MarkText>no number</MarkText></TradeMark>
<ns:TradeMark xmlns:ns="x"><ns:RegistrationNumber>A4</ns:RegistrationNumber><ns:MarkText>Prefixed</ns:MarkText></ns:TradeMark>
<TradeMarkRecord><ApplicationNumber>A5</ApplicationNumber><MarkText>Other tag</MarkText></TradeMarkRecord>
</B></T>"""


def test_xml_keeps_good_records_beside_broken_ones(spark, tmp_path):
    (tmp_path / "j.xml").write_text(XML)
    rows = {r["filing_id"]: r for r in S.read_filings_xml(spark, str(tmp_path / "j.xml"), "2025-050").collect()}
    assert {"A1", "A2", "A5"} <= set(rows)
    a = rows["A1"]
    assert (a["mark_text"], a["filing_date"], a["publication_date"]) == ("RED & OAT", date(2025, 9, 15), date(2025, 12, 12))
    assert (a["applicant_name"], a["applicant_country"], a["applicant_postcode_area"]) == ("Oat Ltd", "GB", "BS1")
    assert a["nice_classes"] == [29, 30]
    assert a["goods_text"] == "Bread; cakes. Tea."
    assert rows["A2"]["filing_date"] is None
    assert rows["A2"]["goods_text_available"] is False


def test_xml_gzip_and_zip(spark, tmp_path):
    with gzip.open(tmp_path / "j.xml.gz", "wt") as f:
        f.write(XML)
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("note.txt", "x")
        z.writestr("a.xml", XML)
    S.unzip(spark, str(tmp_path / "j.zip"), str(tmp_path / "out"))
    a, b = (S.read_filings_xml(spark, str(tmp_path / p), "b").count() for p in ("j.xml.gz", "out"))
    assert a == b == S.read_filings_xml(spark, str(tmp_path / "j.xml.gz"), "b", tags=("TradeMark", "TradeMarkRecord")).count()


HEAD = "Trade Mark|Mark Text|Filed|Published|Name|Country|No of Marks in Series|Status|Class1|Class30|Hyperlink"
TEXT = [HEAD, 'T1|Oat|2025-09-15|12/12/2025|Oat Ltd|GB|x|Live|0|1|=HYPERLINK("http://a.b/T1","T1")', "T2|Short|2025-09-15|x|N", "", "T3|too|few", "|no number|2025-01-01|x|y|z", "T4|All|20250915|20251212|N|GB|2|Live|Y|No|"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_delimited_text(spark, tmp_path, encoding):
    (tmp_path / "w.txt").write_text("\r\n".join(TEXT), encoding=encoding)
    rows = {r["filing_id"]: r for r in S.read_filings(spark, "text", str(tmp_path / "w.txt"), "b", case_url="https://c/").collect()}
    assert set(rows) == {"T1", "T2", "T4"}
    assert rows["T1"]["nice_classes"] == [30]
    assert rows["T1"]["source_url"] == "https://a.b/T1"
    assert (rows["T1"]["series_count"], rows["T4"]["series_count"]) == (0, 2)
    assert rows["T2"]["nice_classes"] == []
    assert rows["T2"]["source_url"] == "https://c/T2"
    assert rows["T4"]["filing_date"] == date(2025, 9, 15)


def test_dispatch_and_emptiness(spark, tmp_path):
    with pytest.raises(ValueError, match="no parser"):
        S.read_filings(spark, "pdf", "x", "b")
    with pytest.raises(ValueError, match="no records"):
        S.at_least_one(spark.range(0), "x")
    (tmp_path / "w.txt").write_text("nothing here")
    with pytest.raises(ValueError, match="header"):
        S.read_filings_text(spark, str(tmp_path / "w.txt"), "b")


def test_register(spark, tmp_path):
    (tmp_path / "c.csv").write_text(' CompanyName, CompanyNumber,CompanyStatus,IncorporationDate,SICCode.SicText_1,SICCode.SicText_2,RegAddress.County\n"Oat, Foods Ltd",1,Active,31/01/2024,10710 - Bread,,Kent\n,2,Active,,,,\n')
    rows = S.read_register(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["company_name"], r["name_key"], r["sic_codes"], r["incorporation_date"], r["region"]) for r in rows] == [("Oat, Foods Ltd", "oatfoods", ["10710"], date(2024, 1, 31), "Kent")]
    (tmp_path / "c.json").write_text(json.dumps([{"company_name": "Oat Ltd", "company_number": "1", "incorporation_date": "31/01/2024"}]))
    assert S.read_register_json(spark, str(tmp_path / "c.json")).first()["incorporation_date"] == date(2024, 1, 31)


def test_evidence(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"oat bar": [{"title": "t", "url": "u1", "snippet": "s"}, {"title": "t2", "url": "u2", "snippet": ""}], "none": []}))
    rows = S.read_evidence(spark, str(tmp_path / "e.json"))
    assert [(r["query"], r["rank"], r["url"]) for r in rows.orderBy("rank").collect()] == [("oat bar", 1, "u1"), ("oat bar", 2, "u2")]
    asked = spark.createDataFrame([("Oat",), ("zzz",)], "query string")
    assert S.evidence_containing(asked, rows).count() == 2


def test_batches_snapshot_and_payloads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("journal_2025-050.xml", "week_2025-12-19.txt", "other.txt"):
        (tmp_path / "in" / n).write_text("<?xml " + "x" * 20)
    assert sorted(r["batch_id"] for r in S.read_batches(spark, str(tmp_path / "in")).collect()) == ["2025-050", "2025-051"]
    ok = S.valid_payloads(spark, str(tmp_path / "in"), 10).where("is_xml and long_enough").count()
    assert ok == 3
    assert S.integrity(spark, str(tmp_path / "in")).where("length(sha256) = 64").count() == 3
    snap = spark.range(300).select(F.when(F.col("id") < 150, F.lit(date(2025, 12, 12))).when(F.col("id") < 290, F.lit(date(2025, 12, 19))).otherwise(F.lit(date(2025, 12, 26))).alias("publication_date"), "id")
    assert [r[0] for r in S.complete_batches(snap, 2).collect()] == [date(2025, 12, 19), date(2025, 12, 12)]
    S.slice_snapshot(snap, [date(2025, 12, 12)], str(tmp_path / "slices"))
    assert spark.read.parquet(str(tmp_path / "slices")).count() == 150


def test_images_and_element_counts(spark, tmp_path):
    assert spark.range(1).select(S.without_images(F.lit("a<ns:ImageData x='1'>zz\nz</ns:ImageData>b"))).first()[0] == "ab"
    (tmp_path / "j.xml").write_text(XML)
    assert S.element_counts(spark, str(tmp_path / "j.xml")).where("element = 'ClassNumber'").first()["n"] == 3


def test_leads_prospects_feedback(spark, tmp_path):
    (tmp_path / "l.csv").write_text("\ufeffbrand_name,packaging_relevance,score\nOat,,80\n", encoding="utf-8")
    lead = S.read_leads(spark, str(tmp_path / "l.csv"), ("packaging_relevance", "label_relevance")).first()
    assert (lead["brand_name"], lead["packaging_relevance"], lead["label_relevance"], lead["score"]) == ("Oat", "NONE", "UNKNOWN", 80)
    (tmp_path / "p.csv").write_text("\ufeffprospect_id,company_name\np1,Oat\n", encoding="utf-8")
    assert S.read_prospects(spark, str(tmp_path / "p.csv")).first()["research_notes"] is None
    (tmp_path / "f.csv").write_text("trademark_number,state,note\n1,useful,x\n2,,y\n3,odd,z\n")
    good, bad = S.read_feedback(spark, str(tmp_path / "f.csv"), ("USEFUL",))
    assert [r["trademark_number"] for r in good.collect()] == ["1"]
    assert [r["problem"] for r in bad.collect()] == ["unknown state ODD"]


def test_first_available(spark):
    assert S.first_available(lambda: None, lambda: spark.range(0), lambda: spark.range(2)).count() == 2
    with pytest.raises(ValueError, match="no source"):
        S.first_available(lambda: None)


def test_extract_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Oat", 80, ["a", "b"], "pre_launch", None), ('Q"x', 90, [], "odd", "s")], "brand_name string, score int, score_reasons array<string>, launch_stage string, website string")
    E.write_extract(df, str(tmp_path / "x"), F.desc("score"))
    name = next((tmp_path / "x").glob("part-*"))
    assert name.read_bytes()[:3] == b"\xef\xbb\xbf"
    back = S.read_leads(spark, str(tmp_path / "x"), ())
    assert back.columns == list(E.CSV_COLUMNS)
    assert [(r["brand_name"], r["launch_stage"]) for r in back.collect()] == [('Q"x', "odd"), ("Oat", "Pre-launch")]
    assert back.collect()[1]["score_reasons"] == "a | b"


def test_insert_once_upsert_and_deliveries(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("b1", "1", 1), ("b1", "1", 2), ("b1", "2", 3)], "batch string, id string, v int")
    assert (E.insert_once(df, path, ["batch", "id"], "v"), E.insert_once(df, path, ["batch", "id"], "v")) == (2, 0)
    up = str(tmp_path / "u")
    E.upsert_partition(df.where("v > 1"), up, "batch", ["id"])
    E.upsert_partition(spark.createDataFrame([("b2", "9", 9)], df.schema), up, "batch", ["id"])
    E.upsert_partition(spark.createDataFrame([("b1", "1", 7)], df.schema), up, "batch", ["id"])
    assert sorted((r["batch"], r["id"], r["v"]) for r in spark.read.parquet(up).collect()) == [("b1", "1", 7), ("b1", "2", 3), ("b2", "9", 9)]
    d = spark.createDataFrame([("r1", "a@b", "weekly"), ("r1", "a@b", "weekly")], "run_id string, recipient string, kind string")
    assert (E.record_deliveries(d, str(tmp_path / "d")), E.record_deliveries(d, str(tmp_path / "d"))) == (1, 0)
    E.append_history(df, str(tmp_path / "h"))
    E.append_history(df, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 6
    E.backup({"x": df}, str(tmp_path / "bk"))
    assert spark.read.parquet(str(tmp_path / "bk/x")).count() == 3
    assert rel.upserted(df.where("v = 3"), df, ["id"]).count() == 3


def test_xml_is_read_once_for_the_end_tag_that_it_has(spark, tmp_path):
    record = lambda n, p="": f"<{p}TradeMark><{p}ApplicationNumber>{n}</{p}ApplicationNumber></{p}TradeMark>"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<?xml version='1.0'?><all>" + "".join(record(f"UK{i}") for i in range(50)) + "</all>")
    df = S.read_filings_xml(spark, str(tmp_path / "x"), "b")
    assert df.count() == 50
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    (tmp_path / "x" / "b.xml").write_text("<all>" + "".join(record(f"US{i}", "ns:") for i in range(3)) + "</all>")
    assert S.read_filings_xml(spark, str(tmp_path / "x"), "b").count() == 53
    (tmp_path / "none.xml").write_text("<all><other/></all>")
    assert S.read_filings_xml(spark, str(tmp_path / "none.xml"), "b").count() == 0


def test_null_partitions_are_upserted(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, v string, p string"
    E.upsert_partition(spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "x")], schema), path, "p", ["id"])
    E.upsert_partition(spark.createDataFrame([(2, "B", None)], schema), path, "p", ["id"])
    assert sorted((r["id"], r["v"], r["p"]) for r in spark.read.schema(schema).parquet(path).collect()) == [(1, "a", None), (2, "B", None), (3, "c", "x")]


def test_insert_without_an_order_and_a_broken_store(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    assert [E.insert_once(rows, path, ["id"]) for _ in range(2)] == [2, 0]
    broken = str(tmp_path / "broken")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017, PT011  what is stored can't be read: nothing is appended
        E.insert_once(rows, broken, ["id"])


def test_deliveries_runs_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a@b.c", "weekly")], "run_id string, recipient string, kind string")
    path = str(tmp_path / "d")
    assert [E.recorded_deliveries(rows, path).first()["created"] for _ in range(2)] == [True, False]
    assert spark.read.parquet(path).count() == 1
    run = lambda s: spark.createDataFrame([("r1", s)], "run_id string, status string").select("status", "run_id")
    messages = spark.createDataFrame([("r1", "match", "m1"), ("r1", "match", "m2")], "run_id string, stage string, message string")
    assert E.record_run(run("STARTED"), messages, str(tmp_path / "runs"), str(tmp_path / "errors")) == 2
    assert E.record_run(run("FAILED"), messages, str(tmp_path / "runs"), str(tmp_path / "errors")) == 0
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()] == ["FAILED"]
    assert spark.createDataFrame([(1, None, "é")], "b int, c string, a string").select(E.sorted_json("b", "c", "a")).first()[0] == '{"a":"é","b":1,"c":null}'
    stored = spark.createDataFrame([("b1", '[{"key":"k","text":"t","weight":3}]', '{"design":"HIGH"}'), ("b2", None, None)], "batch_id string, reasons string, intent string")
    row = S.rehydrated(stored, "b1").first()
    assert (row["reasons"][0]["weight"], row["intent"]) == (3, {"design": "HIGH"})
    assert len(E.SAMPLE_COLUMNS) == 26
    batches = spark.createDataFrame([("p1", "2025-049"), ("p2", "2025-050")], "path string, batch_id string")
    assert S.resolve_batch(batches).first()["path"] == "p2"
    with pytest.raises(ValueError, match="2024-001"):
        S.resolve_batch(batches, "2024-001")
