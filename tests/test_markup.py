"""Elements of records that need not be well formed."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.sources import markup as M
from tidemark.sources import readers as S


def texts(record):
    return [(x["name"], x["text"]) for x in M.elements(record)]


def test_what_a_record_is_made_of():
    assert texts("<a>x<b>y</b>tail</a>") == [("a", "x"), ("b", "y")]
    assert texts("<a><![CDATA[1 < 2 & <b>]]></a>") == [("a", "1 < 2 & <b>")]
    assert texts("<a>&#163;5 &#xA3;6 &lt;ok&gt; &amp;amp; &nbsp;</a>") == [("a", "£5 £6 <ok> &amp; &nbsp;")]
    assert texts("<a>one<!-- <b>no</b> -->two<?pi <c>?></a>") == [("a", "onetwo")]
    assert texts("<a t='x > y'><b/>z</a>") == [("a", ""), ("b", "")]
    assert texts("no tags") == texts(None) == texts("") == []
    assert texts("<a>5 < 6</a>") == [("a", "5 < 6")]


def test_tags_that_cross_or_stay_open():
    assert texts("<a><b>x</a>y<c>z") == [("a", ""), ("b", "x"), ("c", "z")]
    assert texts("<m>crossing<b></m></b><n>on</n>") == [("m", "crossing"), ("b", ""), ("n", "on")]
    assert texts("</x><a>1</y></a>") == [("a", "1")]
    assert [x["path"] for x in M.elements("<a><b><c/></b><d>")] == [[], [0], [0, 1], [0]]
    assert texts("<a>x<!-- open") == [("a", "x")]
    assert texts("<a><![CDATA[open") == [("a", "open")]


def test_names_spaces_and_attributes():
    a, b, c = M.elements('<n:a xmlns:n="u1" xmlns="u2" id="1" n:k=\'&quot;q&quot;\'><b xmlns="u3"/><o:c/></n:a>')
    assert (a["name"], a["space"], a["attributes"]) == ("a", "u1", {"id": "1", "n:k": '"q"'})
    assert (b["space"], c["name"], c["space"]) == ("u3", "c", None)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "<r><k>first</k><p><k>in</k><q><k>deep</k></q></p><j> </j><k>last</k></r>"), (2, None)], "id int, r string").withColumn("elements", F.lit("clash"))
    e = F.col("elements")
    got = M.with_elements(df, "r").select(
        "id", M.texts(e, "k").alias("k"), M.texts(M.inside(e, "q", "p"), "k").alias("inside"), M.first_text(e, ("j", "z", "k")).alias("first"), M.texts(M.inside(e, "none"), "k").alias("none")
    )
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, ["first", "in", "deep", "last"], ["in", "deep"], "first", []), (2, [], [], None, [])]


XML = """<?xml version="1.0"?><x:T xmlns:x="u"><x:B>
<x:TradeMark><x:ApplicationNumber><![CDATA[A1]]></x:ApplicationNumber><x:MarkText>Caf&#233; &#xA3;</x:MarkText>
 <x:GoodsServicesText>Tea <!-- not <x:MarkText>this</x:MarkText> -->and cake</x:GoodsServicesText><x:ClassNumber>30</x:ClassNumber>
 <x:Applicant kind="a > b"><x:Name><x:EntityName>Oat &amp; Co</x:EntityName></x:Name></x:Applicant><x:Name>Agent</x:Name></x:TradeMark>
<x:TradeMark><x:ApplicationNumber>A2</x:ApplicationNumber><x:ApplicationDate>2025-09-15</x:ApplicationDate><x:MarkText>crossing<x:b></x:MarkText></x:b>
 <x:ClassNumber>29<x:ClassNumber>30</x:ClassNumber><x:OrganizationName>Whole record Ltd</x:OrganizationName></x:TradeMark>
<x:TradeMark><x:MarkText>no number</x:MarkText></x:TradeMark>
</x:B></x:T>"""


def test_filings_of_records_that_a_pattern_would_lose(spark, tmp_path):
    (tmp_path / "j.xml").write_text(XML, encoding="utf-8")
    rows = {r["filing_id"]: r for r in S.read_filings_xml(spark, str(tmp_path / "j.xml"), "2025-050").collect()}
    assert set(rows) == {"A1", "A2"}
    a, b = rows["A1"], rows["A2"]
    assert (a["mark_text"], a["goods_text"], a["nice_classes"], a["applicant_name"]) == ("Café £", "Tea and cake", [30], "Oat & Co")
    assert (b["mark_text"], b["filing_date"], b["nice_classes"], b["applicant_name"]) == ("crossing", date(2025, 9, 15), [29, 30], "Whole record Ltd")


def test_records_cut_across_tasks(spark, tmp_path):
    one = "<TradeMark><ApplicationNumber>N{}</ApplicationNumber><MarkText><![CDATA[{}]]></MarkText></TradeMark>\n"
    (tmp_path / "j.xml").write_text("<T>" + "".join(one.format(i, "x" * (i % 97)) for i in range(3000)) + "</T>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = S.read_filings_xml(spark, str(tmp_path / "j.xml"), "b").select("filing_id", F.length("mark_text").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["filing_id"]: r["n"] or 0 for r in rows} == {f"N{i}": i % 97 for i in range(3000)}
