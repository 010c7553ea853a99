"""The data source of batches: ranges, members, and the stream that reads each batch once."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import batches as B
from tidemark.sources import readers as S

TAGS = ("TradeMark", "MarkRecord")
RECORD = "<n:TradeMark a='1'><n:ApplicationNumber>{}</n:ApplicationNumber><n:MarkText>{}</n:MarkText></n:TradeMark>"


def xml(ids, size=40):
    return "<T>" + "\n".join(RECORD.format(i, "x" * (size + i % 13)) for i in ids) + "<MarkRecord><ApplicationNumber>z</ApplicationNumber></MarkRecord></T>"


def write(folder, name, ids, **more):
    text = xml(ids, **more) if ".xml" in name or name.endswith(".zip") else "\r\n".join(f"line {i}" for i in ids)
    if name.endswith(".zip"):
        with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.md", "no")
            z.writestr("b.xml", text)
            z.writestr("c.txt", "one\ntwo\n")
    elif name.endswith(".gz"):
        (folder / name).write_bytes(gzip.compress(text.encode()))
    else:
        (folder / name).write_text(text, newline="")


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("size", [13, 64, 333])
def test_ranges_hold_each_record_once(monkeypatch, step, size):
    monkeypatch.setattr(B, "READ_BYTES", step)
    for tags, data in ((TAGS, xml(range(20)).encode()), ((), b"a\n\nbb\r\nccc" + b"d" * 50 + b"\n" + b"e" * 20)):
        whole = list(B.records(io.BytesIO(data), 0, None, tags))
        assert len(whole) == (21 if tags else 5)
        assert all(data[a:].startswith(v) for a, v in whole)
        found = []
        for a in range(0, len(data), size):
            begin = a
            if a and not tags:
                while begin <= len(data) and data[begin - 1 : begin] != b"\n":
                    begin += 1
            found += list(B.records(io.BytesIO(data[begin:]), begin, min(len(data), a + size), tags))
        assert found == whole


def test_broken_records():
    read = lambda t: [v.decode() for _, v in B.records(io.BytesIO(t.encode()), 0, None, ("R",))]
    assert read("<R>1</R >x<R/>y</R><S>no</S><R>open") == ["<R>1</R >", "<R/>y</R>", "<R>open"]
    assert read("") == read("<Rx>a</Rx>") == []


def test_weeks():
    assert [B.week_of(x) for x in ("journal_2025-050.xml", "week_2025-12-19.txt", "2025-01-02.xml", "x2025-99-99", "note.txt")] == ["2025-050", "2025-051", "2024-052", None, None]
    assert B.weeks_between("2024-051", "2025-002") == ["2024-052", "2025-001"]
    assert B.weeks_between("2021-052", "2022-001") == ["2021-053"]
    assert B.weeks_between("2025-001", "2025-002") == []


def test_batch_of_all_forms(spark, tmp_path):
    write(tmp_path, "j_2025-050.xml", range(500))
    write(tmp_path, "j_2025-051.zip", range(500, 520))
    write(tmp_path, "j_2025-052.xml.gz", range(600, 620))
    write(tmp_path, "w_2026-01-09.txt", range(300))
    write(tmp_path, "other.xml", range(5))
    rows = B.read_records(spark, str(tmp_path), TAGS, range_bytes=1000)
    assert rows.rdd.getNumPartitions() > 20
    counts = {(r["batch_id"], r["member"]): r["n"] for r in rows.groupBy("batch_id", "member").agg(F.count("*").alias("n")).collect()}
    assert counts == {("2025-050", None): 501, ("2025-051", "b.xml"): 21, ("2025-051", "c.txt"): 2, ("2025-052", None): 21, ("2026-002", None): 300}
    assert rows.where("batch_id = '2025-050'").select("at").distinct().count() == 501
    assert {r["value"] for r in rows.where("batch_id = '2026-002'").collect()} == {f"line {i}" for i in range(300)}
    some = B.read_records(spark, str(tmp_path), TAGS, batches=["2025-051", "2025-052"]).where("member is null or member like '%.xml'")
    filings = S.filings_of(some.withColumn("ordinal", F.col("at")), "value", F.col("batch_id"))
    assert sorted((r["filing_id"], r["batch_id"]) for r in filings.collect() if r["filing_id"] != "z") == sorted([(str(i), "2025-051") for i in range(500, 520)] + [(str(i), "2025-052") for i in range(600, 620)])


def test_stream_reads_each_batch_once_late_ones_too(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        rows = B.stream_records(spark, str(folder), TAGS, range_bytes=700)
        query = rows.select("batch_id", "value").writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        query.processAllAvailable()
        query.stop()
        return {r["batch_id"]: r["n"] for r in spark.read.schema("batch_id string, value string").parquet(out).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}

    write(folder, "j_2025-048.xml", range(30))
    write(folder, "j_2025-050.xml", range(40))
    assert run() == {"2025-048": 31, "2025-050": 41}
    assert run() == {"2025-048": 31, "2025-050": 41}
    write(folder, "j_2025-049.xml", range(10))  # late
    write(folder, "j_2025-053.zip", range(5))
    write(folder, "j_2025-050-again.xml", range(9))  # a batch is read once
    assert run() == {"2025-048": 31, "2025-049": 11, "2025-050": 41, "2025-053": 8}
    write(folder, "j_2025-051.xml", range(3))
    assert run() == {"2025-048": 31, "2025-049": 11, "2025-050": 41, "2025-051": 4, "2025-053": 8}
    whole = B.read_records(spark, str(folder), TAGS).where("file not like '%again%'").select("batch_id", "value")
    streamed = spark.read.parquet(out)
    assert whole.exceptAll(streamed).isEmpty()
    assert streamed.exceptAll(whole).isEmpty()
