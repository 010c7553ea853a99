import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger as L

SCHEMA = "day string, id string, v int"


def df(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(spark, root, name="t"):
    return sorted((tuple(r) for r in L.read(spark, root, name, SCHEMA).select("day", "id", "v").collect()), key=repr)


@pytest.mark.parametrize("within", [None, "day"])
def test_insert_is_once_by_batch_and_by_key(spark, tmp_path, within):
    root = str(tmp_path / "s")
    assert L.read(spark, root, "t", SCHEMA).count() == 0
    rows = df(spark, ("d1", "a", 1), ("d1", "a", 2), ("d1", None, 3), (None, "b", 4))
    assert L.insert(rows, root, "t", ["day", "id"], "q", "0", "v", within=within) == 3
    assert L.insert(rows, root, "t", ["day", "id"], "q", "0", "v", within=within) == 0  # the batch again
    assert L.insert(rows, root, "t", ["day", "id"], "q", "1", "v", within=within) == 0  # its keys again
    assert L.insert(df(spark, ("d1", "a", 9), ("d2", "a", 5), (None, "b", 9)), root, "t", ["day", "id"], "q", "2", "v", within=within) == 1
    assert stored(spark, root) == sorted([("d1", "a", 1), ("d1", None, 3), (None, "b", 4), ("d2", "a", 5)], key=repr)
    assert L.insert(df(spark), root, "t", ["day", "id"], "q", "3", within=within) == 0
    assert [e["n"] for e in L.entries(spark, root)] == [0, 1, 2, 3]


def test_a_try_that_dies_before_the_ledger_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    rows = df(spark, ("d1", "a", 1))
    with monkeypatch.context() as m:
        m.setattr(L, "_created", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            L.commit(root, "q", "0", {"t": rows, "u": rows})
    assert len(list((tmp_path / "s" / "data" / "t").iterdir())) == 1  # files, but no entry
    assert stored(spark, root) == []
    assert L.commit(root, "q", "0", {"t": rows, "u": rows}) is True
    assert L.commit(root, "q", "0", {"t": rows, "u": rows}) is False
    assert stored(spark, root) == stored(spark, root, "u") == [("d1", "a", 1)]


def test_two_writers_at_once_add_a_key_once(spark, tmp_path, monkeypatch):
    root, real, gate, added = str(tmp_path / "s"), L._commit, threading.Barrier(2), []

    def together(spark_, root_, query, batch, tables, before, within=None):
        if not before:
            gate.wait(60)  # both have read an empty ledger
        return real(spark_, root_, query, batch, tables, before, within)

    monkeypatch.setattr(L, "_commit", together)
    rows = {"x": df(spark, ("d", "a", 1), ("d", "b", 2)), "y": df(spark, ("d", "b", 7), ("d", "c", 8))}
    threads = [threading.Thread(target=lambda n=n: added.append(L.insert(rows[n], root, "t", ["id"], n, "0"))) for n in rows]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(added) == [1, 2]
    assert [r[1] for r in stored(spark, root)] == ["a", "b", "c"]
    assert len(L.entries(spark, root)) == 2


def test_rename_never_replaces(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    assert L.moved(spark, f"file:{tmp_path}/a", f"file:{tmp_path}/c") is True
    assert L.moved(spark, f"file:{tmp_path}/b", f"file:{tmp_path}/c") is False
    assert (tmp_path / "c").read_text() == "1"


def test_stream_tried_again_from_an_older_checkpoint(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")
    df(spark, ("d1", "a", 1), ("d1", "b", 2)).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(L.sink(root, "t", ["id"], "q")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)

    run(str(tmp_path / "c1"))
    run(str(tmp_path / "c2"))  # a lost checkpoint: all batches come again
    assert [r[1] for r in stored(spark, root)] == ["a", "b"]
    df(spark, ("d2", "b", 3), ("d2", "c", 4)).write.mode("append").parquet(source)
    run(str(tmp_path / "c1"))
    assert [r[1] for r in stored(spark, root)] == ["a", "b", "c"]
    assert L.read(spark, root, "t", SCHEMA).agg(F.sum("v")).first()[0] == 7
