from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import stateful as S

T0 = datetime(2025, 12, 5)  # a Friday


def drain(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_weekly_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=7 * i), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, kind string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(S.weekly(stream, "ts", "kind"), "weeks", "complete")
    got = sorted((r["week"]["start"], r["kind"], r["n"]) for r in spark.table("weeks").collect())
    want = df.groupBy(F.window("ts", "7 days", startTime="1 day").alias("w"), "kind").count()
    assert got == sorted((r["w"]["start"], r["kind"], r["count"]) for r in want.collect())
    assert got[0][0] == T0


def test_append_once_over_repeated_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    for i in range(2):  # a second query sees all input again
        S.append_once(stream(), str(tmp_path / "out"), str(tmp_path / f"ck{i}"), ["k"], "v").awaitTermination(120)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_subscriptions_equal_the_batch(spark, tmp_path):
    rows = [("c1", "e1", T0, "trialing"), ("c1", "e2", T0 + timedelta(days=1), "past_due"), ("c1", "e2", T0 + timedelta(days=1), "past_due"), ("c2", "e3", T0, "unpaid"), ("c2", "e4", T0 + timedelta(days=2), "active"), ("c3", "e5", T0, "odd")]
    df = spark.createDataFrame(rows, "customer string, id string, ts timestamp, status string")
    df.write.parquet(str(tmp_path / "in"))
    drain(S.subscriptions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "subs", "update")
    cols = ("customer", "status", "since", "at", "n")
    got = {r["customer"]: tuple(r[c] for c in cols) for r in spark.table("subs").collect()}
    want = {r["customer"]: tuple(r[c] for c in cols) for r in S.subscriptions_batch(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} == {"c1": ("c1", "PAST_DUE"), "c2": ("c2", "ACTIVE"), "c3": ("c3", None)}
    assert got["c1"] == want["c1"]


def test_step_ignores_repeats_and_older_events():
    state = S.step((None, None, None, None, 0), (2, "b", "active"))
    assert S.step(state, (2, "b", "canceled")) == state
    assert S.step(state, (1, "z", "canceled")) == state
    assert S.step(state, (3, "a", "incomplete_expired"))[0] == "CANCELLED"


def test_once_within_watermark(spark, tmp_path):
    df = spark.createDataFrame([("e1", T0), ("e1", T0), ("e2", T0)], "id string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    drain(S.once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["id"], "ts"), "once", "append")
    assert sorted(r["id"] for r in spark.table("once").collect()) == ["e1", "e2"]


def test_requests_and_opt_out(spark):
    req = spark.createDataFrame([(" A@b.c", 1), ("a@b.c", 2), ("d@e.f", 3)], "email string, ts int")
    stored = spark.createDataFrame([("d@e.f",)], "email string")
    assert [r["ts"] for r in S.keep_first_request(req, stored).collect()] == [1]
    assert S.opt_out(spark.createDataFrame([("A@B.C",), ("x@y.z",)], "email string"), req).count() == 1
    from datetime import date

    wanted = spark.createDataFrame([("2025-050", date(2025, 12, 12)), ("2025-049", date(2025, 12, 5))], "batch_id string, due date")
    got = S.availability(wanted, wanted.limit(0), date(2025, 12, 13)).collect()
    assert {r["batch_id"]: r["verdict"] for r in got} == {"2025-050": "retry", "2025-049": "missing"}
