"""The limiter and the subscriptions with timers against their batch forms, over shuffled micro-batches and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sales
from tidemark.streaming import limits as L
from tidemark.streaming import stateful as S

T0 = datetime(2025, 12, 5)
END = datetime(2026, 6, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def batches(spark, folder, rows, schema):
    """Each list of rows as one file, read one a micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={i:03d}"))


def run(spark, df, out, checkpoint, mode, name="x"):
    rows = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    out.extend(rows)


def test_limiter_over_shuffled_batches_and_a_restart(rocks, tmp_path):
    rng = random.Random(4)
    schema = "key string, event string, at timestamp"
    hits = [(rng.choice("abc"), f"e{i:03d}", T0 + timedelta(seconds=rng.randint(0, 20_000))) for i in range(150)]
    late = sorted(hits, key=lambda h: h[2] + timedelta(seconds=rng.randint(0, 3000)))
    parts = [late[i : i + 50] for i in range(0, 150, 50)] + [[("z", "end", END)], [("z", "end2", END + timedelta(days=1))]]
    got: list = []
    source = lambda: rocks.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    batches(rocks, tmp_path / "in", parts[:2], schema)
    run(rocks, L.limited(source(), 5, 3600), got, str(tmp_path / "ck"), "append")
    for i, part in enumerate(parts[2:], 2):
        rocks.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i:03d}"))
        run(rocks, L.limited(source(), 5, 3600), got, str(tmp_path / "ck"), "append")
    want = sales.limiter(rocks.createDataFrame(hits, schema), "key", "at", 5, 3600, "event").collect()
    decided = [(r["key"], r["event"], r["allowed"]) for r in got if r["key"] != "z"]
    assert sorted(decided) == sorted((r["key"], r["event"], r["allowed"]) for r in want)
    assert {d[2] for d in decided} == {True, False}


def test_subscriptions_with_initial_state_and_a_restart(rocks, tmp_path):
    schema = "customer string, id string, ts timestamp, status string"
    day = lambda n: T0 + timedelta(days=n)
    old = [("a", "e0", day(-3), "active"), ("b", "e1", day(-2), "past_due")]
    new = [
        [("a", "e4", day(2), "past_due"), ("a", "e3", day(1), "trialing"), ("c", "e5", day(1), "active")],
        [("a", "e6", day(5), "active"), ("c", "e7", day(4), "past_due"), ("c", "e7", day(4), "past_due")],
        [("z", "end", END, "active")],
        [("z", "end2", END + timedelta(days=9), "active")],
    ]
    initial = rocks.createDataFrame([("a", "ACTIVE", day(-3), day(-3), "e0", 1), ("b", "PAST_DUE", day(-2), day(-2), "e1", 1)], "customer string, status string, since timestamp, at timestamp, last string, n long")
    source = lambda: rocks.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    got: list = []
    for i, part in enumerate(new):
        rocks.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i:03d}"))
        run(rocks, L.subscribed(source(), initial=initial), got, str(tmp_path / "ck"), "update")
    last = {r["customer"]: (r["status"], r["since"], r["n"]) for r in got if r["customer"] != "z"}
    want = {r["customer"]: r for r in S.subscriptions_batch(rocks.createDataFrame(old + [x for p in new for x in p], schema)).collect()}
    assert last["a"] == ("ACTIVE", day(5), want["a"]["n"])
    assert (want["a"]["status"], want["a"]["since"]) == last["a"][:2]
    # overdue ones are cancelled when the grace period has passed
    assert (want["b"]["status"], want["c"]["status"]) == ("PAST_DUE", "PAST_DUE")
    assert last["b"] == ("CANCELLED", want["b"]["since"] + timedelta(days=14), want["b"]["n"])
    assert last["c"] == ("CANCELLED", want["c"]["since"] + timedelta(days=14), want["c"]["n"])


def test_moments():
    assert L.moment(L.micros(__import__("pandas").Timestamp("2025-12-05 01:02:03.456789"))) == datetime(2025, 12, 5, 1, 2, 3, 456789)
    assert L.moment(None) is None
    assert F.lit(1) is not None
