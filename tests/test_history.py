import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import relational as rel


@pytest.fixture
def table(spark, tmp_path):
    name = f"history_{uuid.uuid4().hex}"
    yield H.opened(spark, name, str(tmp_path / "h"), "string", "int", 4)
    spark.sql(f"DROP TABLE {name}")


def batch(spark, rows):
    return spark.createDataFrame(rows, "id int, who string, week int")


def test_weeks_one_after_the_other_equal_all_at_once(spark, table):
    rows = [(i, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"k{i * 7 % 23}", i % 5) for i in range(200)]
    rows.append((200, "late", None))
    weeks = [[r for r in rows if r[2] == w] for w in (1, 0, 3, 2, None, 4)]  # late batches too
    for w in weeks:
        H.append(batch(spark, w), table, "who", "week")
    got = H.first_seen(batch(spark, rows), table, "who", "week")
    want = rel.first_seen(batch(spark, rows), "who", "week")
    assert got.columns == ["id", "who", "week", "first_seen"]
    assert sorted((r["id"], r["first_seen"]) for r in got.collect()) == sorted((r["id"], r["first_seen"]) for r in want.collect())
    n = spark.table(table).count()
    H.append(batch(spark, rows), table, "who", "week")  # again
    assert spark.table(table).count() == n


def test_a_batch_is_judged_before_it_is_stored(spark, table):
    H.append(batch(spark, [(1, "a", 3)]), table, "who", "week")
    got = {r["id"]: r["first_seen"] for r in H.first_seen(batch(spark, [(2, "a", 4), (3, "b", 4), (4, "b", 5), (5, "a", 2), (6, None, 4)]), table, "who", "week").collect()}
    assert got == {2: False, 3: True, 4: False, 5: True, 6: False}
    assert H.first_seen(batch(spark, []), table, "who", "week").count() == 0


def test_history_is_not_shuffled(spark, tmp_path):
    name = H.opened(spark, f"h_{uuid.uuid4().hex}", str(tmp_path / "h"), "string", "int", 7)  # not the shuffle's own number of partitions
    H.append(batch(spark, [(i, f"k{i}", 1) for i in range(50)]), name, "who", "week")
    H.append(batch(spark, [(i, f"k{i}", 0) for i in range(40, 60)]), name, "who", "week")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = H._met(batch(spark, [(1, "k1", 2)]), name, "who", "week")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = plan[plan.rindex("+- Sort [") :]
    assert "Bucketed: true" in stored
    assert "Exchange" not in stored, plan
    assert "SortMergeJoin" in plan


def test_reopened_and_compacted(spark, tmp_path):
    a, b, c = (f"h_{uuid.uuid4().hex}" for _ in range(3))
    path = str(tmp_path / "h")
    H.opened(spark, a, path, "string", "int", 4)
    H.append(batch(spark, [(1, "x", 5), (2, "y", 5)]), a, "who", "week")
    H.append(batch(spark, [(1, "x", 3)]), a, "who", "week")
    H.opened(spark, b, path, "string", "int", 4)  # another session's name for the folder
    assert spark.table(b).count() == 3
    H.compacted(spark, b, c, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.table(c).collect()) == [("x", 3), ("y", 5)]
    assert spark.table(c).agg(F.count_distinct("key")).first()[0] == 2
