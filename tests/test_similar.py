"""The set-similarity join against all pairs."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import similar as J


def rows(n=150, seed=1, common=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.choice([[f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 9))], [f"u{i}_{k}" for k in range(4)]])
        out.append((i, base + ["hot"] * common + rng.choice([[], base[:1], ["w1"]])))
        if rng.random() < 0.3:
            out.append((1000 + i, base[:-1] + ["hot"]))
    return out + [(5000, []), (5001, None), (None, ["w1", "hot"]), (5002, ["hot"]), (5003, [None, "hot"]), (3, out[3][1])]


def by_hand(data, least):
    sets = {}
    for i, x in data:
        s = frozenset(t for t in x or () if t is not None)
        if i is not None and s:
            sets[s] = min(i, sets.get(s, i))
    items = sorted((c, s) for s, c in sets.items())
    pairs = {(a, b, len(x & y), len(x | y)) for a, x in items for b, y in items if a < b and Fraction(len(x & y), len(x | y)) >= least}
    members = {(i, sets.get(frozenset(t for t in x or () if t is not None))) for i, x in data}
    return pairs, members


@pytest.mark.parametrize("least", [Fraction(1, 2), Fraction(7, 10), Fraction(1)])
def test_all_pairs(spark, least):
    data = rows()
    df = spark.createDataFrame(data, "k int, x array<string>").repartition(3)
    found = J.similar_sets(df, "k", F.col("x"), least)
    pairs, members = by_hand(data, least)
    got = [tuple(r) for r in found.pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs
    assert {tuple(r) for r in found.members.collect()} == members
    links = {r["id"]: r["links"] for r in J.linked(found).collect() if r["class"] == 3}
    assert links == {i: len([p for p in pairs if 3 in p[:2]]) for i in links}


def test_a_token_that_everyone_has_makes_no_pairs(spark):
    data = [(i, ["hot", *[f"own{i}_{k}" for k in range(i % 4)]]) for i in range(4000)]
    df = spark.createDataFrame(data, "k int, x array<string>")
    for least in (Fraction(1, 2), Fraction(7, 10)):
        _, sets = J.classes(df, "k", F.col("x"))
        made = J.candidates(sets, least)
        assert made.count() <= 1000 + 1  # only {hot, one} with {hot}
        found = J.similar_sets(df, "k", F.col("x"), least)
        assert found.pairs.count() == (1000 if least == Fraction(1, 2) else 0)


def test_nothing_and_wrong_thresholds(spark):
    df = spark.createDataFrame([], "k int, x array<string>")
    found = J.similar_sets(df, "k", F.col("x"))
    assert (found.pairs.count(), found.members.count()) == (0, 0)
    with pytest.raises(ValueError, match="threshold"):
        J.similar_sets(df, "k", F.col("x"), Fraction(0))


def test_sets_that_share_a_rare_token_by_chance_are_dropped_in_the_join(spark):
    rng = random.Random(7)
    data = [(i, rng.sample([f"w{k}" for k in range(400)], 40)) for i in range(200)]
    data += [(1000 + i, [*x[:38], f"own{i}", f"mine{i}"]) for i, x in data[:20]]
    _, sets = J.classes(spark.createDataFrame(data, "k int, x array<string>"), "k", F.col("x"))
    made = {frozenset(r) for r in J.candidates(sets, Fraction(7, 10)).collect()}
    assert made >= {frozenset((i, 1000 + i)) for i in range(20)}
    assert len(made) < 100  # thousands of pairs share a token of their prefixes


def stored(spark, path):
    """Bytes shuffled so far, and bytes that lie in the folder."""
    from pathlib import Path

    shuffled = spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    return shuffled + sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_what_is_stored_is_no_multiple_of_the_texts(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(20000)]
    texts = [" ".join(sorted({names[int(20000 * rng.random() ** 2)] for _ in range(200)})) for _ in range(3000)]
    texts += [t + " more" for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = stored(spark, folder)
    found = J.similar_sets(df, "k", F.split("text", " "))
    assert sum(r["links"] for r in J.linked(found).collect()) == 60
    made = (stored(spark, folder) - before) / sum(map(len, texts))
    assert made < 5, made
    assert "Exchange" not in found.pairs._jdf.queryExecution().executedPlan().toString()


def test_odd_tokens_and_ids_with_several_sets(spark):
    base = [f"w{k}" for k in range(8)]
    data = [(1, [*base, "", "a\0b"]), (2, [*base, "", "a\\0b"]), (3, [*base, "", "a", "b"]), (4, [""]), (5, ["\0"]), (6, ["", "\\"]), (7, ["é", "ß", ""]), (8, ["ß", "é"])]
    data += [(9, base), (9, [*base, "x"]), (9, [*base, "y"]), (10, [*base, "x"])]
    found = J.similar_sets(spark.createDataFrame(data, "k int, x array<string>"), "k", F.col("x"), Fraction(2, 3))
    sets = {(i, frozenset(x)) for i, x in data if (i, x[-1:]) != (10, ["x"])}
    pairs = sorted((a, b, len(x & y), len(x | y)) for a, x in sets for b, y in sets if a < b and 3 * len(x & y) >= 2 * len(x | y))
    assert sorted(tuple(r) for r in found.pairs.collect()) == pairs
    assert not [r for r in found.pairs.collect() if r["a"] == r["b"]]


def test_blocks_and_their_parts_meet_once(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAST_POSTS", 60)
    data = rows(seed=5)
    least = Fraction(1, 2)
    spelt = J.spelled_sets(spark.createDataFrame(data, "k int, x array<string>").repartition(5), "k", F.col("x"))
    _, sets = J.grouped(spelt)
    met, ends = J.linking(sets, J.counted(sets), least)
    want, _ = by_hand(data, least)
    assert met.rdd.getNumPartitions() > 10
    assert sorted(tuple(r) for r in met.collect()) == sorted(want)
    counts = {r["class"]: r["n"] for r in ends.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    assert counts == {c: sum(c in w[:2] for w in want) for c in {c for w in want for c in w[:2]}}

    for name, value in (("POSTS", 20), ("ROWS", 7), ("MEETINGS", 30), ("WORDS", 16), ("WAITING", 25), ("TOKENS", 40)):
        monkeypatch.setattr(J, name, value)
    files = [f for b in J.blocks(spark.read.parquet(J.laid_out(sets, J.counted(sets), least))) for f in b["files"]]
    top = files[0].rsplit("/size=", 1)[0]
    found = []
    by_size = {}
    for f in files:
        by_size.setdefault(f.split("/size=")[1].split("/")[0], []).append(f.removeprefix(top))
    held = [J.Block(top, some) for some in by_size.values()]
    for i, one in enumerate(held):
        for other in held[: i + 1]:
            for batch in J.joined(one, other, least):
                found += [(min(r["a"], r["b"]), max(r["a"], r["b"]), r["shared"], r["total"]) for r in batch.to_pylist()]
    assert sorted(found) == sorted(want)
    assert max(len(list(b.parts())) for b in held) > 2
