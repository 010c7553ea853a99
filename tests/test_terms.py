"""The automaton of words against `contains` for each word."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import terms as A


def by_hand(text, words):
    out = []
    for w in dict.fromkeys(x for x in words if x):
        at = [i for i in range(len(text)) if text.startswith(w, i)]
        if at:
            out.append((w, len(at), at[0]))
    return out


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcé日 ") for _ in range(rng.randint(a, b)))
    return [None, "", "a", "aaaa", "abcabcab" * 300, *[word(0, 80) for _ in range(n)], word(5000, 5000)], [word(1, 5) for _ in range(120)] + ["", "a", "aa", "aaa", "abc", "bc", "c", "abc", "a" * 1500, "zzz"]


@pytest.mark.parametrize("cells", [1 << 25, 300])
def test_terms_are_what_contains_says(spark, monkeypatch, cells):
    rows, words = texts()
    monkeypatch.setattr(A, "STRETCH", 64)
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string").repartition(3).withColumn("terms", F.lit("clash"))
    got = {r["id"]: r["terms"] for r in A.with_terms(df, "t", words, cells=cells).collect()}
    assert got.pop(0) is None
    assert {i: [tuple(x) for x in hits] for i, hits in got.items()} == {i: by_hand(t, words) for i, t in enumerate(rows) if t is not None}


def test_the_first_of_a_list_and_rules(spark):
    rows, words = texts(2)
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    few = words[:20]
    hit = A.with_terms(df, "t", few).select("id", F.get("terms", F.lit(0))["term"].alias("first"), F.size("terms").alias("n"))
    want = df.select("id", X.first_of(tuple(few), F.col("t")).alias("first"), X.hits(tuple(dict.fromkeys(few)), F.col("t")).alias("n"))
    differ = hit.join(want.withColumnsRenamed({"first": "f", "n": "m"}), "id").where("not (first <=> f) or (first is not null and n <> m)")
    assert differ.count() == 0
    rules = [("abc", "x"), ("a", "y"), ("abc", "z"), ("é", "x")]
    got = {r["t"]: r["rule"] for r in A.matched_rules(spark.createDataFrame([("éa",), ("zabc",), ("q",), (None,)], "t string"), "t", rules).collect()}
    assert got == {"éa": "y", "zabc": "x", "q": None, None: None}


def test_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r["terms"] for r in A.with_terms(df, "t", []).orderBy("t").collect()] == [None, []]
    assert A.with_terms(df.limit(0), "t", ["a"]).count() == 0


def test_ten_thousand_words_in_one_pass():
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    words = sorted({letters[rng.integers(0, 27, n)].tobytes().decode() for n in rng.integers(3, 12, 10_000)})
    parts = A.automata(words)
    assert len(parts) == 1
    data = letters[rng.integers(0, 27, 200_000)]
    cuts = np.array([0, 70_000, 70_000, 200_000])
    text, word, begin = parts[0][1].hits(data, cuts)
    for i in range(3):
        t = data[cuts[i] : cuts[i + 1]].tobytes().decode()
        found = set(zip(word[text == i].tolist(), begin[text == i].tolist(), strict=True))
        assert all(t.startswith(words[w], b) for w, b in found)
        assert len(found) == sum(len([1 for b in range(len(t)) if t.startswith(w, b)]) if w in t else 0 for w in words[:300]) + len([1 for w, _ in found if w >= 300])
