"""Operator 11 against scores worked out for every document."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def by_hand(docs, items, k=10):
    counts = [(i, {w: ts.count(w) for w in set(ts)}, len(ts)) for i, t in docs if (ts := terms(t))]
    many, total = len(counts), sum(n for _, _, n in counts)
    df = {}
    for _, c, _ in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    asked = {}
    for q, t in items:
        if q is not None:
            asked.setdefault(q, set()).update(terms(t))
    out = []
    for q, ws in asked.items():
        found = []
        for i, c, n in counts:
            m = 100 - 90 + 90 * n * many // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "É", "é", "x9"] + [f"w{i}" for i in range(300)]
    pick = lambda m: " ".join(words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(m))
    docs = [(i, pick(rng.randint(0, 40)) + rng.choice(["", ".", "\n—"])) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (None, "w1 w2 w3 rare"), (7, docs[7][1]), (n + 3, docs[3][1]), (n + 4, pick(30000)), (n + 5, "only rare")]
    items = [(i, pick(rng.randint(1, 25))) for i in range(30)] + [(100, None), (101, ""), (102, "nowhere at-all"), (None, "w1"), (3, "w250 the"), (103, "the"), (104, docs[9][1])]
    return docs, items


@pytest.mark.parametrize(("blocks", "shard"), [(1 << 20, 1 << 15), (300, 50)])
def test_search(spark, monkeypatch, blocks, shard):
    monkeypatch.setattr(lexical, "FIRST", 16 if shard == 50 else 256)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"score": F.lit("clash"), "item_id": F.lit(0), "n": F.lit(1), "terms": F.lit(2)})
    q = spark.createDataFrame(items, "item_id int, text string").withColumns({"rank": F.lit(1), "query": F.lit(1)})
    got = sorted(tuple(r) for r in lexical.search(d, q, block_bytes=blocks, shard_docs=shard).collect())
    assert got == by_hand(docs, items)


def test_nothing(spark):
    docs, items = corpus(20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0


def test_documents_that_cannot_beat_the_threshold_are_not_scored():
    rng = np.random.default_rng(2)
    n, v = 20000, 40
    holds = [np.flatnonzero(rng.random(n) < p) for p in np.geomspace(0.0005, 0.6, v)]
    at = [[] for _ in range(n)]
    for t, docs in enumerate(holds):
        for i in docs.tolist():
            at[i].append(t)
    lists = [np.array(x, np.int32) for x in at]
    stats = lexical.Statistics.of(n, 100 * n, np.array([len(x) for x in holds]))
    shard = lexical.Shard(np.arange(n), np.full(n, 100), lists, [np.ones(len(x), np.int32) for x in lists], stats)
    asked = np.arange(v)
    docs, scores = shard.best(asked, 10)
    every = np.zeros(n, np.int64)
    np.add.at(every, shard.doc, shard.impact)
    want = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == want.tolist()
    assert scores.tolist() == every[want].tolist()
    assert shard.scored < 0.2 * n
