"""The near-dedup stage against all pairs by hand."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import near_copies, simhash

from .test_search_and_dedup import LOWER, SPACED


def groups_by_hand(rows):
    """The smallest id that links reach, for {id: text}."""
    sets = {}
    for i, t in rows.items():
        w = [x.translate(LOWER) for x in SPACED.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and (not sets[a] and not sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in rows}


def planted():
    """Texts with copies of many rates of edits, a common passage, a chain, a large group, and texts without words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    texts = [None, "", " \n ", "one two", "One  two", "one two three"]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(20, 200))] + common * rng.randint(0, 1)
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    base = [word() for _ in range(100)]
    for _ in range(60):
        texts.append(" ".join(base[:-1] + [word()]))
    return dict(enumerate(texts))


def test_near_copies(spark, monkeypatch):
    rows = planted()
    want = groups_by_hand(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    near = lambda x: simhash.near_duplicates(x, shingle=5, similar=True)
    assert {r["doc_id"]: r["component_id"] for r in near(df).collect()} == want
    monkeypatch.setattr(near_copies, "CLUSTER_BYTES", 20_000)  # large clusters go in rounds
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    assert {r["doc_id"]: r["component_id"] for r in near(df).collect()} == want
    assert near(df.limit(0)).count() == 0


def test_texts_that_share_a_passage_do_not_meet(monkeypatch):
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 60).astype(np.uint64)
    own = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, own(40)])) for _ in range(5000)]
    base = own(100)
    sets += [np.unique(np.concatenate([base[: 100 - i % 9], own(i % 9)])) for i in range(2000)]
    compared = []
    plain = np.concatenate
    monkeypatch.setattr(near_copies.np, "concatenate", lambda x, *a, **k: (compared.append(len(x)), plain(x, *a, **k))[1])
    a, b = near_copies.linked(sets)
    assert min(*a, *b) >= 5000
    assert len(a) == 1999
    assert sum(compared[3:]) < 10 * 2000 * 2  # comparisons, and as many offsets


def test_linked_is_what_all_pairs_link():
    rng = random.Random(8)
    sets = []
    for _ in range(40):
        base = [rng.randrange(400) for _ in range(rng.randint(1, 60))]
        for _ in range(4):
            sets.append(np.unique(np.array([x if rng.random() < 0.93 else rng.randrange(400) for x in base], np.uint64)))
    a, b = near_copies.linked(sets)
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for x, y in zip(a, b, strict=True):
        assert find(x) != find(y)  # a forest
        root[find(x)] = find(y)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = len(np.intersect1d(x, y))
            if 5 * shared >= 4 * (len(x) + len(y) - shared):
                assert find(i) == find(j)


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == set(groups_by_hand(rows).values())
