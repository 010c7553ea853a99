"""Operator 13 against a tree built by hand."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import merkle

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_by_hand(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path_by_hand(levels, i, fanout):
    path = []
    for nodes in levels[:-1]:
        a = i // fanout * fanout
        path.append((nodes[a:i], nodes[i + 1 : a + fanout]))
        i //= fanout
    return path


def by_hand(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels_by_hand([leaf(r) for r in groups[s]], fanout)
    top = levels_by_hand([trees[s][-1][0] for s in order], fanout)
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = path_by_hand(trees[s], i, fanout) + path_by_hand(top, j, fanout)
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                h = leaf((*r[:4], r[4].translate(LOWER)))
            for before, after in path:
                h = sha(*before, h, *after)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha(*[x for p in path for side in p for x in side]), h, h == root))
    return out


def rows(n=700, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice(["hot", "hot", "hot", "é", "Z", None, "", f"s{i % 23}"])
        out.append((rng.choice([i, i, i, i, 5, -i]), s, rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Ünïcode TEXT", "plain", "X" * (i % 40)])))
    out += [(None, "hot", None, None, None)] * 3 + [(7, "alone", "en", 1, "T" * 200000)] + [(9, "same", "en", 1, "Same")] * 40
    rng.shuffle(out)
    return out


def ask(spark, data, fanout=16, extra=False):
    df = spark.createDataFrame(data, COLUMNS).repartition(5)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in ("g", "h", "i", "n", "key", "leaf", "root", "path", "altered")})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, fanout=fanout, altered=(tampered, {"text": merkle.lowered(F.col("text"))}))


def test_proofs(spark):
    data = rows()
    got = [tuple(r) for r in merkle.digest(ask(spark, data, extra=True).proofs()).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(data), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_small_fanout_one_group_and_nothing(spark):
    data = [(i, "one", "en", i, f"Text {i}") for i in range(37)]
    got = [tuple(r) for r in merkle.digest(ask(spark, data, fanout=2).proofs()).collect()]
    assert sorted(got) == sorted(by_hand(data, 2))
    assert [tuple(r) for r in merkle.digest(ask(spark, data[:1]).proofs()).collect()] == by_hand(data[:1])
    assert merkle.digest(ask(spark, []).proofs()).count() == 0


def test_changed_goes_down_to_what_differs(spark):
    data = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(300)]
    other = [(*r[:4], "new") if r[0] in (6, 100) else r for r in data] + [(1000, "s9", "en", 1, "x"), *[(2000 + i, "s2", "en", 1, "x") for i in range(200)]]
    old, new = ask(spark, data), ask(spark, other)
    assert old.root != new.root
    got = {tuple(r) for r in merkle.changed(old, new).collect()}
    assert got == {("1s0", 2), ("1s1", 33), ("1s9", 0), *[("1s2", i) for i in range(100, 300)]}
    assert merkle.changed(old, ask(spark, data)).count() == 0
