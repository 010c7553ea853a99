"""Operator 12 against brute force, and what insertions and deletions leave."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import cuckoo, line_dedup

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    k = line.strip(SPACE).translate(LOWER)
    return k if len(k) >= 20 else None


def by_hand(docs, indexed=None):
    holders = {}
    for i, t in indexed if indexed is not None else docs:
        for line in (t or "").split("\n"):
            if i is not None and key(line):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [i is not None and len(h := holders.get(key(x), ())) >= 3 and i != max(h) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(n=150, seed=1):
    rng = random.Random(seed)
    common = ["A licence line that many have", "the hot line of all documents ", "nineteen code points"[:19], "twenty code points é", "ÀÉÎ upper stays as it is ok", "x" * 30]
    docs = [(None, "\n".join(common)), (0, None), (1, ""), (2, "\n\n"), (3, " \n\t"), (4, "\r\n".join(common * 50)), (4, common[0])]
    for i in range(5, n):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own line number {rng.randint(0, 60)} of some length" for _ in range(rng.randint(0, 8))]
        docs.append((i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "\r", " \x0b"]) for x in lines)))
    return docs + [docs[20], (n, "\n".join(f"line {j} of a long text that goes on" for j in range(20000)))]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def cleaned(index, df):
    return sorted((tuple(r) for r in line_dedup.digest(index.clean(df)).collect()), key=repr)


def state(index):
    """Counts and, by asking for all keys, that no repeat is missing from the filters."""
    counts = {bytes(r.key): (r.docs, r["last"]) for r in index.counts().collect()}
    every = index.refs().select("key").distinct()
    perhaps = {bytes(r.key) for r in index.asked(every).collect()}
    repeats = {k for k, (n, _) in counts.items() if n >= index.least}
    members = index._read((index.state().filters,), line_dedup._FILTERS).agg(F.sum("members")).first()[0] or 0
    assert repeats <= perhaps
    assert members == len(repeats)
    return counts


def test_whole_table(spark, tmp_path):
    docs = texts()
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"))
    df = frame(spark, docs).withColumns({"kept": F.lit("clash"), "key": F.lit(1), "doc": F.lit(1), "n_lines": F.lit(2), "_gone": F.lit(3)})
    index.insert(df)
    assert cleaned(index, df) == by_hand(docs)


def test_batches_deletions_and_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "ASKED_KEYS", 16)
    docs = texts(90, 2)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shard_keys=8)
    assert cleaned(index, frame(spark, docs)) == by_hand(docs, [])
    index.insert(frame(spark, docs[:50]))
    first = state(index)
    index.insert(frame(spark, docs[50:]))
    both = state(index)
    assert cleaned(index, frame(spark, docs)) == by_hand(docs)
    index.insert(frame(spark, docs[60:70]))  # again: counts stay
    assert state(index) == both
    gone = {d[0] for d in docs[50:]} - {d[0] for d in docs[:50]}
    index.delete(ids(gone | {10**6}))
    assert state(index) == first
    rest = [d for d in docs if d[0] not in gone]
    assert cleaned(index, frame(spark, rest)) == by_hand(rest)
    index.compact()
    assert state(index) == first
    index.delete(ids({d[0] for d in docs if d[0] is not None}))
    assert state(index) == {}


def test_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    docs = texts(40, 3)
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"))
    index.insert(frame(spark, docs[:20]))
    before = state(index)
    with monkeypatch.context() as m:
        m.setattr(index, "_finish", lambda *a: 1 / 0)
        try:
            index.insert(frame(spark, docs[20:]))
        except ZeroDivisionError:
            pass
    assert state(index) == before
    assert index.clean(frame(spark, docs).limit(0)).count() == 0


def test_cuckoo_filter_holds_takes_out_and_fills():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64)
    f = cuckoo.Cuckoo.sized(16000)
    assert f.add(keys[:8000])
    assert f.add(keys[8000:16000])
    assert f.has(keys[:16000]).all()
    assert f.has(rng.integers(0, 2**63, 100000).astype(np.uint64)).mean() < 0.0005
    assert f.remove(keys[:8000]) == 8000
    assert f.has(keys[8000:16000]).all()
    assert f.members == 8000
    assert cuckoo.Cuckoo.loaded(f.saved()).has(keys[8000:16000]).all()
    assert f.remove(keys[8000:16000]) == 8000
    assert f.members == 0
    small = cuckoo.Cuckoo.sized(10)
    assert not small.add(keys[:1000])
    same = np.full(8, keys[0], np.uint64)  # as many as two buckets hold
    assert f.add(same)
    assert f.remove(same) == 8


def test_lines():
    _, start, end, of, keys = line_dedup.lines(pa.array([None, "a\n\nb", "", "\n"]))
    assert of.tolist() == [0, 1, 1, 1, 2, 3, 3]
    assert (end - start).tolist() == [0, 1, 0, 1, 0, 0, 0]
    assert keys == [None] * 7
