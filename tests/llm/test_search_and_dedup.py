"""Operators 3, 4 and 6 against brute force."""

import hashlib
import json
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, simhash, substrings
from tidemark.llm.components import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(seed=1, n=60):
    """Texts that share passages, with copies, near copies, empty, null and long ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "a", "Oat", "é", "bar,", "x9", "日本"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(m)) for m in (12, 49, 50, 51, 70, 120)]
    out = [None, "", "  \n\t ", "one", " ".join(["same"] * 300), "a b " * 200]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))))
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(parts))
    out += [out[8], out[8], out[9] + " more", " ".join(word() for _ in range(30000)) + " " + passages[4]]
    return out


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return df.withColumns({"n_words": F.lit("clash"), "hits": F.lit(1), "fp": F.lit(2), "spans": F.lit(3), "low": F.lit(4)}) if extra else df


def repeats_by_hand(rows, length=50):
    seen, out = {}, {}
    for i, t in enumerate(rows):
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[k : k + length]), i) < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = texts(seed)
    got = substrings.digest(substrings.remove_repeats(table(spark, rows, extra=seed == 2).repartition(5))).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == repeats_by_hand(rows)


def test_substrings_in_chunks_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 64)
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 1000).astype(np.uint64)
    found = [(s + f, s + f + n + 49) for _, s, part in substrings._chunks(words, np.array([0, 1000]), 50) for f, n in zip(*substrings.seeds(part)[2:], strict=True)]
    assert sorted(x for a, b in found for x in range(a, b - 49)) == list(range(951))
    rows = texts(3, 30)
    got = substrings.digest(substrings.remove_repeats(table(spark, rows), length=12, k=5)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == repeats_by_hand(rows, 12)


def test_spans_of_repeated_rows_are_not_multiplied(spark):
    long = " ".join(f"w{i}" for i in range(80))
    count = lambda n: substrings.repeats(spark.createDataFrame([(1, long)] + [(2, long + " z")] * n, "doc_id long, text string")).distinct().count()
    assert count(2) == count(20)
    got = substrings.remove_repeats(spark.createDataFrame([(1, long)] + [(2, long + " z")] * 20, "doc_id long, text string"))
    assert sorted((r["n_words"], r["kept"].count(" ") + 1) for r in got.collect()) == [(80, 80)] + [(81, 1)] * 20


def test_substrings_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (5, long), (5, long + " z"), (7, long), (7, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.digest(substrings.remove_repeats(df)).collect())
    assert got == [(0, 60, 0), (5, 60, 0), (5, 61, 0), (7, 1, 0), (7, 60, 60)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def fingerprints_by_hand(rows):
    out = []
    for t in rows:
        w = [x.translate(LOWER) for x in SPACED.findall(t or "")]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def classes_by_hand(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = texts(4, 40)[:-1]
    fps = fingerprints_by_hand(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows, extra=True)).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, classes_by_hand(fps, 4), strict=True))}


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        f = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize(("seed", "shard_rows", "blocks"), [(1, 10, (3, 1)), (2, 60, (5, 2)), (3, 10_000, None), (4, 5, (6, 2)), (5, 40, (6, 2))])
def test_links_connect_what_brute_force_connects(spark, seed, shard_rows, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 64)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in clustered(300, seed)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), shard_rows=shard_rows, blocks=blocks)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = classes_by_hand([f % (1 << 64) for f in fps], 4)
    by_root = {}
    for f, c in zip(fps, want, strict=True):
        by_root.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_root.values()))
    assert edges.count() <= 4 * len(fps) * 30


def test_tree_prunes_by_triangle_bounds():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 4000).astype(np.uint64)
    mask = simhash.block_masks(3)[0]
    tree = simhash.Tree(values, mask, 100)
    home = dict(zip(*tree.overlapping(values, 0), strict=True))
    rows, leaves = tree.overlapping(values[:50], 1)
    asked = {}
    for r, leaf in zip(rows.tolist(), leaves.tolist(), strict=True):
        asked.setdefault(r, set()).add(leaf)
    near = np.bitwise_count((values[:50, None] ^ values[None, :]) & np.uint64(mask)) <= 1
    assert all(home[j] in asked[i] for i, j in zip(*np.nonzero(near), strict=True))
    assert sum(map(len, asked.values())) < 0.6 * 50 * tree.leaves


def test_without_reach_a_fingerprint_asks_in_one_shard_of_a_tree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 4000).astype(np.uint64)
    found = simhash.block_masks(6, 2)
    assert len(found) == 15
    for pattern in range(15):  # whatever four bits differ, some choice of two blocks has none of them
        near = values ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << np.uint64(4 * pattern)) ^ (np.uint64(1) << np.uint64(63 - pattern))
        assert np.any([(values ^ near) & np.uint64(m) == 0 for m in found], axis=0).all()
    rows, _ = simhash.Tree(values, found[3], 5).overlapping(values, 0)
    assert sorted(rows.tolist()) == list(range(4000))


def test_beyond_the_switch_each_fingerprint_asks_once_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPARSE", 1000)
    assert [simhash.reach_of(4, *x) for x in (simhash.FEW, simhash.MANY, (1, 1), (2, 1), (6, 3))] == [1, 0, 4, 2, 1]
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 3000))
    values = np.unique(np.concatenate([values, values[:200] ^ 1 ^ (1 << rng.integers(1, 60, 200)) ^ (1 << rng.integers(1, 60, 200)) ^ (1 << 62)]))
    nodes = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    made = simhash.dealt(nodes, sample=500, shard_rows=100)
    assert made.reach == 0
    assert made.homes.count() == made.guests.count() == 15 * len(values)
    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, sample=500, shard_rows=100)).collect()}
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 4
    assert all(got.get(int(values[i]), i) == got.get(int(values[j]), j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True))
    assert len(got) >= 400


def test_simhash_null_ids_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (9, "a b c d e"), (3, "A B  C d e"), (9, "a b c d e"), (4, None), (2, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 3), (2, 2), (3, 3), (4, 2), (9, 3), (9, 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def contamination_by_hand(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = [x.translate(LOWER) for x in ALNUM.findall((t or "").translate(LOWER))]
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in enumerate(rows):
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    hit[k : k + n] = [True] * n
                    found |= ids
        found -= {None}
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit))
    return out


def items_for(rows, seed=1):
    rng = random.Random(seed)
    out = [(900, None), (901, ""), (902, "--"), (903, "x9"), (904, "OAT bar"), (None, "the the"), (905, rows[8]), (905, rows[9])]
    for i in range(10, 40):
        w = (rows[i % len(rows)] or "").split()
        a = rng.randrange(max(1, len(w)))
        out.append((i, "!".join(w[a : a + rng.randint(1, 40)]).upper()))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_decontaminate(spark, block_bytes):
    rows = texts(5, 30)[:-1]
    items = items_for(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(table(spark, rows, extra=True).repartition(3), bench, block_bytes=block_bytes)
    assert {"fp", "spans"} <= set(found.columns)
    assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(found).collect()} == contamination_by_hand(rows, items)


def test_decontaminate_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digest(decontaminate.find_contamination(docs, none)).collect()] == [(3, 0, 0), (3, 0, 0), (1, 0, 0)]
    one = spark.createDataFrame([(4, "b")], "item_id long, text string")
    assert sorted((r["n_hit"], r["n_items"]) for r in decontaminate.digest(decontaminate.find_contamination(docs, one)).collect()) == [(1, 1)] * 3
    assert decontaminate.find_contamination(docs.limit(0), one).count() == 0


def test_wu_manber_skips_positions():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    block, search = decontaminate.build(pa.array([item])), decontaminate.Search()
    search.add(block)
    assert (search.shifts[10] == 8).mean() > 0.9
    data = np.frombuffer(" ".join([*words, item]).encode(), np.uint8)
    start, end, bounds = common.find_words(data, np.array([0, len(data)]), common.ALNUM_WORD)
    where, _ = search.starts(10, common.word_hashes(data, start, end), bounds)
    assert search.looked < 0.15 * len(start)  # a jump of up to eight words from each
    assert set(range(20_000, 20_021)) <= set(where.tolist())


def test_skipping_holds_with_many_items():
    rng = np.random.default_rng(4)
    spell = lambda x: " ".join(f"w{i}" for i in x.tolist())
    items = [spell(rng.integers(0, 5000, 100)) for _ in range(20_000)]
    block, search = decontaminate.build(pa.array(items)), decontaminate.Search(bits=decontaminate.table_bits(2_000_000))
    search.add(block)
    assert (search.shifts[10] == 0).mean() < 0.2
    data = np.frombuffer(spell(rng.integers(0, 5000, 20_000)).encode(), np.uint8)
    start, end, bounds = common.find_words(data, np.array([0, len(data)]), common.ALNUM_WORD)
    search.starts(10, common.word_hashes(data, start, end), bounds)
    assert search.looked < 0.35 * len(start)


def test_decontaminate_repeated_items_and_large_ones(spark):
    long = " ".join(f"v{i}" for i in range(400))
    items = [(1, "one two three four five six seven eight nine ten")] * 200 + [(2, "one two three four five six seven eight nine ten")] * 200 + [(i, f"tiny{i}") for i in range(50)] + [(99, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = ["zero one two three four five six seven eight nine ten", "a tiny7 b", long + " more", None]
    found = decontaminate.find_contamination(table(spark, rows), bench, block_bytes=500)
    assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(found).collect()} == contamination_by_hand(rows, items)


def test_patterns_are_mapped_from_their_file(tmp_path):
    block = decontaminate.build(pa.array(["a b c", "one two three four five six seven eight nine ten eleven", None]))
    again = decontaminate.mapped(str(tmp_path / "x"), decontaminate.save(block, str(tmp_path / "x")))
    assert isinstance(again.words, np.memmap)
    assert [(p.length, p.keys.tolist(), p.owner.tolist()) for p in again.patterns] == [(p.length, p.keys.tolist(), p.owner.tolist()) for p in block.patterns]
    assert again.spell(3, 5) == b"one two"


def test_tables_in_slices_equal_one_table():
    rng = np.random.default_rng(8)
    items = [" ".join(f"w{i}" for i in rng.integers(0, 900, n).tolist()) for n in (2, 3, 30, 80, 200)]
    search = decontaminate.Search()
    search.add(decontaminate.build(pa.array(items)))
    cells = rng.integers(0, 1 << search.bits, 5000).astype(np.uint64)
    for length, shift in search.shifts.items():
        parts = {i: x for i, x in enumerate(shift.reshape(64, -1)) if (x != decontaminate.full_move(length)).any()}
        assert len(parts) < 64 or length == 10
        assert np.array_equal(decontaminate.Sliced(parts, search.bits - 6, decontaminate.full_move(length))[cells], shift[cells])


def test_decontaminate_in_many_blocks_and_slices(spark):
    rows = texts(7, 25)[:-1]
    items = [(f"q{i}", t) for i, t in items_for(rows, 2)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find_contamination(table(spark, rows).repartition(3), bench, block_bytes=300, slice_bits=11)
    assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(found).collect()} == contamination_by_hand(rows, items)


def test_patterns_are_made_in_tasks_under_the_shared_folder(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(400)]
    rows = spark.createDataFrame(items, "item long, text string")
    bits, blocks, slices = decontaminate.write_patterns(rows, 10, 20_000, 12)
    top = spark.conf.get("spark.checkpoint.dir")
    assert len(blocks) > 5 and len(slices) == 1 << bits - 12
    assert all(p.startswith(f"{top}/tidemark-patterns-") for p in [*(b[0] for b in blocks), *(s[2] for s in slices)])
    got = [decontaminate.mapped(decontaminate.on_machine(p), json.loads(places)) for p, places in blocks]
    assert sorted(i for b in got for i in b.ids.to_pylist()) == list(range(400))
    assert sum(len(p.keys) for b in got for p in b.patterns) == 400 * 41
    whole = decontaminate.Search(bits=bits)
    for b in got:
        whole.add(b)
    for length, i, path in slices:
        assert np.array_equal(np.fromfile(path, np.uint8), whole.shifts[length][i << 12 : i + 1 << 12])


def test_a_file_that_no_machine_mounts_is_fetched_once(spark, tmp_path, monkeypatch):
    (tmp_path / "patterns").write_bytes(b"abc")
    far = pyarrow.fs.SubTreeFileSystem(str(tmp_path), pyarrow.fs.LocalFileSystem())
    monkeypatch.setattr(decontaminate.pyarrow.fs, "FileSystem", SimpleNamespace(from_uri=lambda path: (far, "patterns")))
    here = decontaminate.on_machine("far://patterns")
    (tmp_path / "patterns").unlink()
    assert decontaminate.on_machine("far://patterns") == here and open(here, "rb").read() == b"abc"


def test_word_finding_equals_regular_expressions():
    rows = texts(6, 20)
    for mask, pattern in ((common.SPACED_WORD, SPACED), (common.ALNUM_WORD, ALNUM)):
        data, at = common.text_bytes(pa.array(rows))
        if pattern is ALNUM:
            data = common.LOWER[data]
        start, end, bounds = common.find_words(data, at, mask)
        raw = data.tobytes()
        got = [[raw[a:b].decode() for a, b in zip(start[x:y], end[x:y], strict=True)] for x, y in zip(bounds, bounds[1:], strict=False)]
        assert got == [pattern.findall((t or "").translate(LOWER) if pattern is ALNUM else (t or "")) for t in rows]
