"""Operators 5, 7, 8 and 10 by round trips and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, media, queries, sharding, training_order

SF = "/root/testdata/sf0.01"
CASES = [None, "", " ", "\n\n  x", "it's 12 don't", "日本語 ñandú \U0001f600", "a" * 3000, "word " * 30_000, "x\x85\xa0 \x1c　y", "it's 12 don't"]


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path, pattern = queries.vocabulary()
    lines = bpe.rank_lines(path)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines())}
    return bpe.Vocabulary.load(lines, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_bpe_equals_the_library(coder, spark):
    ours, library = coder
    rng = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in ours.tokens]
    for _ in range(8000):
        t = "".join(rng.choice(tokens) for _ in range(rng.randint(0, 8)))
        assert ids(ours.encode(t)) == library.encode_ordinary(t), t
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = library.encode_ordinary(t)
        assert tuple(got[i])[1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_prefix_tables_hold_every_prefix(coder):
    ours, library = coder
    for piece in (b" internationalisation", b"aaaaaaaaaaab", " ñandúes".encode()):
        last = ours.extend(piece, [])
        for n in range(1, len(piece) + 1):
            assert ours.spell(last[:n]) == library._core_bpe.encode_single_piece(piece[:n])


def test_appends_and_edits_are_exact_and_local(coder):
    ours, library = coder
    rng = random.Random(2)
    alphabet = "aàéß  \n\t.,'sdt12٣日 -_eeestionth"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        e = bpe.Encoding(ours, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 5))
            new = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))
            e.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (e.text, e.ids()) == (text, library.encode_ordinary(text))
    e = bpe.Encoding(ours, "some words " * 10_000)
    before = e.encoded
    e.edit(50_000, 50_003, "xyz")
    e.append("tail")
    assert e.ids() == library.encode_ordinary(e.text)
    assert e.encoded - before < 100


def test_bpe_edge_rows(spark, coder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string").withColumns({"ids": F.lit("clash"), "lang": F.lit("x")})
    got = bpe.encode(df, *queries.vocabulary(), decoded=True).orderBy("doc_id").collect()
    for r, t in zip(got, CASES, strict=True):
        assert ids(r["ids"]) == coder[1].encode_ordinary(t or "")
        assert bytes(r["decoded"]).decode() == (t or "")
        assert r["lang"] == "x"
    assert bpe.encode(df.limit(0), *queries.vocabulary()).count() == 0


def test_sharding_law(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_sharding(spark, SF).toPandas()
    assert len(got) == len(texts)
    assert set(got.shard) <= set(range(40))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {40}
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_sharding_follows_weights_and_confines_movement(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    place = lambda tree: sharding.with_shard(rows, F.col("k"), tree, "shard").toPandas().set_index("k").shard
    tree = sharding.default_tree(16)
    a = place(tree)
    heavy = place(sharding.default_tree(16, [1.0] * 15 + [3.0]))
    assert abs((heavy == 15).sum() / 20_000 - 3 / 18) < 0.02
    moved = a[a != heavy]
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    assert all(region(heavy[k]) == 1 for k in moved.index)  # only into the region that grew
    inside = moved.index[[region(a[k]) == 1 for k in moved.index]]
    assert all(rack(heavy[k]) == 3 for k in inside)  # and there into the rack that grew
    g = a
    for n in (16, 17, 18):
        tree = sharding.grow(tree)
        b = place(tree)
        assert set(b[b != g]) == {n}
        g = b
    none = place(sharding.default_tree(16, [0.0, *[1.0] * 15]))
    assert not (none == 0).any()


def test_sharding_edge_rows_and_buckets(spark):
    rows = [(None, "a"), (None, None), (1, "x"), (1, "x"), (1, "x"), (2, ""), *[(i, "t") for i in range(3, 200)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "slot": F.lit(1), "size": F.lit(2)})
    placed = sharding.place(df, sharding.default_tree(3)).cache()
    got = sharding.number(placed, bucket_rows=7).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got[got.doc_id.isna()].shard.nunique() == 1
    assert sharding.assign(df.limit(0)).count() == 0


def test_sharding_slots_do_not_depend_on_splits(spark):
    rows = [(7, "same")] * 500 + [(i, f"t{i}") for i in range(300)] + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, sharding.number(sharding.place(df.repartition(n), sharding.default_tree(5)), bucket_rows=50, run_rows=64).collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1]
    assert len(got[0]) == len(rows)


def test_sharding_draws_by_hand(spark):
    import math
    import struct

    import xxhash

    tree = sharding.grow(sharding.default_tree(40, [1.0 + i % 3 for i in range(40)]))

    def walk(k):
        node, seed = tree, xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        while node.children:
            draws = [-math.log(((xxhash.xxh64_intdigest(x.name.encode(), seed) >> 11) + 0.5) / 2**53) / x.weight for x in node.children]
            node = node.children[draws.index(min(draws))]
        return node.shard

    got = sharding.with_shard(spark.range(3000), F.col("id"), tree, "shard").collect()
    assert [r["shard"] for r in got] == [walk(r["id"]) for r in got]


def test_places_do_not_depend_on_splits(spark, tmp_path):
    spark.range(5000).repartition(3).write.parquet(str(tmp_path / "r"))
    got = []
    for size in ("4096", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        placed, n = common.numbered(spark.read.parquet(str(tmp_path / "r")))
        got.append(sorted(map(tuple, placed.collect())))
        assert (n, sorted(x[1] for x in got[-1])) == (5000, list(range(5000)))
    assert got[0] == got[1]
    some, n = common.numbered(spark.read.parquet(str(tmp_path / "r")).where("id % 2 = 0"))
    assert (n, sorted(r["place"] for r in some.collect())) == (2500, list(range(2500)))
    assert common.numbered(spark.range(0))[1] == 0


def test_sharding_runs_no_python(spark):
    plan = sharding.place(spark.read.parquet(f"{SF}/documents.parquet"), sharding.default_tree(40))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_media_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_media(spark, SF).collect()
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        rest = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(raw, rest) == rest


def test_media_edge_rows(spark):
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(CASES)], "doc_id long, text string").withColumns({"content": F.lit(1), "meta": F.lit(2)})
    got = media.media_columns(df).collect()
    assert sorted(bytes(r["payload"]).decode().rstrip(" ") for r in got) == sorted((t or "").rstrip(" ") for t in CASES)
    assert sum(r["id"] is None for r in got) == 1
    assert media.media_columns(df.limit(0)).count() == 0


def test_archives_in_byte_ranges_and_damaged_members(spark, tmp_path):
    path = str(tmp_path / "a")
    members = spark.range(200).select(F.format_string("m%03d", "id").alias("name"), F.col("id").cast("string").alias("meta"), F.repeat(F.col("id").cast("string"), 200).cast("binary").alias("content")).repartition(3)
    media.write_archives(members, path, archiveBytes="20000")
    (tmp_path / "a" / f"part-{'0' * 32}-00000.zip").write_bytes(b"a failed try")  # not in a manifest
    for size in ("700", "1000000"):
        got = media.read_archives(spark, path, rangeBytes=size).collect()
        assert sorted((r["name"], r["meta"], bytes(r["content"])) for r in got) == sorted((r["name"], r["meta"], bytes(r["content"])) for r in members.collect())
    victim = next(r for r in got if r["name"] == "m150")
    file = tmp_path / "a" / victim["archive"]
    raw = bytearray(file.read_bytes())
    raw[victim["offset"] + 60] ^= 1
    file.write_bytes(raw)
    bad = [r for r in media.read_archives(spark, path, onError="keep").collect() if r["error"]]
    assert [r["name"] for r in bad] == ["m150"]
    with pytest.raises(Exception):  # noqa: B017, PT011  the message depends on how Spark wraps it
        media.read_archives(spark, path).collect()


def test_archives_are_appended_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = lambda a, b: spark.range(a, b).select(F.format_string("m%03d", "id").alias("name"), F.lit("x").alias("meta"), F.lit(b"12").alias("content")).repartition(2)
    names = lambda: sorted(r["name"] for r in media.read_archives(spark, path).collect())
    media.write_archives(rows(0, 10), path)
    media.write_archives(rows(10, 15), path)
    assert names() == [f"m{i:03d}" for i in range(15)]
    media.write_archives(rows(20, 22), path, mode="overwrite")
    assert names() == ["m020", "m021"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "a" / "others.zip", "w") as z:
        z.writestr("foreign", b"abc")
    assert names() == ["foreign", "m020", "m021"]


def test_images_are_png_that_another_decoder_reads():
    import struct

    payload = bytes(range(192)) * 3
    image = media.encode_png(payload)
    parts, at = {}, 8
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        parts[image[at + 4 : at + 8]] = image[at + 8 : at + 8 + n]
        at += 12 + n
    lines = zlib.decompress(parts[b"IDAT"])
    assert struct.unpack(">IIBB", parts[b"IHDR"][:10]) == (64, 3, 8, 2)
    assert b"".join(lines[i * 193 + 1 : (i + 1) * 193] for i in range(3)) == payload
    flat = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(float)
    got = dict(x.split("=") for x in media.feature(media.decode_png(image)).split(";"))
    assert got["h"] == "3"
    assert [float(x) for x in got["mean"].split(",")] == [round(v, 2) for v in flat.mean(0)]
    assert [float(x) for x in got["std"].split(",")] == pytest.approx(flat.std(0), abs=0.006)


def test_a_member_is_tried_again_by_itself(tmp_path):
    class Flaky:
        def __init__(self, fs):
            self.fs, self.opened = fs, 0

        def open_input_file(self, path):
            self.opened += 1
            if self.opened < 3:
                raise OSError("gone for a moment")
            return self.fs.open_input_file(path)

    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a", b"one")
        z.writestr("b", b"two")
    fs, top = media.open_fs(str(tmp_path))
    reader = media.ArchiveReader({"path": str(tmp_path)})
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        flaky = Flaky(fs)
        assert reader._member(flaky, f"{top}/x.zip", z.getinfo("b")) == (b"two", None)
        assert flaky.opened == 3


def test_a_task_writes_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "MOST_TASKS", 2)
    df = spark.createDataFrame([(i, np.full(i, i, "<u4").tobytes()) for i in range(23)], "doc_id long, ids binary")
    index = training_order.write_order(df, str(tmp_path / "s"), shard_rows=4, record=8)
    assert {r["shard"] for r in index.collect()} == set(range(6))
    for r in index.collect():
        assert training_order.ShardReader(str(tmp_path / "s"), r["shard"]).tokens(r["first_token"], r["n_tokens"]).tolist() == [r["doc_id"]] * r["doc_id"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(training_order.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 64:
        assert got != [r[0] for r in spark.range(n).select(training_order.permuted(F.col("id"), n, key=9)).collect()]
        assert np.corrcoef(got, range(n))[0, 1] < 0.5


def test_training_order(spark, tmp_path, coder):
    docs, n = common.numbered(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    folder = str(tmp_path / "s")
    index = training_order.write_order(training_order.tokenise(docs, *queries.vocabulary()), folder, placed=n, shard_rows=128, record=64)
    rows = sorted(index.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(1000)) == sorted(r["place"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stream, seen = {}, 0
    for r in rows:
        want = coder[1].encode_ordinary(texts[r["doc_id"]])
        assert r["shard"] == r["slot"] // 128
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        s = stream.setdefault(r["shard"], [])
        assert r["first_token"] == len(s)
        s += [*want, 50256]
        seen += 1
    for shard, want in stream.items():
        reader = training_order.ShardReader(folder, shard)
        assert reader.about["tokens"] == len(want)
        records = list(reader)
        assert all(len(x) == 64 for x in records)
        flat = np.concatenate(records).tolist()
        assert flat[: len(want)] == want
        assert set(flat[len(want) :]) <= {50256}
        again = training_order.ShardReader(folder, shard, record=3)  # goes on from a record
        np.testing.assert_array_equal(next(again), records[3])
    assert seen == 1000


def test_training_order_edge_rows(spark, tmp_path):
    rows = [(1, b"\1\0\0\0"), (None, None), (2, b""), (2, b""), (3, b"\1\0\0\0\2\0\0\0")]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").withColumns({"slot": F.lit(1), "shard": F.lit("x")})
    got = training_order.write_order(df, str(tmp_path / "s"), shard_rows=2).collect()
    assert sorted(r["slot"] for r in got) == [0, 1, 2, 3, 4]
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 1, 2]
    assert training_order.write_order(df.limit(0), str(tmp_path / "e")).count() == 0
    folder = tmp_path / "again"
    for _ in range(2):  # a second try leaves files of other names; the manifest says which count
        index = training_order.write_order(df, str(folder), shard_rows=2).collect()
    assert len(list(folder.glob("shard-*.bin"))) == 6
    assert {r["file"] for r in index} == {training_order.ShardReader(str(folder), k).about["file"] for k in range(3)}
    with pytest.raises(Exception, match="doesn't hold"):
        training_order.write_order(spark.createDataFrame([(1, b"\0\0\1\0")], "doc_id long, ids binary"), str(tmp_path / "b"))
