"""Exact set-similarity join by prefixes: all pairs of token sets whose Jaccard similarity reaches a threshold.

Equal sets are one class first. Tokens are ordered by how often they occur, rarest first; of two sets of a similarity of t at least, the first
n - ceil(t n) + 1 tokens of the larger and the first m - ceil(2 t m / (1 + t)) + 1 of the smaller one hold a common one, so only these are looked at.
Occurrences are counted in cells that several tokens may share: any order of all tokens finds all pairs, so the counts may be rough and have a fixed size.

Nothing is shuffled by token. Sets are written once, in files of sets of about one size, each with its prefix and a sketch; blocks are some such files, and a task reads two
blocks whose sizes allow pairs and joins them in memory. So each pair is met in one task only, pairs are never written, and what is on disk grows with the
input alone, however many pairs share tokens or link.

A sketch has one bit for each value of a set's tokens' hashes, told by whether an even or an odd number of them has it. Each token that only one of two
sets has flips one bit at most, so two sketches differ in no more bits than the sets in tokens: what differs in more is no pair. What is left is compared
on whole sets, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..session import cut, run_dir

#: Cells in which occurrences of tokens are counted, and tasks that count at most, as each has its own cells.
CELLS, COUNTERS = 1 << 21, 64
#: Prefix tokens of a block at least, unless its size class has fewer, and at most; blocks that there are if they may be small.
LEAST_POSTS, POSTS, BLOCKS = 1 << 17, 3 << 19, 32
#: Met pairs looked at together, words of a sketch likewise, pairs that wait for their whole sets, and tokens of those taken together.
MEETINGS, WORDS, WAITING, TOKENS = 1 << 20, 1 << 20, 1 << 19, 1 << 20
#: Rows and bytes of sets that are hashed together; the rows fit the upper 12 bits of a sort key.
ROWS, BYTES = 1 << 12, 1 << 20
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Similar:
    """pairs: (a, b, shared, total) of classes, a the one with the smaller id, with how many tokens both and either have; they are found whenever they are read. members: each
    row's id and class, the smallest id with an equal set; rows without tokens have no class. ends: (class, n), several rows of a class, with n pairs in all: pairs are
    counted where they are found."""

    pairs: DataFrame
    members: DataFrame
    ends: DataFrame


def spelled(tokens: Column) -> Column:
    """The different tokens in order as one text with zero characters between; null if there are none. Zero characters of tokens and what marks them are escaped."""

    def text(x: Column) -> Column:
        bare = F.transform(x, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("\0"), F.lit("\\0")))
        zeros = lambda plain: F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("\0"), F.lit("")))
        joined = V.once(F.array_join(x, "\0"), lambda plain: F.when(plain.contains("\\") | (zeros(plain) != F.size(x) - 1), F.array_join(bare, "\0")).otherwise(plain))
        return F.when(F.size(x) > 0, joined)

    return V.once(F.sort_array(F.array_distinct(F.array_compact(tokens))), text)


def spelled_sets(rows: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, x, _k) of each row, written once: its tokens as `spelled` and a hash of that; null tokens don't count."""
    return cut(rows.select(F.col(id).alias("id"), spelled(tokens).alias("x")).withColumn("_k", F.unhex(F.sha2("x", 256))), "sets", compression="zstd")


def grouped(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class) of each of the spelled sets, and (class, x) of each different one."""
    known = sets.where("_k is not null and id is not null").groupBy("_k")
    members = sets.select("id", "_k").join(known.agg(F.min("id").alias("class")), "_k", "left")
    return members.select("id", "class"), known.agg(F.min("id").alias("class"), F.first("x").alias("x")).select("class", "x")


def classes(rows: DataFrame, id: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(id, class) of each row, and (class, x) of each different set, x being its tokens as `spelled`."""
    return grouped(spelled_sets(rows, id, tokens))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BYTES, ROWS at most."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        to = min(max(to, at + 1), at + ROWS)
        yield at, to
        at = to


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token of spelled sets, and how many tokens each set has."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    gaps = np.flatnonzero(data == 0)
    start, end = np.sort(np.concatenate([bounds[:-1], gaps + 1])), np.sort(np.concatenate([gaps, bounds[1:]]))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(data) + 1, _BASE, np.uint64))
        back = np.multiply.accumulate(np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        h = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33)), np.searchsorted(gaps, bounds[1:]) - np.searchsorted(gaps, bounds[:-1]) + 1


def counted(sets: DataFrame) -> np.ndarray:
    """How often tokens of each cell occur in the spelled sets, 2^20 - 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at, to in slices(batch["x"]):
                np.add.at(cells, (hashed(batch["x"].slice(at, to - at))[0] % np.uint64(CELLS)).astype(np.int64), 1)
        for at in range(0, CELLS, 1 << 16):
            some = at + np.flatnonzero(cells[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cells[some])], names=["cell", "n"])

    found = sets.select("x").coalesce(COUNTERS).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.least(F.sum("n"), F.lit((1 << 20) - 1)).cast("int").alias("n")).toArrow()
    cells = np.zeros(CELLS, np.int32)
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    return cells


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Values of bytes: data[bounds[i] : bounds[i + 1]] each."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def sketches(h: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of sets of n hashes each in so many 64-bit words, a power of two, and where each begins; half of a sketch laid on the other by XOR is a sketch of half the width."""
    ends = np.concatenate([[0], np.cumsum(words)])
    at = (h >> np.uint64(32)) & np.repeat(words * 64 - 1, n).astype(np.uint64)
    made = np.zeros(ends[-1], np.uint64)
    np.bitwise_xor.at(made, np.repeat(ends[:-1], n) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return made, ends


def indexed(texts: pa.Array, cells: np.ndarray, least: Fraction) -> list[pa.Array]:
    """Of each spelled set: n, its number of tokens; k, how many of its prefix a larger set has to look at; t, the prefix without tokens that no other set has, as
    32-bit hashes; its sketch; and its size class, of which there are two for each power of two."""
    h, n = hashed(texts)
    p, q = least.numerator, least.denominator
    row = np.repeat(np.arange(len(n)), n)
    many = cells[h % np.uint64(CELLS)].astype(np.uint64)
    t = np.sort(row.astype(np.uint64) << np.uint64(52) | many << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
    alone = np.bincount(row[many == 1], minlength=len(n))
    asks, there = n + (-p * n) // q + 1, n + (-2 * p * n) // (p + q) + 1
    at = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    kept = np.maximum(asks - alone, 0)
    t = t[(at >= alone[row]) & (at < asks[row])].astype(np.uint32)
    octave = np.frexp(n.astype(np.float64))[1]
    made, ends = sketches(h, n, 1 << np.maximum(octave - 6, 0))
    size = 2 * octave + (n.astype(np.float64) ** 2 >= np.exp2(2.0 * octave - 1))
    bounds = np.concatenate([[0], np.cumsum(kept)])
    return [pa.array(n, pa.int32()), pa.array(np.clip(there - alone, 0, kept), pa.int32()), binaries(t, bounds), binaries(made, ends), pa.array(size, pa.int32())]


def laid_out(sets: DataFrame, cells: np.ndarray, least: Fraction) -> str:
    """Write each set with its index to a folder of one's own for each size class; returns the folder above."""
    cells = sets.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([*sets.schema.fields, *[T.StructField(c, k) for c, k in (("n", T.IntegerType()), ("k", T.IntegerType()), ("t", T.BinaryType()), ("sketch", T.BinaryType()), ("size", T.IntegerType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["x"]):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, *indexed(part["x"], cells.value, least)], names=schema.names)

    path = run_dir(sets.sparkSession, "sized")
    sets.mapInArrow(run, schema).write.partitionBy("size").option("compression", "zstd").parquet(path)
    return path


@dataclass
class Sets:
    """Sets of a block in order of their size: n, where their prefixes begin in t (32-bit hashes), how many tokens of these a larger set looks at, sketches, and the file and row where each is."""

    n: np.ndarray
    k: np.ndarray
    bounds: np.ndarray
    t: np.ndarray
    sketch: np.ndarray
    file: np.ndarray
    row: np.ndarray

    @cached_property
    def posts(self) -> np.ndarray:
        """(token, row) in order, of the tokens that larger sets look at."""
        size = np.diff(self.bounds)
        row = np.repeat(np.arange(len(size)), size)
        mine = np.arange(len(self.t)) - self.bounds[row] < self.k[row]
        return np.sort(self.t[mine].astype(np.uint64) << np.uint64(32) | row[mine].astype(np.uint64))

    @cached_property
    def asks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole prefixes' tokens and their rows by token, and the place that each had."""
        order = np.argsort(self.t)
        return self.t[order].astype(np.uint64) << np.uint64(32), np.repeat(np.arange(len(self.n)), np.diff(self.bounds))[order], order


class Block:
    """Some files of one size class; high: the most tokens that a set has."""

    def __init__(self, top: str, files: list[str], high: int = 1) -> None:
        self.fs, folder = pyarrow.fs.FileSystem.from_uri(top)
        self.files = [folder + f for f in files]
        self.rows = max(min(ROWS, TOKENS // high), 1)

    def batches(self, file: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(self.files[file]) as f:
            yield from pq.ParquetFile(f).iter_batches(self.rows, columns=columns)

    def parts(self) -> Iterator[Sets]:
        """All sets, in parts of about POSTS prefix tokens at most."""
        got, posts = [], 0
        for file in range(len(self.files)):
            at = 0
            for batch in self.batches(file, ["n", "k", "t", "sketch"]):
                got.append((batch, np.full(len(batch), file, np.int32), np.arange(at, at + len(batch))))
                at, posts = at + len(batch), posts + pc.sum(pc.binary_length(batch["t"])).as_py() // 4
                if posts >= POSTS:
                    yield self.part(got)
                    got, posts = [], 0
        if got:
            yield self.part(got)

    def part(self, got: list) -> Sets:
        table = pa.Table.from_batches([x[0] for x in got]).combine_chunks()
        n = table["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(table["t"]).to_numpy() // 4)])
        return Sets(n[order].astype(np.int64), table["k"].to_numpy().astype(np.int64), bounds, joined("t", np.uint32), joined("sketch", np.uint64).reshape(len(n), -1), np.concatenate([x[1] for x in got])[order], np.concatenate([x[2] for x in got])[order])

    def whole(self, part: Sets, rows: np.ndarray) -> pa.Table:
        """(class, x) of the part's rows given, in their order."""
        found, places = [], []
        for file in np.unique(part.file[rows]).tolist():
            mine = np.flatnonzero(part.file[rows] == file)
            mine = mine[np.argsort(part.row[rows[mine]])]
            want, at = part.row[rows[mine]], 0
            for batch in self.batches(file, ["class", "x"]):
                some = want[(low := np.searchsorted(want, at)) : np.searchsorted(want, at + len(batch))] - at
                if len(some):
                    found.append(batch.take(pa.array(some)))
                    places.append(mine[low : low + len(some)])
                at += len(batch)
        return pa.Table.from_batches(found).take(pa.array(np.argsort(np.concatenate(places))))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def meetings(a: Sets, b: Sets, same: bool, later: bool, least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) whose sketches allow a pair, each once, with the one of a the larger set. same: a and b are one; later: of equal sizes those of a come after those of b."""
    p, q = least.numerator, least.denominator
    low = np.searchsorted(b.n, -(-p * a.n // q))
    high = np.arange(len(a.n)) if same else np.searchsorted(b.n, a.n, "right" if later else "left")
    t, row, order = a.asks
    first, many = np.empty(len(t), np.int64), np.zeros(len(t), np.int64)
    first[order] = lo = np.searchsorted(b.posts, t | low[row].astype(np.uint64))
    many[order] = np.maximum(np.searchsorted(b.posts, t | high[row].astype(np.uint64)) - lo, 0)
    sums = np.concatenate([[0], np.cumsum(many)])[a.bounds]  # of whole rows
    words = min(a.sketch.shape[1], b.sketch.shape[1])
    fold = lambda s: np.bitwise_xor.reduce(s.reshape(len(s), -1, words), 1)
    x, y, at = fold(a.sketch), fold(b.sketch), 0
    step = max(WORDS // words, 1)
    while at < len(a.n):
        to = max(int(np.searchsorted(sums, sums[at] + MEETINGS, "right")) - 1, at + 1)
        mine = slice(a.bounds[at], a.bounds[to])
        if sums[to] > sums[at]:
            met = b.posts[spread(first[mine], many[mine])] & np.uint64(0xFFFFFFFF)
            met = np.sort(np.repeat(np.repeat(np.arange(at, to), np.diff(a.bounds[at : to + 1])), many[mine]).astype(np.uint64) << np.uint64(32) | met)
            met = met[np.concatenate([[True], met[1:] != met[:-1]])]
            i, j = (met >> np.uint64(32)).astype(np.int64), (met & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for k in range(0, len(i), step):
                u, v = i[k : k + step], j[k : k + step]
                both = a.n[u] + b.n[v]
                live = np.bitwise_count(x[u] ^ y[v]).sum(1, dtype=np.int64) <= both + 2 * (-p * both // (p + q))
                if live.any():
                    yield u[live], v[live]
        at = to


def shared_tokens(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many tokens the spelled sets x[i] and y[j] have in common; i in order."""
    lists = pc.split_pattern(pa.concat_arrays([x, y]), "\0")
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    bounds, n = lists.offsets.to_numpy(), len(x)
    marked, out = np.zeros(codes.max() + 1, bool), np.empty(len(i), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = codes[bounds[i[s]] : bounds[i[s] + 1]]
        marked[own] = True
        if e - s == 1:
            out[s] = np.count_nonzero(marked[codes[bounds[n + j[s]] : bounds[n + j[s] + 1]]])
        else:
            size = bounds[n + j[s:e] + 1].astype(np.int64) - bounds[n + j[s:e]]
            out[s:e] = np.add.reduceat(marked[codes[spread(bounds[n + j[s:e]].astype(np.int64), size)]], np.cumsum(size) - size, dtype=np.int64)
        marked[own] = False
    return out


def confirmed(one: Block, a: Sets, other: Block, b: Sets, i: np.ndarray, j: np.ndarray, least: Fraction) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, total) of the rows i of a and j of b that reach the threshold; sets of one class are no pair."""
    mine, i = np.unique(i, return_inverse=True)
    yours, j = np.unique(j, return_inverse=True)
    x, y = one.whole(a, mine), other.whole(b, yours)
    n, m = a.n[mine], b.n[yours]
    group = (np.cumsum(n) // TOKENS)[i] * (int(m.sum()) // TOKENS + 1) + (np.cumsum(m) // TOKENS)[j]
    order = np.lexsort((j, i, group))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        u, at = np.unique(i[order[s:e]], return_inverse=True)
        v, to = np.unique(j[order[s:e]], return_inverse=True)
        shared = shared_tokens(x["x"].take(pa.array(u)).combine_chunks(), y["x"].take(pa.array(v)).combine_chunks(), at, to)
        total = n[u[at]] + m[v[to]] - shared
        good = np.flatnonzero(shared * least.denominator >= total * least.numerator)
        ends = [z["class"].take(pa.array(w)).combine_chunks() for z, w in ((x, u[at[good]]), (y, v[to[good]]))]
        found = pa.RecordBatch.from_arrays([*ends, pa.array(shared[good], pa.int32()), pa.array(total[good], pa.int32())], names=["a", "b", "shared", "total"])
        yield found.filter(pc.not_equal(found["a"], found["b"]))


def joined(one: Block, other: Block, least: Fraction) -> Iterator[pa.RecordBatch]:
    """The pairs between two blocks, or within one that is given twice."""
    for i, a in enumerate(one.parts()):
        for j, b in enumerate(other.parts()):
            if one is other and j > i:
                break
            if one is other and j == i:
                ways = [(a, a, one, one, True, True)]
            else:
                ways = [(a, b, one, other, False, True), (b, a, other, one, False, False)]
            for x, y, mine, yours, same, later in ways:
                wait: list = []
                for met in meetings(x, y, same, later, least):
                    wait.append(met)
                    if sum(len(u) for u, _ in wait) >= WAITING:
                        yield from confirmed(mine, x, yours, y, *map(np.concatenate, zip(*wait, strict=True)), least)
                        wait = []
                if wait:
                    yield from confirmed(mine, x, yours, y, *map(np.concatenate, zip(*wait, strict=True)), least)


def blocks(sized: DataFrame) -> list[dict]:
    """Files of each size class by blocks, with the sizes of their sets and the number of prefix tokens."""
    files = sized.groupBy("size", F.input_file_name().alias("file")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.octet_length("t") / 4).cast("long").alias("posts"))
    files = sorted((r.asDict() for r in files.collect()), key=lambda f: (f["size"], f["file"]))
    most, out = min(max(sum(f["posts"] for f in files) // BLOCKS, LEAST_POSTS), POSTS), []
    for f in files:
        if out and out[-1]["size"] == f["size"] and out[-1]["posts"] + f["posts"] <= most:
            b = out[-1]
            b.update(files=[*b["files"], f["file"]], low=min(b["low"], f["low"]), high=max(b["high"], f["high"]), posts=b["posts"] + f["posts"])
        else:
            out.append({**f, "files": [f["file"]]})
    return out


def linking(sets: DataFrame, cells: np.ndarray, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, shared, total) of classes that reach the threshold, and (class, n) of the pairs' ends, counted in parts. cells: how often tokens occur, in these
    sets at least."""
    spark, p, q = sets.sparkSession, least.numerator, least.denominator
    kind = sets.schema["class"].dataType
    path = laid_out(sets, cells, least)
    found = blocks(spark.read.schema("n int, t binary, size int").parquet(path))
    units = [(i, j) for i in range(len(found)) for j in range(i + 1) if found[j]["high"] * q >= p * found[i]["low"] and found[i]["high"] * q >= p * found[j]["low"]]
    units.sort(key=lambda u: -found[u[0]]["posts"] * found[u[1]]["posts"])  # the longest first
    top = found[0]["file"].rsplit("/size=", 1)[0] if found else ""
    files = [([f.removeprefix(top) for f in b["files"]], b["high"]) for b in found]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch["id"].to_pylist():
                one, other = (Block(top, *files[i]) for i in units[u])
                yield from joined(one, one if units[u][0] == units[u][1] else other, least)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs(batches):
            counts = pc.value_counts(pa.concat_arrays([batch["a"], batch["b"]]))
            yield pa.RecordBatch.from_arrays(counts.flatten(), names=["class", "n"])

    tasks = spark.range(0, len(units), 1, max(len(units), 1))
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("shared", T.IntegerType()), T.StructField("total", T.IntegerType())])
    met = tasks.mapInArrow(pairs, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "total")
    return met, tasks.mapInArrow(ends, T.StructType([T.StructField("class", kind), T.StructField("n", T.LongType())]))


def candidates(sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of classes that reach the threshold."""
    return linking(sets, counted(sets), least)[0].select("a", "b")


def similar_sets(rows: DataFrame, id: str, tokens: Column, least: Fraction = Fraction(7, 10)) -> Similar:
    """All pairs of rows' token sets with a Jaccard similarity of `least` (above 0, up to 1) or more.

    Rows without an id or without tokens link with nothing; repeated tokens count once; rows of one id with different sets are rows of their own, that don't link.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    spelt = spelled_sets(rows, id, tokens)
    members, sets = grouped(spelt)
    pairs, ends = linking(sets, counted(spelt.where("_k is not null and id is not null")), least)
    return Similar(pairs, members, ends)


def linked(found: Similar) -> DataFrame:
    """(id, class, links): for each row its class and with how many other classes that links."""
    ends = found.ends.groupBy("class").agg(F.sum("n").alias("links"))
    return found.members.join(ends, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
