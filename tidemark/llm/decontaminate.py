"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark's windows are the patterns. For each pattern length a shift table over blocks of a few words says how far a
position can be moved on without missing an occurrence; where it says zero, the bucket of the block's hash and of the
pattern's first words gives the few patterns that may stand there, and direct comparison of the words confirms one.
Documents are never shuffled and are passed over once: each task searches its own rows, many stretches of text in lock-step.
The benchmark is dealt by hash into blocks of about `block_bytes`; a task each makes the patterns of one and writes them as a file of
arrays under the shared folder, with the block's cells of the shift table, which other tasks merge slice by slice. The tasks
that search map those files into memory. The driver sees the files' names only, however large the benchmark is.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import common

#: Words of a window, and of a block of the shift table.
WINDOW, BLOCK = 10, 3
#: Bytes of benchmark text that one file of patterns is made of, about; its task holds about 40 times as much while it makes one.
BLOCK_BYTES = 8 << 20
#: Cells of a shift table for each word of the benchmark, and their number (as a power of two) at least and at most.
CELLS, FEWEST, MOST = 8, 16, 30
#: Cells of one file of a shift table at most, as a power of two.
SLICE = 24
#: Window starts that one lane of the lock-step search takes.
LANE = 256
#: Odd factors of a block's words.
_ODD = common.mix(np.arange(1, 1 + BLOCK, dtype=np.uint64)) | np.uint64(1)
_HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: What the tasks that make patterns tell: of a block its file and where its arrays are; of a slice of the shift table the cells that it sets.
_MADE = pa.schema([("path", pa.string()), ("places", pa.string()), ("length", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary()), ("moves", pa.binary())])
_SLICES = pa.schema([("length", pa.int32()), ("slice", pa.int32()), ("path", pa.string())])


def block_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words at each position."""
    total = words[at] * _ODD[0]
    for j in range(1, n):
        total += words[at + j] * _ODD[j]
    return common.mix(total)


def bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The suffix's hash above, the prefix's below: a bucket's patterns stand together, those of one prefix too."""
    return suffix & np.uint64(0xFFFFFFFF00000000) | prefix >> np.uint64(32)


@dataclass
class Patterns:
    """Patterns of one length by bucket: which words they are, and the items that have them (items[i] : items[i + 1] of `owner`)."""

    length: int
    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray
    owner: np.ndarray


@dataclass
class Block:
    """The patterns of a part of the benchmark, with the words that they are made of and its items' ids."""

    words: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    patterns: list[Patterns]
    ids: pa.ChunkedArray | None = None

    def spell(self, a: int, b: int) -> bytes:
        return b" ".join([self.text[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])

    def find(self, p: Patterns, words: np.ndarray, start: np.ndarray, key: np.ndarray, spell: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Which of the starts are occurrences and of which pattern. spell: the bytes of a run of the text's words."""
        low, high = np.searchsorted(p.keys, key, "left"), np.searchsorted(p.keys, key, "right")
        found_at, found = [], []
        while len(start):
            live = low < high
            start, low, high = start[live], low[live], high[live]
            same = (words[start[:, None] + np.arange(p.length)] == self.words[p.first[low][:, None] + np.arange(p.length)]).all(1)
            for s, i in zip(start[same].tolist(), low[same].tolist(), strict=True):
                f = int(p.first[i])
                if spell(s, s + p.length) == self.spell(f, f + p.length):
                    found_at.append(s)
                    found.append(i)
            low = low + 1
        return np.array(found_at, np.int64), np.array(found, np.int64)


def build(texts: pa.Array, window: int = WINDOW) -> Block:
    """The patterns of item texts; an item is known by its place in them."""
    data, at = common.text_bytes(texts)
    data = common.LOWER[data]
    start, end, bounds = common.find_words(data, at, common.ALNUM_WORD)
    words = common.word_hashes(data, start, end)
    block = Block(words, start.astype(np.int64), end.astype(np.int64), data, [])
    n = np.diff(bounds)
    for length in np.unique(np.minimum(n[n > 0], window)).tolist():
        mine = np.flatnonzero(np.minimum(n, window) == length)
        many = n[mine] - length + 1
        owner = np.repeat(mine, many)
        first = np.repeat(bounds[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        width = min(BLOCK, length)
        key = bucket(block_hash(words, first + length - width, width), block_hash(words, first, width))
        whole = common.run_hashes(words, first, first + length, 0xD6E8FEB86659FD93)
        order = np.lexsort((whole, key))
        key, whole, first, owner = key[order], whole[order], first[order], owner[order]
        new = np.ones(len(first), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (key[1:] != key[:-1])
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        for i in np.flatnonzero(~new).tolist():  # equal hashes: equal words, or a pattern of its own
            if block.spell(first[i], first[i] + length) != block.spell(first[leader[i]], first[leader[i]] + length):
                new[i] = True
        heads = np.flatnonzero(new)
        block.patterns.append(Patterns(length, key[heads], first[heads].astype(np.int64), np.append(heads, len(first)).astype(np.int64), owner.astype(np.int64)))
    return block


def save(block: Block, path: str) -> dict:
    """Write a block's arrays one after the other; gives where each is."""
    places, at = {}, 0
    arrays = {k: getattr(block, k) for k in ("words", "start", "end", "text")}
    arrays |= {f"{p.length}.{k}": getattr(p, k) for p in block.patterns for k in ("keys", "first", "items", "owner")}
    if block.ids is not None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("item", block.ids.type)])) as out:
            out.write_table(pa.table({"item": block.ids}))
        arrays["ids"] = np.frombuffer(sink.getvalue(), np.uint8)
    fs, file = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_output_stream(file) as f:
        for name, x in sorted(arrays.items()):
            places[name] = (x.dtype.str, at, len(x))
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
            at += x.nbytes + -x.nbytes % 8
    return places


def mapped(path: str, places: dict) -> Block:
    """A saved block, its arrays mapped into memory."""
    raw = np.memmap(path, np.uint8, "r")
    got = {k: raw[at : at + n * np.dtype(d).itemsize].view(d) for k, (d, at, n) in places.items()}
    lengths = sorted({int(k.split(".")[0]) for k in got if "." in k})
    ids = pa.ipc.open_stream(pa.py_buffer(got["ids"])).read_all()["item"] if "ids" in got else None
    return Block(got["words"], got["start"], got["end"], got["text"], [Patterns(n, *(got[f"{n}.{k}"] for k in ("keys", "first", "items", "owner"))) for n in lengths], ids)


def on_machine(path: str) -> str:
    """A shared file's path for mapping: its own where the machine mounts it, else that of a copy among the files that Spark
    keeps for the executor, fetched once; a new executor fetches it again."""
    fs, file = pyarrow.fs.FileSystem.from_uri(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return file
    own = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(file))
    if not os.path.exists(own):
        draft = f"{own}-{uuid.uuid4().hex}"
        with fs.open_input_stream(file) as f, open(draft, "wb") as out:
            shutil.copyfileobj(f, out, 1 << 20)
        os.replace(draft, own)
    return own


def full_move(length: int) -> int:
    """How far a position moves on whose block no pattern of the length holds."""
    return min(255, length - min(BLOCK, length) + 1)


def cells_of(block: Block, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each pattern length the cells of a table of 2 ** bits that the block sets, in order, and the least move of each."""
    found = {}
    for p in block.patterns:
        width = min(BLOCK, p.length)
        last = p.length - width
        key = np.zeros(0, np.uint64)
        for j in range(last, -1, -1):  # one place of the block in its pattern after the other, so that few keys are held at once
            own = np.unique(block_hash(block.words, p.first + j, width) >> np.uint64(64 - bits) << np.uint64(8) | np.uint64(min(255, last - j)))
            key = np.unique(np.concatenate([key, own]))
            cell = (key >> np.uint64(8)).astype(np.int64)
            new = np.ones(len(cell), bool)
            new[1:] = cell[1:] != cell[:-1]
            key, cell = key[new], cell[new]
        found[p.length] = cell, (key & np.uint64(255)).astype(np.uint8)
    return found


@dataclass
class Sliced:
    """A shift table in slices of 2 ** width cells; a slice that is missing holds full moves only."""

    parts: dict[int, np.ndarray]
    width: int
    full: int

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        moves, of = np.full(len(cells), self.full, np.uint8), cells >> np.uint64(self.width)
        for i in np.unique(of).tolist():
            if i in self.parts:
                mine = of == i
                moves[mine] = self.parts[i][cells[mine] & np.uint64((1 << self.width) - 1)]
        return moves


@dataclass
class Search:
    """The shift table of each pattern length over all blocks, of 2 ** bits cells, and how many positions were looked at."""

    shifts: dict[int, np.ndarray | Sliced] = field(default_factory=dict)
    bits: int = FEWEST
    looked: int = 0

    def add(self, block: Block) -> None:
        for length, (cell, move) in cells_of(block, self.bits).items():
            shift = self.shifts.setdefault(length, np.full(1 << self.bits, full_move(length), np.uint8))
            shift[cell] = np.minimum(shift[cell], move)

    def starts(self, length: int, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts where the shift is zero, and their bucket. bounds: the first word of each text. Only blocks where a lane stands are hashed."""
        shift, width = self.shifts[length], min(BLOCK, length)
        last, tail = bounds[1:] - length, length - width
        lanes = np.maximum(0, (last - bounds[:-1]) // LANE + 1)
        of = np.repeat(np.arange(len(lanes)), lanes)
        at = bounds[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(last[of], at + LANE - 1)
        zero, suffixes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(at):
            self.looked += len(at)
            suffix = block_hash(words, at + tail, width)
            move = shift[suffix >> np.uint64(64 - self.bits)].astype(np.int64)
            hit = move == 0
            zero.append(at[hit])
            suffixes.append(suffix[hit])
            at = at + np.maximum(move, 1)
            live = at <= stop
            at, stop = at[live], stop[live]
        start = np.concatenate(zero)
        return start, bucket(np.concatenate(suffixes), block_hash(words, start, width))


def table_bits(words: int) -> int:
    """The size of a shift table for so many words of benchmark: most cells stay without a block, so most positions are skipped."""
    return min(MOST, max(FEWEST, (CELLS * words - 1).bit_length()))


def _scan(batch: pa.RecordBatch, text: str, search: Search, blocks: list[Block]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Per text: its words, the stretches of hit words, the items found."""
    data, at = common.text_bytes(batch[text])
    data = common.LOWER[data]
    start, end, bounds = common.find_words(data, at, common.ALNUM_WORD)
    words = common.word_hashes(data, start, end)
    raw = data.tobytes()

    def spell(a: int, b: int) -> bytes:
        return b" ".join([raw[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])

    delta = np.zeros(len(words) + 1, np.int32)
    items: list[set] = [set() for _ in range(batch.num_rows)]
    for length in search.shifts:
        where, key = search.starts(length, words, bounds)
        for block in blocks:
            p = next((p for p in block.patterns if p.length == length), None)
            if p is None or not len(where):
                continue
            hit, which = block.find(p, words, where, key, spell)
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + length, -1)
            for d, i in set(zip((np.searchsorted(bounds, hit, "right") - 1).tolist(), which.tolist(), strict=True)):
                items[d].update(block.ids.take(pa.array(p.owner[p.items[i] : p.items[i + 1]])).to_pylist())
    hit = np.cumsum(delta[:-1]) > 0
    hits: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
    if hit.any():
        edge = np.zeros(len(hit) + 1, bool)
        edge[bounds] = True
        begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
        finish = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
        for d, a, b in zip((np.searchsorted(bounds, begin, "right") - 1).tolist(), begin.tolist(), finish.tolist(), strict=True):
            hits[d].append((int(a - bounds[d]), int(b - bounds[d])))
    return np.diff(bounds), hits, items


def write_patterns(rows: DataFrame, window: int, block_bytes: int, slice_bits: int) -> tuple[int, list[tuple[str, str]], list[tuple[int, int, str]]]:
    """Make the patterns of distinct rows (item, text) in tasks, under the shared folder.

    Gives the bits of the shift tables, (file, places) of each block, and (length, slice, file) of each slice of a table. A
    block holds what one hash of the rows takes, about block_bytes, or one larger text. A file is named by the try that wrote
    it and counts once that try's row is there, so a task that runs twice leaves a file that nobody opens.
    """
    spark = rows.sparkSession
    total, words = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.coalesce(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))), F.lit(0))).first()
    bits, parts, top = table_bits(words), 1 if total <= block_bytes else 2 * -(-total // block_bytes), common.run_dir(spark, "patterns")
    width = min(bits, slice_bits)

    def place() -> str:
        fs, folder = pyarrow.fs.FileSystem.from_uri(top)
        fs.create_dir(folder)
        return f"{top}/{uuid.uuid4().hex}"

    def make(rows: pa.Table) -> pa.Table:
        block = build(rows["text"], window)
        if not block.patterns:
            return _MADE.empty_table()
        block.ids, path = rows["item"], place()
        out = [{"path": path, "places": json.dumps(save(block, path))}]
        for length, (cell, move) in cells_of(block, bits).items():
            cuts = np.searchsorted(cell, np.arange((1 << bits - width) + 1) << width).tolist()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    out.append({"length": length, "slice": i, "cells": (cell[a:b] - (i << width)).astype("<u4").tobytes(), "moves": move[a:b].tobytes()})
        return pa.Table.from_pylist(out, _MADE)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        length, path = key[0].as_py(), place()
        shift = np.full(1 << width, full_move(length), np.uint8)
        for cells, moves in zip(rows["cells"], rows["moves"], strict=True):
            cell = np.frombuffer(cells.as_buffer(), "<u4")
            shift[cell] = np.minimum(shift[cell], np.frombuffer(moves.as_buffer(), np.uint8))
        fs, file = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_output_stream(file) as f:
            f.write(shift.tobytes())
        return pa.Table.from_pylist([{"length": length, "slice": key[1].as_py(), "path": path}], _SLICES)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    made = common.materialise(dealt.groupBy("part").applyInArrow(make, from_arrow_schema(_MADE)), "shifts")
    blocks = [tuple(r) for r in made.where("path is not null").select("path", "places").collect()]
    merged = made.where("path is null").select("length", "slice", "cells", "moves").groupBy("length", "slice").applyInArrow(merge, from_arrow_schema(_SLICES))
    return bits, blocks, [tuple(r) for r in merged.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, slice_bits: int = SLICE) -> DataFrame:
    """Mark the benchmark passages of every text.

    Adds to `docs` n_words (long), hits (stretches of hit words, end exclusive) and item_ids (of the items whose windows
    occur). A text or item that is null or has no words gives no hit; an item of fewer words than the window is one
    pattern; repeated rows are marked alike; items of one id count once, and items without an id hit but are not
    listed; an empty benchmark hits nothing, an empty table gives no rows; a very long text is a step of its own, whole.
    A column of `docs` named as an added one is replaced.
    """
    spark = docs.sparkSession
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("item_ids", T.ArrayType(benchmark.schema[item_id].dataType))]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {x.name for x in added}] + added)
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    bits, files, slices = write_patterns(rows, window, block_bytes, slice_bits)
    shared, width = spark.sparkContext.broadcast((files, slices)), min(bits, slice_bits)  # names of files, two for each block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, slices = shared.value
        shifts: dict[int, Sliced] = {}
        for length, i, path in slices:
            shifts.setdefault(length, Sliced({}, width, full_move(length))).parts[i] = np.memmap(on_machine(path), np.uint8, "r")
        arrow, blocks = to_arrow_schema(schema), [mapped(on_machine(path), json.loads(places)) for path, places in files]
        for batch in common.steps(batches, text):
            n, hits, items = _scan(batch, text, Search(shifts, bits), blocks)
            kept = [batch[f.name].cast(arrow.field(f.name).type) for f in schema.fields[:-3]]
            more = [
                pa.array(n, arrow.field("n_words").type),
                pa.array([[{"start": a, "end": b} for a, b in x] for x in hits], arrow.field("hits").type),
                pa.array([sorted(x - {None}) for x in items], arrow.field("item_ids").type),
            ]
            yield pa.RecordBatch.from_arrays([*kept, *more], schema=arrow)

    return common.map_texts(docs.select([f.name for f in schema.fields[:-3]]), run, schema)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts of words, of hit words and of items, the items' hash, and whether any word is hit."""
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        F.col(doc_id),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
