"""Line dedup that can be undone: an index of lines on shared storage, with exact reference counts and sharded cuckoo filters.

A line's key is the line without white space at its ends and in lower case (ASCII). A key of `shortest` code points or more that
is found in `least` documents or more is a repeat: all its lines go but those of the largest document that has it.

The index holds, by key hash (128 bits), which documents have it: the exact table. Rows are only ever added to it, +1 for a
document that brings a key and -1 for one that is taken out, so a state is a sum and every insertion can be taken back.
Repeats, which are few, are also members of cuckoo filters, one for each shard of the keys: a key enters its shard's filter when its
count reaches `least` and leaves it when the count falls below. So a document's lines are asked for in the filters first, and
only those that may be repeats, most of them truly, meet the exact table, which decides. A filter that is too full, or
shards that hold more than they are meant to, are made anew from the exact table.

Each batch writes folders of its own and then one row that names them: a batch that fails half-way has changed nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .cuckoo import Cuckoo

#: Documents that make a line a repeat, and code points of the shortest line that can be one.
LEAST, SHORTEST = 3, 20
#: Members that a shard's filter is meant to hold, and keys that one task asks a filter for, about.
SHARD_KEYS, ASKED_KEYS = 1 << 18, 1 << 18
_REFS = "key binary, doc {}, sign int"
_FILTERS = "shard int, filter binary, members long"
_BATCHES = "batch int, refs array<string>, filters string, shards int"
_NEWLINE = np.uint8(10)


def lines(texts: pa.Array, shortest: int = SHORTEST) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """All bytes of the texts; each line's start, end, and text's place; its key's hash, or None if the key is too short.

    A null or empty text is one empty line.
    """
    data, at = common.text_bytes(texts)
    n = len(at) - 1
    breaks = np.flatnonzero(data == _NEWLINE)
    of_break = np.searchsorted(at, breaks, "right") - 1
    start = np.concatenate([at[:-1], breaks + 1])
    of = np.concatenate([np.arange(n), of_break])
    order = np.lexsort((start, of))
    start, of = start[order], of[order]
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    end = np.where(last, at[of + 1], np.append(start[1:], 0) - 1)
    solid = np.flatnonzero(common.SPACED_WORD[data]) if len(data) else np.zeros(0, np.int64)
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    low, high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    low[some], high[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])  # not a byte within a code point
    long = points[high] - points[low] >= shortest
    lower = common.LOWER[data].tobytes()
    blake = hashlib.blake2b
    keys: list[bytes | None] = [None] * len(start)
    for i in np.flatnonzero(long).tolist():
        keys[i] = blake(lower[low[i] : high[i]], digest_size=16).digest()
    return data.tobytes(), start, end, of, keys


def postings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(key, doc): the keys of each document, once each for a row; rows without an id have none."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc", docs.schema[doc_id].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            _, _, _, of, keys = lines(batch[text], shortest)
            pairs = sorted({(d, k) for d, k in zip(of.tolist(), keys, strict=True) if k})
            at = pa.array([d for d, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs], pa.binary()), batch[doc_id].take(at)], names=["key", "doc"])

    return common.map_texts(docs.where(F.col(doc_id).isNotNull()).select(doc_id, text), run, schema)


def first_bytes(keys: pa.Array) -> np.ndarray:
    """The keys' first 8 bytes as numbers: what filters go by."""
    return np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), "<u8").astype(np.uint64)


@dataclass(frozen=True)
class State:
    """What the last finished batch left: the exact table's folders, the filters' folder, the number of shards."""

    batch: int
    refs: tuple[str, ...]
    filters: str | None
    shards: int


class LineIndex:
    """An index of lines in a folder that driver and executors share. Batches come one after the other."""

    def __init__(self, spark: SparkSession, path: str, *, doc_type: str = "bigint", least: int = LEAST, shortest: int = SHORTEST, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.doc_type = spark, path.rstrip("/"), doc_type
        self.least, self.shortest, self.shard_keys = least, shortest, shard_keys

    # state

    def state(self) -> State:
        try:
            last = self.spark.read.schema(_BATCHES).parquet(f"{self.path}/batches").orderBy(F.desc("batch")).first()
        except AnalysisException:  # no folder yet
            last = None
        return State(last.batch, tuple(last.refs), last.filters, last.shards) if last else State(0, (), None, 1)

    def _write(self, df: DataFrame, what: str) -> str:
        name = f"{what}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: tuple[str, ...], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _finish(self, old: State, refs: tuple[str, ...], filters: str, shards: int) -> None:
        row = self.spark.createDataFrame([(old.batch + 1, list(refs), filters, shards)], _BATCHES)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def refs(self, state: State | None = None) -> DataFrame:
        """The exact table as written: (key, doc, sign)."""
        return self._read((state or self.state()).refs, _REFS.format(self.doc_type))

    def _counts(self, refs: DataFrame) -> DataFrame:
        """(key, docs, last): how many documents have each key, and the largest of them. A pair counts while its signs add up to more than 0."""
        live = refs.groupBy("key", "doc").agg(F.sum("sign").alias("_s")).where("_s > 0")
        return live.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))

    def counts(self) -> DataFrame:
        """The reference counts: (key, docs, last)."""
        return self._counts(self.refs())

    def repeats(self) -> DataFrame:
        """The keys that are repeats, from the exact table."""
        return self.counts().where(F.col("docs") >= self.least)

    # filters

    def _shard(self, shards: int):
        return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")

    def _made(self, repeats: DataFrame, shards: int) -> DataFrame:
        """New filters of the keys given."""

        def make(key: tuple, rows: pa.Table) -> pa.Table:
            hashes, size = first_bytes(rows["key"]), rows.num_rows
            while not (found := Cuckoo.sized(size)).add(hashes):
                size *= 2
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([found.saved()], pa.binary()), "members": pa.array([rows.num_rows], pa.int64())})

        return repeats.select(self._shard(shards), "key").groupBy("shard").applyInArrow(make, _FILTERS)

    def _update(self, state: State, refs: DataFrame, batch: DataFrame) -> tuple[str, int]:
        """Write the filters after a batch of refs: its name, and the number of shards. What crosses the least count goes in or out of its shard's filter."""
        repeats = lambda x: self._counts(x).where(F.col("docs") >= self.least).select("key")

        def anew(x: DataFrame) -> tuple[str, int]:
            every = common.materialise(repeats(x), "repeats")
            shards = max(1, -(-every.count() // self.shard_keys))
            return self._write(self._made(every, shards), "filters"), shards

        if not state.filters:
            return anew(refs.unionByName(batch) if state.refs else batch)
        touched = batch.select("key").distinct()
        before = repeats(refs.join(touched, "key", "left_semi")).withColumn("old", F.lit(1))
        after = repeats(refs.unionByName(batch).join(touched, "key", "left_semi")).withColumn("new", F.lit(1))
        crossing = before.join(after, "key", "full_outer").where("old is null or new is null")
        crossing = common.materialise(crossing.select(self._shard(state.shards), "key", F.col("new").isNotNull().alias("enters")), "crossing")
        old = self._read((state.filters,), _FILTERS)
        members = old.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0] + crossing.where("enters").count()
        if members > 2 * self.shard_keys * state.shards:
            return anew(refs.unionByName(batch))

        def change(key: tuple, filters: pa.Table, rows: pa.Table) -> pa.Table:
            """The shard's filter after the changes; an empty one if it must be made anew."""
            own = Cuckoo.loaded(filters["filter"][0].as_py()) if filters.num_rows else Cuckoo.sized(rows.num_rows)
            full = False
            if rows.num_rows:
                enters, hashes = rows["enters"].to_numpy(), first_bytes(rows["key"])
                if own.remove(hashes[~enters]) != (~enters).sum():
                    raise ValueError("the filters and the exact table differ")
                full = not own.add(hashes[enters])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([b"" if full else own.saved()], pa.binary()), "members": pa.array([own.members], pa.int64())})

        changed = common.materialise(old.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(change, _FILTERS), "filters")
        full = changed.where(F.octet_length("filter") == 0).select("shard")
        if not full.isEmpty():
            keys = repeats(refs.unionByName(batch)).select("key", self._shard(state.shards)).join(full, "shard", "left_semi")
            changed = changed.where(F.octet_length("filter") > 0).unionByName(self._made(keys, state.shards))
        return self._write(changed, "filters"), state.shards

    # batches

    def _commit(self, state: State, batch: DataFrame) -> None:
        name = self._write(batch, "refs")
        written = self._read((name,), _REFS.format(self.doc_type))
        filters, shards = self._update(state, self.refs(state), written)
        self._finish(state, (*state.refs, name), filters, shards)

    def insert(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> None:
        """Add documents. Rows of one id are one document; rows without an id, and keys that are too short, add nothing. A document
        that is there already gains the keys it did not have, and what it had is counted once all the same."""
        found = postings(docs, doc_id=doc_id, text=text, shortest=self.shortest).distinct()
        self._commit(self.state(), found.select("key", F.col("doc").cast(self.doc_type).alias("doc"), F.lit(1).alias("sign")))

    def delete(self, ids: DataFrame, *, doc_id: str = "doc_id") -> None:
        """Take documents out, however often they came in: counts, largest documents and filters are then as if they had never been there."""
        state = self.state()
        gone = self.refs(state).join(ids.select(F.col(doc_id).cast(self.doc_type).alias("doc")).distinct(), "doc", "left_semi")
        gone = gone.groupBy("key", "doc").agg(F.sum("sign").alias("_s")).where("_s > 0")
        self._commit(state, gone.select("key", "doc", (-F.col("_s")).cast("int").alias("sign")))

    def compact(self) -> None:
        """Write the exact table anew as one folder of live pairs; the folders before stay until they are removed."""
        state = self.state()
        live = self.refs(state).groupBy("key", "doc").agg(F.sum("sign").alias("_s")).where("_s > 0")
        if state.filters:
            name = self._write(live.select("key", "doc", F.lit(1).alias("sign")), "refs")
            self._finish(state, (name,), state.filters, state.shards)

    # use

    def asked(self, keys: DataFrame) -> DataFrame:
        """The keys, which differ, that may be repeats by their shards' filters. A shard's keys are dealt over several tasks, each with the filter."""
        state = self.state()
        if not state.filters:
            return keys.where("false")
        parts = max(1, -(-keys.count() // (state.shards * ASKED_KEYS)))

        def ask(key: tuple, filters: pa.Table, rows: pa.Table) -> pa.Table:
            if not filters.num_rows or not rows.num_rows:
                return rows.select(["key"]).slice(0, 0)
            return rows.select(["key"]).filter(pa.array(Cuckoo.loaded(filters["filter"][0].as_py()).has(first_bytes(rows["key"]))))

        filters = self._read((state.filters,), _FILTERS).select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter")
        dealt = keys.select(self._shard(state.shards), F.pmod(F.xxhash64("key", F.lit(parts)), F.lit(parts)).cast("int").alias("part"), "key")
        return filters.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(ask, "key binary")

    def drops(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (key, doc) those whose lines go. Filters are asked for each key once, and only what they let through meets the exact table."""
        keys = common.materialise(pairs.select("key").distinct(), "keys")
        perhaps = common.materialise(self.asked(keys), "perhaps")
        sure = self._counts(self.refs().join(perhaps, "key", "left_semi")).where(F.col("docs") >= self.least)
        sure = common.materialise(sure.select("key", "last"), "repeats")
        return pairs.join(sure, "key").where("doc <> last").select("key", "doc")

    def clean(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add n_lines, n_dropped and kept, the text without the lines that repeat, to documents of this index (or others, held against it).

        A null or empty text is one empty line. Rows without an id keep all lines; rows of one id are one document, and equal rows
        are cleaned alike. A very long text is a step of its own, whole. A column of `docs` named as an added one is replaced,
        one named _doc or _gone left out. An empty table gives no rows.
        """
        added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
        fields = [f for f in docs.schema.fields if f.name not in {x.name for x in added} | {"_doc", "_gone"}]
        pairs = common.materialise(postings(docs, doc_id=doc_id, text=text, shortest=self.shortest).distinct(), "pairs")
        drops = self.drops(pairs)
        gone = drops.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("key").alias("_gone"))  # a document's own lines
        rows = docs.select([f.name for f in fields]).join(common.materialise(gone, "drops"), F.col(doc_id) == F.col("_doc"), "left").drop("_doc")
        schema = T.StructType([*fields, *added])
        shortest = self.shortest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.steps(batches, text):
                data, start, end, of, keys = lines(batch[text], shortest)
                gone = [set(x) if x else () for x in batch["_gone"].to_pylist()]
                n, dropped, kept = np.bincount(of, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64), []
                first = np.searchsorted(of, np.arange(batch.num_rows + 1))
                for i, out in enumerate(gone):
                    a, b = first[i], first[i + 1]
                    if not out:
                        kept.append(data[start[a] : end[b - 1]].decode())
                        continue
                    stay = [j for j in range(a, b) if keys[j] is None or keys[j] not in out]
                    dropped[i] = b - a - len(stay)
                    kept.append(b"\n".join([data[start[j] : end[j]] for j in stay]).decode())
                more = [pa.array(n, pa.int64()), pa.array(dropped), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in fields], *more], names=schema.names)

        return common.map_texts(rows, run, schema)


def digest(cleaned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts of lines and of lines that went, and the hash of what stays."""
    return cleaned.select(F.col(doc_id), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
