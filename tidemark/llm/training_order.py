"""Training-order materialisation.

Every token sequence has a place in the input, 0 to n - 1 without a gap. A keyed Feistel network permutes the smallest power of two that
holds n, and walking its cycles until a value under n comes up permutes the places themselves: that is the sequence's
global slot, so the order is random, repeatable from the key, and known without sorting. Ranges of slots are shards, and a task
writes a range of them. It joins a shard's sequences in slot order, each with an end token behind, and writes them as records of
a fixed number of tokens, so that record r of a shard begins at byte r * stride and a reader can go on from any record. Every try
of a task writes files of its own names; the manifest, written last from the tries that Spark took, says which a shard's is.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Sequences of a shard, tokens of a record, rounds of the network, and cycle steps (each leaves the walk unfinished
#: for less than half of the rows; an unfinished walk stops the job).
SHARD_ROWS, RECORD, ROUNDS, WALK = 8192, 1024, 6, 128
KEY = 20240229
#: Tasks that write shards at most: beyond as many shards a task writes several. The folder of the manifest.
MOST_TASKS, MANIFEST = 1 << 15, "manifest"


def permuted(place: Column, n: int, key: int = KEY) -> Column:
    """The slot of a place: a permutation of 0 .. n - 1."""
    bits = max(0, n - 1).bit_length()
    small, large = bits // 2, bits - bits // 2

    def turn(x: Column, r: Column) -> Column:  # halves of `small` and `large` bits change places in each round
        even = r % 2 == 0
        low, high = F.when(even, large).otherwise(small), F.when(even, small).otherwise(large)
        power = lambda k: F.when(k == large, F.lit(1 << large)).otherwise(F.lit(1 << small)).cast("long")
        right, left = x % power(low), (x / power(low)).cast("long") if bits > 52 else F.floor(x / power(low))
        return right * power(high) + left.bitwiseXOR(F.pmod(F.xxhash64(F.lit(key), r, right), power(high)))

    rounds, steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.sequence(F.lit(0), F.lit(WALK - 1))
    once = lambda x: F.aggregate(rounds, x, turn)
    found = F.aggregate(steps, place.cast("long"), lambda x, i: F.when((i > 0) & (x < n), x).otherwise(once(x)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a cycle was not walked to its end")).cast("long"))


class ShardFile:
    """Writes one shard under a name that no other try uses."""

    def __init__(self, folder: str, shard: int, record: int, dtype: str, pad: int):
        self.fs, self.top = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.top)
        self.file, self.shard, self.record, self.dtype, self.pad = f"shard-{shard:08d}.{uuid.uuid4().hex}.bin", shard, record, np.dtype(dtype), pad
        self.out, self.tokens, self.sequences = self.fs.open_output_stream(posixpath.join(self.top, self.file)), 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Append one sequence and its end token; gives its first token's position in the shard."""
        at = self.tokens
        self.out.write(np.append(ids, self.pad).astype(self.dtype).tobytes())
        self.tokens += len(ids) + 1
        self.sequences += 1
        return at

    def close(self) -> pyarrow.NativeFile:
        """Fill the last record, and open what was written."""
        self.out.write(np.full(-self.tokens % self.record, self.pad, self.dtype).tobytes())
        self.out.close()
        return self.fs.open_input_file(posixpath.join(self.top, self.file))


def _tokens(file: pyarrow.NativeFile, first: int, n: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(file.read_at(n * dtype.itemsize, first * dtype.itemsize), dtype)


class ShardReader:
    """Reads a shard's records in turn; `record` is the state to go on from."""

    def __init__(self, folder: str, shard: int, record: int = 0):
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        found = ds.dataset(posixpath.join(top, MANIFEST), filesystem=fs, format="parquet").to_table(filter=ds.field("shard") == shard).to_pylist()
        if not found:
            raise FileNotFoundError(f"{folder} has no shard {shard}")
        self.about = found[0]
        self.file, self.record = fs.open_input_file(posixpath.join(top, self.about["file"])), record
        self.dtype = np.dtype(self.about["dtype"])

    def __iter__(self) -> ShardReader:
        return self

    def __next__(self) -> np.ndarray:
        if self.record >= self.about["records"]:
            raise StopIteration
        self.record += 1
        size = self.about["record_tokens"]
        return _tokens(self.file, (self.record - 1) * size, size, self.dtype)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n tokens from a position of the shard."""
        return _tokens(self.file, first, n, self.dtype)


def write_order(sequences: DataFrame, folder: str, *, id_col: str = "doc_id", ids: str = "ids", key: int = KEY, end_token: int = 50256, dtype: str = "<u2", record: int = RECORD, shard_rows: int = SHARD_ROWS, placed: int | None = None, ids_type: str = "<u4") -> DataFrame:
    """Write all sequences (ids: binary, integers of ids_type) in training order, and give where each is.

    Returns id_col, place, slot, shard, first_token, n_tokens, ids_sha256 of the ids read back from the shard (as 32-bit integers)
    and the shard's file, a row for each row. `placed` is the number of rows where these bring their places (numbered by
    common.numbered before they were tokenised); else they are written once and numbered.
    Null and empty sequences take a slot and hold no token but the end; repeated rows take slots of their own; a very long
    sequence is one sequence, whole; an empty table writes no shard; other columns, whatever their names, are not read.
    An id of more than dtype holds, or a slot that is missing, stops the job.
    """
    kept = sequences.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"), *["place"] * (placed is not None))
    rows, n = (kept, placed) if placed is not None else common.numbered(common.materialise(kept, "sequences"))
    shards = max(1, -(-n // shard_rows))
    each = -(-shards // MOST_TASKS)  # shards of a task
    dealt = rows.withColumn("slot", permuted(F.col("place"), n, key)).withColumn("shard", (F.floor(F.col("slot") / shard_rows)).cast("int"))
    dealt = dealt.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    schema = T.StructType([T.StructField(id_col, sequences.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("place", "slot")], T.StructField("shard", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("first_token", "n_tokens")], T.StructField("ids_sha256", T.StringType()), T.StructField("file", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []

        def finish() -> pa.RecordBatch:
            with out.close() as back:
                hashes = [hashlib.sha256(_tokens(back, at, m, out.dtype).astype("<u4").tobytes()).hexdigest() for at, m, _ in rows]
            table = pa.Table.from_batches([b for *_, b in rows])
            spans = [pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in ("id", "place", "slot", "shard")], *spans, pa.array(hashes), pa.array([out.file] * len(rows))], names=schema.names)

        for batch in common.steps(batches, "ids"):
            narrow = batch.select(["id", "place", "slot", "shard"])
            for i, (shard, content) in enumerate(zip(batch["shard"].to_pylist(), batch["ids"].to_pylist(), strict=True)):
                if out is None or out.shard != shard:
                    if out is not None:
                        yield finish()
                    out, rows = ShardFile(folder, shard, record, dtype, end_token), []
                got = np.frombuffer(content or b"", ids_type)
                if len(got) and got.max() > np.iinfo(np.dtype(dtype)).max:
                    raise ValueError(f"{dtype} doesn't hold the id {got.max()}")
                rows.append((out.add(got), len(got), narrow.slice(i, 1)))
        if out is not None:
            yield finish()

    index = common.materialise(common.map_texts(dealt, run, schema), "order")
    whole = index.agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high")).first()
    if n and tuple(whole) != (n, n, 0, n - 1):
        raise RuntimeError(f"slots are not 0 to {n - 1}: {whole}")
    tokens = F.max(F.col("first_token") + F.col("n_tokens") + 1)
    about = index.groupBy("shard", "file").agg(F.min("slot").alias("first_slot"), F.count("*").alias("sequences"), tokens.alias("tokens"), F.ceil(tokens / record).alias("records"))
    about.withColumns({"record_tokens": F.lit(record), "dtype": F.lit(np.dtype(dtype).str), "end_token": F.lit(end_token)}).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{MANIFEST}")
    return index


def tokenise(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", ids_type: str = "<u4") -> DataFrame:
    """Add ids of ids_type by the public tokenizer library with a rank file (this operator orders ids; it is not an encoder)."""
    from .bpe import rank_lines

    lines = docs.sparkSession.sparkContext.broadcast(rank_lines(ranks))
    kept = [f for f in docs.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        pairs = (x.split() for x in lines.value.splitlines() if x)
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for batch in common.steps(batches, text):
            ids = [encoder.encode_to_numpy(t).astype(ids_type).tobytes() if t else b"" for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], pa.array(ids, pa.binary())], names=[*[f.name for f in kept], "ids"])

    return common.map_texts(docs, run, T.StructType([*kept, T.StructField("ids", T.BinaryType())]))
