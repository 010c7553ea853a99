"""What several operators share: tables, folders on shared storage, and words of a batch of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, run_dir  # noqa: F401  run_dir: for the operators

#: Bytes of text that one numpy step takes at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of an Arrow batch between Spark and Python at most.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write once as Parquet on shared storage and read it again: cuts the lineage and survives lost executors."""
    return cut(df, what)


def numbered(df: DataFrame, name: str = "place") -> tuple[DataFrame, int]:
    """Add a row's place, 0, 1, 2 ... without a gap, and give the count.

    Rows are numbered by their file and where they stand in it, so that a place is the same however files are split between
    tasks. What isn't a whole scan of Parquet is written first. What is joined back holds 16 bytes a file.
    """
    try:
        rows = df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
        counts = rows.groupBy("_file").agg(F.count("*").alias("n"), F.max("_at").alias("last"), F.count_distinct("_metadata.file_path").alias("files")).orderBy("_file").toArrow()
    except AnalysisException:
        return numbered(materialise(df, "numbered"), name)
    n, last = counts["n"].to_numpy(), counts["last"].to_numpy()
    if not np.array_equal(n, last + 1):  # rows were left out after the scan
        return numbered(materialise(df, "numbered"), name)
    if (counts["files"].to_numpy() > 1).any():
        raise RuntimeError("two files' names have one hash")
    before = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    offsets = df.sparkSession.createDataFrame(pa.table({"_file": counts["_file"], "_before": before.astype(np.int64)}))
    return rows.join(F.broadcast(offsets), "_file").withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before"), int(n.sum())


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over rows that hold texts. Texts can be long, so the session's Arrow batches are held to BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def hash_share(key: Column, n: int, wanted: int) -> Column:
    """Whether a row is in a share by its key's hash that holds about `wanted` of n rows."""
    return F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))


def texts_by_hash(rows: DataFrame, most: int, most_bytes: int) -> pa.Table:
    """Rows (h, t, ...) for the driver in the order of h, one of each h: at most `most`, and most_bytes of text together.

    Only hashes and sizes are looked at before it is known which texts come. A text that the bytes left can't hold is passed
    over and the next one is looked at. Of several texts of one h the one with the smallest hash of its own is meant, so that
    rows of one h never exceed the bounds.
    """
    sized = rows.withColumns({"_t": F.xxhash64("t"), "_n": F.coalesce(F.octet_length("t"), F.lit(0))})
    narrow = sized.groupBy("h").agg(F.min(F.struct("_t", "_n")).alias("x")).orderBy("h").limit(most).select("h", "x._t", "x._n").toArrow()
    left, fit = most_bytes, []
    for i, n in enumerate(narrow["_n"].to_pylist()):
        if n <= left:
            fit.append(i)
            left -= n
    picked = rows.sparkSession.createDataFrame(narrow.take(pa.array(fit, pa.int64())).select(["h", "_t"]))  # `most` rows of 16 bytes
    others = [c for c in rows.columns if c != "h"]
    found = sized.join(F.broadcast(picked), ["h", "_t"]).groupBy("h").agg(F.first(F.struct(*others)).alias("x"))
    return found.select("h", "x.*").toArrow().sort_by("h")


#: Labelled rows that a classifier is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 24 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, *, doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """Texts and labels of at most `most` labelled ids for which `keep` holds, by hashes of their ids, `most_bytes` of text together.

    The labels are cut to the sample before texts are read. Ids and labels that are null are not used; an id with several
    labels has the smallest, one with several texts one of them.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & keep).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    mine = F.xxhash64("_id")
    chosen = known.where(hash_share(mine, known.count(), 2 * most)).groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = chosen.orderBy(F.pmod(mine, F.lit(1 << 30)), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(F.broadcast(chosen), "_id").select(mine.alias("h"), "t", "_y")
    got = texts_by_hash(rows, most, most_bytes)
    return got["t"].to_pylist(), got["_y"].to_numpy()


def all_labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Text `t` and label `_y` of every labelled id for which `keep` holds, and the hash `h` of the id.

    Ids and labels that are null are not used; an id with several labels has the smallest, one with several texts that with
    the smallest hash.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & keep).groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(known, "_id")
    found = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("t").alias("_t"), "t", "_y")).alias("x"))
    return found.select(F.xxhash64("_id").alias("h"), "x.t", "x._y")


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each run of rows with one value of a column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch[column].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and a < b and held[0][column][0].as_py() != values[a]:
                yield held
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield held


#: Numbers of the weights that are averaged in one group, and the columns of a block.
BLOCK, BLOCKS = 1 << 13, "block int, part int, n long, x binary"


def weights_in_blocks(weights: np.ndarray, part: int, n: int) -> pa.RecordBatch:
    """What a task hands on of a part of n rows for `mean_of_parts`."""
    blocks = [weights[i : i + BLOCK].astype(np.float32).tobytes() for i in range(0, len(weights), BLOCK)]
    k = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, n, np.int64)), pa.array(blocks, pa.binary())], names=["block", "part", "n", "x"])


def mean_of_parts(blocks: DataFrame) -> np.ndarray:
    """The mean of the parts' weights by their rows, added in the order of parts; the driver gets the mean only."""

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("n", "ascending")])
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(rows["x"].to_pylist(), rows["n"].to_pylist(), strict=True))
        return pa.table({"block": rows["block"].slice(0, 1), "x": pa.array([(total / sum(rows["n"].to_pylist())).astype(np.float32).tobytes()], pa.binary())})

    found = blocks.groupBy("block").applyInArrow(mean, "block int, x binary").toArrow().sort_by("block")
    return np.concatenate([np.frombuffer(x, np.float32) for x in found["x"].to_pylist()])


def score_texts(docs: DataFrame, model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add model.scores of every whole text, a batch at a time; a column of the name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], pa.array(shared.value.scores(batch[text]), pa.float64())], names=schema.names)

    return map_texts(docs, run, schema)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`: which fold a row is in."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` or more, for narrow columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and where each value begins; null is the empty text."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true inside the given inclusive spans."""
    found = np.zeros(256, bool)
    for a, b in spans:
        found[a : b + 1] = True
    return found


#: Bytes of a word: all but space and the controls 9 to 13.
SPACED_WORD = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of an alphanumeric word, after A-Z became lower case: 0-9, a-z, and all above ASCII.
ALNUM_WORD = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def find_words(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one entry more than texts). No word crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, at)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of x over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n at least; base is odd."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = max(n, 1 << 16)
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair: equal runs, equal hashes. Wraps modulo 2**64."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever stands around it."""
    found = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        a, b = start[i], end[j - 1]
        found[i:j] = run_hashes(_BYTE[data[a:b]], start[i:j] - a, end[i:j] - a, 0x9E3779B97F4A7C55)
        i = j
    return found
