"""Exact substring deduplication over words: seed and extend.

Every window of `length` words has one seed, the k-word run in it with the least hash (winnowing), so equal windows
have equal seeds. Windows of one seed stand side by side; the words they cover are the seed's region. Documents are
joined on seeds. A region that a smaller document has word for word is a repeat as a whole; of equal regions only the
smallest document's is looked at further. Where a seed has different regions, these are extended from the seed to both
sides, to each window around it, and the extensions are matched by their own hashes. So no pair of occurrences is ever
made: each step is a grouped minimum, summed up before the shuffle, and a join back. What is covered by matches are
the maximal repeats of at least `length` words.

Seed, region and window hashes are independent, so a match needs two equal 64-bit hashes of the words: among 10^13 windows
the chance of any false one is about 10^-13. Spans of a document are a set, so repeated rows add none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a window and of a seed.
LENGTH, SEED = 50, 20
#: Words of one text that are looked at in one go.
CHUNK = 1 << 19
_SEED_BASE, _RUN_BASE = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def _words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each word's start and end and hash, and the first word of each text."""
    data, at = common.text_bytes(texts)
    start, end, bounds = common.find_words(data, at, common.SPACED_WORD)
    return data, start, end, common.word_hashes(data, start, end), bounds


def seeds(words: np.ndarray, length: int = LENGTH, k: int = SEED) -> tuple[np.ndarray, ...]:
    """(seed hash, region hash, first window, windows) of one text's words."""
    none = np.zeros(0, np.uint64)
    if len(words) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    i = np.arange(len(words) - k + 1)
    hashes = common.run_hashes(words, i, i + k, _SEED_BASE)
    least, where, width, want = hashes, i, 1, length - k + 1
    while width < want:  # the least of a window of `width` seeds, the rightmost of equal ones
        by = min(width, want - width)
        right = least[by:] <= least[:-by]
        least, where = np.where(right, least[by:], least[:-by]), np.where(right, where[by:], where[:-by])
        width += by
    first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
    n = np.diff(np.concatenate([first, [len(where)]]))
    return hashes[where[first]], common.run_hashes(words, first, first + n + length - 1, _RUN_BASE), first, n


def _chunks(words: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, first word, words) of stretches that hold every window once."""
    for d, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
        for s in range(0, max(0, b - a - length + 1), CHUNK):
            yield d, s, words[a + s : min(b, a + s + CHUNK + length - 1)]


def find_seeds(docs: DataFrame, doc_id: str, text: str, length: int, k: int) -> DataFrame:
    """(seed, region, doc, first, n): each seed of each document with the windows around it."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("seed", "region")] + [T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            *_, words, bounds = _words(batch[text])
            found = [(d, s, *seeds(part, length, k)) for d, s, part in _chunks(words, bounds, length)]
            if found:
                of = pa.array(np.repeat([x[0] for x in found], [len(x[2]) for x in found]))
                col = [np.concatenate(x) for x in ([x[2] for x in found], [x[3] for x in found], [x[4] + x[1] for x in found], [x[5] for x in found])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col[0].view(np.int64)), pa.array(col[1].view(np.int64)), batch[doc_id].take(of), pa.array(col[2].astype(np.int32)), pa.array(col[3].astype(np.int32))], names=schema.names
                )

    return common.map_texts(docs.select(doc_id, text).where(F.col(doc_id).isNotNull()), run, schema)


def _holds(words: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the words first:end have the hash, for each; false where the text is shorter."""
    found = np.zeros(len(first), bool)
    inside = end <= len(words)
    found[inside] = common.run_hashes(words, first[inside], end[inside], _RUN_BASE) == hashes[inside]
    return found


def _wide(lists: pa.ListArray, field: str) -> tuple[np.ndarray, np.ndarray]:
    """A field of all structs of a list column, and how many each row has."""
    counts = np.diff(lists.offsets.to_numpy())
    counts[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    return lists.flatten().field(field).to_numpy(zero_copy_only=False), counts


def extensions(docs: DataFrame, leaders: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(seed, window, doc, first): each window of the leaders' regions (doc, seed, region, first, n)."""
    wanted = leaders.groupBy("doc").agg(F.collect_set(F.struct("seed", "region", "first", "n")).alias("runs"))
    joined = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(wanted, "doc")
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("window", T.LongType()), joined.schema["doc"], T.StructField("first", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            *_, words, bounds = _words(batch["text"])
            seed, counts = _wide(batch["runs"], "seed")
            region, first, n = (_wide(batch["runs"], c)[0] for c in ("region", "first", "n"))
            at = np.concatenate([[0], np.cumsum(counts)])
            for d in range(batch.num_rows):
                own, rows = words[bounds[d] : bounds[d + 1]], slice(at[d], at[d + 1])
                f, m = first[rows].astype(np.int64), n[rows].astype(np.int64)
                ok = _holds(own, f, f + m + length - 1, region[rows].view(np.uint64))
                f, m, s = f[ok], m[ok], seed[rows][ok]
                start = np.repeat(f - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if len(m) else f
                if len(start):
                    window = common.run_hashes(own, start, start + length, _RUN_BASE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(s, m)), pa.array(window.view(np.int64)), batch["doc"].take(pa.array(np.full(len(start), d))), pa.array(start.astype(np.int32))], names=schema.names
                    )

    return common.map_texts(joined, run, schema)


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = SEED) -> DataFrame:
    """(doc, first, words, hash): the runs of words whose windows a smaller document has too."""
    found = common.materialise(find_seeds(docs, doc_id, text, length, k), "seeds")
    # what is joined back is written first: a join of two fresh shuffles can split a seed that very many documents have
    shared = common.materialise(found.groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("seed"), "shared")
    met = common.materialise(found.join(shared, "seed"), "shared-seeds")
    regions = common.materialise(met.groupBy("seed", "region").agg(F.min("doc").alias("leader")), "regions")
    many = common.materialise(regions.groupBy("seed").agg(F.count("*").alias("regions")).where("regions > 1").select("seed", F.lit(True).alias("differ")), "many")
    led = common.materialise(regions.join(many, "seed", "left"), "leaders")
    ranked = common.materialise(met.join(led, ["seed", "region"]), "ranked")
    span = lambda words, hashed: ("doc", "first", words.cast("int").alias("words"), F.col(hashed).alias("hash"))
    whole = ranked.where("doc > leader").select(*span(F.col("n") + length - 1, "region"))
    windows = common.materialise(extensions(docs, ranked.where("differ and doc = leader"), doc_id, text, length), "windows")
    least = common.materialise(windows.groupBy("seed", "window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("seed", "window", "low"), "least")
    part = windows.join(least, ["seed", "window"]).where("doc > low").select(*span(F.lit(length), "window"))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = SEED) -> DataFrame:
    """Remove the words that windows cover which a smaller document holds as well.

    Returns doc_id, n_words, removed (stretches of word numbers, end exclusive) and kept (the other words, joined by one
    space), a row for each row. Windows are judged on the input. Null, empty and short texts lose nothing; rows of one
    doc_id never remove each other's words; rows without a doc_id lose nothing and count for nobody; an empty table
    gives no rows; very long texts are read in stretches that hold every window; other columns are not read.
    length - k must not be negative.
    """
    spans = repeats(docs, doc_id=doc_id, text=text, length=length, k=k)
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("first", "words", "hash")).alias("spans"))
    joined = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(spans, "doc", "left")
    stretch = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(stretch)), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            data, start, end, words, bounds = _words(batch["text"])
            raw = data.tobytes()
            first, counts = _wide(batch["spans"], "first")
            size, hashed = (_wide(batch["spans"], c)[0] for c in ("words", "hash"))
            at = np.concatenate([[0], np.cumsum(counts)])
            removed, kept = [], []
            for d in range(batch.num_rows):
                a, b, rows = bounds[d], bounds[d + 1], slice(at[d], at[d + 1])
                f = first[rows].astype(np.int64)
                e = f + size[rows]
                ok = _holds(words[a:b], f, e, hashed[rows].view(np.uint64)) if len(f) else np.zeros(0, bool)
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, f[ok], 1)
                np.add.at(cover, e[ok], -1)
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2).tolist()
                removed.append([{"start": x, "end": y} for x, y in edges])
                left = np.flatnonzero(~gone) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip(start[left].tolist(), end[left].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(np.diff(bounds)), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names
            )

    return common.map_texts(joined, run, schema)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per row: counts of words and of removed words, and the hash of the kept text."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col(doc_id), "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
