"""Ranked lexical search by WAND over shards of documents.

A document is its terms with their counts. For each shard, a part of the rows that one task holds, the postings of the terms
asked for are laid out by term and document, with the impact that each adds to a score and each term's largest impact in the
shard. A query walks its terms' postings together: cursors stand at each term's next document, in the order of these
documents; the pivot is the first cursor at which the largest impacts so far add up to more than the threshold, the score of
the k-th best so far, and no document before the pivot's can beat it: the walk leaps there. From the pivot a stretch of documents
is taken at once; of these only documents whose own terms' largest impacts beat the threshold are scored, and
those that enter raise it. Each shard gives its k best, and the shards' lists are merged.

Queries come in blocks of so many bytes of text; a block's vocabulary, which its bytes bound, goes to all tasks, and documents are
passed over once a block to count its terms and once, as counts, to score. Scores are 64-bit integers throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Best documents of a query.
TOP = 10
#: Bytes of query text of a block, and documents of a shard at most.
BLOCK_BYTES, SHARD_DOCS = 4 << 20, 1 << 15
#: Documents of a stretch: short at first, until there is a threshold, then longer.
FIRST, STRETCH = 256, 8192
#: Bytes of a term: all but the ASCII characters that are neither digits nor letters.
TERM = common.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts in lower case (ASCII), each term's start, end and hash, and the first term of each text."""
    data, at = common.text_bytes(texts)
    data = common.LOWER[data]
    start, end, first = common.find_words(data, at, TERM)
    return data, start, end, common.word_hashes(data, start, end), first


@dataclass(frozen=True)
class Vocabulary:
    """The terms of a block's queries by hash, sorted, and the spelling of each."""

    hashes: np.ndarray
    words: list[bytes]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text how many terms it has, which of the vocabulary's and how often. Spellings are compared, not only hashes."""
        data, start, end, hashes, first = terms_of(texts)
        n = np.diff(first)
        if not len(self.hashes):
            none = [np.zeros(0, np.int32)] * len(n)
            return n, none, none
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = at[hit]
        size = np.array([len(w) for w in self.words])
        spelled, offset = np.frombuffer(b"".join(self.words), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]])
        same = end[hit] - start[hit] == size[term]
        for j in range(int(size[term[same]].max(initial=0))):
            more = np.flatnonzero(same & (size[term] > j))
            same[more] = data[start[hit[more]] + j] == spelled[offset[term[more]] + j]
        hit, term = hit[same], term[same]
        of = np.searchsorted(first, hit, "right") - 1
        pair, count = np.unique(of * len(self.hashes) + term, return_counts=True)
        cuts = np.searchsorted(pair, np.arange(1, len(n)) * len(self.hashes))
        return n, np.split((pair % len(self.hashes)).astype(np.int32), cuts), np.split(count.astype(np.int32), cuts)


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many have terms, their terms together, and the weight of each vocabulary term."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, terms: int, holding: np.ndarray) -> Statistics:
        return cls(documents, terms, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64))

    def impacts(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document of so many terms that has it so many times."""
        # 90 n N may pass 64 bits where N alone has 40 of them: then it is worked out in Python's integers
        most = 90 * int(length.max(initial=0)) * self.documents
        m = 10 + (90 * length * self.documents // self.terms if most < 1 << 63 else np.array([90 * n * self.documents // self.terms for n in length.tolist()], np.int64))
        return self.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m))


class Shard:
    """Postings of one shard: documents in the order of their ids, by term."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], stats: Statistics):
        order = np.argsort(ids, kind="stable")
        self.ids, self.stats = ids[order], stats
        sizes = np.array([len(terms[i]) for i in order.tolist()], np.int64)
        term = np.concatenate([terms[i] for i in order.tolist()]).astype(np.int64)
        tf = np.concatenate([times[i] for i in order.tolist()]).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        impact = stats.impacts(term, tf, np.repeat(length[order], sizes))
        by = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[by], impact[by]
        self.start = np.searchsorted(term[by], np.arange(len(stats.weights) + 1))
        self.most = np.zeros(len(stats.weights), np.int64)
        some = np.flatnonzero(self.start[1:] > self.start[:-1])
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.start[some])
        self.scored = 0

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents' places and scores, best first, equal scores by place. Only scores above 0."""
        terms = terms[self.most[terms] > 0]
        cursor, end, most = self.start[terms].copy(), self.start[terms + 1], self.most[terms]
        docs, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        width = FIRST
        while True:
            live = cursor < end
            if not live.all():
                cursor, end, most, terms = cursor[live], end[live], most[live], terms[live]
            if not len(terms):
                return docs, scores
            heads = self.doc[cursor]
            order = np.argsort(heads, kind="stable")
            beats = np.flatnonzero(np.cumsum(most[order]) > threshold)
            if not len(beats):
                return docs, scores
            pivot = int(heads[order[beats[0]]])
            # every term's cursor leaps to the pivot, and its postings of the stretch that begins there are taken
            a = np.array([c + np.searchsorted(self.doc[c:e], pivot) for c, e in zip(cursor.tolist(), end.tolist(), strict=True)], np.int64)
            b = np.array([c + np.searchsorted(self.doc[c:e], pivot + width) for c, e in zip(a.tolist(), end.tolist(), strict=True)], np.int64)
            many = b - a
            at = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            here = self.doc[at] - pivot
            bound = np.bincount(here, np.repeat(most, many).astype(np.float64), width)  # whole numbers below 2^53 for queries of up to 300 000 terms
            hopeful = bound > threshold
            if hopeful.any():
                keep = hopeful[here]
                self.scored += int(hopeful.sum())
                score = np.bincount(here[keep], self.impact[at[keep]].astype(np.float64), width).astype(np.int64)
                enter = np.flatnonzero(score > threshold)
                docs, scores = np.concatenate([docs, pivot + enter]), np.concatenate([scores, score[enter]])
                first = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[first], scores[first]
                if len(scores) == k:
                    threshold = int(scores[-1])
            cursor = b
            width = min(STRETCH, 2 * width)


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """Queries (item, text) in blocks by a hash of the item, about block_bytes each."""
    total = queries.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for i in range(blocks):
        yield dealt.where(F.col("_block") == i).select("item", "text").orderBy("item").toArrow()


def counted(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, text: str) -> DataFrame:
    """(id, n, terms, times) of each document that has a term: its id, how many terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("times", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            n, terms, times = shared.value.find(batch[text])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch[doc_id], pa.array(n, pa.int64()), *lists], names=schema.names).filter(pa.array(n > 0))

    return common.map_texts(docs.select(doc_id, text), run, schema)


def _searched(index: DataFrame, stats: Statistics, asked: list[np.ndarray], k: int, shard_docs: int) -> DataFrame:
    """(query, id, score): each shard's k best of each query, by the query's place."""
    shared = index.sparkSession.sparkContext.broadcast((stats, asked))
    schema = T.StructType([T.StructField("query", T.IntegerType()), index.schema["id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, asked = shared.value
        for batch in common.gathered(batches, shard_docs):
            ids = batch["id"].to_numpy(zero_copy_only=False)
            flat = [np.split(batch[c].flatten().to_numpy(), np.cumsum(batch[c].value_lengths().to_numpy())[:-1]) for c in ("terms", "times")]
            shard = Shard(ids, batch["n"].to_numpy(), *flat, stats)
            for i, terms in enumerate(asked):
                docs, scores = shard.best(terms, k)
                if len(docs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)), pa.array(shard.ids[docs], batch.schema.field("id").type), pa.array(scores)], names=schema.names)

    return index.where("id is not null and size(terms) > 0").mapInArrow(run, schema)


def search(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents, rank from 1, equal scores by ascending doc_id.

    Documents that are null, empty or without terms are none; very long ones are read whole, a step of their own. Rows of one
    doc_id are documents of their own; rows without one count in the statistics and are not ranked. An item's terms are those of
    all its rows; items that are null or have no terms are not answered. Without documents or items there are no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    items = queries.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    named = T.StructType([T.StructField("query", T.IntegerType()), T.StructField(item_id, queries.schema[item_id].dataType)])
    found = None
    for block in _blocks(items, block_bytes):
        data, start, end, hashes, first = terms_of(block["text"])
        known, one = np.unique(hashes, return_index=True)
        vocabulary = Vocabulary(known, [data[start[i] : end[i]].tobytes() for i in one.tolist()])
        names: list = []
        asked: list[np.ndarray] = []
        for i, item in enumerate(block["item"].to_pylist()):
            mine = np.searchsorted(known, hashes[first[i] : first[i + 1]])
            if names and names[-1] == item:
                asked[-1] = np.unique(np.concatenate([asked[-1], mine]))
            else:
                names.append(item)
                asked.append(np.unique(mine))
        index = common.materialise(counted(docs, vocabulary, doc_id, text), "terms")
        total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(known), np.int64)
        df = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the block at most
        holding[df["term"].to_numpy()] = df["count"].to_numpy()
        stats = Statistics.of(total[0], total[1], holding)
        best = _searched(index, stats, asked, k, shard_docs)
        best = best.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), named)), "query")  # the block's items
        found = best if found is None else found.unionByName(best)
    rank = F.row_number().over(W.partitionBy(item_id).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(item_id, F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")
