"""SimHash near-duplicates whose links are those of an exact Jaccard similarity: simhash.near_duplicates with `similar`.

Texts link when the sets of their shingles have a Jaccard similarity of 0.8 at least. The vantage-point trees find the pairs whose
fingerprints lie within the radius. But at 0.8 fingerprints of 64 bits lie 10 bits apart on average and up to 18, where no
triangle bound prunes; so there are candidates by minimal hashes too: sets of a similarity of 0.8 have the least hash in common
with a chance of 0.8, four of them with 0.41, and of 24 bands of four they miss all with a chance of 3 in a million. Candidates, those of
the trees and those that share a band, are ids only, and connect texts into clusters. The sets of a cluster's texts go once to the
task that has the cluster, and there the exact links are found by prefixes: of two sets that link one of the rarest fifth of
their shingles is shared. A passage that very many texts have is never among a set's rarest shingles unless it makes up most of it, so
such texts don't meet. A cluster whose sets are larger than a task should hold goes another way, in rounds over its bands.
Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash
from .components import components

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bands of minimal hashes, and hashes of a band.
BANDS, WIDTH = 24, 4
#: Bytes of the sets of a cluster that one task takes.
CLUSTER_BYTES = 128 << 20
#: Of larger clusters: rounds that link to one member of a band while the pairs left are more than so many a posting.
STARS, PAIRS = 4, 4
#: Odd factors that give each minimal hash its order.
_FACTORS = common.mix(np.arange(1, 1 + BANDS * WIDTH, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; one of all words if they are fewer; none without words."""
    data, at = common.text_bytes(texts)
    data = common.LOWER[data]
    start, end, first = common.find_words(data, at, common.SPACED_WORD)
    words = common.word_hashes(data, start, end)
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    cuts = np.concatenate([[0], np.cumsum(shingles)])
    of = np.repeat(np.arange(len(n)), shingles)
    a = np.arange(len(of)) - cuts[of] + first[of]
    hashed = common.run_hashes(words, a, np.minimum(a + shingle, first[of + 1]), 0xD1B54A32D192ED03) if len(of) else np.zeros(0, np.uint64)
    return [np.unique(hashed[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set that is not empty: hashes of its minimal hashes, WIDTH a band."""
    data, starts = np.concatenate(sets), np.cumsum([0, *[len(x) for x in sets[:-1]]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for i in range(WIDTH):
            key = common.mix(key ^ np.minimum.reduceat(data * _FACTORS[band * WIDTH + i], starts))
        keys[:, band] = key
    return keys


def nodes(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, fp, node, n, bands) of every row: its fingerprint, the hash of its set (0 without words), the set's size, its band keys."""
    longs = [T.StructField(c, T.LongType()) for c in ("fp", "node", "n")]
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *longs, T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            sets = shingle_sets(batch[text], shingle)
            fp = np.array([simhash.fingerprint(t, shingle) for t in batch[text].to_pylist()], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            some = [x for x in sets if len(x)]
            keys = band_keys(some).ravel() if some else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([BANDS * (len(x) > 0) for x in sets])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch[doc_id], pa.array(fp), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), bands], names=schema.names)

    return common.map_texts(docs.select(doc_id, text), run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have a Jaccard similarity of 0.8 at least; texts: (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.steps(iter([batch]), "x"):
                good = []
                for x, y in zip(shingle_sets(part["x"], shingle), shingle_sets(part["y"], shingle), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(LEAST[1] * shared >= LEAST[0] * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(good)), part["b"].filter(pa.array(good))], names=["a", "b"])

    return common.map_texts(both, run, "a long, b long")


def by_fingerprints(found: DataFrame, radius: int, tree: dict) -> DataFrame:
    """Pairs (a, b) of nodes that link by fingerprints: of equal ones with the smallest node of them, of near ones those."""
    own = found.select("node", "fp").distinct()
    heads = common.materialise(own.groupBy("fp").agg(F.min("node").alias("head")), "near-heads")
    edges = simhash.links(heads.select("fp"), radius=radius, **tree)
    for c in ("a", "b"):
        edges = edges.join(heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_")), c)
    pairs = own.join(heads, "fp").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(edges.select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest, as pairs of places, of the links between sets: of all pairs with a Jaccard similarity of 0.8 at least.

    A set is compared with earlier ones that share a shingle of its prefix, with one component after the other, and with a component only
    until they link: so a large group of near copies costs a few comparisons each.
    """
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.lexsort((token, count[token], of))
    prefix = size + LEAST[0] * size // -LEAST[1] + 1  # size - ceil(0.8 size) + 1
    keep = (np.arange(len(of)) - first[of] < prefix[of]) & (count[token[order]] > 1)
    asks = np.split(token[order][keep], np.searchsorted(of[keep], np.arange(1, len(sets))))
    own = np.split(token, first[1:])
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    mine, seen, a, b = np.zeros(len(count), bool), {}, [], []
    for i, asked in enumerate(asks):
        mine[own[i]] = True
        tried: set[int] = set()
        for t in asked.tolist():
            groups = seen.setdefault(t, {})  # the sets before that have t in their prefix, by component
            for r in [r for r in groups if find(r) != r]:
                groups.setdefault(find(r), []).extend(groups.pop(r))
            for r, members in list(groups.items()):
                if find(r) == find(i):
                    continue
                fresh = (j for j in members if j not in tried and LEAST[1] * min(size[i], size[j]) >= LEAST[0] * max(size[i], size[j]))
                step = 1
                while some := list(islice(fresh, step)):
                    tried.update(some)
                    step = min(4 * step, 1024)
                    shared = np.add.reduceat(mine[np.concatenate([own[j] for j in some])], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                    good = np.flatnonzero(LEAST[1] * shared >= LEAST[0] * (size[i] + size[some] - shared))
                    if len(good):
                        a.append(i)
                        b.append(some[good[0]])
                        parent[find(r)] = find(i)
                        break
            groups.setdefault(find(i), []).append(i)
        mine[own[i]] = False
    return a, b


def within_clusters(clusters: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of the clusters' nodes (node, root), each cluster in one task; texts: (node, text), one for each node."""
    rows = clusters.join(texts, "node").select("root", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            found = shingle_sets(batch["text"], shingle)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["root"], batch["node"], lists], names=["root", "node", "shingles"])

    def join(rows: pa.Table) -> pa.Table:
        node, column = rows["node"].to_numpy(), rows["shingles"].combine_chunks()
        flat, cuts = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())[:-1]
        a, b = linked(np.split(flat, cuts))
        return pa.table({"a": node[np.array(a, np.int64)], "b": node[np.array(b, np.int64)]})

    return common.map_texts(rows, sets, "root long, node long, shingles array<long>").groupBy("root").applyInArrow(join, "a long, b long")


def band_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the nodes of each band: all with the smallest."""
    posts = found.select("node", F.explode("bands").alias("h")).distinct()
    heads = posts.groupBy("h").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b <> _last").select("h", "b")
    return posts.join(heads, "h").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = simhash.RADIUS, **tree) -> DataFrame:
    """What simhash.near_duplicates gives with `similar`; ids are not null."""
    found = common.materialise(nodes(docs, doc_id, text, shingle), "near-nodes")
    least = common.materialise(found.groupBy("node").agg(F.min(doc_id).alias("first"), F.first("n").alias("n")), "near-first")
    pairs = common.materialise(by_fingerprints(found, radius, tree).unionByName(band_pairs(found)), "near-pairs")
    clusters = components(pairs).join(least.where("n > 0"), "node")
    sized = clusters.groupBy("root").agg((F.sum("n") * 8 > CLUSTER_BYTES).alias("large"))
    clusters = common.materialise(clusters.join(sized, "root").select("node", "root", "first", "large"), "near-clusters")
    source = docs.select(F.col(doc_id).alias("first"), F.col(text).alias("text"))
    asked = clusters.where("not large").select("node", "first").hint("merge")  # the same plan at every size
    texts = source.join(asked, "first").groupBy("node").agg(F.min("text").alias("text"))
    links = common.materialise(within_clusters(clusters.where("not large").select("node", "root"), texts, shingle), "near-links")
    large = clusters.where("large")
    if not large.isEmpty():
        links = links.unionByName(in_rounds(found.join(large.select("node"), "node", "left_semi"), pairs.join(large.select(F.col("node").alias("a")), "a", "left_semi"), least, source, shingle))
    label = simhash.smallest(least.select("node", "first"), "node", components(links))
    return found.select(doc_id, "fp", "node").join(label, "node").select(doc_id, simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def in_rounds(found: DataFrame, pairs: DataFrame, least: DataFrame, source: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between nodes by their bands: each round links what is apart to one member of each band, the last compares what then
    still is. pairs: candidates besides the bands; every pair's texts are joined to it to be compared."""

    def good(pair: DataFrame) -> DataFrame:
        asked = pair.select(F.col("a").alias("node")).unionByName(pair.select(F.col("b").alias("node"))).distinct()
        texts = source.join(asked.join(least.select("node", "first"), "node"), "first").groupBy("node").agg(F.min("text").alias("text"))
        return common.materialise(confirmed(pair, texts, shingle), "near-links")

    links = good(pairs)
    roots = components(links)
    one = found.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).select("node", "n", F.explode("bands").alias("h"))
    met = one.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    posts = common.materialise(one.join(met, "h"), "near-posts")
    total, before = posts.count(), 0
    for step in range(STARS + 1):
        label = posts.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("c"))
        rows = posts.join(label, "node")
        heads = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("c", F.lit(step)).alias("_"), "node", "n", "c")).alias("head"), F.min("c").alias("_a"), F.max("c").alias("_b"), F.count("*").alias("m")).where("_a <> _b")
        heads = common.materialise(heads.select("h", "m", "head.node", "head.n", "head.c"), "near-heads")
        todo = heads.agg(F.sum(F.col("m").cast("double") * F.col("m") / 2)).first()[0] or 0
        if not todo:
            break
        last = step == STARS or todo <= PAIRS * total or (step > 1 and links.count() == before)
        before = links.count()
        rows = common.materialise(rows.join(heads.select("h"), "h"), "near-apart")  # bands with texts that are still apart
        other = rows if last else heads
        near = f"r.c <> o.c and {LEAST[1]} * least(r.n, o.n) >= {LEAST[0]} * greatest(r.n, o.n)"
        both = rows.alias("r").join(other.alias("o"), "h").where(near + (" and r.node < o.node" if last else ""))
        pair = both.select(F.least("r.node", "o.node").alias("a"), F.greatest("r.node", "o.node").alias("b")).distinct()
        links = links.unionByName(good(common.materialise(pair, "near-pairs")))
        roots = components(links)
        if last:
            break
        posts = rows.select("h", "node", "n")
    return links
