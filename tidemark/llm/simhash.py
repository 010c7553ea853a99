"""SimHash near-duplicates with vantage-point trees.

Fingerprints of 64 bits link when they differ in at most `radius` of them. Their bits are cut into blocks; a linked
pair differs in few bits of some choice of `together` blocks, at most as many as if its bits were dealt evenly (pigeonhole): its reach. The
Hamming distance on these bits is a distance too, never above that on all bits, so triangle bounds on it are safe, and at its
small radius they prune well. For each choice a vantage-point tree of a bounded sample deals fingerprints into shards by their
distance to vantage points. Every fingerprint lives in one shard and asks in each shard whose border its ball overlaps. In a
shard the same division goes on until few enough are left to compare, on all bits. Links come out as a spanning forest of
each shard, never as all pairs of a group, and equal fingerprints are one node throughout.

A ball of reach 1 crosses more borders the deeper the trees are: about 4 shards of 24, but hundreds of a million. So beyond
SPARSE fingerprints the choices are longer, two blocks of six, whose reach is 0: each fingerprint is in one shard of each of
15 trees however deep they are, and shards that the bounded trees leave too large are cut by a hash of the bits chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Words of a shingle, the hash's seed, and the bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: (blocks, together): few fingerprints have a tree for each third of the bits, more than SPARSE one for each pair of sixths.
FEW, MANY, SPARSE = (3, 1), (6, 2), 1 << 19
#: Fingerprints that a tree is fitted on, about: those with the smallest hashes.
SAMPLE = 50_000
#: Fingerprints that a shard is meant to hold; trees grow deeper with the input. A shard far above is dealt over several tasks.
SHARD_ROWS = 10_000
#: Comparisons made at once; fingerprints dealt at once.
BRUTE, DEALT_ROWS = 1 << 20, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats counted; without words 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    total = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        spans = zip(starts[i : min(n, i + (1 << 16))].tolist(), last[i : i + (1 << 16)].tolist(), strict=False)
        h = np.array([hashed(line[a:b], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * total > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's bits as a signed long."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            found = np.array([fingerprint(t, shingle) for t in batch[text].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch[doc_id], pa.array(found.view(np.int64))], names=[doc_id, "fp"])

    return common.map_texts(docs.select(doc_id, text), run, schema)


def block_masks(blocks: int, together: int = 1) -> list[int]:
    """Masks of each choice of `together` of the blocks of nearly equal size that the 64 bits are dealt into."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(x) for x in combinations([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)], together)]


def reach_of(radius: int, blocks: int, together: int) -> int:
    """Bits in which a pair within the radius differs at most on the best choice of `together` of the blocks: on those with the fewest, dealt evenly."""
    each, more = divmod(radius, blocks)
    return together * each + max(0, together - (blocks - more))


def distance(a: np.ndarray, b, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask))


class Tree:
    """A vantage-point tree over the masked distance: inner nodes have a vantage point and a median, leaves a number."""

    def __init__(self, sample: np.ndarray, mask: int, leaf: int):
        self.mask, self.nodes, self.leaves = mask, [], 0
        values = sample & np.uint64(mask)
        self._grow(values, leaf, np.random.default_rng(7))

    def _grow(self, values: np.ndarray, leaf: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(values) > leaf:
            for point in values[rng.integers(len(values), size=8)]:
                d = distance(values, point, self.mask)
                middle = int(np.median(d))
                if (d <= middle).all() and middle:
                    middle -= 1
                near = d <= middle
                if 0 < near.sum() < len(values):
                    left = self._grow(values[near], leaf, rng)
                    self.nodes[at] = (point, middle, left, self._grow(values[~near], leaf, rng))
                    return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def overlapping(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf): all leaves that may hold something within the radius of each value; radius 0 gives its home."""
        rows, found, todo = [], [], [(0, np.arange(len(values)))]
        while todo:
            at, of = todo.pop()
            node = self.nodes[at]
            if not len(of):
                continue
            if not isinstance(node, tuple):
                rows.append(of)
                found.append(np.full(len(of), node))
                continue
            point, middle, left, right = node
            d = distance(values[of], point, self.mask).astype(np.int64)
            todo.append((left, of[d - radius <= middle]))
            todo.append((right, of[d + radius > middle]))
        return np.concatenate(rows), np.concatenate(found)


class Forest:
    """Union and find over the rows of a shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: roots fall to the smallest root they are linked with until all pairs agree."""
        while len(a):
            p = self.roots()
            x, y = p[a], p[b]
            apart = x != y
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(self.parent, high, low)


def link_shard(homes: np.ndarray, guests: np.ndarray, mask: int, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a shard's fingerprints and those that ask in it, as pairs of fingerprints.

    Divides both by vantage points, on the mask's bits while that divides and on all bits after; an asker goes to each side
    its ball overlaps.
    """
    every = np.unique(np.concatenate([homes, guests]))
    forest = Forest(len(every))
    rng = np.random.default_rng(11)
    todo = [(np.searchsorted(every, np.unique(homes)), np.searchsorted(every, np.unique(guests)), False)]
    full = (1 << 64) - 1
    while todo:
        home, guest, whole = todo.pop()
        if not len(home) or not len(guest):
            continue
        if len(home) * len(guest) <= BRUTE:
            for i in range(0, len(guest), max(1, BRUTE // max(1, len(home)))):
                part = guest[i : i + max(1, BRUTE // max(1, len(home)))]
                x, y = np.nonzero(np.bitwise_count(every[home][:, None] ^ every[part][None, :]) <= radius)
                forest.link(home[x], part[y])
            continue
        use, r = (full, radius) if whole else (mask, reach)
        for point in every[home][rng.integers(len(home), size=8)]:
            d = distance(every[home], point, use).astype(np.int64)
            middle = int(np.median(d))
            if (d <= middle).all() and middle:
                middle = int(d[d < d.max()].max())
            near = d <= middle
            if near.any() and not near.all():
                g = distance(every[guest], point, use).astype(np.int64)
                todo.append((home[near], guest[g - r <= middle], whole))
                todo.append((home[~near], guest[g + r > middle], whole))
                break
        else:
            if not whole:
                todo.append((home, guest, True))
            else:  # one fingerprint
                for i in range(0, len(guest), BRUTE):
                    part = guest[i : i + BRUTE]
                    close = part[np.bitwise_count(every[part] ^ every[home[0]]) <= radius]
                    forest.link(np.full(len(close), home[0]), close)
    root = forest.roots()
    child = np.flatnonzero(root != np.arange(len(root)))
    return every[child], every[root[child]]


@dataclass(frozen=True)
class Dealt:
    """Fingerprints (shard, fp) as they live in shards and as they ask in them, and how shards are numbered."""

    homes: DataFrame
    guests: DataFrame
    masks: list[int]
    reach: int
    cells: int
    shards: int


def dealt(nodes: DataFrame, *, radius: int = RADIUS, blocks: tuple[int, int] | None = None, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> Dealt:
    """Deal distinct fingerprints `fp` into the shards of the trees."""
    n = nodes.count()
    of, together = blocks or (FEW if n <= SPARSE else MANY)
    masks, reach = block_masks(of, together), reach_of(radius, of, together)
    picked = nodes.where(common.hash_share(F.xxhash64("fp"), n, sample)).select("fp").toArrow()["fp"].to_numpy()
    leaf = max(4, len(picked) * shard_rows // max(1, n))
    trees = [Tree(np.sort(picked).view(np.uint64), m, leaf) for m in masks]
    least = min(t.leaves for t in trees)
    cells = 1 if reach else max(1, n // (least * shard_rows))  # without reach, what links has one hash of the mask's bits
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch], ball: int) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, DEALT_ROWS):  # a tree is walked once for a batch
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for b, tree in enumerate(shared.value):
                rows, leaves = tree.overlapping(fp, ball)
                cell = common.mix(fp[rows] & np.uint64(tree.mask)) % np.uint64(cells)
                shard = (leaves * len(masks) + b) * cells + cell.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[rows].view(np.int64))], names=["shard", "fp"])

    homes, guests = (nodes.select("fp").mapInArrow(lambda x, ball=ball: deal(x, ball), "shard long, fp long") for ball in (0, reach))
    return Dealt(homes, guests, masks, reach, cells, least * cells)


def links(nodes: DataFrame, *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, **more) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect whatever links within the radius connect; `more` as for `dealt`."""
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    made = dealt(nodes, radius=radius, shard_rows=shard_rows, **more)
    homes, guests, masks, reach, cells = made.homes, made.guests, made.masks, made.reach, made.cells
    bound = 4 * max(shard_rows, nodes.count() // made.shards)  # four times what a shard holds on average: few are above
    counts = homes.groupBy("shard").count().where(F.col("count") > bound)
    large = common.materialise(counts.select("shard", F.ceil(F.col("count") / bound).cast("int").alias("parts")), "large-shards")
    # the rows of a shard above the bound are dealt over parts, and its askers ask in each
    homes = homes.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "fp", F.lit(True).alias("home"))
    asked = guests.join(large, "shard", "left" if reach else "inner")  # without reach a whole shard's askers are its own rows
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "fp", F.lit(False).alias("home"))

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        home = rows["home"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = link_shard(fp[home], fp[home] if home.all() else fp[~home], masks[key[0].as_py() // cells % len(masks)], reach, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return homes.unionByName(asked).groupBy("shard", "part").applyInArrow(join, edge)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similar: bool = False, **tree) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    With `similar` texts link when their sets of shingles have a Jaccard similarity of near_copies.LEAST at least: links of
    fingerprints are confirmed by it, and similar pairs whose fingerprints lie further apart are found by near_copies.

    Null, empty and blank texts have fingerprint zero and link like others; very long ones are read whole; repeated rows are
    repeated; rows without a doc_id join a component but never name it; an empty table gives no rows; other columns are not read.
    """
    if similar:
        from .near_copies import near_copies

        return near_copies(docs, doc_id=doc_id, text=text, shingle=shingle, radius=radius, **tree)
    found = common.materialise(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    nodes = common.materialise(found.groupBy("fp").agg(F.min(doc_id).alias("first")), "nodes")
    label = smallest(nodes, "fp", components(links(nodes, radius=radius, **tree)))
    return found.join(label, "fp").select(doc_id, hex_digits("fp").alias("fingerprint"), "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def smallest(nodes: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest `first` of each node's component, from the nodes' (node, first) and components' roots.

    What is joined on the root, of which one may have a third of the nodes, is written before: then the join can be split.
    """
    named = common.materialise(nodes.join(roots.withColumnRenamed("node", node), node, "left").select(node, "first", F.coalesce("root", node).alias("root")), "named")
    least = common.materialise(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return named.join(least, "root").select(node, "component_id")
