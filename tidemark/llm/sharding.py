"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, with u a hash of the key and the
child's name in (0, 1), and the smallest draw wins: children win in proportion to their weights, and a key changes
child only when the changed child is the one it leaves or enters. So a change of weights moves keys only between the
subtrees whose weights changed and the rest. A shard that is added by `grow` opens a region of its own: whatever moves
then moves into that one shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Shards of a rack and racks of a region in `default_tree`.
RACK, REGION = 4, 2
#: Rows that one numbering task takes, about; equal rows that one task writes at most.
BUCKET_ROWS, RUN_ROWS = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Node:
    """A region, a rack, or (without children) a shard. Its weight is its own or the sum of its children's."""

    name: str
    own: float = 0.0
    children: tuple[Node, ...] = ()
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.children) if self.children else self.own


def default_tree(shards: int, weights: list[float] | None = None) -> Node:
    """Shards 0.. in racks of RACK and regions of REGION racks; every weight 1 unless given."""
    leaf = [Node(f"shard{i}", (weights or [1.0] * shards)[i], shard=i) for i in range(shards)]
    racks = [Node(f"rack{i}", children=tuple(leaf[i * RACK : (i + 1) * RACK])) for i in range(-(-shards // RACK))]
    return Node("root", children=tuple(Node(f"region{i}", children=tuple(racks[i * REGION : (i + 1) * REGION])) for i in range(-(-len(racks) // REGION))))


def leaves(tree: Node) -> list[Node]:
    return [y for x in tree.children for y in leaves(x)] if tree.children else [tree]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One shard more, in a region of its own, so that no other subtree's weight changes."""
    n = max(x.shard for x in leaves(tree)) + 1
    new = Node(f"shard{n}", weight, shard=n)
    return Node(tree.name, children=(*tree.children, Node(f"region+{n}", children=(Node(f"rack+{n}", children=(new,)),))))


def _levels(tree: Node) -> list[list[Node]]:
    """The nodes of each level, the root's first. All shards must lie equally deep."""
    found = [[tree]]
    while any(x.children for x in found[-1]):
        found.append([y for x in found[-1] for y in x.children])
    return found


def with_shard(rows: DataFrame, key: Column, tree: Node, name: str) -> DataFrame:
    """Add the shard of a key: at each level the child with the smallest draw. A null key is a key like another."""
    at = F.lit(1)
    levels = _levels(tree)
    for depth, (nodes, below) in enumerate(zip(levels, levels[1:], strict=False)):
        place = {id(x): i + 1 for i, x in enumerate(below)}
        width = max(len(x.children) for x in nodes)
        pad = lambda x, none: [*x, *[none] * (width - len(x))]
        names = F.array(*[F.array(*[F.lit(v) for v in pad([y.name for y in x.children], "")]) for x in nodes])
        weights = F.array(*[F.array(*[F.lit(float(v)) for v in pad([y.weight for y in x.children], 0.0)]) for x in nodes])
        children = F.array(*[F.array(*[F.lit(v) for v in pad([place[id(y)] for y in x.children], 0)]) for x in nodes])
        u = lambda j: (F.shiftrightunsigned(F.xxhash64(key, names[at - 1][j]), 11).cast("double") + 0.5) / float(1 << 53)
        draws = [F.when(weights[at - 1][j] > 0, -F.log(u(j)) / weights[at - 1][j]) for j in range(width)]
        step = f"_{name}_{depth}"
        win = F.array_position(F.array(*draws), F.least(*draws) if width > 1 else draws[0]).cast("int")
        rows = rows.withColumn(step, children[at - 1][win - 1])
        at = F.col(step)
    shards = F.array(*[F.lit(x.shard) for x in levels[-1]])
    return rows.withColumn(name, shards[at - 1].cast("int")).drop(*[f"_{name}_{i}" for i in range(len(levels) - 1)])


def place(docs: DataFrame, tree: Node, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's size (UTF-8 bytes plus 16; null text: 16), text_crc32 (null: as the empty text), shard and grown_shard."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"))
    return with_shard(with_shard(rows, F.col(key), tree, "shard"), F.col(key), grow(tree), "grown_shard")


def number(placed: DataFrame, *, key: str = "doc_id", shard: str = "shard", bucket_rows: int = BUCKET_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add slot: 0, 1, 2 ... within each shard without a gap; which row has which depends on the rows alone, not on how they are split.

    Equal rows are counted first, so that a row repeated without end is one. A shard's rows are dealt into hash buckets, the
    counts of each bucket are summed up by themselves, and those of the buckets before it are added, so that no task holds a
    whole shard. Then each count becomes its rows again; counts above run_rows are spread in runs over the tasks.
    """
    rows = placed.groupBy(*placed.columns).agg(F.count("*").alias("_n"))
    buckets = max(1, -(-placed.count() // bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    order = [key, "text_crc32", *[c for c in placed.columns if c not in (key, shard, "text_crc32")]]
    within = F.sum("_n").over(W.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    firsts = rows.withColumn("_first", within).join(offsets, [shard, "_bucket"]).withColumn("_first", F.col("_before") + F.col("_first"))
    spread = lambda x, n: x.withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + n - 1)))
    few = spread(firsts.where(F.col("_n") <= run_rows), F.col("_n"))
    runs = firsts.where(F.col("_n") > run_rows).withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {run_rows}"))))
    runs = runs.repartition(key, "_run").withColumn("_first", F.col("_first") + F.col("_run") * run_rows)
    many = spread(runs, F.least(F.lit(run_rows), F.col("_n") - F.col("_run") * run_rows))
    return few.select(*placed.columns, "slot").unionByName(many.select(*placed.columns, "slot"))


def assign(docs: DataFrame, shards: int = 40, *, tree: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard and a slot.

    Returns key, size, text_crc32, shard, grown_shard (with one shard more) and slot. Repeated rows and rows without a
    key share a shard and take slots of their own; of a very long text only its length and checksum are carried; an empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    placed = common.materialise(place(docs, tree or default_tree(shards), key=key, text=text), "sharding")
    return number(placed, key=key)
