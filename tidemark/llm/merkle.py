"""A Merkle manifest of a dataset, with DataFrame functions only: a tree for each group of rows and one over the groups.

A row's leaf is a hash of its fields. Rows are numbered within their group, and level by level the numbers are divided by the
fanout: the children of one quotient, sorted, are hashed into their parent, until a group has one node, its subroot; subroots
go through the same levels to the root. Proofs come from the same tables the other way: from the root down each level's runs
are joined with their parents' proofs, and put the siblings of each child before them. So a join key has `fanout` rows
whatever the sizes of groups are, and a proof is written once for each run of leaves, not once for each leaf.

Numbers come from row_number within ranges: rows are dealt into ranges of (group, key), numbered there, and the counts of
the group's ranges before are added, so that no task holds a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Children of a node.
FANOUT = 16
#: Fields of a leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: `-` for null, else its length in UTF-8 bytes, a colon and itself; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z to a-z, the rest unchanged."""
    return F.translate(text, _UPPER, _LOWER)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add i, the row's number from 0 within its group g in the order given (nulls first), and n, the group's rows.

    rows come from Parquet. Where rows tie they stand as in their files, so a row repeated without end is dealt over ranges too.
    """
    placed = rows.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    by = [F.col(c).asc_nulls_first() for c in (*order, "_file", "_at")]
    dealt = common.materialise(placed.repartitionByRange(F.col("g"), *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("g", "_range").agg(F.count("*").alias("_m"))
    group = W.partitionBy("g")
    earlier = F.sum("_m").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("g", "_range", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("n"))
    within = F.row_number().over(W.partitionBy("g", "_range").orderBy(*by)) - 1
    return dealt.withColumn("_i", within).join(counts, ["g", "_range"]).withColumn("i", F.col("_before") + F.col("_i")).drop("_range", "_file", "_at", "_before", "_i")


def runs(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """The runs (g, run, kids, n, h) of a level's nodes (g, i, h, n): sorted children, and their hash; a group's only node is its own."""
    kids = F.sort_array(F.collect_list(F.struct("i", "h", *carried)))  # `fanout` nodes at most
    made = nodes.groupBy("g", F.expr(f"i div {fanout}").alias("run")).agg(kids.alias("kids"), F.max("n").alias("n"))
    return made.withColumn("h", F.when(F.col("n") > 1, hashed(F.array_join("kids.h", ""))).otherwise(F.col("kids")[0]["h"]))


@dataclass(frozen=True)
class Tree:
    """All runs by level, and the tops (g, level, h): each group's last node and the level where it stands alone."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int

    def paths(self, above: DataFrame, level: int) -> DataFrame:
        """(g, i, path, ...) for the nodes of a level. above: (g, level, path, ...) of the tops; a path's steps are (before, after)."""
        carried = [c for c in above.columns if c not in ("g", "level", "path")]
        found = None
        for k in range(len(self.levels) - 1, level - 1, -1):
            tops = above.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", *carried)
            if found is not None:
                kids = stepped(self.levels[k].where("n > 1").join(found.withColumnRenamed("i", "run"), ["g", "run"]))
                tops = tops.unionByName(kids.select("g", "kid.i", "path", *carried))
            found = common.materialise(tops, "paths") if k > level else tops
        return found


def stepped(runs: DataFrame) -> DataFrame:
    """A row for each kid of runs with their own path: its siblings before and after it go before that path."""
    side = lambda a, b: F.array_join(F.slice("kids.h", a, b), "")
    one = runs.select("*", F.posexplode("kids").alias("_k", "kid"))
    step = F.struct(side(F.lit(1), F.col("_k")).alias("before"), side(F.col("_k") + 2, F.greatest(F.size("kids") - F.col("_k") - 1, F.lit(0))).alias("after"))
    return one.withColumn("path", F.concat(F.array(step), "path")).drop("_k", "kids")


def tree(leaves: DataFrame, fanout: int, *carried: str) -> Tree:
    """The tree over numbered leaves (g, i, h, n); `carried` columns stay with the kids of the first level."""
    levels, tops, level, more = [], None, 0, carried
    nodes = leaves
    while True:
        made = common.materialise(runs(nodes, fanout, *more), "runs")
        levels.append(made)
        alone = made.where("n = 1").select("g", F.lit(level).alias("level"), "h")
        tops = alone if tops is None else tops.unionByName(alone)
        going = made.where("n > 1")
        if going.isEmpty():
            return Tree(levels, tops, fanout)
        nodes = going.select("g", F.col("run").alias("i"), "h", F.ceil(F.col("n") / fanout).cast("long").alias("n"))
        level, more = level + 1, ()


@dataclass(frozen=True)
class Manifest:
    """The tree of rows by group, the tree of groups, and the root (None of an empty table)."""

    rows: Tree
    groups: Tree
    root: str | None

    def subroots(self) -> DataFrame:
        """(g, h): a group's code ("0", or "1" and its text) and its subroot."""
        return self.rows.tops.select("g", "h")

    def proofs(self) -> DataFrame:
        """A row for each leaf: key, leaf, altered (null: as the leaf), subroot, root, and path, its (before, after) from leaf to root."""
        names = self.groups.levels[0].select("run", F.explode("kids").alias("x")).select(F.col("x.i").alias("i"), "x.code", "x.level", F.col("x.h").alias("subroot"))
        empty = F.array().cast("array<struct<before:string,after:string>>")
        tops = self.groups.tops.select("g", "level", empty.alias("path"))
        above = self.groups.paths(tops, 0).join(names, "i").select(F.col("code").alias("g"), "level", "path", "subroot")
        above = common.materialise(above, "paths")
        first = self.rows.levels[0]
        upper = self.rows.paths(above, 1).withColumnRenamed("i", "run") if len(self.rows.levels) > 1 else above.where("false").select("g", F.lit(0).cast("long").alias("run"), "path", "subroot")
        many = stepped(first.where("n > 1").join(upper, ["g", "run"]))
        one = first.where("n = 1").join(above.where("level = 0"), "g").withColumn("kid", F.col("kids")[0])
        found = many.select("kid", "path", "subroot").unionByName(one.select("kid", "path", "subroot"))
        return found.select("kid.key", F.col("kid.h").alias("leaf"), "kid.altered", "subroot", F.lit(self.root).alias("root"), "path")


def manifest(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT, altered: tuple[Column, dict[str, Column]] | None = None) -> Manifest:
    """Build the trees of `docs`. altered: for which rows, and of which fields what other values; their leaves come along.

    Any field may be null; rows without a group are a group, the first; rows without a key stand first in theirs. Rows of one
    key stand in the order of their leaves, and equal rows have places and proofs of their own. Empty texts are fields of
    length 0, very long ones are hashed whole. An empty table has no root. Other columns, whatever their names, are not read.
    """
    values = {c: F.col(c) for c in columns}
    other = F.lit(None).cast("string")
    if altered:
        other = F.when(altered[0], hashed(*[field((values | altered[1])[c]) for c in columns]))
    code = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(code.alias("g"), F.col(key).alias("key"), hashed(*[field(values[c]) for c in columns]).alias("h"), other.alias("altered"))
    rows = tree(numbered(common.materialise(leaves, "leaves"), "key", "h"), fanout, "key", "altered")
    tops = rows.tops.select(F.lit("").alias("g"), F.col("g").alias("code"), "h", "level")
    groups = tree(numbered(common.materialise(tops, "subroots"), "code"), fanout, "code", "level")
    root = groups.tops.select("h").first()
    return Manifest(rows, groups, root and root[0])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, x: hashed(x["before"], h, x["after"]))


def changed(old: Manifest, new: Manifest) -> DataFrame:
    """(group code, i) of the leaves that differ between two manifests of one fanout, by number within the group; of the longer group all leaves beyond.

    Goes down from the subroots: only runs under nodes that differ are joined, so equal groups cost one comparison.
    """
    differ = old.subroots().alias("a").join(new.subroots().alias("b"), "g", "full_outer").where(~F.col("a.h").eqNullSafe(F.col("b.h"))).select("g")
    nodes = lambda x, k: x.rows.levels[k].select("g", "run", F.explode("kids").alias("x")).select("g", "run", F.col("x.i").alias("i"), F.col("x.h").alias("h")) if k < len(x.rows.levels) else None
    alive = None
    for k in range(max(len(old.rows.levels), len(new.rows.levels)) - 1, -1, -1):
        sides = [nodes(x, k) for x in (old, new)]
        sides = [y if y is not None else next(z for z in sides if z is not None).where("false") for y in sides]
        if alive is None:
            sides = [y.join(differ, "g", "left_semi") for y in sides]
        else:
            known = alive.select("g", F.col("i").alias("run"))
            fresh = differ.join(alive.select("g").distinct(), "g", "left_anti")  # groups without nodes above
            sides = [y.join(known, ["g", "run"], "left_semi").unionByName(y.join(fresh, "g", "left_semi")) for y in sides]
        both = sides[0].alias("a").join(sides[1].alias("b"), ["g", "run", "i"], "full_outer")
        alive = common.materialise(both.where(~F.col("a.h").eqNullSafe(F.col("b.h"))).select("g", "i"), "changed")
    return alive


def digest(proofs: DataFrame, name: str = "doc_id") -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, the hash of its proof, the root that its altered (else own) leaf folds to, and whether that is the root."""
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    fold = folded(F.coalesce("altered", "leaf"), F.col("path"))
    found = proofs.select(F.col("key").alias(name), "leaf", "subroot", "root", hashed(siblings).alias("proof_sha256"), fold.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
