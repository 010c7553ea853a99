"""Operators over any table: first-match decisions, keep-first, lookups in blocks, rankings, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

Rule = tuple[str, Column]


def first_reason(rules: list[Rule]) -> Column:
    """The name of the first rule that holds; null if none. A null condition does not hold."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def decide(df: DataFrame, stage: str, rules: list[Rule]) -> DataFrame:
    """Add stage and reason where a rule holds; rows that have a reason already keep it."""
    found = first_reason(rules)
    if "reason" not in df.columns:
        return df.withColumn("reason", found).withColumn("stage", F.when(F.col("reason").isNotNull(), stage))
    fresh = F.col("reason").isNull()
    return df.withColumns({"stage": F.when(fresh & found.isNotNull(), stage).otherwise(F.col("stage")), "reason": F.when(fresh, found).otherwise(F.col("reason"))})


def with_detail(df: DataFrame, details: dict[str, Column]) -> DataFrame:
    """Add detail: what a reason was about, where its name has one; a row keeps the detail that it has."""
    found = F.coalesce(*[F.when(F.col("reason") == name, c.cast("string")) for name, c in details.items()], F.lit(None).cast("string"))
    return df.withColumn("detail", F.coalesce("detail", found) if "detail" in df.columns else found)


def rejections(df: DataFrame, *columns: str) -> DataFrame:
    """The rejected rows with stage, reason and, where there is one, detail."""
    return df.where(F.col("reason").isNotNull()).select(*columns, "stage", "reason", *["detail"] * ("detail" in df.columns))


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("stage", "reason")


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; the order must tell all rows of a key apart."""
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key. Spark cuts each partition to k rows a key before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add how many rows share the keys, null being a key like another: summed up before the shuffle and joined, so that a large
    group is split."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias(name))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(counts, same, "left").drop(*[f"_{k}" for k in keys])


def best_match(candidates: DataFrame, key: str, score: str, *tie: Column | str, gap: int = 5, penalty: int = 15, exact: int = 98, least: int = 55) -> DataFrame:
    """The best candidate of each key, with its confidence.

    A best score under `exact` with the second one less than `gap` behind is ambiguous and loses `penalty`; what is
    then under `least` is no match.
    """
    order = W.partitionBy(key).orderBy(F.col(score).desc(), *tie)
    ranked = candidates.withColumns({"_rank": F.row_number().over(order), "runner_up": F.lead(score).over(order)}).where("_rank = 1").drop("_rank")
    near = F.col("runner_up").isNotNull() & (F.col(score) - F.col("runner_up") < gap) & (F.col(score) < exact)
    return ranked.withColumn("ambiguous", near).withColumn("confidence", F.col(score) - F.when(near, penalty).otherwise(0)).where(F.col("confidence") >= least)


def blocked_lookup(left: DataFrame, right: DataFrame, left_id: str, left_key: Column, right_key: Column, right_order: list[str], k: int = 25, prefix: int = 4) -> DataFrame:
    """Up to k rows of `right` for each row of `left`: the first of an equal key, or, for rows without any, the first by key of those
    whose key begins with the left key's first token (of `prefix` characters at least).

    The order is the right side's own, so that side is cut to k rows a key, and to k rows a wanted beginning, before either join:
    no group's pairs are made.
    """
    a, b = left.withColumn("_key", left_key), right.withColumn("_rkey", right_key).where("_rkey is not null")
    first = top_k(b, ["_rkey"], k, *right_order)
    exact = a.join(first, F.col("_key") == F.col("_rkey")).withColumn("method", F.lit("exact"))
    rest = a.join(b.select("_rkey").distinct(), F.col("_key") == F.col("_rkey"), "left_anti").withColumn("_token", F.split("_key", " ")[0]).where(F.length("_token") >= prefix)
    word = F.split("_rkey", " ")[0]
    begins = F.transform(F.sequence(F.lit(prefix), F.length(word)), lambda n: F.substring(word, F.lit(1), n))
    wanted = rest.select(F.col("_token").alias("_begin")).distinct()
    named = first.where(F.length(word) >= prefix).withColumn("_begin", F.explode(begins)).join(wanted, "_begin", "left_semi")
    found = rest.join(top_k(named, ["_begin"], k, "_rkey", *right_order), F.col("_token") == F.col("_begin")).withColumn("method", F.lit("prefix"))
    return exact.unionByName(found.drop("_token", "_begin")).drop("_key", "_rkey")


def sharing(left: DataFrame, right: DataFrame, keys: list[str], left_tokens: Column, right_tokens: Column) -> DataFrame:
    """Pairs of equal keys that share a token, each once: joined on the token, so that rows without a common one never meet. Both
    sides keep their columns; the keys are named alike."""
    a = left.withColumn("_x", left_tokens).withColumn("_t", F.explode("_x"))
    b = right.withColumn("_y", right_tokens).withColumn("_t", F.explode("_y"))
    return a.join(b, [*keys, "_t"]).where(F.col("_t") == F.get(F.array_intersect("_x", "_y"), F.lit(0))).drop("_t", "_x", "_y")


def contained(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Pairs whose right key holds the left key, each once. Empty and null keys hold nothing.

    Left keys meet right keys by equi-joins on whole keys: a right key is read at the places where a left key's beginning stands, which
    is of the largest power of two characters that the left key has, so half of it at least. What is cut out there at the left keys'
    lengths is joined on itself. A right key makes at most as many rows as it has characters, for each power of two and then for
    each length of a left key that begins so; a beginning that all keys share makes no pairs.
    """
    a = left.withColumn("_key", left_key).where("_key <> ''")
    size = F.expr("cast(shiftleft(1L, cast(floor(log2(length(_key))) as int)) as int)")
    keys = a.select("_key").distinct().withColumn("_size", size)
    begins = keys.groupBy("_size", F.substring("_key", F.lit(1), F.col("_size")).alias("_begin")).agg(F.collect_set(F.length("_key")).alias("_lengths"))  # as many as a key has characters
    sizes = keys.agg(F.collect_set("_size").alias("_sizes"))  # one row of a few powers of two
    b = right.withColumn("_rkey", right_key).where("_rkey <> ''")
    each = b.crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes")).drop("_sizes").where("length(_rkey) >= _size")
    each = each.withColumn("_at", F.explode(F.expr("sequence(1, length(_rkey) - _size + 1)"))).withColumn("_begin", F.expr("substring(_rkey, _at, _size)"))
    cuts = each.join(begins, ["_size", "_begin"]).withColumn("_length", F.explode("_lengths")).where("_at + _length - 1 <= length(_rkey)")
    cuts = cuts.withColumn("_key", F.expr("substring(_rkey, _at, _length)")).where("instr(_rkey, _key) = _at")  # the first place where it stands: a pair once
    return a.join(cuts.select(*right.columns, "_key"), "_key").drop("_key")


def first_seen(df: DataFrame, key: str, period: str) -> DataFrame:
    """Add whether a row lies in the first period of its key."""
    least = df.groupBy(key).agg(F.min(period).alias("_first"))
    return df.join(least, key, "left").withColumn("first_seen", F.coalesce(F.col(period) == F.col("_first"), F.lit(False))).drop("_first")


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def reason_counts(df: DataFrame, column: str = "reason", most: int | None = None) -> DataFrame:
    """Rows of each reason, the most frequent first, names breaking ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(most) if most else counts


def bucketed(df: DataFrame, score: Column, edges: list[tuple[str, float]]) -> DataFrame:
    """Rows of each bucket, empty ones too. edges: (name, least score) from the top."""
    bucket = F.coalesce(*[F.when(score >= low, F.lit(name)) for name, low in edges])
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(edges)], "bucket string, position int")
    return F.broadcast(names).join(counts, "bucket", "left").select("bucket", "position", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def thresholds(df: DataFrame, score: Column, levels: list[int], period: str | None = None) -> DataFrame:
    """How many rows reach each level, in one pass; with a period also how many a period, two places."""
    once = df.agg(*[F.count_if(score >= t).alias(str(t)) for t in levels], *([F.count_distinct(period).alias("_p")] if period else []))
    each = [[F.lit(t).alias("threshold"), F.col(str(t)).alias("n"), *([F.bround(F.col(str(t)) / F.greatest("_p", F.lit(1)), 2).alias("per_period")] if period else [])] for t in levels]
    return once.select(F.explode(F.array(*[F.struct(*x) for x in each])).alias("x")).select("x.*")


def band_of(value: Column, bands: list[tuple[str, float, float]]) -> Column:
    """The band whose inclusive span holds the value; in a gap, the last band."""
    return F.coalesce(*[F.when(value.between(low, high), F.lit(name)) for name, low, high in bands], F.lit(bands[-1][0]))


def budgeted(df: DataFrame, n: int, key: str, *order: Column | str) -> DataFrame:
    """Add whether a row is among the first n of all; the key tells rows apart. Only the n first keys are gathered, and joined back (by broadcast
    where Spark finds them small)."""
    first = df.orderBy(*order, key).limit(n).select(key).withColumn("in_budget", F.lit(True))
    return df.join(first, key, "left").withColumn("in_budget", F.coalesce("in_budget", F.lit(False)))


def duplicates(df: DataFrame, order: str, keys: dict[str, Column]) -> DataFrame:
    """Rows that share a key with an earlier row: (order, duplicate_of, why), the first key in order that does.

    Each row is linked to the first of its group, never to all others. Null and empty keys link nothing. The rows are read once: their
    keys are written, one row for each, and what follows is one grouped minimum and one join.
    """
    each = F.array(*[F.struct(F.lit(i).alias("_i"), key.cast("string").alias("_k")) for i, key in enumerate(keys.values())])
    keyed = cut(df.select(F.col(order), F.explode(each).alias("x")).select(order, "x.*").where("_k <> ''"), "keys")
    least = keyed.groupBy("_i", "_k").agg(F.min(order).alias("duplicate_of"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = keyed.join(least, ["_i", "_k"]).where(F.col(order) > F.col("duplicate_of")).groupBy(order).agg(F.min(F.struct("_i", "duplicate_of")).alias("x"))
    return found.select(order, "x.duplicate_of", F.get(F.array(*map(F.lit, keys)), F.col("x._i")).alias("why"))


def insert_missing(new: DataFrame, stored: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The new rows whose keys are not stored, each key once: what an idempotent append writes."""
    return not_in(keep_first(new, keys, *order), stored, keys)


def upserted(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the new ones in place of those with the same keys."""
    return not_in(stored, new, keys).unionByName(new, allowMissingColumns=True)


def blocked(df: DataFrame, rules: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Add `blocked_by`: the first rule whose list has the row's key. rules: (name, list with the column, column)."""
    for i, (_, listed, column) in enumerate(rules):
        df = df.join(listed.select(column).distinct().withColumn(f"_b{i}", F.lit(True)), column, "left")
    flags = [f"_b{i}" for i in range(len(rules))]
    return df.withColumn("blocked_by", F.coalesce(*[F.when(F.col(b), F.lit(name)) for b, (name, *_) in zip(flags, rules, strict=True)])).drop(*flags)
