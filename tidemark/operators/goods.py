"""Goods texts to items, kinds, groups and a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..functions.values import share


def item_texts(goods: Column) -> Column:
    """Items between ; and . without bracketed parts, normalised, empty ones left out."""
    parts = F.split(F.coalesce(goods, F.lit("")), r"[;.]")
    return F.filter(F.transform(parts, lambda p: X.normalise(F.regexp_replace(p, r"[\[(][^\])]*[\])]", " "))), lambda p: p != "")


def group_scores(item: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The group and keyword with the best score: the keyword's length, 3 more if it is in the last word. The first of equal ones wins."""
    head = X.head_noun(item)
    options = F.array(*[
        F.when(F.contains(item, F.lit(k)), F.struct((F.lit(len(k)) + F.when(F.contains(head, F.lit(k)), 3).otherwise(0)).alias("points"), F.lit(-(100 * i + j)).alias("place"), F.lit(g).alias("grp"), F.lit(k).alias("matched")))
        for i, (g, words) in enumerate(groups.items()) for j, k in enumerate(words)
    ])
    return F.array_max(options)


def classify(item: Column) -> Column:
    """hospitality, trade, food, non_food or unknown, the first that holds."""
    any_of = lambda words: F.coalesce(*[F.when(F.contains(item, F.lit(w)), True) for w in words], F.lit(False))
    food = tuple(w for words in R.GROUPS.values() for w in words)
    return F.when(any_of(R.HOSPITALITY), "hospitality").when(any_of(R.TRADE), "trade").when(any_of(food), "food").when(any_of(R.NON_FOOD), "non_food").otherwise("unknown")


def items(df: DataFrame, key: str, goods: str) -> DataFrame:
    """(key, pos, item, kind, grp, matched): a row for each item."""
    rows = df.select(key, F.posexplode(item_texts(F.col(goods))).alias("pos", "item")).withColumn("kind", classify(F.col("item")))
    best = F.when(F.col("kind") == "food", group_scores(F.col("item"), R.GROUPS))
    return rows.withColumn("_b", best).select(key, "pos", "item", "kind", F.col("_b.grp").alias("grp"), F.col("_b.matched").alias("matched"))


def dominant(rows: DataFrame, key: str, group: str = "grp") -> DataFrame:
    """(key, dominant, dominant_items, several, groups): the group with the most rows, the first by name of equal ones, whether it is
    really several (equal counts, or less than 0.4 of the rows), and all groups in this order. Null groups do not count."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(key, group).agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g"))))
    each = counts.groupBy(key).agg(order.alias("o"), F.sum("n").alias("all"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    several = F.coalesce(first["m"] == second["m"], F.lit(False)) | (-first["m"] / F.col("all") < 0.4)
    return each.select(key, first["g"].alias("dominant"), (-first["m"]).alias("dominant_items"), several.alias("several"), F.transform("o", lambda x: x["g"]).alias("groups"))


def profile(rows: DataFrame, key: str) -> DataFrame:
    """Counts of each kind and shares, and the dominant group of the food items."""
    kinds = rows.groupBy(key).agg(F.count("*").alias("n_items"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("food", "trade", "hospitality", "non_food", "unknown")])
    rate = {"food_share": share(F.col("n_food"), F.col("n_food") + F.col("n_hospitality") + F.col("n_non_food")), "non_food_share": share(F.col("n_non_food"), F.col("n_food") + F.col("n_non_food"))}
    return kinds.join(dominant(rows, key), key, "left").withColumns(rate)


def label_of(group: Column, labels: dict[str, str] = R.GROUP_LABELS) -> Column:
    """A group's label, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), group)


def group_of(label: Column, labels: dict[str, str] = R.GROUP_LABELS) -> Column:
    """The group of a label, whatever its case and the space around it."""
    return label_of(F.lower(F.trim(label)), {v.lower(): k for k, v in labels.items()})


def category_label(groups: Column, several: Column) -> Column:
    """The dominant group's label; where there are really several, the first three of them."""
    named = F.transform(F.slice(groups, 1, 3), lambda g: F.lower(F.coalesce(label_of(g), g)))
    first = F.get(groups, F.lit(0))
    return F.when(several, F.concat(F.lit("Several packaged-food categories: "), F.array_join(named, ", "))).otherwise(label_of(first))


def inferred_category(sic: Column, brand: Column) -> Column:
    """Where goods tell none: the group of the first activity code that has one, else the first group that a word of the brand hints at."""
    of = F.create_map(*[F.lit(x) for kv in R.SIC_GROUP.items() for x in kv])
    by_code = F.filter(F.transform(F.coalesce(sic, F.array().cast("array<string>")), lambda c: F.try_element_at(of, F.trim(c))), lambda g: g.isNotNull())
    words = F.split(X.normalise(brand), " ")
    hints = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, ws))), F.lit(g)) for g, ws in R.BRAND_HINTS.items()]
    return F.coalesce(F.get(by_code, F.lit(0)), *hints)


def out_of_scope(goods: Column, classes: Column) -> Column:
    """Whether words of other trades outweigh those of food: share at least a half with two hits or a decisive word, or a decisive word in class 5."""
    distinct = lambda groups: sum((F.contains(goods, F.lit(w)).cast("int") for w in dict.fromkeys(w for words in groups.values() for w in words)), F.lit(0))
    out, food = distinct(R.OUT_OF_SCOPE), distinct(R.GROUPS)
    decisive = F.coalesce(*[F.when(F.contains(goods, F.lit(w)), True) for w in R.DECISIVE], F.lit(False))
    part = share(out, out + food)
    return (decisive & F.array_contains(classes, 5)) | (decisive & (part >= 0.5)) | ((out >= 2) & (part >= 0.5))


def packaged_probability(classes: Column, group_hits: Column, has_goods: Column, is_word_mark: Column) -> Column:
    """The sum of what speaks for packaged food, 0 to 1, two places."""
    main = F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, R.MAIN_FOOD))), F.lit(False))
    only = (F.size(classes) > 0) & (F.size(F.array_except(classes, F.array(*map(F.lit, R.MAIN_FOOD)))) == 0)
    total = F.lit(0.0)
    for part in (F.when(main, 0.35), F.when(only, 0.1), F.when(group_hits > 0, 0.2), F.least(group_hits, F.lit(4)) * 0.05, F.when(has_goods, 0.15).otherwise(-0.05), F.when(F.size(classes) >= 8, -0.15), F.when(is_word_mark, 0.05)):
        total = total + F.coalesce(part, F.lit(0.0))
    return F.bround(F.when(total < 0, 0.0).when(total > 1, 1.0).otherwise(total), 2)


def distribution_relevance(probability: Column) -> Column:
    return F.when(probability >= 0.6, "HIGH").otherwise("MEDIUM")


def relevance(probability: Column) -> Column:
    return F.when(probability >= 0.7, "HIGH").when(probability >= 0.4, "MEDIUM").otherwise("LOW")


def product_terms(group: Column, label: Column) -> Column:
    """A group's keywords and its label's words of more than three characters, each once, in order."""
    words = F.create_map(*[x for g, ws in R.GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, ws)))])
    own = F.coalesce(F.try_element_at(words, group), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(own, F.split(X.normalise(label), " ")), lambda w: F.length(w) > 3))
