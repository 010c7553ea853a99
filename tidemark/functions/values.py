"""Numbers, arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relevance bands from low to high (fixed values).
BANDS = ("NONE", "LOW", "MEDIUM", "HIGH")


def clamp(c: Column, low: float, high: float) -> Column:
    """Held to the span; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def spread(a: Column, b: Column) -> Column:
    """The larger of a / b and b / a."""
    return F.greatest(a / F.greatest(b, F.lit(1)), b / F.greatest(a, F.lit(1)))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def pounds(pence: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(pence / 100, 2))


def class_list(c: Column) -> Column:
    """Numbers 1 to 45 from a text list, each once, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;/\s]+"), lambda p: F.regexp_extract(p, r"^\D*(\d{1,2})(?!\d)", 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.expr("try_cast(null as int)") if p is None else p.try_cast("int")), lambda n: (n >= 1) & (n <= 45))))


def flags_to_classes(flags: list[Column]) -> Column:
    """The numbers of the flags that are set."""
    off = ("0", "", "N", "No", "false", "False")
    return F.filter(F.array(*[F.when(f.isNotNull() & ~F.trim(f).isin(*off), F.lit(i + 1)) for i, f in enumerate(flags)]), lambda x: x.isNotNull())


def all_in(classes: Column, allowed: list[int]) -> Column:
    """Not empty and nothing but the allowed ones."""
    return (F.size(classes) > 0) & (F.size(F.array_except(classes, F.array(*map(F.lit, allowed)))) == 0)


def any_in(classes: Column, wanted: list[int]) -> Column:
    return F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, wanted))), F.lit(False))


def with_prefix(codes: Column, prefixes: list[str], most: int = 3) -> Column:
    """The first codes with any of the prefixes, joined."""
    return F.array_join(F.slice(F.filter(codes, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p))), 1, most), ",")


def all_with_prefix(codes: Column, prefixes: list[str]) -> Column:
    return (F.size(codes) > 0) & F.forall(codes, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p)))


def pipe_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), F.trim), lambda x: x != "")


def rank_of(band: Column) -> Column:
    """0 to 3 for the bands; null for another value."""
    at = F.array_position(F.array(*map(F.lit, BANDS)), band)
    return F.when(at > 0, at - 1)


def at_least(band: Column, least: Column) -> Column:
    return F.coalesce(rank_of(band) >= rank_of(least), F.lit(False))


def shifted(band: Column, by: Column | int) -> Column:
    """The band moved up or down, held to the ends; an unknown one stays."""
    rank = rank_of(band) + by
    return F.when(rank.isNull(), band).otherwise(F.get(F.array(*map(F.lit, BANDS)), F.when(rank < 0, 0).when(rank > 3, 3).otherwise(rank).cast("int")))


def intent_map(found: Column, complete: Column, keys: tuple[str, ...]) -> Column:
    """A band for each key: NONE for one that is missing from a complete map, UNKNOWN otherwise."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.coalesce(F.try_element_at(found, F.lit(k)), F.when(complete, "NONE").otherwise("UNKNOWN")) for k in keys]))


def json_block(c: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once a row however often `use` names it: for what is dear to compute, as parsing."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def valid_judgement(c: Column, categories: tuple[str, ...]) -> Column:
    """A model's answer as a struct, null unless every field is there and in range."""

    def checked(parsed: Column) -> Column:
        ok = parsed["probability"].between(0, 1) & parsed["category"].isin(*categories) & parsed["is_product"].isNotNull() & (F.length(F.coalesce(parsed["note"], F.lit(""))) <= 600)
        return F.when(ok, parsed)

    return once(F.from_json(json_block(c), "category string, probability double, is_product boolean, note string", {"mode": "PERMISSIVE"}), checked)


def json_field(c: Column, path: str, default: str) -> Column:
    """The text at a path of a JSON text, the default where it is absent."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def merged(rule: Column, judged: Column, low: float = 0.0, high: float = 1.0) -> tuple[Column, Column]:
    """A rule's probability averaged with a model's, three places half to even, and whether the rule's stands alone: where the
    model gave none or one outside low to high."""
    usable = once(judged, lambda j: F.when(j.between(low, high), j))
    return once(usable, lambda u: F.when(u.isNull(), rule).otherwise(F.bround((u + rule) / 2, 3))), usable.isNull()
