"""Additive scores with ordered reasons, caps and bands; buying intent; commercial mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..functions.values import shifted


def fired(conditions: dict[str, Column], facts: dict[str, Column], scale: Column | float, indicators: tuple[R.Indicator, ...] = R.LAUNCH_INDICATORS) -> Column:
    """The indicators whose condition holds, as an array of (key, text, weight, position).

    Positive weights are scaled and rounded half to even one by one; negative ones are taken as they are.
    """
    found = []
    for i, x in enumerate(x for x in indicators if x.key in conditions):
        weight = F.bround(F.lit(float(x.weight)) * scale, 0).cast("int") if x.weight > 0 else F.lit(x.weight)
        words = X.render(x.text, **{k: v for k, v in facts.items() if "{" + k + "}" in x.text})
        found.append(F.when(conditions[x.key], F.struct(F.lit(x.key).alias("key"), words.alias("text"), weight.alias("weight"), F.lit(i).alias("position"))))
    return F.array_compact(F.array(*found))


def launch_conditions(
    *, age: Column, first: Column, marks: Column, classes: Column, category: Column, sic: Column, confidence: Column, matched: Column, accounts: Column, known: Column, site_maturity: Column, retailers: Column,
    launches: Column, presence: Column, marketplaces: Column, mark: Column, kind: Column, has_goods: Column, major: Column, person: Column, uk: Column,
) -> dict[str, Column]:
    """When each of R.LAUNCH_INDICATORS fires. Of a kind (age, marks, classes, match, presence) one does at most; null fires nothing."""
    n, kind = F.size(classes), F.lower(kind)
    name = X.normalise(mark)
    words = F.split(name, " ")
    reads = (name != "") & (F.size(words) <= 4) & (F.length(name) <= 30) & (F.size(F.array_except(words, F.array(*map(F.lit, R.GENERIC_NAME_WORDS)))) > 0)
    accounts = F.upper(X.text(accounts))
    services = (F.size(sic) > 0) & (F.size(sic_with(sic, "non_product")) == F.size(sic))
    return {
        "company_incorporated_within_12m": age <= 1, "company_incorporated_within_24m": (age > 1) & (age <= 2), "company_incorporated_within_48m": (age > 2) & (age <= 4),
        "company_older_than_10y": age > 10, "company_older_than_6y": (age > 6) & (age <= 10), "first_trademark_for_applicant": first, "single_mark_this_journal": marks == 1, "portfolio_filing": marks >= R.PORTFOLIO_NOTE,
        "specific_packaged_food_category": category.isNotNull(), "narrow_class_profile": n.between(1, 3), "many_classes": n >= 8, "food_sic_code_match": F.size(sic_with(sic, "manufacturing", "trade")) > 0,
        "service_business_sic_only": services, "strong_company_match": matched & (confidence >= 85), "weak_company_match": matched & (confidence < 70), "no_company_match": ~matched,
        "small_company_accounts": matched & accounts.isin(*R.SMALL_ACCOUNTS), "company_dormant": matched & (accounts == "DORMANT"), "early_stage_website": known & (site_maturity == "early_stage"),
        "no_major_retail_listings": known & (retailers == 0), "active_launch_signals": known & (F.size(launches) > 0), "mature_brand_footprint": known & (site_maturity == "established"),
        "widely_distributed": known & (presence == "multiple_retail"), "already_on_marketplace": known & (presence != "multiple_retail") & (marketplaces > 0), "distinctive_consumer_brand_name": reads,
        "word_mark": F.startswith(kind, F.lit("word")), "figurative_only_mark": F.startswith(kind, F.lit("fig")), "goods_text_unavailable": ~has_goods, "major_brand_owner": major, "natural_person_applicant": person,
        "non_uk_applicant": ~uk, "service_only_profile": category.isNull() & (F.size(F.array_intersect(classes, F.array(*map(F.lit, R.FOOD)))) == 0),
    }


def sic_with(codes: Column, *kinds: str) -> Column:
    """The activity codes that begin with a prefix of the kinds."""
    prefixes = F.array(*[F.lit(p) for k in kinds for p in R.SIC[k]])
    return F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.exists(prefixes, lambda p: F.startswith(F.trim(c), p)))


def mode_points(*, sic: Column, goods: Column, classes: Column, food: Column, trade: Column, hospitality: Column, items: Column, food_share: Column, web: Column) -> tuple[Column, Column]:
    """What speaks for a packaged product and what for a service. food, trade, hospitality, items: counts of goods items; web: the
    words of pages that are about the filing, null if there are none."""
    any_of = lambda c, marks: F.coalesce(*[F.when(F.contains(c, F.lit(m)), True) for m in marks], F.lit(False))
    codes = F.coalesce(sic, F.array().cast("array<string>"))
    has = lambda k: F.size(sic_with(codes, k)) > 0
    idle = (F.size(codes) > 0) & (F.size(sic_with(codes, "service")) + F.size(sic_with(codes, "non_operating")) == F.size(codes))
    web = X.text(web)
    product = {
        "food_manufacturing_sic": has("manufacturing"), "food_trade_sic": has("trade"), "packaged_formats_in_goods": any_of(goods, R.PACKAGED_WORDS), "food_dominant_goods": food_share >= R.FOOD_DOMINANT,
        "broad_food_range": food >= R.BROAD_RANGE, "trade_services_in_goods": trade > 0, "corroborated_product_web_evidence": any_of(web, R.RANGE_WORDS),
    }
    service = {
        "food_service_sic": has("service"), "all_sic_codes_are_service_or_non_operating": idle, "non_operating_sic_only": ~idle & has("non_operating") & ~has("manufacturing") & ~has("trade"),
        "hospitality_goods": hospitality > 0, "hospitality_dominant_goods": (items > 0) & (hospitality / F.greatest(food + hospitality, F.lit(1)) >= R.HOSPITALITY_DOMINANT), "class_43_present": F.array_contains(classes, 43),
        "corroborated_hospitality_web_evidence": any_of(web, R.OUTLET_WORDS) | X.has_street(web),
    }
    points = lambda fired_, weights: sum((F.when(c, weights[k]).otherwise(0) for k, c in fired_.items()), F.lit(0))
    return points(product, R.PRODUCT_POINTS), points(service, R.SERVICE_POINTS)


def commercial_mode(product: Column, service: Column, *, sic: Column, food: Column, hospitality: Column, non_food: Column, non_food_share: Column) -> Column:
    """PACKAGED_PRODUCT, MIXED_BUT_PRODUCT_RELEVANT, FOOD_SERVICE, NON_PRODUCT or UNCERTAIN, the first that holds; food goods that are
    incidental to others are NON_PRODUCT whatever the points."""
    has = lambda *k: F.size(sic_with(sic, *k)) > 0
    incidental = (non_food > 0) & (food > 0) & (non_food_share >= R.NON_FOOD_DOMINANT) & ~has("manufacturing", "trade") & (food < R.SURVIVES_WITHOUT_SIC)
    serves = (service > product) & ((hospitality > 0) | has("service") | has("non_operating"))
    only_idle = has("non_operating") & ~has("service") & (hospitality == 0)
    enough = product >= R.MODE_FLOOR
    return F.when(incidental, "NON_PRODUCT").when(enough & (service == 0), "PACKAGED_PRODUCT").when(enough & (product - service >= R.MODE_MARGIN), "MIXED_BUT_PRODUCT_RELEVANT").when(serves & only_idle, "NON_PRODUCT").when(serves, "FOOD_SERVICE").otherwise("UNCERTAIN")


def total(reasons: Column, base: int = R.BASE) -> Column:
    """Base and weights, held between 0 and 100."""
    n = F.aggregate(reasons, F.lit(base), lambda a, x: a + x["weight"])
    return F.when(n < 0, 0).when(n > 100, 100).otherwise(n)


def capped(score: Column, caps: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """The score under each cap that applies, one after the other, and the name of the last cap that changed it."""
    reason = F.lit(None).cast("string")
    for name, applies, most in caps:
        hit = applies & (score > most)
        score, reason = F.when(hit, most).otherwise(score), F.when(hit, name).otherwise(reason)
    return score, reason


def band(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= low, name) for low, name in R.BANDS], F.lit(R.BANDS[-1][1]))


def top_reasons(reasons: Column, most: int = 6) -> Column:
    """Texts by weight from the top, equal ones in firing order."""
    order = lambda a, b: F.when(a["weight"] != b["weight"], b["weight"] - a["weight"]).otherwise(a["position"] - b["position"])
    return F.transform(F.slice(F.array_sort(reasons, order), 1, most), lambda x: x["text"])


def intent(group: Column, stage: Column) -> Column:
    """A band for each supplier: the group's own where there is one, else the default, moved by the launch stage."""
    out = []
    for s in R.SUPPLIERS:
        own = F.coalesce(*[F.when(group == g, F.lit(bands[s])) for g, bands in R.INTENT_GROUP.items() if s in bands], F.lit(R.INTENT_DEFAULT[s]))
        by = F.coalesce(*[F.when(stage == g, F.lit(moves[s])) for g, moves in R.INTENT_SHIFT.items() if s in moves], F.lit(0))
        out += [F.lit(s), shifted(own, by)]
    return F.create_map(*out)


def top_intents(intents: Column, most: int = 3) -> Column:
    """The suppliers with HIGH and then with MEDIUM, in their order."""
    entries = F.filter(F.map_entries(intents), lambda e: e["value"].isin("HIGH", "MEDIUM"))
    ranked = F.transform(entries, lambda e, i: F.struct(F.when(e["value"] == "HIGH", 0).otherwise(1).alias("r"), i.alias("i"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: x["k"])


def final_reason(band_: Column, mode_: Column, established: Column) -> Column:
    """Why a scored filing is not delivered, the first that holds."""
    return F.when(~band_.isin("HIGH", "MEDIUM"), "score_below_band").when(mode_.isin("SERVICE", "FOOD_SERVICE", "NON_PRODUCT"), "service_business").when(established.isNotNull(), "established_brand")
