"""Whose page is it? Signals that tie a domain to a filing, a verdict, which results count as evidence, and what they say.

A filing has a few search results (13 at most, by evidence.evidence_for), so what is gathered for one is small. Results join
filings on the filing's key; nothing is compared across filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X


def is_distinctive(name: Column, common: tuple[str, ...] = X.COMMON_WORDS, least: int = R.DISTINCTIVE_LENGTH) -> Column:
    """Two tokens, or one uncommon token of `least` characters or more; of a normalised name."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    first = F.get(words, F.lit(0))
    return F.coalesce((F.size(words) >= 2) | ((F.length(first) >= least) & ~first.isin(*common)), F.lit(False))


def _lead_word(name: Column, words: Column, common: tuple[str, ...] = X.COMMON_WORDS) -> Column:
    """Whether the name's first word, if it is long and uncommon, stands in the words as a whole word."""
    lead = F.split(name, " ")[0]
    return (F.length(lead) >= R.DISTINCTIVE_LENGTH) & ~lead.isin(*common) & F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), lead, F.lit(" ")))


def company_present(words: Column, legal: Column, brand: Column) -> Column:
    """The company's name without legal form, or its leading word; a company named as the brand is no evidence."""
    return F.coalesce((legal != "") & (legal != brand) & (F.contains(words, legal) | _lead_word(legal, words)), F.lit(False))


def brand_present(words: Column, brand: Column) -> Column:
    """The brand, or the long and uncommon first of its several words."""
    return F.coalesce((brand != "") & (F.contains(words, brand) | (F.contains(brand, F.lit(" ")) & _lead_word(brand, words))), F.lit(False))


def contexts(df: DataFrame, key: str, brand: Column, company: Column, number: Column, places: list[Column], terms: Column) -> DataFrame:
    """What is known of each filing: (key, _brand, _legal, _number, _places, _terms). company: its registered name, else the applicant's."""
    known = F.filter(F.array(*[X.normalise(p) for p in places]), lambda p: (p != "") & ~p.isin(*R.WIDE_PLACES))
    return df.select(key, X.normalise(brand).alias("_brand"), X.company_name(company).alias("_legal"), X.normalise(number).alias("_number"), known.alias("_places"), F.filter(terms, lambda x: F.length(x) > 3).alias("_terms"))


def _any_in(words: Column, marks: Column) -> Column:
    return F.coalesce(F.exists(marks, lambda m: F.contains(words, m)), F.lit(False))


def _sector(words: Column) -> Column:
    return _any_in(words, F.col("_terms")) | F.coalesce(*[F.when(F.contains(words, F.lit(w)), True) for w in R.SECTOR_WORDS], F.lit(False))


def pages(results: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The results (key, rank, domain, domain_class, url, title, snippet) with their filing's context and what their words say."""
    words = X.normalise(F.concat_ws(" ", "title", "snippet"))
    rows = results.withColumn("_words", words).join(known, key)
    w = F.col("_words")
    return rows.withColumns({"_company": company_present(w, F.col("_legal"), F.col("_brand")), "_place": _any_in(w, F.col("_places")), "_named": (F.col("_brand") != "") & F.contains(w, F.col("_brand"))})


def candidates(rows: DataFrame, key: str) -> DataFrame:
    """(key, domain, url, pages, first, weight, keys) of each domain that could be the filing's own, from `pages`.

    Domains of other classes and pages deep in a site are no candidates. The corroboration by a third party is the first
    result on another domain that names brand and company.
    """
    named = F.array_sort(F.collect_list(F.when(F.col("_named") & F.col("_company") & (F.col("_legal") != ""), F.struct("rank", "domain", "url"))))
    others = rows.where("domain <> ''").groupBy(key).agg(named.alias("_others"))
    own = rows.where((F.col("domain") != "") & (F.col("domain_class") == "own") & ~X.is_article(F.col("url")))
    said = lambda *columns: X.normalise(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet")))), lambda x: F.array(*[x[c] for c in columns]))), " "))
    depth = F.length(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")))
    same = [F.first(c).alias(c) for c in ("_brand", "_legal", "_number", "_places", "_terms")]
    each = own.groupBy(key, "domain").agg(said("title", "snippet").alias("_all"), said("title").alias("_titles"), F.min_by("url", F.struct(depth, "rank")).alias("url"), F.count("*").alias("pages"), F.min("rank").alias("first"), *same)
    each = each.join(others, key, "left")
    b, all_ = F.col("_brand"), F.col("_all")
    joined, stem = F.replace(b, F.lit(" "), F.lit("")), F.split("domain", r"\.")[0]
    exact = (joined != "") & (stem == joined)
    fired = {
        "exact_domain_brand_match": exact,
        "partial_domain_brand_match": ~exact & (joined != "") & (F.contains(stem, joined) | ((F.length(stem) > 3) & F.contains(joined, stem))),
        "brand_in_title": (b != "") & F.contains(F.col("_titles"), b),
        "company_number_match": (F.col("_number") != "") & F.contains(F.replace(all_, F.lit(" "), F.lit("")), F.col("_number")),
        "company_name_match": company_present(all_, F.col("_legal"), b),
        "location_match": _any_in(all_, F.col("_places")),
        "sector_match": _sector(all_),
        "multiple_pages_same_domain": F.col("pages") > 1,
        "third_party_corroboration": F.exists("_others", lambda x: x["domain"] != F.col("domain")),
    }
    keys = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in fired.items()]))
    weight = sum((F.when(v, R.VERIFY_WEIGHTS[k]).otherwise(0) for k, v in fired.items()), F.lit(0))
    return each.select(key, "domain", "url", "pages", "first", "_brand", weight.alias("weight"), keys.alias("keys"), F.get(F.filter("_others", lambda x: x["domain"] != F.col("domain")), F.lit(0))["url"].alias("corroborated_by"))


def qualifies() -> Column:
    """Weight enough, the brand on the site, and a tie to the company, or for a distinctive brand its exact domain in the trade."""
    has = lambda names: F.arrays_overlap("keys", F.array(*map(F.lit, names)))
    alone = is_distinctive(F.col("_brand")) & F.array_contains("keys", "exact_domain_brand_match") & F.array_contains("keys", "sector_match")
    return (F.col("weight") >= R.VERIFIED_LEAST) & has(R.BRAND_LINKS) & (has(R.COMPANY_TIES) | alone)


def verdicts(found: DataFrame, key: str) -> DataFrame:
    """(key, verdict, website, site, best_domain, best, qualifying) from `candidates`: CONFLICTING for several qualifying domains,
    VERIFIED for one, PROBABLE for a best weight that is high, else UNVERIFIED."""
    order = F.struct("weight", "pages", -F.col("first"), "domain")
    rows = found.withColumn("_ok", qualifies())
    one = F.when(F.col("_ok"), order)
    best = rows.groupBy(key).agg(F.count_if("_ok").alias("qualifying"), F.max("weight").alias("best"), F.max_by("domain", order).alias("best_domain"), F.max_by("domain", one).alias("_domain"), F.max_by("url", one).alias("_url"))
    verdict = F.when(F.col("qualifying") > 1, "CONFLICTING").when(F.col("qualifying") == 1, "VERIFIED").when(F.col("best") >= R.PROBABLE_LEAST, "PROBABLE").otherwise("UNVERIFIED")
    verified = F.col("qualifying") == 1
    return best.select(key, verdict.alias("verdict"), F.when(verified, F.col("_domain")).alias("website"), F.when(verified, X.site_root(F.col("_url"))).alias("site"), "best_domain", "best", "qualifying")


def attributed(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The pages that are about the filing: on its verified domain, with its distinctive legal name, or with its brand and the
    company, its place or, if the brand is distinctive, the trade."""
    w, b = F.col("_words"), F.col("_brand")
    named = brand_present(w, b)
    about = F.coalesce(F.col("domain") == F.col("website"), F.lit(False)) | (is_distinctive(F.col("_legal")) & F.contains(w, F.col("_legal"))) | (named & (F.col("_company") | F.col("_place") | (is_distinctive(b) & _sector(w))))
    return rows.join(found.select(key, "website"), key, "left").where(about)


def footprint(about: DataFrame, key: str) -> DataFrame:
    """(key, retailers, n_retailers, n_marketplaces, n_socials, n_press, encyclopaedia, urls, launches, boasts, sells, words) of `attributed` pages."""
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col("domain_class") == c, F.col("domain"))))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", F.concat_ws(" ", "title", "snippet").alias("t")))), lambda x: x["t"]), " ")
    urls = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])), 1, 8)
    rows = about.groupBy(key).agg(of("retailer").alias("retailers"), of("marketplace").alias("_m"), of("social").alias("_s"), F.count_distinct(F.when(F.col("domain_class") == "press", F.col("url"))).alias("n_press"), F.min_by("url", F.when(F.col("domain_class") == "encyclopaedia", F.struct("rank", "url"))).alias("encyclopaedia"), raw.alias("_raw"), urls.alias("urls"))
    rows = rows.withColumns({"words": X.normalise("_raw"), "_low": F.lower("_raw")})
    hits = lambda c, marks: F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col(c), m))
    rows = rows.withColumns({"launches": F.slice(F.array_sort(hits("words", R.LAUNCH_PHRASES)), 1, 6), "boasts": F.slice(hits("words", R.ESTABLISHED_PHRASES), 1, 6), "sells": F.size(hits("_low", R.SHOP_PHRASES)) > 0})
    return rows.select(key, "retailers", F.size("retailers").alias("n_retailers"), F.size("_m").alias("n_marketplaces"), F.size("_s").alias("n_socials"), "n_press", "encyclopaedia", "urls", "launches", "boasts", "sells", "words")


def website_maturity(known: Column, site: Column) -> Column:
    """established, early_stage or unknown; known: whether any page is about the filing."""
    old = (F.col("n_retailers") > 0) | (F.size("boasts") >= 2) | F.col("encyclopaedia").isNotNull()
    young = site.isNotNull() & ((F.size("launches") > 0) | (F.size("boasts") == 0))
    return F.when(~known, "unknown").when(old, "established").when(young, "early_stage").otherwise("unknown")


def retail_presence(searched: Column, known: Column, site: Column) -> Column:
    """The strongest presence; searched: whether there were results at all."""
    return F.when(~searched, "none_found").when(~known, "unknown").when(F.col("n_retailers") > 0, "multiple_retail").when(F.col("n_marketplaces") > 0, "marketplace").when(site.isNotNull() & F.col("sells"), "direct_only").when(site.isNotNull(), "none_found").otherwise("unknown")


def launch_stage(attempted: Column, known: Column, site: Column, maturity: Column, presence: Column, age: Column) -> Column:
    """established, scaling, early_launch, pre_launch or unknown, the first that holds."""
    with_site = F.when(presence.isin("marketplace", "independent_retail"), "scaling").when(F.col("sells"), "early_launch").when(F.size("launches") > 0, "pre_launch").otherwise("early_launch")
    return F.when(attempted & ((F.col("n_retailers") > 0) | (maturity == "established")), "established").when(attempted & site.isNotNull(), with_site).when(attempted & known & (age <= 2.0), "pre_launch").otherwise("unknown")


def brand_maturity(known: Column, site: Column) -> tuple[Column, Column]:
    """established, emerging or unknown, and why it is established (all reasons that hold, in order)."""
    r, boasts = F.col("n_retailers"), F.size("boasts")
    why = F.array_compact(F.array(F.when(r >= 2, "several retailers"), F.when(F.col("encyclopaedia").isNotNull(), "encyclopaedia entry"), F.when(F.col("n_press") >= 3, "press"), F.when(boasts >= 2, "heritage phrases"), F.when((r >= 1) & (boasts >= 1), "retailer and phrase")))
    young = (F.size("launches") > 0) | site.isNotNull() | (F.col("n_marketplaces") > 0)
    return F.when(~known, "unknown").when(F.size(why) > 0, "established").when(young, "emerging").otherwise("unknown"), F.when(known & (F.size(why) > 0), why)
