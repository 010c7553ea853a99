"""The rules as data: small tables, so that a changed rule changes no code. The terms are this library's own."""

from __future__ import annotations

from dataclasses import dataclass

#: Trade classes (fixed values): food, main food, and sets of which a filing must have more than members of one.
FOOD, MAIN_FOOD = [29, 30, 31, 32, 33], [29, 30]
CLASS_ONLY = {"services_only": [43], "retail_only": [35], "produce_only": [31], "supplements_only": [5]}
DEAD_STATUS = ("withdrawn", "refused", "dead", "expired", "removed")
UK_VALUES = ("gb", "uk", "united kingdom", "great britain", "england", "scotland", "wales", "northern ireland", "isle of man", "channel islands", "jersey", "guernsey")
EXCLUDED_GOODS = ("tobacco", "cosmetic", "petrol", "software", "veterinary")
OUT_OF_SCOPE = {"pet": ("pet food", "dog", "cat"), "vitamin": ("vitamin", "supplement", "capsule"), "venue": ("restaurant", "hotel", "catering")}
#: Words that decide by themselves that goods are out of scope.
DECISIVE = ("pet food", "vitamin")
GROUPS = {
    "bakery": ("bread", "cake", "biscuit", "pastry"),
    "dairy": ("milk", "cheese", "yoghurt", "butter"),
    "snack": ("crisp", "nut", "snack", "popcorn"),
    "drink": ("juice", "tea", "coffee", "water"),
    "sauce": ("sauce", "pickle", "dressing", "spice"),
}
MAJOR_BRANDS = ("nestle", "unilever", "kraft heinz", "mars", "danone")
NON_FOOD = ("clothing", "toy", "furniture", "jewellery")
TRADE = ("wholesale", "retail", "import", "distribution")
HOSPITALITY = ("restaurant", "cafe", "bar", "takeaway")
SIC_GROUP = {"10710": "bakery", "10510": "dairy", "10860": "snack", "11070": "drink", "10840": "sauce"}
#: Portfolio sizes, age limits in years, days after filing that an incorporation may lie.
PORTFOLIO_NOTE, PORTFOLIO_REJECT, OLDEST, POST_DATED_DAYS = 4, 8, 6.0, 180


@dataclass(frozen=True)
class Indicator:
    """A named condition's weight and text; evidence indicators count only where that kind of evidence was looked for."""

    key: str
    weight: int
    text: str
    kind: str = "core"


#: The base score, bands from the top, caps and the most by which weights are scaled up (fixed values).
BASE, BANDS = 25, ((80, "HIGH"), (60, "MEDIUM"), (0, "SUPPRESS"))
CAPS = {"no_company": 74, "no_category": 74, "no_web": 79}
MOST_SCALE = 2.0
#: Kinds of suppliers in delivered order, their default relevance, and how a launch stage moves it by a band (fixed values).
SUPPLIERS = ("flexible_packaging", "labels", "cartons", "contract_manufacturing", "copacking", "distribution", "brokerage", "fulfilment", "marketing")
INTENT_DEFAULT = {
    "flexible_packaging": "MEDIUM", "labels": "MEDIUM", "cartons": "LOW", "contract_manufacturing": "MEDIUM", "copacking": "MEDIUM",
    "distribution": "MEDIUM", "brokerage": "LOW", "fulfilment": "LOW", "marketing": "LOW",
}
INTENT_SHIFT = {
    "pre_launch": {"flexible_packaging": 1, "labels": 1, "contract_manufacturing": 1, "copacking": 1, "distribution": -1, "brokerage": -1, "fulfilment": -1},
    "early_launch": {"distribution": 1, "fulfilment": 1, "marketing": 1},
    "scaling": {"flexible_packaging": -1, "contract_manufacturing": -1, "distribution": 1, "brokerage": 1, "fulfilment": 1},
    "established": {s: -1 for s in SUPPLIERS},
}
#: What the groups of GROUPS mean for suppliers where it isn't the default: the published values of the trade each stands for (fixed values).
INTENT_GROUP = {
    "bakery": {"flexible_packaging": "HIGH", "cartons": "HIGH", "contract_manufacturing": "HIGH", "copacking": "HIGH", "distribution": "HIGH", "brokerage": "MEDIUM", "fulfilment": "MEDIUM", "marketing": "MEDIUM"},
    "dairy": {"flexible_packaging": "HIGH", "labels": "HIGH", "cartons": "MEDIUM", "contract_manufacturing": "HIGH", "copacking": "HIGH", "distribution": "HIGH", "brokerage": "MEDIUM", "marketing": "MEDIUM"},
    "snack": {"flexible_packaging": "HIGH", "cartons": "MEDIUM", "contract_manufacturing": "HIGH", "copacking": "HIGH", "distribution": "HIGH", "brokerage": "MEDIUM", "fulfilment": "MEDIUM", "marketing": "MEDIUM"},
    "drink": {"flexible_packaging": "HIGH", "labels": "HIGH", "cartons": "MEDIUM", "contract_manufacturing": "HIGH", "copacking": "HIGH", "fulfilment": "HIGH", "marketing": "MEDIUM"},
    "sauce": {"flexible_packaging": "LOW", "labels": "HIGH", "cartons": "MEDIUM", "contract_manufacturing": "HIGH", "copacking": "HIGH", "distribution": "HIGH", "brokerage": "MEDIUM", "fulfilment": "MEDIUM", "marketing": "MEDIUM"},
}
#: Domain suffixes by class, in order; the first class wins.
DOMAIN_CLASS = (("marketplace", ("amazon.co.uk", "etsy.com", "ebay.co.uk")), ("social", ("instagram.com", "facebook.com")), ("retailer", ("tesco.com", "waitrose.com")), ("press", ("bbc.co.uk", "theguardian.com")), ("encyclopaedia", ("wikipedia.org", "britannica.com")), ("directory", ("companieshouse.gov.uk", "yell.com", "trustpilot.com")))
#: All indicators of a filing, positive and negative, with their weights (fixed values); texts are this library's own.
LAUNCH_INDICATORS = (
    Indicator("company_incorporated_within_12m", 12, "incorporated {age_phrase} filing", "age"),
    Indicator("company_incorporated_within_24m", 8, "incorporated {age_phrase} filing", "age"),
    Indicator("company_incorporated_within_48m", 4, "incorporated {age_phrase} filing", "age"),
    Indicator("first_trademark_for_applicant", 8, "first filing by this applicant"),
    Indicator("single_mark_this_journal", 3, "one mark in this batch"),
    Indicator("specific_packaged_food_category", 10, "goods are in one trade: {category}"),
    Indicator("narrow_class_profile", 4, "covers {n_classes} classes only"),
    Indicator("food_sic_code_match", 6, "registered for food making or trade ({sic})"),
    Indicator("strong_company_match", 5, "sure of the company ({confidence})"),
    Indicator("early_stage_website", 7, "has a young website ({website})", "web"),
    Indicator("no_major_retail_listings", 7, "no large retailer lists it", "web"),
    Indicator("active_launch_signals", 6, "announces a launch ({launch})", "web"),
    Indicator("small_company_accounts", 3, "files small accounts"),
    Indicator("distinctive_consumer_brand_name", 3, "reads as a product's name"),
    Indicator("word_mark", 2, "is a word mark"),
    Indicator("major_brand_owner", -60, "belongs to a large brand owner"),
    Indicator("company_older_than_6y", -18, "company was {age} years old"),
    Indicator("company_older_than_10y", -10, "company is long established"),
    Indicator("portfolio_filing", -20, "files {marks} marks at once"),
    Indicator("many_classes", -8, "covers {n_classes} classes"),
    Indicator("no_company_match", -15, "no company was found"),
    Indicator("weak_company_match", -8, "unsure of the company ({confidence})"),
    Indicator("natural_person_applicant", -20, "applicant is a person"),
    Indicator("non_uk_applicant", -25, "applicant is abroad"),
    Indicator("service_only_profile", -25, "looks like a service"),
    Indicator("mature_brand_footprint", -25, "brand is established"),
    Indicator("widely_distributed", -18, "sold by several retailers"),
    Indicator("goods_text_unavailable", -8, "goods are not known"),
    Indicator("figurative_only_mark", -4, "is a picture mark"),
    Indicator("company_dormant", -10, "company is dormant"),
    Indicator("service_business_sic_only", -25, "registered for services only ({sic})"),
    Indicator("already_on_marketplace", -6, "sold on a marketplace"),
)
#: Kinds of accounts that small companies file, and words that make no product's name (fixed values).
SMALL_ACCOUNTS = ("MICRO ENTITY", "TOTAL EXEMPTION SMALL", "SMALL", "ACCOUNTS TYPE NOT AVAILABLE", "TOTAL EXEMPTION FULL")
GENERIC_NAME_WORDS = ("the", "company", "limited", "ltd", "group", "services", "solutions", "uk")
#: Weights of what ties a domain to a filing, which of them tie it to the company and which to the brand, and least weights (fixed values).
VERIFY_WEIGHTS = {
    "company_number_match": 4, "company_name_match": 3, "exact_domain_brand_match": 3, "location_match": 2, "third_party_corroboration": 2,
    "brand_in_title": 1, "partial_domain_brand_match": 1, "sector_match": 1, "multiple_pages_same_domain": 1,
}
COMPANY_TIES = ("company_number_match", "company_name_match", "location_match", "third_party_corroboration")
BRAND_LINKS = ("exact_domain_brand_match", "partial_domain_brand_match", "brand_in_title")
VERIFIED_LEAST, PROBABLE_LEAST, DISTINCTIVE_LENGTH = 4, 3, 8
#: Phrases of pages (fixed values).
LAUNCH_PHRASES = ("coming soon", "launching soon", "pre-order", "preorder", "new brand", "we launched", "founded in", "our story", "crowdfunding", "crowdfunder", "kickstarter", "seedrs", "stockists", "wholesale enquiries", "trade enquiries", "sample pack")
SHOP_PHRASES = ("add to basket", "add to cart", "shop now", "buy now", "our shop", "£")
ESTABLISHED_PHRASES = (
    "since 18", "since 19", "since 20", "nationwide", "available in over", "stocked in over", "our factories", "our factory", "global brand", "worldwide", "annual revenue",
    "turnover of", "distributors in", "million bottles", "million packs", "award-winning brand", "best-selling", "bestselling", "market leader", "leading brand", "household name",
)
#: Words of the food trade on pages: this library's own, beside the words of GROUPS.
SECTOR_WORDS = ("food", "snack", "drink", "flavour", "recipe", "ingredient", "kitchen", "bakery", "grocery", "organic", "vegan", "dairy", "meal", "baked", "roasted")
WIDE_PLACES = ("england", "scotland", "wales", "united kingdom", "uk")
#: Points of the commercial mode, prefixes of register activities, shares and least counts (fixed values).
PRODUCT_POINTS = {"food_manufacturing_sic": 3, "food_trade_sic": 2, "packaged_formats_in_goods": 2, "food_dominant_goods": 2, "broad_food_range": 1, "trade_services_in_goods": 1, "corroborated_product_web_evidence": 2}
SERVICE_POINTS = {"food_service_sic": 3, "all_sic_codes_are_service_or_non_operating": 2, "non_operating_sic_only": 2, "hospitality_goods": 2, "hospitality_dominant_goods": 2, "class_43_present": 1, "corroborated_hospitality_web_evidence": 3}
SIC = {
    "manufacturing": ("10", "11"),
    "trade": ("4617", "4631", "4632", "4633", "4634", "4635", "4636", "4637", "4638", "4639", "4711", "4721", "4722", "4723", "4724", "4725", "4726", "4729", "4781", "4791", "4799"),
    "service": ("5610", "5621", "5629", "5630"),
    "non_operating": ("6420", "6810", "6820", "6832", "7010", "7022", "7740", "8299", "9999", "9609", "5911", "5912", "5913", "5914", "6201", "6202", "7311", "7810", "7820", "7830"),
    "non_product": ("5610", "5621", "5629", "5630", "6810", "6820", "6832", "7010", "7022", "8299", "9999", "4711", "4719", "4771", "4791", "4799"),
}
FOOD_DOMINANT, HOSPITALITY_DOMINANT, NON_FOOD_DOMINANT, BROAD_RANGE, SURVIVES_WITHOUT_SIC, MODE_FLOOR, MODE_MARGIN = 0.6, 0.25, 0.5, 10, 12, 4, 1
#: Words of packaging, of outlets and of product ranges: this library's own.
PACKAGED_WORDS = ("packet", "pouch", "carton", "jar", "bottle", "tinned", "canned", "sachet", "frozen", "chilled", "ready meal", "powder", "dried", "preserved")
OUTLET_WORDS = ("menu", "opening hours", "book a table", "takeaway", "our restaurant", "our cafe", "deliveroo")
RANGE_WORDS = ("stockists", "wholesale enquiries", "trade enquiries", "our range", "available at", "multipack", "per pack", "distributor")
#: Labels of groups, and words of a brand's name that hint at one: this library's own.
GROUP_LABELS = {"bakery": "Bakery", "dairy": "Dairy", "snack": "Snacks", "drink": "Drinks", "sauce": "Sauces and pickles"}
BRAND_HINTS = {"bakery": ("bake", "bakery", "bread", "dough", "cake"), "dairy": ("dairy", "cheese", "creamery", "milk"), "snack": ("snack", "crisps", "nuts", "popcorn"), "drink": ("brew", "tea", "coffee", "juice"), "sauce": ("sauce", "spice", "chilli", "pickle")}


def positive_scale(looked_for_web: bool, indicators: tuple[Indicator, ...] = LAUNCH_INDICATORS) -> float:
    """By how much positive weights are scaled so that evidence that was not looked for does not count against a filing.

    Only the best age indicator can fire, so it counts once.
    """
    age = max(x.weight for x in indicators if x.kind == "age")
    full = age + sum(x.weight for x in indicators if x.weight > 0 and x.kind != "age")
    had = full if looked_for_web else full - sum(x.weight for x in indicators if x.weight > 0 and x.kind == "web")
    return min(MOST_SCALE, full / had)
