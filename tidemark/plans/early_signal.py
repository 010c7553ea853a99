"""From filings, a company register and web evidence to one scored opportunity for each company, with every rejection kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rulebook
from .. import rules as R
from ..functions import dates as D
from ..functions import text as X
from ..functions import values as V
from ..operators import consolidate as C
from ..operators import evidence as E
from ..operators import goods as G
from ..operators import matching as M
from ..operators import relational as rel
from ..operators import scoring as S
from ..operators import verification as P
from ..operators.counters import Guard, check, counted, failing
from ..session import cut

KEY = ["batch_id", "filing_id"]


@dataclass
class Result:
    """Scored rows (suppressed ones with their reason), opportunities, rejections and the funnel's counts."""

    scored: DataFrame
    opportunities: DataFrame
    rejections: DataFrame
    duplicates: DataFrame
    counts: DataFrame


def with_goods(filings: DataFrame) -> DataFrame:
    """Add the normalised goods, the packaged-food probability, the category and the goods profile."""
    goods = X.normalise("goods_text")
    best = G.group_scores(goods, R.GROUPS)
    rows = filings.withColumns({"goods": goods, "row": F.concat_ws(":", *KEY)}).withColumns({"group_hits": X.hits(tuple(w for g in R.GROUPS.values() for w in g), F.col("goods")), "category": best["grp"]})
    rows = rows.withColumn("probability", G.packaged_probability(F.col("nice_classes"), F.col("group_hits"), F.col("goods") != "", F.lower(F.col("mark_type")) == "word"))
    profile = G.profile(G.items(filings.withColumn("row", F.concat_ws(":", *KEY)), "row", "goods_text"), "row")
    return rows.join(profile, "row", "left")


def product_rules() -> list[rel.Rule]:
    c, goods = F.col("nice_classes"), F.col("goods")
    applicant = X.normalise("applicant_name")
    brands = F.coalesce(*[F.when(F.contains(F.concat(F.lit(" "), applicant, F.lit(" ")), F.lit(f" {b} ")), True) for b in R.MAJOR_BRANDS], F.lit(False))
    uk = (F.trim(X.text("applicant_country")) == "") | F.lower(F.trim("applicant_country")).isin(*R.UK_VALUES)
    return [
        ("dead_status", F.lower(F.trim("status")).isin(*R.DEAD_STATUS)),
        ("no_brand_name", F.trim(X.text("mark_text")) == ""),
        *[(name, V.all_in(c, allowed)) for name, allowed in R.CLASS_ONLY.items()],
        ("no_food_class", ~V.any_in(c, R.FOOD)),
        ("supporting_class_only", ~V.any_in(c, R.MAIN_FOOD)),
        ("excluded_goods", X.first_of(R.EXCLUDED_GOODS, goods).isNotNull()),
        ("out_of_scope", G.out_of_scope(goods, c)),
        ("major_brand", brands),
        ("not_uk", ~uk),
    ]


def with_evidence(rows: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Add what the web says: only results that are about a filing count. known: whether there are any; searched: whether there were results."""
    none = {"n_retailers": F.lit(0), "n_marketplaces": F.lit(0), "n_press": F.lit(0), "sells": F.lit(False), "searched": F.lit(False), "known": F.lit(False)}
    empty = F.array().cast("array<string>")
    texts = {"encyclopaedia": F.lit(None).cast("string"), "words": F.lit(None).cast("string"), "website": F.lit(None).cast("string"), "site": F.lit(None).cast("string")}
    if evidence is None:
        return rows.withColumns(none | texts | {"launches": empty, "boasts": empty, "urls": empty, "verdict": F.lit("NOT_ATTEMPTED")})
    live = rows.where("reason is null")
    found = E.classified(E.evidence_for(live, evidence, "row", "mark_text", "company_name"))
    context = P.contexts(live, "row", F.col("mark_text"), F.coalesce("company_name", "applicant_name"), F.col("company_number"), [F.col("region"), F.col("applicant_region")], G.product_terms(F.col("category"), F.col("category_label")))
    pages = cut(P.pages(found, context, "row"), "pages")
    verdicts = cut(P.verdicts(P.candidates(pages, "row"), "row"), "verdicts")
    about = P.footprint(P.attributed(pages, verdicts, "row"), "row").withColumn("known", F.lit(True))
    searched = pages.select("row").distinct().withColumn("searched", F.lit(True))
    out = rows.join(about, "row", "left").join(verdicts.select("row", "verdict", "website", "site"), "row", "left").join(searched, "row", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    return out.withColumns({"launches": F.coalesce("launches", empty), "boasts": F.coalesce("boasts", empty), "urls": F.coalesce("urls", empty), "verdict": F.coalesce("verdict", F.lit("UNVERIFIED"))})


#: A run in which most rows got no score publishes nothing.
GUARDS = (failing("scored", "unscored", "scored"),)


def run(filings: DataFrame, companies: DataFrame, evidence: DataFrame | None = None, guards: Sequence[Guard] = GUARDS, book: rulebook.Rulebook | None = None) -> Result:
    """All stages. `evidence` are search results (query, rank, title, url, snippet); without them web evidence is not looked for.

    Every filing ends as a rejection with its first reason, as a duplicate, or scored; nothing is dropped without a trace.
    Indicators, caps, bands and supplier intents are those of `book`, by default the shipped rules; rows carry its version.
    Counts are taken as the stages "enriched" and "scored" are written; a guard that does not hold on them raises `Stopped`. A filing of
    a major brand's owner or from abroad was rejected by the product rules before it is scored, so their indicators never fire here.
    """
    food = V.any_in(F.col("nice_classes"), R.FOOD)
    batch = filings.withColumn("applicant", X.normalise("applicant_name"))
    marks = batch.where("applicant <> ''").groupBy("batch_id", "applicant").agg(F.count("*").alias("marks"))
    rows = with_goods(batch).join(marks, ["batch_id", "applicant"], "left").withColumn("marks", F.coalesce("marks", F.lit(1)))
    rows = rel.decide(rows, "product", product_rules())
    corporate = X.has_legal_form("applicant_name")
    rows = rows.withColumn("applicant_type", F.when(F.col("applicant") == "", "UNKNOWN").when(corporate, "CORPORATE").otherwise("PERSON"))
    rows = cut(rel.decide(rows, "applicant", [("portfolio", F.col("marks") >= R.PORTFOLIO_REJECT)]), "qualified")

    matches = M.match_applicants(rows.where("reason is null"), companies).select("applicant_name", "company_name", "company_number", "company_status", "incorporation_date", "dissolution_date", "sic_codes", "region", "accounts_category", "method", "ambiguous", "confidence")
    rows = M.with_match(rows, matches)
    matched = F.col("company_number").isNotNull()
    rows = rows.withColumn("was_matched", matched)
    rows = M.without_post_dated(rows, "filing_date", "incorporation_date", ["company_name", "company_number", "company_status", "incorporation_date", "dissolution_date", "sic_codes", "region", "accounts_category"], R.POST_DATED_DAYS)
    age = D.clamped_age(D.age_years(F.col("incorporation_date"), F.col("filing_date")))
    rows = rows.withColumn("age", age)
    rows = rel.decide(rows, "company", [("dissolved_when_filed", F.col("dissolution_date") <= F.col("filing_date")), ("too_established", F.col("age") > R.OLDEST)])
    rows = cut(rows, "matched")

    own = F.col("category")
    rows = rows.withColumn("category", F.coalesce(own, G.inferred_category(F.col("sic_codes"), F.col("mark_text"))))
    rows = rows.withColumn("category_label", F.coalesce(G.category_label(F.col("groups"), F.col("several")), G.label_of(F.col("category"))))
    rows = cut(with_evidence(rows, evidence), "evidenced")
    looked = evidence is not None

    number = F.col("filing_id")
    rows = rows.withColumn("dedupe_key", X.dedupe_key(number, F.col("mark_text"), F.col("applicant_name")))
    past = F.coalesce(F.col("stage") != "product", F.lit(True))
    measures = {
        "raw": F.count("*"), "food_class": F.count_if(food), "product": F.count_if(past), "corporate": F.count_if(past & (F.col("applicant_type") == "CORPORATE")), "matched": F.count_if("was_matched"), "emerging": F.count_if(F.col("reason").isNull()),
    }
    rows, n = counted(rel.first_seen(rows, "applicant", "batch_id"), "enriched", measures)
    check("enriched", n, guards)
    place = F.row_number().over(W.partitionBy("batch_id", "dedupe_key").orderBy("ordinal", "filing_id"))
    tagged = rows.where("reason is null").withColumn("place", place)
    duplicates = tagged.where("place > 1").select(*KEY, "dedupe_key")
    kept = tagged.where("place = 1").drop("place")
    a, sic, classes, known, site = F.col("age"), F.col("sic_codes"), F.col("nice_classes"), F.col("known"), F.col("website")
    kept = kept.withColumns({"site_maturity": P.website_maturity(known, site), "retail_presence": F.when(F.lit(looked), P.retail_presence(F.col("searched"), known, site)).otherwise("unknown")})
    maturity, established = P.brand_maturity(known, site)
    kept = kept.withColumns({"brand_maturity": maturity, "established": established, "stage_of_launch": P.launch_stage(F.lit(looked), known, site, F.col("site_maturity"), F.col("retail_presence"), a)})
    conditions = S.launch_conditions(
        age=a, first=F.col("first_seen") | (F.col("applicant") == ""), marks=F.col("marks"), classes=classes, category=F.col("category"), sic=sic, confidence=F.col("confidence"), matched=F.col("company_number").isNotNull(),
        accounts=F.col("accounts_category"), known=known, site_maturity=F.col("site_maturity"), retailers=F.col("n_retailers"), launches=F.col("launches"), presence=F.col("retail_presence"), marketplaces=F.col("n_marketplaces"),
        mark=F.col("mark_text"), kind=F.col("mark_type"), has_goods=F.coalesce(F.col("goods_text_available"), F.lit(False)), major=F.lit(False), person=F.col("applicant_type") == "PERSON", uk=F.lit(True),
    )
    facts = {
        "age_phrase": D.filing_phrase(a), "age": F.bround(a, 1), "category": F.col("category_label"), "marks": F.col("marks"), "n_classes": F.size(classes), "confidence": F.col("confidence"), "website": site,
        "launch": F.array_join(F.slice("launches", 1, 3), ", "), "sic": V.with_prefix(sic, [p for k in ("manufacturing", "trade", "non_product") for p in R.SIC[k]]),
    }
    book = book or rulebook.shipped()
    kept = book.scored(kept, conditions, facts, looked, {"no_company": F.col("company_number").isNull() | (F.col("confidence") < 70), "no_category": F.col("category").isNull(), "no_web": ~known})
    goods = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    product, service = S.mode_points(sic=sic, goods=F.col("goods"), classes=classes, food=goods("food"), trade=goods("trade"), hospitality=goods("hospitality"), items=goods("items"), food_share=F.coalesce("food_share", F.lit(0.0)), web=F.when(known, F.col("words")))
    kept = kept.withColumns({"product_points": product, "service_points": service})
    mode = S.commercial_mode(F.col("product_points"), F.col("service_points"), sic=sic, food=goods("food"), hospitality=goods("hospitality"), non_food=goods("non_food"), non_food_share=F.coalesce("non_food_share", F.lit(0.0)))
    kept = kept.withColumn("mode", mode)
    kept = book.with_intents(kept, "category", "stage_of_launch", "intent")
    kept = kept.withColumns({"company_key": C.company_key(F.col("company_number"), F.replace("applicant", F.lit(" "), F.lit("")), F.col("row"))})
    kept, late = counted(kept, "scored", {"scored": F.count("*"), "unscored": F.count_if(F.col("score").isNull()), "websites": F.count("site"), "high": F.count_if(F.col("band") == "HIGH"), "medium": F.count_if(F.col("band") == "MEDIUM")})
    check("scored", late, guards)
    scored = kept.withColumn("suppressed_for", S.final_reason(F.col("band"), F.col("mode"), F.col("established")))
    deliverable = scored.where("suppressed_for is null")
    order = [F.desc("score"), F.desc(F.col("category").isNotNull()), F.desc(F.col("goods") != ""), F.asc_nulls_first("filing_date"), F.desc("filing_id"), "batch_id", "ordinal"]
    deliverable = deliverable.withColumn("related", F.struct((-F.col("score")).alias("place"), "filing_id", "mark_text"))
    opportunities = C.consolidate(deliverable, "company_key", order, {"mark_text": "other_marks", "related": "others"}, "nice_classes").drop("related")
    counts = filings.sparkSession.createDataFrame([{**n, **late}], ", ".join(f"{name} bigint" for name in (*n, *late)))
    return Result(scored, opportunities, rel.rejections(rows, *KEY, "mark_text", "applicant_name"), duplicates, counts)
