"""What a run delivers: one row for each opportunity in the extract's columns, and the sample that a supplier may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import relational as rel
from ..operators import scoring as S
from ..sources import ledger
from ..sources import writers as E
from .early_signal import Result

#: Relevance columns of the extract by supplier, and the stages' labels in a sample (fixed values).
RELEVANCE = {
    "flexible_packaging": "packaging_relevance", "labels": "label_relevance", "cartons": "carton_relevance", "contract_manufacturing": "contract_manufacturing_relevance", "copacking": "copacking_relevance",
    "distribution": "distribution_relevance", "brokerage": "brokerage_relevance", "fulfilment": "fulfilment_relevance", "marketing": "marketing_relevance",
}
SAMPLE_STAGES = {
    "pre_launch": "Pre-launch — brand protected, no retail presence found", "early_launch": "Early launch — selling, limited distribution", "scaling": "Scaling — established distribution",
    "established": "Established", "unknown": "Not established from available evidence",
}
URLS = 5


def rows(opportunities: DataFrame) -> DataFrame:
    """The extract's columns, typed, in order, from `early_signal.run(...).opportunities`, with the lead's reasons as `why_selected`.

    A website is only given where it was verified. Other marks and their brands are in one order, the best first. Columns of the
    opportunities that are not delivered are dropped, whatever their names.
    """
    c = F.col
    reasons = S.top_reasons(c("reasons"))
    brands = F.filter(F.transform("others", lambda x: x["mark_text"]), lambda b: F.trim(F.coalesce(b, F.lit(""))) != "")
    cells: dict[str, Column] = {
        "brand_name": c("mark_text"), "trademark_number": c("filing_id"), "filing_date": c("filing_date"), "publication_date": c("publication_date"), "product_category": F.coalesce("category_label", "category"), "goods_summary": c("goods_text"),
        "company_name": c("company_name"), "company_number": c("company_number"), "company_incorporation_date": c("incorporation_date"), "company_region": c("region"), "website": c("site"), "website_status": F.lower("verdict"),
        "contact_page": F.lit(None).cast("string"), "launch_stage": c("stage_of_launch"), "brand_maturity": c("brand_maturity"), "retail_presence": c("retail_presence"),
        **{column: c("intent")[supplier] for supplier, column in RELEVANCE.items()},
        "score": c("score"), "score_band": c("band"), "score_reasons": reasons, "other_marks": F.transform("others", lambda x: x["filing_id"]), "other_brand_names": brands, "source_url": c("source_url"),
        "evidence_urls": F.array_join(F.slice("urls", 1, URLS), " "),
    }
    return opportunities.select(*[cells[name].alias(name) for name in E.CSV_COLUMNS])


def order() -> list[Column]:
    """The best first; numbers break ties."""
    return [F.desc("score"), F.asc_nulls_last("brand_name"), F.asc("trademark_number")]


def write(opportunities: DataFrame, path: str) -> None:
    """The extract of a run as one CSV: opportunities of a batch are few, as each is read by a person."""
    E.write_extract(rows(opportunities), path, *order())


def publish(result: Result, root: str, batch: str, query: str = "early_signal") -> bool:
    """Commit a run's tables (delivered, rejections, duplicates, counts) together, once for a batch; gives whether this call did. A run that a
    guard stopped has no result, so nothing of it is published."""
    tables = {"delivered": rows(result.opportunities), "rejections": result.rejections, "duplicates": result.duplicates, "counts": result.counts}
    return ledger.commit(root, query, batch, tables)


def sample_reason(least: int = 60) -> Column:
    """Why a delivered row may not be in a sample, the first that holds; null if it may."""
    number = F.trim(F.coalesce("company_number", F.lit("")))
    return rel.first_reason([("below the deliverable band", ~F.coalesce(F.col("score_band").isin("HIGH", "MEDIUM"), F.lit(False))), ("below the minimum score", F.coalesce("score", F.lit(0)) < least), ("no company match", number == "")])


def sample(delivered: DataFrame, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """(rows of the sample in its columns, (reason, n) of what was held back) from `rows`. `why_selected` are the score's reasons."""
    judged = delivered.withColumn("_reason", sample_reason(least))
    held = judged.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    names = {"why_selected": F.array_join("score_reasons", " | "), "launch_stage": E.labelled(F.col("launch_stage"), SAMPLE_STAGES), "flexible_packaging_relevance": F.col(RELEVANCE["flexible_packaging"])}
    kept = judged.where("_reason is null")
    return kept.select(*[names.get(n, F.col(n)).alias(n) for n in E.SAMPLE_COLUMNS]), held


def missing_suppliers(opportunities: DataFrame) -> DataFrame:
    """Opportunities whose intents lack a supplier of the extract: none, unless rules and columns no longer agree."""
    return opportunities.where(F.exists(F.array(*map(F.lit, R.SUPPLIERS)), lambda s: ~F.map_contains_key("intent", s)))
