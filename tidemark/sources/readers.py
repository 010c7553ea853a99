"""Readers: register extracts as XML and delimited text, the company register, evidence, leads, prospects and feedback."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates as D
from ..functions import text as X
from ..functions import values as V
from . import markup as M

# Names of elements and columns of the published formats (fixed values).
RECORD_TAGS = ("TradeMark", "TradeMarkRecord", "Trademark", "MarkRecord")
ALIASES = {
    "filing_id": ("ApplicationNumber", "RegistrationNumber", "MarkNumber", "TradeMarkNumber", "ApplicationNumberText"),
    "filing_date": ("ApplicationDate", "FilingDate", "ApplicationFilingDate"),
    "publication_date": ("PublicationDate", "MarkEventDate", "JournalDate"),
    "mark_text": ("MarkVerbalElementText", "MarkSignificantVerbalElementText", "WordMarkSpecification", "MarkVerbalElement", "MarkText"),
    "mark_type": ("MarkFeature", "MarkKind", "MarkType"),
    "mark_category": ("MarkCategory", "MarkCurrentStatusCode", "KindMark"),
    "status": ("MarkCurrentStatusCode", "MarkCurrentStatus", "Status"),
    "series_count": ("SeriesQuantity", "NumberOfMarksInSeries", "SeriesCount"),
}
APPLICANT_TAGS = ("ApplicantDetails", "Applicant", "ApplicantAddressBook")
NAME_TAGS = ("FreeFormatNameDetails", "FreeFormatNameLine", "FreeFormatName", "OrganizationName", "EntityName", "Name", "FirstName", "LastName", "ApplicantName")
COUNTRY_TAGS = ("CountryCode", "Country", "ApplicantCountryCode")
POSTCODE_TAGS = ("PostcodeText", "PostalCode", "Postcode")
CLASS_TAGS = ("ClassNumber", "NiceClassNumber", "ClassDescriptionNumber")
GOODS_TAGS = ("GoodsServicesDescription", "GoodsServicesDescriptionText", "ClassificationTermText", "GoodsServicesText")
XML_DATES = (("yyyy-MM-dd", 10), ("yyyyMMdd", 8), ("dd/MM/yyyy", 10), ("dd-MM-yyyy", 10), ("yyyy/MM/dd", 10))
TEXT_DATES = (("yyyy-MM-dd", None), ("dd/MM/yyyy", None), ("yyyyMMdd", None))
REGISTER_DATES = (("dd/MM/yyyy", None), ("yyyy-MM-dd", None))
GOODS_LIMIT = 2000


def _record_ends(spark: SparkSession, path: str, tags: tuple[str, ...]) -> dict[str, list[str]]:
    """The names that records end with, with their prefix, and the files in which each occurs."""
    pieces = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", rf"</((?:\w+:)?(?:{'|'.join(tags)}))\s*$", 1).alias("end"))
    found = pieces.where("end <> ''").groupBy("end", "file").count().orderBy("end", "file").collect()  # a row a file
    return {end: [r["file"] for r in found if r["end"] == end] for end in dict.fromkeys(r["end"] for r in found)}


def read_filings_xml(spark: SparkSession, path: str, batch_id: str, source_name: str = "xml", source_url: str | None = None, tags: tuple[str, ...] = RECORD_TAGS) -> DataFrame:
    """Filings of register XML, plain or gzip, any namespace.

    The text is split at the records' end tags, which are looked for first, and each record's elements are found in its own text, so
    that a record that is not well formed costs no other record, and files are split between tasks. A file is read once for
    each end tag that it has, which is one.
    """
    out = spark.createDataFrame([], "r string, ordinal long")
    for end, files in _record_ends(spark, path, tags).items():
        raw = spark.read.option("lineSep", f"</{end}>").text(files)
        record = F.regexp_extract("value", rf"(?s)(<{end}(?:\s[^>]*)?>.*)$", 1)
        out = out.unionByName(raw.select(record.alias("r"), F.monotonically_increasing_id().alias("ordinal")).where("r <> ''"))
    return filings_of(out, "r", F.lit(batch_id), source_name, source_url)


def filings_of(records: DataFrame, record: str, batch_id: Column, source_name: str = "xml", source_url: str | None = None) -> DataFrame:
    """Filings of records (record, ordinal): XML texts, each of one filing, which need not be well formed.

    Fields are looked up by their names' order, then the document's. The applicant's are those within its first element; where there is none,
    of the whole record. A date that no format reads is null; classes outside 1 to 45 go; records without a number go.
    """
    rows = M.with_elements(records.select(F.col(record).alias("_r"), batch_id.alias("batch_id"), "ordinal"), "_r", "_e")
    e = F.col("_e")
    first = lambda c: M.first_text(e, ALIASES[c])
    scope = F.when(F.size(M.named(e, *APPLICANT_TAGS)) > 0, M.inside(e, *APPLICANT_TAGS)).otherwise(e)
    goods = F.nullif(X.summarise(F.array_join(M.texts(e, *GOODS_TAGS), " "), GOODS_LIMIT), F.lit(""))
    rows = rows.select(
        *[first(c).alias(c) for c in ("filing_id", "mark_text", "mark_type", "mark_category")],
        *[D.parse(first(c), *XML_DATES).alias(c) for c in ("filing_date", "publication_date")],
        M.first_text(scope, NAME_TAGS).alias("applicant_name"),
        M.first_text(scope, COUNTRY_TAGS).alias("applicant_country"),
        F.lit(None).cast("string").alias("applicant_region"),
        X.postcode_area(M.first_text(scope, POSTCODE_TAGS)).alias("applicant_postcode_area"),
        V.class_list(F.array_join(M.texts(e, *CLASS_TAGS), ",")).alias("nice_classes"),
        goods.alias("goods_text"),
        goods.isNotNull().alias("goods_text_available"),
        F.coalesce(first("series_count").try_cast("int"), F.lit(0)).alias("series_count"),
        first("status").alias("status"),
        "batch_id", F.lit(source_url).cast("string").alias("source_url"), F.lit(source_name).alias("source_name"), "ordinal",
    )
    return rows.where("filing_id is not null")


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-16 where the first file begins with its mark, else UTF-8. Only the beginning of a file is read."""
    begin = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("h")).first()
    return "UTF-16" if begin and begin["h"] in ("FFFE", "FEFF") else "UTF-8"


def read_filings_text(spark: SparkSession, path: str, batch_id: str, source_name: str = "open_data", encoding: str | None = None, case_url: str = "") -> DataFrame:
    """Filings of pipe-delimited text with a header; rows of fewer than five fields or without a number go, missing last fields are null."""
    lines = spark.read.option("encoding", encoding or encoding_of(spark, path)).option("sep", "\x00").option("quote", "").csv(path).select(F.col("_c0").alias("line"))
    header = lines.first()
    if header is None or "|" not in (header["line"] or ""):
        raise ValueError(f"{path} has no header of delimited columns")
    names = [c.strip().lstrip("\ufeff") for c in header["line"].split("|")]
    rows = lines.select(F.split("line", r"\|").alias("p"), F.monotonically_increasing_id().alias("ordinal")).where((F.size("p") >= 5) & (F.col("p")[0] != names[0]))
    field = lambda n: F.nullif(F.trim(F.get("p", F.lit(names.index(n)))), F.lit("")) if n in names else F.lit(None).cast("string")
    link = F.nullif(F.regexp_extract(X.text(field("Hyperlink")), r'(?i)HYPERLINK\("([^"]+)"', 1), F.lit(""))
    out = rows.select(
        field("Trade Mark").alias("filing_id"), field("Mark Text").alias("mark_text"), field("Mark Type").alias("mark_type"), field("Category of Mark").alias("mark_category"),
        D.parse(field("Filed"), *TEXT_DATES).alias("filing_date"), D.parse(field("Published"), *TEXT_DATES).alias("publication_date"),
        field("Name").alias("applicant_name"), field("Country").alias("applicant_country"), field("Region").alias("applicant_region"), field("Postcode").alias("applicant_postcode_area"),
        V.flags_to_classes([field(f"Class{i}") for i in range(1, 46)]).alias("nice_classes"),
        F.lit(None).cast("string").alias("goods_text"), F.lit(False).alias("goods_text_available"), F.coalesce(field("No of Marks in Series").try_cast("int"), F.lit(0)).alias("series_count"),
        field("Status").alias("status"), F.lit(batch_id).alias("batch_id"), F.coalesce(F.regexp_replace(link, "http://", "https://"), F.concat(F.lit(case_url), field("Trade Mark"))).alias("source_url"), F.lit(source_name).alias("source_name"), "ordinal",
    )
    return out.where("filing_id is not null")


READERS: dict[str, Callable[..., DataFrame]] = {"xml": read_filings_xml, "text": read_filings_text}


def read_filings(spark: SparkSession, parser: str, path: str, batch_id: str, **options) -> DataFrame:
    """Dispatch by the declared parser."""
    if parser not in READERS:
        raise ValueError(f"no parser {parser!r}; there are {sorted(READERS)}")
    return READERS[parser](spark, path, batch_id, **options)


def at_least_one(df: DataFrame, what: str) -> DataFrame:
    """The rows; none at all is an error."""
    if df.isEmpty():
        raise ValueError(f"no records in {what}")
    return df


def unzip(spark: SparkSession, path: str, out: str, suffix: str = ".xml") -> None:
    """The first member with the suffix of each ZIP file, as text lines under `out` (a ZIP can't be split, so a task takes a file)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(suffix)), None)
                    if member:
                        with io.TextIOWrapper(z.open(member), "utf-8", errors="replace") as f:
                            while lines := f.readlines(1 << 20):
                                yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in lines]})

    spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string").write.text(out)


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(path, batch_id, modified) of a folder's files, the id from YYYY-NNN or a date in the name."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    number = F.nullif(F.regexp_extract(name, r"(\d{4}-\d{3})(?!\d)", 1), F.lit(""))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return files.withColumn("batch_id", F.coalesce(number, D.batch_number(day))).where("batch_id is not null")


def latest_batch(batches: DataFrame) -> str | None:
    """The newest of `read_batches`."""
    row = batches.agg(F.max("batch_id")).first()
    return row[0]


def resolve_batch(batches: DataFrame, wanted: str | None = None) -> DataFrame:
    """The files of a batch, the newest where none is asked for; a batch that isn't there is an error."""
    batch = wanted or latest_batch(batches)
    found = batches.where(F.col("batch_id") == batch)
    return at_least_one(found, f"batch {batch}")


def complete_batches(snapshot: DataFrame, weeks: int, least: int = 100) -> DataFrame:
    """The latest publication dates with at least `least` rows."""
    return snapshot.groupBy("publication_date").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("publication_date")).limit(weeks)


def slice_snapshot(snapshot: DataFrame, dates: list, out: str) -> None:
    """The rows of the dates, a folder for each date."""
    snapshot.where(F.col("publication_date").isin(dates)).withColumn("published", F.col("publication_date")).write.mode("overwrite").partitionBy("published").parquet(out)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Companies of the register's CSV: trimmed headers, a name and a number required, SIC codes before ` - `, a key of the name."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    field = lambda n: F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) if n in raw.columns else F.lit(None).cast("string")
    sic = F.filter(F.array(*[F.trim(F.split(X.text(field(f"SICCode.SicText_{i}")), " - ")[0]) for i in range(1, 5)]), lambda c: c != "")
    rows = raw.select(
        X.name_key(field("CompanyName")).alias("name_key"), field("CompanyName").alias("company_name"), field("CompanyNumber").alias("company_number"), field("CompanyStatus").alias("company_status"), field("CompanyCategory").alias("company_category"),
        D.parse(field("IncorporationDate"), *REGISTER_DATES).alias("incorporation_date"), D.parse(field("DissolutionDate"), *REGISTER_DATES).alias("dissolution_date"), sic.alias("sic_codes"),
        field("RegAddress.County").alias("region"), field("RegAddress.PostTown").alias("post_town"), field("RegAddress.Country").alias("country"), field("Accounts.AccountCategory").alias("accounts_category"),
    )
    return rows.where("company_name is not null and company_number is not null")


def read_register_json(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a JSON array."""
    raw = spark.read.schema("company_name string, company_number string, company_status string, incorporation_date string, sic_codes array<string>").option("multiLine", True).json(path)
    return raw.withColumns({"incorporation_date": D.parse(F.col("incorporation_date"), *REGISTER_DATES), "name_key": X.name_key("company_name")})


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, title, url, snippet) of a JSON map from query to results, in one file."""
    whole = spark.read.option("wholetext", True).text(path)
    found = F.from_json("value", "map<string, array<struct<title:string, url:string, snippet:string>>>")
    entry = whole.select(F.explode(found).alias("query", "results"))
    return entry.select("query", F.posexplode("results").alias("i", "x")).select("query", (F.col("i") + 1).alias("rank"), "x.*")


def evidence_containing(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each query the results of the first recorded one that holds it or that it holds: a fixture's loose lookup."""
    from ..operators.relational import contained, top_k

    a, b = queries.withColumn("q", X.normalise("query")), evidence.select(F.col("query").alias("recorded")).distinct().withColumn("r", X.normalise("recorded"))
    within = contained(a, b, F.col("q"), F.col("r")).select("query", "recorded")
    around = contained(b, a, F.col("r"), F.col("q")).select("query", "recorded")
    return top_k(within.unionByName(around).distinct(), ["query"], 1, "recorded").join(evidence.withColumnRenamed("query", "recorded"), "recorded")


def read_leads(spark: SparkSession, path: str, intents: tuple[str, ...]) -> DataFrame:
    """A delivered CSV, older ones with fewer columns too: an intent column that is absent is UNKNOWN, not NONE."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    return raw.withColumns({i: F.coalesce(F.col(i), F.lit("NONE")) if i in raw.columns else F.lit("UNKNOWN") for i in intents} | {"score": F.col("score").try_cast("int")})


def stored_opportunities(stored: DataFrame, batch_id: str | None = None, limit: int = 500) -> DataFrame:
    """Deliverable stored rows, best first; the limit is the listing's."""
    rows = stored.where(~F.col("suppressed"))
    return (rows.where(F.col("batch_id") == batch_id) if batch_id else rows).orderBy(F.desc("score"), F.desc("batch_id"), "opportunity_key").limit(limit)


#: Columns of a stored opportunity that hold JSON, and their types.
STORED_JSON = {"reasons": "array<struct<key:string,text:string,weight:int>>", "related": "array<string>", "evidence_urls": "array<string>", "intent": "map<string,string>"}


def rehydrated(stored: DataFrame, batch_id: str) -> DataFrame:
    """A stored run's opportunities as they were scored, JSON columns decoded. What was not stored (goods, candidates) stays lost."""
    rows = stored.where(F.col("batch_id") == batch_id)
    return rows.withColumns({c: F.from_json(c, t) for c, t in STORED_JSON.items() if c in stored.columns and stored.schema[c].dataType.typeName() == "string"})


def first_available(*sources: Callable[[], DataFrame | None]) -> DataFrame:
    """The first source that has rows: an explicit file, the store, the newest file, a study's."""
    for source in sources:
        found = source()
        if found is not None and not found.isEmpty():
            return found
    raise ValueError("no source has rows")


def read_prospects(spark: SparkSession, path: str) -> DataFrame:
    """The research CSV; a mark at its beginning is skipped, missing columns are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    names = [x.split()[0] for x in schemas.PROSPECT.split(", ")]
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names])


def read_feedback(spark: SparkSession, path: str, states: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Valid rows of one sheet, and the others with what is wrong and their line; rows without a state are skipped.

    Lines are counted by one task, as a sheet is small; a header is the first.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path).coalesce(1).withColumn("row", F.monotonically_increasing_id() + 2)
    rows = raw.withColumn("state", F.upper(F.trim("state"))).where("state <> ''")
    known = F.col("state").isin(*states)
    return rows.where(known), rows.where(~known).withColumn("problem", F.concat(F.lit("unknown state "), "state"))


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def valid_payloads(spark: SparkSession, path: str, least: int = 100_000) -> DataFrame:
    """Files with whether they look like a published extract: an XML head and enough bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", (F.col("length") >= least).alias("long_enough"), (F.substring("content", 1, 5) == F.lit(b"<?xml")).alias("is_xml"))


def without_images(c: Column, tags: tuple[str, ...] = ("MarkImageBinary", "ImageData", "BinaryImage")) -> Column:
    """An XML text without embedded pictures."""
    for t in tags:
        c = F.regexp_replace(c, rf"(?s)<(?:\w+:)?{t}[\s>].*?</(?:\w+:)?{t}>", "")
    return c


def element_counts(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """How often each element occurs, the most frequent first."""
    names = F.regexp_extract_all("value", F.lit(r"<([A-Za-z][\w:]*)"), F.lit(1))
    return spark.read.text(path).select(F.explode(names).alias("element")).groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(most)
