"""Rules from JSON files: checked against a shape, given a version, and compiled to columns or join tables.

A rulebook has three sections, each a JSON object; keys that begin with `_` are comments.

scoring     base, bands, caps, most_scale, and indicators of key, weight, text and kind (core, age or web)
intent      suppliers in order, a default band of each, bands by group and moves by launch stage
prospects   points by category, signals of key, weight, fields and any_of, bands, and words that rule a prospect out

The version is a hash of the rules without comments and layout, so equal rules have equal versions wherever they were read. A
store keeps every version that was in use, so that rows can be scored by an older one again (`rescore`).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R
from .functions import text as X
from .functions.values import BANDS, shifted
from .operators import sales
from .operators import scoring as S
from .session import run_dir

#: What each section holds: a type, [shape] for a list, {str: shape} for a map, {name: shape} for named fields; a name with ? may be missing.
SHAPES = {
    "scoring": {"base": int, "bands": {str: int}, "caps": {str: int}, "most_scale": float, "indicators": [{"key": str, "weight": int, "text": str, "kind?": str}]},
    "intent": {"suppliers": [str], "default": {str: str}, "groups": {str: {str: str}}, "stages": {str: {str: int}}},
    "prospects": {"categories": {str: int}, "signals": [{"key": str, "weight": int, "fields": [str], "any_of": [str]}], "bands": {str: int}, "ruled_out": [str], "ruled_out_fields": [str]},
}
KINDS = ("core", "age", "web")
#: What an indicator's text may name.
FACTS = ("age_phrase", "age", "category", "marks", "n_classes", "confidence", "website", "launch", "sic")


class BadRules(ValueError):
    """Rules that don't have their shape; `problems` names each place."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def without_comments(value):
    if isinstance(value, dict):
        return {k: without_comments(v) for k, v in value.items() if not k.startswith("_")}
    return [without_comments(v) for v in value] if isinstance(value, list) else value


def shape_problems(value, shape, at: str) -> list[str]:
    """Where a value departs from a shape."""
    if isinstance(shape, list):
        if not isinstance(value, list):
            return [f"{at}: a list is wanted"]
        return [p for i, v in enumerate(value) for p in shape_problems(v, shape[0], f"{at}[{i}]")]
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{at}: an object is wanted"]
        if str in shape:
            return [p for k, v in value.items() for p in shape_problems(v, shape[str], f"{at}.{k}")]
        known = {k.rstrip("?"): (s, k.endswith("?")) for k, s in shape.items()}
        found = [f"{at}.{k}: is missing" for k, (_, may) in known.items() if k not in value and not may]
        found += [f"{at}.{k}: is not known" for k in value if k not in known]
        return found + [p for k, v in value.items() if k in known for p in shape_problems(v, known[k][0], f"{at}.{k}")]
    right = isinstance(value, (int, float) if shape is float else shape) and not isinstance(value, bool)
    return [] if right else [f"{at}: {shape.__name__} is wanted, not {value!r}"]


def meaning_problems(d: dict) -> list[str]:
    """What has its shape but can't be meant: repeated keys, unknown names, texts with facts that don't exist."""
    out, (s, i, p) = [], (d["scoring"], d["intent"], d["prospects"])
    for at, rows in (("scoring.indicators", s["indicators"]), ("prospects.signals", p["signals"])):
        keys = [x["key"] for x in rows]
        out += [f"{at}: {k} is there more than once" for k in sorted({k for k in keys if keys.count(k) > 1})]
    out += [f"scoring.indicators.{x['key']}: kind {x['kind']} is not known" for x in s["indicators"] if x.get("kind", "core") not in KINDS]
    out += [f"scoring.indicators.{x['key']}: no fact is named {f}" for x in s["indicators"] for f in re.findall(r"\{(\w+)\}", x["text"]) if f not in FACTS]
    out += [f"{at}.bands: none" for at, x in (("scoring", s), ("prospects", p)) if not x["bands"]]
    out += [f"prospects.signals.{x['key']}: no words" for x in p["signals"] if not x["any_of"]]
    out += [f"intent.suppliers: {k} is there more than once" for k in sorted({k for k in i["suppliers"] if i["suppliers"].count(k) > 1})]
    out += [f"intent.default: {k} has no band" for k in i["suppliers"] if k not in i["default"]]
    for at, bands in (("default", i["default"]), *(("groups." + g, b) for g, b in i["groups"].items())):
        out += [f"intent.{at}.{k}: {v} is no band" for k, v in bands.items() if v not in BANDS]
    for at, named in (("default", i["default"]), *(("groups." + g, b) for g, b in i["groups"].items()), *(("stages." + g, b) for g, b in i["stages"].items())):
        out += [f"intent.{at}: no supplier is named {k}" for k in named if k not in i["suppliers"]]
    return out


@dataclass(frozen=True)
class Rulebook:
    """Rules that passed `checked`, as plain data."""

    sections: str

    @cached_property
    def data(self) -> dict:
        return json.loads(self.sections)

    @property
    def version(self) -> str:
        return hashlib.sha256(self.sections.encode()).hexdigest()[:16]

    @cached_property
    def indicators(self) -> tuple[R.Indicator, ...]:
        return tuple(R.Indicator(x["key"], x["weight"], x["text"], x.get("kind", "core")) for x in self.data["scoring"]["indicators"])

    def scale(self, looked_for_web: bool) -> float:
        """By how much positive weights grow where web evidence was not looked for; of the age indicators the best counts."""
        up = [x for x in self.indicators if x.weight > 0]
        full = max([x.weight for x in up if x.kind == "age"], default=0) + sum(x.weight for x in up if x.kind != "age")
        had = full - (0 if looked_for_web else sum(x.weight for x in up if x.kind == "web"))
        return min(float(self.data["scoring"]["most_scale"]), full / had) if had else 1.0

    def band(self, score: Column) -> Column:
        """The highest band that the score reaches; below all of them the last. A null score has no band."""
        return _band(score, self.data["scoring"]["bands"])

    def scored(self, rows: DataFrame, conditions: dict[str, Column], facts: dict[str, Column], looked_for_web: bool, caps: dict[str, Column] | None = None) -> DataFrame:
        """Add reasons, score, cap, band and rules_version. conditions: when an indicator fires; one without a condition never does.
        caps: when a cap of the rules applies, in the rules' order."""
        rows = rows.withColumn("reasons", S.fired(conditions, facts, self.scale(looked_for_web), self.indicators))
        limits = [(k, (caps or {})[k], most) for k, most in self.data["scoring"]["caps"].items() if k in (caps or {})]
        score, cap = S.capped(S.total(F.col("reasons"), self.data["scoring"]["base"]), limits)
        return rows.withColumns({"score": score, "cap": cap}).withColumns({"band": self.band(F.col("score")), "rules_version": F.lit(self.version)})

    def intent_table(self, spark: SparkSession) -> DataFrame:
        """(group, stage, intents): one row for each pair that the rules name, and null for any other group or stage."""
        i, rows = self.data["intent"], []
        for group in (None, *i["groups"]):
            for stage in (None, *i["stages"]):
                own, moves = {**i["default"], **i["groups"].get(group, {})}, i["stages"].get(stage, {})
                rows += [(group, stage, n, k, own[k], moves.get(k, 0)) for n, k in enumerate(i["suppliers"])]
        each = spark.createDataFrame(rows, "group string, stage string, n int, supplier string, own string, by int").withColumn("band", shifted(F.col("own"), F.col("by")))
        listed = F.array_sort(F.collect_list(F.struct("n", "supplier", "band")))  # as many as there are suppliers
        return each.groupBy("group", "stage").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["supplier"], x["band"]))).alias("intents"))

    def with_intents(self, rows: DataFrame, group: str, stage: str, name: str = "intents") -> DataFrame:
        """Add the band of each supplier. A join on the pair with a table as large as the rules, whatever the rows."""
        named = lambda c, known: F.when(F.col(c).isin(*known), F.col(c)) if known else F.lit(None).cast("string")
        table = self.intent_table(rows.sparkSession).select(F.col("group").alias("_g"), F.col("stage").alias("_s"), F.col("intents").alias(name))
        on = named(group, self.data["intent"]["groups"]).eqNullSafe(F.col("_g")) & named(stage, self.data["intent"]["stages"]).eqNullSafe(F.col("_s"))
        return rows.drop(name).join(F.broadcast(table), on, "left").drop("_g", "_s")  # (groups + 1) x (stages + 1) rows of rules

    def prospects_scored(self, rows: DataFrame, category: str, suppressed: Column | None = None) -> DataFrame:
        """Add fit (0 to 100), fit_band and signals (key, weight, matched word, in the rules' order).

        A signal counts once, by its first word in its fields; fields that the rows lack are empty. A prospect that is
        `suppressed` or holds a word that rules it out has fit 0, no signals and the band SUPPRESS, as one below all bands.
        """
        p = self.data["prospects"]
        words = lambda fields: X.searchable(*[F.col(c) for c in fields if c in rows.columns]) if set(fields) & set(rows.columns) else F.lit("")
        own = F.coalesce(*[F.when(F.col(category) == k, n) for k, n in p["categories"].items()], F.lit(0))
        found = [F.when(own != 0, F.struct(F.lit("category").alias("key"), own.alias("weight"), F.col(category).alias("matched")))]
        for x in p["signals"]:
            hit = X.first_of(tuple(w.lower() for w in x["any_of"]), words(x["fields"]))
            found.append(F.when(hit.isNotNull(), F.struct(F.lit(x["key"]).alias("key"), F.lit(x["weight"]).alias("weight"), hit.alias("matched"))))
        out = F.coalesce(suppressed, F.lit(False)) if suppressed is not None else F.lit(False)
        if p["ruled_out"]:
            out = out | X.first_of(tuple(w.lower() for w in p["ruled_out"]), words(p["ruled_out_fields"])).isNotNull()
        rows = rows.withColumn("_out", out)
        signals = F.array_compact(F.array(*found))
        rows = rows.withColumn("signals", F.when(F.col("_out"), F.slice(signals, 1, 0)).otherwise(signals))
        rows = rows.withColumn("fit", S.total(F.col("signals"), 0))
        bands = F.coalesce(*[F.when(F.col("fit") >= low, k) for k, low in _falling(p["bands"])], F.lit("SUPPRESS"))
        return rows.withColumn("fit_band", F.when(F.col("_out"), "SUPPRESS").otherwise(bands)).drop("_out")


def _falling(bands: dict[str, int]) -> list[tuple[str, int]]:
    return sorted(bands.items(), key=lambda x: -x[1])


def _band(score: Column, bands: dict[str, int]) -> Column:
    falling = _falling(bands)
    return F.when(score.isNotNull(), F.coalesce(*[F.when(score >= low, k) for k, low in falling], F.lit(falling[-1][0])))


def checked(sections: dict) -> Rulebook:
    """A rulebook of the three sections; raises `BadRules` with all that is wrong."""
    sections = without_comments(sections)
    found = shape_problems(sections, SHAPES, "rules") or meaning_problems(sections)
    if found:
        raise BadRules(found)
    # caps, groups and bands keep the order in which they were written, as it has a meaning: so keys aren't sorted
    return Rulebook(json.dumps(sections, ensure_ascii=False))


def read(spark: SparkSession, folder: str) -> Rulebook:
    """The rulebook of a folder's scoring.json, intent.json and prospects.json, on any file system that Spark reads."""
    files = [f"{folder.rstrip('/')}/{name}.json" for name in SHAPES]
    texts = {r["name"]: r["value"] for r in spark.read.text(files, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), "value").collect()}
    try:
        return checked({name: json.loads(texts[name]) for name in SHAPES})
    except json.JSONDecodeError as e:
        raise BadRules([f"{folder}: {e}"]) from e


def shipped() -> Rulebook:
    """The rules of `tidemark.rules` as a rulebook; prospect signals are those of `sales`."""
    return checked({
        "scoring": {
            "base": R.BASE, "bands": {name: low for low, name in R.BANDS}, "caps": dict(R.CAPS), "most_scale": R.MOST_SCALE,
            "indicators": [{"key": x.key, "weight": x.weight, "text": x.text, "kind": x.kind} for x in R.LAUNCH_INDICATORS],
        },
        "intent": {"suppliers": list(R.SUPPLIERS), "default": dict(R.INTENT_DEFAULT), "groups": R.INTENT_GROUP, "stages": R.INTENT_SHIFT},
        "prospects": {
            "categories": dict(sales.PROSPECT_CATEGORY), "bands": {"A": 55, "B": 38, "C": 15}, "ruled_out": list(sales.RULED_OUT), "ruled_out_fields": ["words"],
            "signals": [{"key": marks[0], "weight": points, "fields": ["words"], "any_of": list(marks)} for marks, points in sales.PROSPECT_SIGNALS],
        },
    })


def keep(spark: SparkSession, book: Rulebook, store: str) -> str:
    """Add a rulebook to the store of all versions and give its version. Versions are named by their content, so a second
    writer of one can only add an equal row, which `version` reads as one."""
    if book.version not in {r["version"] for r in versions(spark, store).select("version").collect()}:
        spark.createDataFrame([(book.version, book.sections)], "version string, sections string").withColumn("kept_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(store)
    return book.version


def versions(spark: SparkSession, store: str) -> DataFrame:
    """(version, sections, kept_at) of the store, a version once, by when it was first kept; none if there is no store yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "version string, sections string, kept_at timestamp")
    rows = spark.read.schema("version string, sections string, kept_at timestamp").parquet(store)
    return rows.groupBy("version").agg(F.min_by("sections", "kept_at").alias("sections"), F.min("kept_at").alias("kept_at"))


def version(spark: SparkSession, store: str, wanted: str) -> Rulebook:
    found = versions(spark, store).where(F.col("version") == wanted).select("sections").collect()
    if not found:
        raise KeyError(f"no rules of version {wanted} in {store}")
    return checked(json.loads(found[0]["sections"]))


def rescore(rows: DataFrame, before: Rulebook, after: Rulebook, score: Callable[[DataFrame, Rulebook], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Score the same rows by two versions. Gives the rows of the later one with the earlier score and band beside them, and how
    many went from each band to each other. The rows are read once and both scores are taken of them side by side, without a
    join, and are written once for both results. `score` adds score and band."""
    was = score(rows, before).select(*rows.columns, F.col("score").alias("was_score"), F.col("band").alias("was_band"))
    both = score(was, after)
    path = run_dir(rows.sparkSession, "rescored")
    both.write.parquet(path)
    both = rows.sparkSession.read.schema(both.schema).parquet(path)
    return both, both.groupBy(F.col("was_band").alias("was"), F.col("band").alias("is")).agg(F.count("*").alias("n"))
