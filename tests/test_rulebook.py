"""Rules from files: shapes, versions, and results equal to the rules in code."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tidemark import rulebook as B
from tidemark import rules as R
from tidemark.operators import sales
from tidemark.operators import scoring as S


def sections(**changes):
    found = json.loads(B.shipped().sections)
    for path, value in changes.items():
        at = found
        *way, last = path.split("__")
        for name in way:
            at = at[name]
        at[last] = value
    return found


def written(tmp_path, found, name="rules"):
    folder = tmp_path / name
    folder.mkdir()
    for section, value in found.items():
        (folder / f"{section}.json").write_text(json.dumps(value, indent=3), "utf-8")
    return str(folder)


def test_files_give_the_version_of_what_they_mean(spark, tmp_path):
    found = sections()
    found["scoring"]["_note"] = "not a rule"
    found["scoring"]["indicators"][0]["_why"] = {"any": ["thing"]}
    found["prospects"]["signals"][0]["any_of"].append("café")
    plain = copy.deepcopy(found)
    del plain["scoring"]["_note"], plain["scoring"]["indicators"][0]["_why"]
    book = B.read(spark, written(tmp_path, found))
    assert book == B.checked(plain) and book.version == B.checked(plain).version != B.shipped().version
    assert book.data["prospects"]["signals"][0]["any_of"][-1] == "café"


@pytest.mark.parametrize(
    ("change", "place"),
    [
        ({"scoring__base": "25"}, "rules.scoring.base"),
        ({"scoring__base": True}, "rules.scoring.base"),
        ({"scoring__more": 1}, "rules.scoring.more: is not known"),
        ({"scoring__indicators": [{"key": "a", "weight": 1}]}, "rules.scoring.indicators[0].text: is missing"),
        ({"scoring__indicators": [{"key": "a", "weight": 1, "text": "x"}] * 2}, "a is there more than once"),
        ({"scoring__indicators": [{"key": "a", "weight": 1, "text": "x {agee}"}]}, "no fact is named agee"),
        ({"scoring__indicators": [{"key": "a", "weight": 1, "text": "x", "kind": "odd"}]}, "kind odd"),
        ({"intent__default__labels": "SOME"}, "intent.default.labels: SOME is no band"),
        ({"intent__groups__bakery": {"nobody": "HIGH"}}, "no supplier is named nobody"),
        ({"intent__default": {}}, "labels has no band"),
        ({"prospects__signals": [{"key": "a", "weight": 1, "fields": ["words"], "any_of": []}]}, "no words"),
        ({"prospects__bands": {}}, "prospects.bands: none"),
        ({"intent": []}, "rules.intent: an object is wanted"),
    ],
)
def test_bad_rules_name_the_place(change, place):
    with pytest.raises(B.BadRules) as e:
        B.checked(sections(**change))
    assert any(place in p for p in e.value.problems)


def test_broken_json_is_bad_rules(spark, tmp_path):
    folder = written(tmp_path, sections())
    (tmp_path / "rules" / "intent.json").write_text("{", "utf-8")
    with pytest.raises(B.BadRules):
        B.read(spark, folder)


def test_shipped_intents_equal_the_compiled_case(spark):
    groups, stages = [None, "", "odd", *R.INTENT_GROUP], [None, "odd", *R.INTENT_SHIFT]
    rows = spark.createDataFrame([(g, s) for g in groups for s in stages], "g string, s string")
    got = B.shipped().with_intents(rows.withColumn("case", S.intent(F.col("g"), F.col("s"))), "g", "s")
    got = got.withColumns({"keys": F.map_keys("intents"), "a": S.top_intents(F.col("intents"), 9), "b": S.top_intents(F.col("case"), 9)}).collect()
    assert len(got) == len(groups) * len(stages)
    assert all(r["intents"] == r["case"] and tuple(r["keys"]) == R.SUPPLIERS and r["a"] == r["b"] for r in got)


def test_shipped_scale_bands_and_prospects_equal_the_code(spark):
    book = B.shipped()
    assert [book.scale(x) for x in (True, False)] == [R.positive_scale(x) for x in (True, False)]
    rows = spark.range(-5, 106).withColumn("score", F.col("id").cast("int"))
    assert rows.where(~book.band(F.col("score")).eqNullSafe(S.band(F.col("score")))).count() == 0
    assert spark.range(1).select(book.band(F.lit(None).cast("int")).alias("b")).first()["b"] is None
    texts = [None, "", "food and low minimum in the uk", "gambling food", "emerging brand, small batch", "enterprise"]
    rows = spark.createDataFrame([(c, t) for c in (None, "odd", "packaging", "logistics") for t in texts], "category string, words string")
    got = book.prospects_scored(rows.withColumn("code", sales.prospect_fit(F.col("category"), F.coalesce("words", F.lit("")))), "category").collect()
    assert all(r["fit"] == r["code"] for r in got) and len(got) == 24
    one = next(r for r in got if r["category"] == "packaging" and r["words"] == texts[2])
    assert [tuple(s) for s in one["signals"]] == [("category", 30, "packaging"), ("food", 12, "food"), ("low minimum", 10, "low minimum"), ("uk", 6, "uk")]
    assert one["fit_band"] == "A" and {r["fit_band"] for r in got if r["words"] == "gambling food"} == {"SUPPRESS"}


def test_suppressed_prospects_and_missing_fields(spark):
    book = B.checked(sections(prospects__signals=[{"key": "a", "weight": 40, "fields": ["words", "notes"], "any_of": ["Food"]}]))
    rows = spark.createDataFrame([("FOOD", True), ("FOOD", False), ("FOOD", None), (None, False)], "words string, gone boolean").withColumn("category", F.lit(None).cast("string"))
    got = book.prospects_scored(rows, "category", F.col("gone")).select("fit", "fit_band").collect()
    assert [tuple(r) for r in got] == [(0, "SUPPRESS"), (40, "B"), (40, "B"), (0, "SUPPRESS")]


def score(rows, book):
    conditions = {"word_mark": F.col("word"), "many_classes": F.col("n") >= 8, "no_company_match": F.col("n") == 0, "active_launch_signals": F.col("word")}
    return book.scored(rows, conditions, {"n_classes": F.col("n"), "launch": F.lit("soon")}, True, {"no_company": F.col("n") == 0})


def test_two_versions_give_a_rescore_diff(spark, tmp_path):
    old, found = B.shipped(), sections(scoring__base=72, scoring__bands={"HIGH": 80, "MEDIUM": 60, "SUPPRESS": 0}, scoring__caps={"no_company": 50})
    next(x for x in found["scoring"]["indicators"] if x["key"] == "many_classes")["weight"] = -20
    new, store = B.checked(found), str(tmp_path / "store")
    assert B.keep(spark, old, store) == B.keep(spark, old, store) and B.keep(spark, new, store) != old.version
    assert B.versions(spark, store).count() == 2 and B.version(spark, store, old.version) == old
    with pytest.raises(KeyError):
        B.version(spark, store, "none")
    rows = spark.createDataFrame([(i, i % 2 == 0, i % 10) for i in range(40)], "id int, word boolean, n int")
    both, moved = B.rescore(rows, B.version(spark, store, old.version), B.version(spark, store, new.version), score)

    def by_hand(word, n, base, many, cap):
        s = base + (8 if word else 0) + (many if n >= 8 else 0) + (-15 if n == 0 else 0)
        s = min(s, cap) if n == 0 else s
        return s, "HIGH" if s >= 80 else "MEDIUM" if s >= 60 else "SUPPRESS"

    want = {}
    for r in both.collect():
        was, now = by_hand(r["word"], r["n"], 25, -8, 74), by_hand(r["word"], r["n"], 72, -20, 50)
        assert (r["was_score"], r["was_band"], r["score"], r["band"], r["rules_version"]) == (*was, *now, new.version)
        want[was[1], now[1]] = want.get((was[1], now[1]), 0) + 1
    assert {(r["was"], r["is"]): r["n"] for r in moved.collect()} == want and len(want) == 3


def test_rescoring_joins_nothing(spark):
    rows = spark.createDataFrame([(1, True, 3)], "id int, word boolean, n int")
    both = score(score(rows, B.shipped()).select("id", "word", "n", F.col("score").alias("was_score")), B.shipped())
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
