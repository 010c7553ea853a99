from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.operators import prospects, sales


def test_sample_and_preview_drops_in_order(spark):
    d = date(2025, 6, 1)
    rows = [(1, "HIGH", "g", None, d, d, "HIGH", "a", False), (2, "LOW", "", None, None, None, "NONE", "b", True), (3, "HIGH", " ", None, d, None, "HIGH", "a", False), (4, "MEDIUM", "g", "CONFLICTING", d, date(2024, 1, 1), "HIGH", "a", False), (5, "HIGH", "g", None, d, d, "LOW", "a", False), (6, "HIGH", "g", None, d, d, "HIGH", "z", None)]
    df = spark.createDataFrame(rows, "id int, band string, goods string, site string, inc date, filed date, rel string, cat string, contacted boolean")
    c = F.col
    sample = rel.first_reason(sales.sample_rules(c("band"), c("goods"), c("site"), c("inc")))
    assert {r[0]: r[1] for r in df.select("id", sample).collect()} == {1: None, 2: "low_band", 3: "no_goods", 4: "conflicting_website", 5: None, 6: None}
    preview = rel.first_reason(sales.preview_rules(F.lit(d), c("filed"), c("rel"), F.lit("MEDIUM"), c("band"), c("cat"), F.array(F.lit("a")), c("contacted")))
    assert {r[0]: r[1] for r in df.select("id", preview).collect()} == {1: None, 2: "already_contacted", 3: "no_date", 4: "too_old", 5: "not_relevant", 6: "other_category"}


def test_due_actions(spark):
    t = date(2025, 6, 10)
    rows = [
        ("a", "EMAIL_1_SENT", "A", date(2025, 6, 3), None, None), ("b", "EMAIL_1_SENT", "A", date(2025, 6, 4), None, None), ("c", "SAMPLE_SENT", "B", None, date(2025, 5, 1), None), ("d", "REPLIED_INTERESTED", "C", None, None, None),
        ("e", "SUBSCRIBED", "A", None, None, None), ("f", "RESEARCHED", "B", None, None, None), ("g", "RESEARCHED", "SUPPRESS", None, None, None), ("h", "OFFER_SENT", "A", None, None, "POSITIVE"), ("i", "READY", "odd", None, None, None), ("j", "READY", "C", None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, status string, prio string, mail date, sample date, reply string")
    df = df.withColumn("action", prospects.due_action(F.col("status"), F.col("prio"), F.col("mail"), F.col("sample"), F.col("reply"), F.lit(t)))
    got = [(r["name"], r["action"]) for r in prospects.due_list(df, "action", "prio", "name").collect()]
    assert got == [("d", "SEND FULL SAMPLE"), ("c", "SEND SUBSCRIPTION OFFER"), ("h", "HANDLE REPLY"), ("a", "SEND FOLLOW-UP"), ("j", "SEND FIRST EMAIL"), ("i", "SEND FIRST EMAIL"), ("f", "FINISH RESEARCH")]


def test_states_that_may_follow(spark):
    pairs = [(a, b) for a in prospects.STATUSES for b in prospects.STATUSES]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("ok", prospects.transition_ok(F.col("a"), F.col("b"))).collect()
    assert all(r["ok"] == (r["a"] == r["b"] or r["b"] in prospects.FOLLOWS.get(r["a"], ())) for r in got)
    assert not spark.range(1).select(prospects.transition_ok(F.lit("OPTED_OUT"), F.lit("READY"))).first()[0]


def test_lists_audit_notes_and_names(spark):
    rows = [("1", "A", "READY", "x", 50, "Zed", "", "please VERIFY", "unknown"), ("2", "A", "READY", "x", 70, "Abe", "https://a.b", None, "phone"), ("3", "B", "OPTED_OUT", "y", 99, "Cy", None, "", "unknown")]
    df = spark.createDataFrame(rows, "prospect_id string, priority string, status string, supplier_category string, fit int, company_name string, website string, notes string, contact_route string").withColumn("verified_email", F.lit(None).cast("boolean"))
    assert [r["prospect_id"] for r in prospects.listing(df).collect()] == ["2", "1", "3"]
    assert [r["prospect_id"] for r in prospects.listing(df, category="y").collect()] == ["3"]
    assert tuple(prospects.audit(df).first()) == (2, 1, 1)
    names = spark.createDataFrame([("https://www.Oat.co.uk/shop", "The Oat & Group Co. Ltd (UK)"), (None, None)], "site string, name string")
    assert [tuple(r) for r in names.select(prospects.domain_of(F.col("site")), prospects.company_of(F.col("name"))).collect()] == [("oat.co.uk", "oat"), ("", "")]
    notes = spark.createDataFrame([(i, f"n{i}" if i % 2 else " ") for i in range(40)], "created_at int, note string")
    assert [r["note"] for r in prospects.latest_notes(notes).collect()] == [f"n{i}" for i in range(39, 15, -2)]


def test_feedback_finds_its_opportunity(spark):
    stored = spark.createDataFrame([("k1", "n1", "Oat", "b1", 1), ("k1", "n9", "Late", "b2", 2), ("k2", "n2", "Rye", "b1", 3)], "dedupe_key string, number string, brand string, batch_id string, ord int")
    feedback = spark.createDataFrame([(1, "k1", None), (2, None, "n2"), (3, "", "n2"), (4, None, "none"), (5, "gone", "n2")], "id int, dedupe_key string, number string")
    got = {r["id"]: (r["dedupe_key"], r["number"], r["brand"]) for r in prospects.with_opportunity(feedback, stored, "ord").collect()}
    assert got == {1: ("k1", "n1", "Oat"), 2: ("k2", "n2", "Rye"), 3: ("k2", "n2", "Rye"), 4: (None, "none", None), 5: ("gone", "n2", None)}


def test_supplier_fit_sums_wanted_intents(spark):
    leads = spark.createDataFrame([("a", {"packaging": "HIGH", "design": "LOW"}, 80), ("b", {"packaging": "NONE"}, 40)], "k string, intents map<string,string>, score int")
    wants = spark.createDataFrame([("s1", "packaging", 30), ("s1", "design", 10), ("s2", "logistics", 50)], "supplier string, intent string, weight int")
    got = {(r["k"], r["supplier"]): r["fit"] for r in sales.supplier_fit(leads, wants, "k", F.lit(2), F.lit(1), F.col("score")).collect()}
    assert got == {("a", "s1"): 15.8, ("b", "s1"): 4.4}


def test_diversified_has_no_cap(spark):
    df = spark.range(6000).select(F.col("id"), F.lit("g").alias("g"), F.concat(F.lit("c"), F.col("id") % 3000).alias("company"), F.concat(F.lit("k"), F.col("id") % 7).alias("category"))
    got = sorted((r["choice"], r["id"]) for r in sales.diversified(df, "g", "company", "category", ["id"], 9).collect())
    assert got == [(i + 1, i) for i in range(9)]


def test_rescore_revenue_operations(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "id int, band string")
    b = spark.createDataFrame([(1, "A"), (2, "A"), (4, "C")], "id int, band string")
    assert {(r["was"], r["is"]): r["n"] for r in sales.rescored(a, b, "id", "band").collect()} == {("A", "A"): 1, ("B", "A"): 1, ("B", None): 1, (None, "C"): 1}
    customers = spark.createDataFrame([("ACTIVE", "x"), ("ACTIVE", "odd"), ("PAST_DUE", "x")], "status string, plan string")
    prices = spark.createDataFrame([("x", 4900)], "plan string, pence int")
    assert tuple(sales.recurring_revenue(customers, prices).first()) == (2, 4900)
    assert tuple(sales.recurring_revenue(customers.limit(0), prices).first()) == (0, 0)
    runs = spark.createDataFrame([("r1", "COMPLETED", datetime(2025, 1, 1)), ("r2", "BLOCKED", datetime(2025, 1, 8))], "run_id string, status string, started_at timestamp")
    sent = spark.createDataFrame([("SENT",), ("FAILED",), ("SENT",)], "status string")
    assert tuple(sales.operations(runs, sent).first()) == (2, 1, 1, "r2", 2, 1)


def test_attribution_and_ratings(spark):
    customers = spark.createDataFrame([(1, "p1", "A@b.c"), (2, None, "d@e.f")], "customer_id int, provider_id string, email string")
    events = spark.createDataFrame([("e1", "p1", "d@e.f"), ("e2", "px", "D@E.F"), ("e3", None, None)], "id string, provider_id string, email string")
    assert {r["id"]: r["customer_id"] for r in sales.attributed_events(events, customers).collect()} == {"e1": 1, "e2": 2, "e3": None}
    rated = spark.createDataFrame([("k1", "BAD_FIT"), ("k1", "USEFUL")], "k string, state string")
    assert [r["k"] for r in sales.unrated(spark.createDataFrame([("k1",), ("k2",)], "k string"), rated, "k").collect()] == ["k2"]
    assert tuple(sales.false_positives(rated).first()) == (2, 1)


def test_prospect_fit_lines_terms_and_failures(spark):
    from tidemark.operators import goods, reports

    c = F.col
    rows = [("packaging", "short run packs for emerging brand food makers in the uk"), ("other", "enterprise only"), ("design", "tobacco packs"), (None, None)]
    df = spark.createDataFrame(rows, "category string, words string")
    assert [r[0] for r in df.select(sales.prospect_fit(c("category"), F.coalesce("words", F.lit("")))).collect()] == [78, 0, 0, 0]
    line = spark.range(1).select(sales.supplier_line(F.lit("packaging"), F.lit("HIGH"), F.lit("dairy")), sales.supplier_line(F.lit("x"), F.lit("LOW"), F.lit("y"))).first()
    assert tuple(line) == ("A dairy brand that is likely to need packaging", None)
    assert tuple(spark.range(1).select(sales.margin(F.lit(200), F.lit(50)), sales.margin(F.lit(0), F.lit(5))).first()) == (75.0, None)
    assert spark.range(1).select(goods.product_terms(F.lit("dairy"), F.lit("Milk & Cheeses"))).first()[0] == ["milk", "cheese", "yoghurt", "butter", "cheeses"]
    got = reports.stage_failures(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "s string, bad boolean"), c("s"), c("bad")).collect()
    assert {r["stage"]: r["fatal"] for r in got} == {"a": False, "b": True}
