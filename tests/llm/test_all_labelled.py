"""Classifiers are fitted on all labelled rows, part by part."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity


def by_sample_order(spark, n, fold=5, held_out=0):
    """Ids whose fold is trained on, in the order by which a sample was taken."""
    ids = spark.range(n).where(f"pmod(crc32(cast(cast(id AS string) AS binary)), {fold}) <> {held_out}").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id")
    return [r["id"] for r in ids.collect()]


def test_toxicity_learns_from_rows_beyond_any_sample(spark):
    rng = random.Random(3)
    ids = by_sample_order(spark, 8500)
    assert len(ids) > 6500
    late = set(ids[6000:])  # only these rows are ever toxic
    fill = lambda: " ".join(f"w{rng.randrange(200)}" for _ in range(6))
    rows = [(i, fill() + (" vequxo" if i in late and k % 2 else ""), int(i in late and k % 2)) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    fresh = [fill() for _ in range(200)]
    assert (net.scores(pa.array([t + " vequxo" for t in fresh])) >= 0.5).mean() > 0.95
    assert (net.scores(pa.array(fresh)) >= 0.5).mean() < 0.05


def test_parts_give_one_network_however_the_tables_lie(spark):
    rng = random.Random(4)
    make = lambda bad: " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + ["lowei" + rng.choice(["ab", "ent", "xo"]) for _ in range(3 * bad)])
    ids = by_sample_order(spark, 900)
    texts, y = [make(k % 2) for k in range(len(ids))], np.arange(len(ids)) % 2
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(None, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids, y.tolist(), strict=True)) + [(None, 1), (ids[0], None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, part_rows=200)
    again = toxicity.fit(docs.unionByName(docs).repartition(7), labels.repartition(3), part_rows=200)
    for a, b in zip((net.known, net.table, *net.filters, net.out, net.thresholds), (again.known, again.table, *again.filters, again.out, again.thresholds), strict=True):
        np.testing.assert_array_equal(a, b)
    np.testing.assert_array_equal(net.known, toxicity.train(texts, y).known)
    fresh = [make(k % 2) for k in range(200)]
    assert ((net.scores(pa.array(fresh)) >= 0.5) == np.arange(200) % 2).mean() > 0.95


def test_thresholds_from_counted_cells_have_the_least_errors():
    rng = np.random.default_rng(5)
    lang = rng.integers(0, 3, 3000)
    y = rng.integers(0, 2, 3000)
    z = rng.normal(y * 2 + lang, 1.0)
    halves = [toxicity._cells(z[a], y[a], lang[a]) for a in (slice(0, 1000), slice(1000, 3000))]
    got = toxicity._thresholds(*toxicity._added(halves))
    cell = lambda x: np.floor(x / toxicity.CELL)
    borders = np.unique(cell(z)) * toxicity.CELL
    wrong = lambda cut: ((z >= cut) != (y == 1)).sum()
    whole = got[4]  # no text has this language: the cut of all
    assert wrong(whole) == min(wrong(c) for c in borders)
    assert np.all(np.diff(got[:3]) > 0)


def test_quality_learns_from_rows_beyond_any_sample(spark):
    rng = random.Random(6)
    ids = by_sample_order(spark, 9000, 4, 2)
    assert len(ids) > 6500
    late = set(ids[6000:])  # only these rows are ever bad
    good = lambda: " ".join(rng.choice(["plain", "words", "of", "prose", "here"]) for _ in range(rng.randint(20, 60))) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "BUY", "##", "NOW!!", "x"]) for _ in range(rng.randint(20, 60)))
    rows = [(i, bad() if i in late and k % 2 else good(), int(not (i in late and k % 2))) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert (model.scores(pa.array([good() for _ in range(200)])) >= quality.CUT).mean() > 0.95
    assert (model.scores(pa.array([bad() for _ in range(200)])) >= quality.CUT).mean() < 0.05


def test_quality_parts_give_one_ranking_however_the_tables_lie(spark):
    rng = random.Random(7)
    make = lambda k: " ".join(rng.choice(["plain", "words", "of", "prose"] if rng.random() < 0.3 + 0.4 * k else ["$$$", "BUY", "x", "9"]) for _ in range(rng.randint(20, 60)))
    ids = by_sample_order(spark, 1200, 4, 2)
    texts, y = [make(k % 2) for k in range(len(ids))], np.arange(len(ids)) % 2
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(None, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids, y.tolist(), strict=True)) + [(None, 1), (ids[0], None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, part_rows=200)
    again = quality.fit(docs.unionByName(docs).repartition(7), labels.repartition(3), part_rows=200)
    for a, b in ((model.edges, again.edges), (model.weights, again.weights), (model.threshold, again.threshold)):
        np.testing.assert_array_equal(a, b)
    whole = quality.train(texts, y)  # one part, exact quantiles
    np.testing.assert_allclose(model.edges, whole.edges, rtol=2**-9)
    fresh, want = [make(k % 2) for k in range(400)], np.arange(400) % 2
    right = [((m.scores(pa.array(fresh)) >= quality.CUT) == want).mean() for m in (model, whole)]
    assert right[0] > 0.95 and right[0] > right[1] - 0.03
