"""Operators 1, 2 and 9: learned scores by held-out accuracy, spans by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
CASES = [None, "", " \n", "one", "word " * 50_000, "!!! ???", "日本語 ñandú"]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = label.sum()
    return (rank[label == 1].mean() - (n - 1) / 2) / (len(label) - n)


def held_out(spark, query, label, fold, kept):
    got = query(spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(got) == 10_000
    assert got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % fold == kept) for i in got.index[:500])
    both = got.join(labels, how="inner")
    both = both[both.held_out]
    return both.score.to_numpy(), both.predicted.to_numpy(), both[label].to_numpy()


def test_quality_on_held_out_rows(spark):
    score, predicted, label = held_out(spark, queries.op1_quality, "quality", 4, 2)
    assert auc(score, label) > 0.99
    assert (predicted == label).mean() > 0.98
    assert ((score >= 0.7) == predicted).all()


def test_toxicity_on_held_out_rows(spark):
    score, predicted, label = held_out(spark, queries.op9_toxicity, "toxic", 5, 0)
    assert auc(score, label) > 0.96
    assert predicted[label == 1].mean() > 0.85
    assert predicted[label == 0].mean() < 0.02


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_texts_and_tables(spark, module):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES + CASES)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "lang": F.lit("xx")})
    label = {"quality": "quality", "toxicity": "toxic"}[module.__name__.split(".")[-1]]
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    model = module.fit(df, labels)
    got = module.score(df, model).orderBy("doc_id").collect()
    assert [r["score"] for r in got[:7]] == [r["score"] for r in got[7:]]
    assert got[0]["score"] == got[1]["score"]
    assert all(0 <= r["score"] <= 1 for r in got)
    for empty in (labels.limit(0), labels.where(f"{label} = 1")):
        assert all(0 <= r["score"] <= 1 for r in module.score(df, module.fit(df, empty)).collect())
    assert module.score(df.limit(0), model).count() == 0


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["idiot", "the", "cat", "sat", "on"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    y = np.array([int("idiot" in t) for t in texts])
    for model in (toxicity.train(texts, y), quality.train(texts, y)):
        whole = model.scores(pa.array(texts))
        alone = np.concatenate([model.scores(pa.array([t])) for t in texts])
        np.testing.assert_allclose(whole, alone, atol=1e-6)


def test_network_learns_words_and_stems():
    rng = random.Random(2)
    stems = ["lowei", "vequ"]
    make = lambda bad: " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + [rng.choice(stems) + rng.choice(["ab", "ent", "xo", "ihr", "und"]) for _ in range(3 * bad)])
    y = np.array([i % 2 for i in range(400)])
    texts = [make(b) for b in y]
    net = toxicity.train(texts[:300], y[:300])
    assert ((net.scores(pa.array(texts[300:])) >= 0.5) == y[300:]).mean() > 0.95


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(4)
    real = lambda *shape: rng.normal(0, 0.5, shape)  # noqa: E731  double precision for the differences
    table = real(30, toxicity.DIM)
    table[0] = 0
    net = toxicity.Network(np.zeros(0, np.uint64), table, [real(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], [real(toxicity.FILTERS) for _ in toxicity.WIDTHS], real(toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1)
    rows, bounds, y, weight = rng.integers(0, 30, (40, 3)), np.array([0, 7, 8, 8, 25, 40]), np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 1])

    def loss():
        z = net.pooled(rows, bounds)[0].astype(float) @ net.out + net.out_bias
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    grads, by_bias = toxicity.gradients(net, rows, bounds, y, weight)
    for p, g in zip((net.table, *net.filters, *net.bias, net.out), grads, strict=True):
        for at in [tuple(int(rng.integers(n)) for n in p.shape) for _ in range(12)]:
            if p is net.table and at[0] == 0:
                continue  # the zero row stays
            was = p[at]
            p[at] = was + 1e-3
            up = loss()
            p[at] = was - 1e-3
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)
    net.out_bias += 1e-3
    up = loss()
    net.out_bias -= 2e-3
    assert by_bias == pytest.approx((up - loss()) / 2e-3, abs=2e-3)


def test_ranking_lowers_the_pair_loss_and_cuts_at_a_quantile():
    rng = random.Random(6)
    good = [" ".join(rng.choice(["plain", "words", "of", "prose", "here"]) for _ in range(rng.randint(20, 60))) + "." for _ in range(80)]
    bad = [" ".join(rng.choice(["$$$", "BUY", "##", "NOW!!", "x"]) for _ in range(rng.randint(20, 60))) for _ in range(40)] + good[:4]
    y = np.array([1] * 80 + [0] * 44)
    model = quality.train(good + bad, y)
    z = model.strengths(quality.features(pa.array(good + bad)))
    loss = lambda s: np.logaddexp(0, -(s[:80, None] - s[None, 80:])).mean()  # noqa: E731  over all pairs of a good and a bad text
    assert loss(z) < 0.2 < loss(np.zeros(len(z)))
    wrong = lambda cut: ((z >= cut) != (y == 1)).sum()
    assert wrong(model.threshold) == min(wrong(c) for c in [*z, *(z + 1e-9)])


def test_languages_are_told_from_the_text():
    words, bounds = toxicity.read_words(pa.array(["the cat is on the mat and", "der Hund und die Katze", "le chat est dans la", "el perro y los gatos", "zzz"]))
    assert [toxicity.LANGUAGES[i] for i in toxicity.languages(words, bounds)] == ["en", "de", "fr", "es", ""]


def spans_by_hand(t):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    out = [(m.start(), m.end(), 0) for m in email.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    alphabet = "0123456789" * 3 + "....  -+@@@abz%_()é\n"
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == spans_by_hand(t), t
    for t in ("4111 1111 1111 1111", "a@b.c%d@e.f", "1.2.3.4.5", "256.1.1.1", "001.2.3.4", "+1 (234) 567-8901", "é a@b.co"):
        assert pii.base_spans(t) == spans_by_hand(t)
    assert len(pii.base_spans("7" * 200_000 + " " + "1." * 50_000 + " " + "a@" * 50_000)) == len(spans_by_hand("1." * 50_000))


def test_pii_query_over_the_table(spark):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = spans_by_hand(t)
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == j for s in want) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))


def test_skip_edges_carry_a_label_to_a_repeated_token():
    rng = random.Random(1)
    card = "4111111111111111"
    handle = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)) + str(rng.randrange(100))
    sample = [f"write to {handle()}@mail.example.com or take {rng.randrange(99)} of {card} at 10.0.0.{i % 250}" for i in range(300)]
    field = pii.train(sample)
    alone = "ask jane.doe77 about it"
    both = "mail jane.doe77@mail.example.com today. " + "then " * 60 + "ask jane.doe77 about it"
    found = lambda t: [(t[a:b], pii.KINDS[k]) for a, b, k, base in pii.find([t], field)[0] if not base]
    assert found(alone) == []
    assert found(both) == [("jane.doe77", "email")]
    off = pii.Field(field.node, field.chain, np.zeros_like(field.skip))
    assert [x for x in pii.find([both], off)[0] if not x[3]] == []


def planted_mentions(seed, n):
    """Texts with a mention that a pattern takes and a later one that none does, and where and what the later one is."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    fill = lambda k: " ".join(word() if rng.random() < 0.97 else str(rng.randrange(10 ** rng.randint(1, 12))) for _ in range(k))
    out, want = [], []
    for i in range(n):
        if i % 4 < 2:  # a handle without its domain
            again = word() + rng.choice("._-") + word() if i % 4 else word() + word() + str(rng.randrange(10, 99))
            first, kind = f"{again}@{word()}.example.org", "email"
        elif i % 4 == 2:  # a card number with a slip of one digit
            d = "".join(str(rng.randrange(10)) for _ in range(15))
            c = next(d + str(x) for x in range(10) if pii.luhn(d + str(x)))
            at = rng.randrange(16)
            again, kind = c[:at] + str((int(c[at]) + rng.randint(1, 9)) % 10) + c[at + 1 :], "card"
            first = " ".join(c[x : x + 4] for x in range(0, 16, 4)) if rng.random() < 0.5 else c
        else:  # a phone number without +
            d = "".join(str(rng.randrange(10)) for _ in range(9))
            first, again, kind = "+44 20 " + d[:4] + " " + d[4:], rng.choice(["0", ""]) + "20" + d, "phone"
        t = f"{fill(rng.randint(5, 60))} {first} {fill(rng.randint(30, 200))} "
        want.append((len(t), len(t) + len(again), kind))
        out.append(f"{t}{again} {fill(rng.randint(0, 40))}")
    return out, want


def test_added_spans_on_planted_mentions(spark):
    """Precision and recall of what the field adds, with weights learned from the table."""
    field = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts, want = planted_mentions(3, 400)
    added = [[(a, b, pii.KINDS[k]) for a, b, k, base in x if not base] for x in pii.find(texts, field)]
    right = sum(any(a <= w[0] and b >= w[1] and k == w[2] for a, b, k in x) for x, w in zip(added, want, strict=True))
    total = sum(map(len, added))
    print(f"added spans: recall {right / len(want):.3f}, precision {right / max(1, total):.3f}")
    assert right >= 0.9 * len(want)
    assert right >= 0.9 * total


def test_marginals_equal_enumeration_on_a_tree():
    g, _ = pii.graph(["a1 b22 c333"])
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    unary, n = g.features @ field.node, len(g.text)
    assert (n, g.chain.tolist(), len(g.skip)) == (3, [[0, 1], [1, 2]], 0)
    want = np.zeros((3, 5))
    for x in np.ndindex(5, 5, 5):
        p = np.exp(sum(unary[i, x[i]] for i in range(3)) + field.chain[x[0], x[1]] + field.chain[x[1], x[2]])
        for i in range(3):
            want[i, x[i]] += p
    np.testing.assert_allclose(field.marginals(g), want / want.sum(1, keepdims=True), atol=2e-3)


def test_pii_edge_texts_redaction_and_clashing_columns(spark):
    rows = [*CASES, "x a@b.co y 10.0.0.1", "x a@b.co y 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumns({"entities": F.lit(1), "kind": F.lit(2)})
    field = pii.fit(df)
    got = pii.entities(df, field, redacted=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got[:7]] == CASES
    assert got[7]["text"] == got[8]["text"] == "x [EMAIL] y [IP]"
    assert got[7]["kind"] == 2
    assert pii.entities(df.limit(0), pii.fit(df.limit(0))).count() == 0
    assert pii.redact("abcdef", [(0, 3, 0, True), (2, 5, 1, True)]) == "[EMAIL]f"
