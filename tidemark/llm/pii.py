"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The random field labels every token that has a digit or an @ and every word that equals an
address's local part: node potentials come from the token's shape and its neighbourhood, chain edges join neighbouring tokens,
and skip edges join distant tokens of one text that repeat or resemble each other (the same characters, the same first or last
digits, an address and its local part). Loopy message passing makes the labels of such tokens agree, so that a mention which no pattern takes is found through one that a
pattern took. Base spans are observed labels and always stay. The weights are learned from base spans by
pseudo-likelihood on a bounded sample of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Texts that the weights are learned from, about (the share of rows by a hash of id and text that gives so many).
SAMPLE = 8000
#: Bytes of their texts at most.
SAMPLE_BYTES = 16 << 20
#: A label's probability from which a token is a span; rounds of message passing; how far apart chain neighbours may be.
SURE, ROUNDS, NEAR = 0.9, 12, 40
STEPS, RATE, PENALTY = 300, 0.1, 1e-3
#: The share of tokens whose shape is hidden in a training step, so that the edges learn to tell labels without it.
HIDDEN = 0.5
#: The weight from which it is learned that tokens joined by a skip edge agree.
AGREE = 9.0

# The patterns (fixed values). Runs of digits are taken whole, which matches the same and never looks at one twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'<>|,;:!?=*#$&\[\]{}]*[0-9@][^\s\"'<>|,;:!?=*#$&\[\]{}]*")
_NUMBER = re.compile(r"\(?[0-9][0-9().-]*(?:\x20[0-9().-]+)+(?<=[0-9])(?![0-9A-Za-z@])")
_WORD = re.compile(r"[^\s\"'<>|,;:!?=*#$&\[\]{}]+")
_EDGES = ".%-_/\\"
#: Letters and digits from which a token can repeat an address's local part, one less for the part itself.
LEAST_NAME = 5


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with what may stand before it, from the end of the match before, and a domain after it."""
    found, pos = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > pos and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the patterns take, by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m.groups())]
    found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


FEATURES = 27


def _shape(token: str, before: str) -> list[int]:
    """Which features a token has."""
    digits, dots = len(_digits(token)), token.count(".")
    letters = sum(c.isalpha() for c in token)
    found = [0, 1 + min(digits, 20) // 2, 12 + min(dots, 4)]
    found += [i for i, has in enumerate((
        "@" in token, "+" in token[:2], "(" in token, "-" in token, not letters, letters > digits, 14 <= digits <= 19 and not letters and luhn(_digits(token)),
        before.rstrip()[-1:] in ("=", ":"), before.rstrip()[-1:] == ")", digits > 19,
    ), 17) if has]
    return found


@dataclass
class Graph:
    """Tokens of many texts: their spans, features, observed labels (-1: none), and edges of both kinds."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _plain(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


def _tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(start, token) in order: each base span; around them what has a digit or an @, groups of digits as one number, and words
    that equal an address's local part of several parts (jane.doe)."""
    found = [(a, b) for a, b, _ in base]
    for m in _TOKEN.finditer(text):
        token = m[0].strip(_EDGES)
        if token:
            found.append((a := m.start() + m[0].index(token), a + len(token)))
    found += [m.span() for m in _NUMBER.finditer(text) if 9 <= len(_digits(m[0])) <= 19]
    names = {name for a, b, k in base if k == 0 and len(name := text[a:b].split("@")[0].strip(_EDGES)) >= LEAST_NAME and not (name.isalpha() or _ANY.search(name))}
    if names:
        lower = {n.lower() for n in names}
        words = ((m.start() + m[0].index(w), w) for m in _WORD.finditer(text) if (w := m[0].strip(_EDGES)) and w.lower() in lower)
        found += [(a, a + len(w)) for a, w in words]
    taken, out, last = {(a, b) for a, b, _ in base}, [], 0
    bounds, i = [(a, b) for a, b, _ in base], 0
    for a, b in sorted(set(found), key=lambda x: (x[0], -x[1])):
        while i < len(bounds) and bounds[i][1] <= a:
            i += 1
        if (a, b) in taken or a >= last and not (i < len(bounds) and bounds[i][0] < b):
            out.append((a, text[a:b]))
            last = max(last, b)
    return out


def _keys(token: str) -> set[str]:
    """What a token shares with those that repeat or resemble it."""
    plain, digits, local = _plain(token), _digits(token), token.split("@")[0]
    keys = {plain} if len(plain) >= LEAST_NAME else set()
    if len(digits) >= 9:
        keys |= {f"..{digits[-9:]}"}
    if len(digits) >= 14:  # a slip in one half leaves the other
        keys |= {f"{digits[:7]}.."}
    if len(local) < len(token) and len(_plain(local)) >= LEAST_NAME - 1:
        keys |= {_plain(local)}
    return keys


def graph(texts: list[str | None]) -> tuple[Graph, list[list[tuple[int, int, int]]]]:
    """The texts' tokens as one graph without edges between texts, and the base spans of each."""
    of, starts, ends, observed, rows, chain, skip, bases = [], [], [], [], [], [], [], []
    for d, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        if not text or not _ANY.search(text):
            continue
        seen: dict[str, int] = {}
        b, last = 0, -NEAR - 1
        for start, token in _tokens(text, base):
            end, at = start + len(token), len(of)
            while b < len(base) and base[b][1] <= start and base[b][2] >= 0:
                b += 1
            cover = next((k for s, e, k in base[b : b + 4] if s < end and e > start), -1)
            of.append(d)
            starts.append(start)
            ends.append(end)
            observed.append(cover + 1 if cover >= 0 else -1)
            rows.append(_shape(token, text[max(0, start - 3) : start]))
            if start - last <= NEAR:
                chain.append((at - 1, at))
            last = end
            for key in _keys(token):
                if key in seen and seen[key] != at:
                    skip.append((seen[key], at))
                seen[key] = at
    x = np.zeros((len(of), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    pairs = lambda p: np.array(p, np.int64).reshape(-1, 2)
    return Graph(np.array(of, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), x, np.array(observed, np.int64), pairs(chain), pairs(skip)), bases


@dataclass
class Field:
    """Weights of features for each label, and of pairs of labels on chain and skip edges. Label 0: no personal data."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Each token's label probabilities after loopy message passing; observed labels are fixed."""
        unary = g.features @ self.node
        seen = g.observed >= 0
        unary[seen] = -50
        unary[seen, g.observed[seen]] = 50
        a = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        b = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        n, m = len(g.chain), len(g.skip)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n), 2 * n + np.arange(m, 2 * m), 2 * n + np.arange(m)]) if n + m else np.zeros(0, np.int64)
        pair = np.concatenate([np.broadcast_to(w, (k, *w.shape)) for w, k in ((self.chain, n), (self.chain.T, n), (self.skip, m), (self.skip.T, m))])
        messages = np.zeros((len(a), unary.shape[1]))
        for _ in range(ROUNDS if len(a) else 0):
            belief = unary.astype(np.float64)
            np.add.at(belief, b, messages)
            out = (belief[a] - messages[back])[:, :, None] + pair
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        belief = unary.astype(np.float64)
        np.add.at(belief, b, messages)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def train(texts: list[str | None]) -> Field:
    """Learn from base spans as labels: each token's label given its features and its neighbours' labels.

    A token that no pattern took but that repeats or resembles one that a pattern took has no known label; it is left out.
    """
    g, _ = graph(texts)
    k = len(KINDS) + 1
    y = np.maximum(g.observed, 0)
    one = np.eye(k)[y]
    node, chain = np.zeros((FEATURES, k)), np.zeros((k, k))
    skip = np.eye(k) * AGREE  # repeated tokens agree; learned from there
    if not len(y):
        return Field(node, chain, skip)
    known = np.ones((len(y), 1))
    for a, b in ((g.skip[:, 0], g.skip[:, 1]), (g.skip[:, 1], g.skip[:, 0])):
        known[a[(g.observed[a] < 0) & (g.observed[b] >= 0)]] = 0
    params = [node, chain, skip]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng = np.random.default_rng(2)
    for step in range(1, STEPS + 1):
        x = g.features * (rng.random((len(y), 1)) >= HIDDEN)
        x[:, 0] = 1
        z = x @ node
        for e, w in ((g.chain, chain), (g.skip, skip)):
            np.add.at(z, e[:, 1], w[y[e[:, 0]]])
            np.add.at(z, e[:, 0], w.T[y[e[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        err = (p / p.sum(1, keepdims=True) - one) * known
        grads = [x.T @ err / len(y) + PENALTY * node]
        for e, w in ((g.chain, chain), (g.skip, skip)):
            prior = 0 if w is chain else np.eye(k) * AGREE
            grads.append((one[e[:, 0]].T @ err[e[:, 1]] + (one[e[:, 1]].T @ err[e[:, 0]]).T) / len(y) + PENALTY * (w - prior))
        for q, d, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(node, chain, skip)


def find(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(start, end, kind, base) of every span of each text: the base spans, and tokens that the field is sure of."""
    g, bases = graph(texts)
    found = [[(*x, True) for x in base] for base in bases]
    if len(g.text):
        p = field.marginals(g)
        label = p.argmax(1)
        for i in np.flatnonzero((label > 0) & (g.observed < 0) & (p.max(1) >= SURE)):
            found[g.text[i]].append((int(g.start[i]), int(g.end[i]), int(label[i]) - 1, False))
    return [sorted(x, key=lambda s: (s[0], s[2], s[1])) for x in found]


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Learn from about `sample` rows and `sample_bytes` of their texts at most: a share by the hash of id and text, each once.

    Rows without an id are not read. Rows that are few or empty, and an empty table, give weights near zero.
    """
    key = F.xxhash64(doc_id, text)
    rows = docs.where(F.col(doc_id).isNotNull() & common.hash_share(key, docs.count(), sample)).where(F.col(text).rlike("[0-9@]")).select(key.alias("h"), F.col(text).alias("t"))
    return train(common.texts_by_hash(rows, sample, sample_bytes)["t"].to_pylist())


ENTITY = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def entities(docs: DataFrame, field: Field, *, text: str = "text", name: str = "entities", redacted: bool = False) -> DataFrame:
    """Add the spans of every whole text, in code points, end exclusive; with `redacted` replace each by its kind in [].

    Null and empty texts have none (null stays null when redacted); repeated rows have the same; a column of the name
    is replaced; other columns stay; an empty table gives no rows; a very long text is a step of its own, whole. Of overlapping
    spans the redaction covers all and names the first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [f for f in docs.schema.fields if f.name != name]
    entity = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(entity))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            texts = batch[text].to_pylist()
            found = find(texts, shared.value)
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in x] for x in found], arrow)
            out = {f.name: batch[f.name] for f in kept}
            if redacted:
                out[text] = pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)], batch[text].type)
            yield pa.RecordBatch.from_arrays([*out.values(), spans], names=schema.names)

    return common.map_texts(docs, run, schema)


def redact(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for a, b, k, _ in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per row: base spans of each kind, their hash, and all spans."""
    base = F.filter("entities", lambda x: x["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in KINDS]
    counts = [(F.size(kinds) - n).alias(f"n_{k}") for n, k in zip(counts, KINDS, strict=True)]
    return found.select(F.col(doc_id), *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("entities")).alias("spans"))
