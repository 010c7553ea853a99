"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

Words are hashed into buckets of an embedding table; filters of several widths run over each text, each filter's
largest value is kept (max pooling), and a logistic layer scores the text. It is trained on all labelled rows in Spark
tasks: a task passes over its part of the rows from the weights of the round before, and the parts' weights are
averaged. Scoring runs over whole texts in tasks too. The threshold is calibrated for each language, which is told from
the text's own function words, by counts of all labelled rows, and folded into the score, so that 0.5 decides for every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of features, dimensions of an embedding, widths of filters and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
#: A word's embedding is the sum of its own bucket's and those of its first so many bytes: inflected forms share a stem.
PREFIXES = (4, 5)
#: A feature in fewer training texts than this, or than this share of them, has the zero embedding.
LEAST_TEXTS, LEAST_SHARE = 3, 0.002
#: Texts of a step, first step size, decay of the weights, share of words left out at random.
BATCH, RATE, DECAY, DROP = 32, 0.02, 2e-3, 0.3
#: Rounds, each a pass over all labelled rows, at least and at most; between them as many as give a part so many steps.
LEAST_ROUNDS, MOST_ROUNDS, STEPS = 3, 8, 1500
#: About so many rows and bytes of text are a part, which one task holds at once.
PART_ROWS, PART_BYTES = 16_384, 64 << 20
#: Words that the filters run over at once; a longer text is a step of its own.
STEP_WORDS = 1 << 16
#: Features counted in a task before it hands on their counts.
HELD = 1 << 20
#: Logits are counted in cells of this width for the thresholds, within the bounds that scores know.
CELL, MOST_LOGIT = 1 / 256, 30
#: Function words by which a text's language is told (fixed values: common words of each language).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as on be at by this from or an".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur au est pas ce".split(),
    "de": "der die das und den von zu mit sich des auf im ein eine dem nicht ist es auch an".split(),
    "es": "el los las de y en que un una por con para se del al es lo como su más".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "")


def _hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data])
    return common.word_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)


_KEYS = np.concatenate([_hash_words(w) for w in FUNCTION_WORDS.values()])
_ORDER = np.argsort(_KEYS)
_KEYS, _WHOSE = _KEYS[_ORDER], np.repeat(np.arange(len(FUNCTION_WORDS)), [len(w) for w in FUNCTION_WORDS.values()])[_ORDER]


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each lower-case word and of its prefixes, a column each, and the first word of each text."""
    data, at = common.text_bytes(texts)
    data = common.LOWER[data]
    start, end, bounds = common.find_words(data, at, common.ALNUM_WORD)
    features = np.empty((len(start), 1 + len(PREFIXES)), np.uint64)
    features[:, 0] = common.word_hashes(data, start, end)
    for i, n in enumerate(PREFIXES):
        features[:, i + 1] = common.word_hashes(data, start, np.minimum(end, start + n)) + np.uint64(n)
    return features, bounds


def languages(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's language as a place in LANGUAGES: the one with most function words; the last if there are none."""
    words = words[:, 0]
    votes = np.zeros((len(bounds) - 1, len(FUNCTION_WORDS)), np.int64)
    left, right = np.searchsorted(_KEYS, words, "left"), np.searchsorted(_KEYS, words, "right")
    for k in range(int((right - left).max(initial=0))):
        at = np.flatnonzero(right - left > k)
        np.add.at(votes, (np.searchsorted(bounds, at, "right") - 1, _WHOSE[left[at] + k]), 1)
    return np.where(votes.any(1), votes.argmax(1), len(FUNCTION_WORDS))


@dataclass
class Network:
    """The trained weights. known: hashes of words with an embedding, sorted; bucket: where theirs is."""

    known: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def buckets(self, words: np.ndarray) -> np.ndarray:
        """The embedding rows of each word's features; row 0 is all zero, for what training met too seldom."""
        if not len(self.known):
            return np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, 1 + (words % np.uint64(BUCKETS)).astype(np.int64), 0)

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list]:
        """Each text's largest filter values; and of each width the values everywhere, the rows and the texts' starts.

        Zero words stand after each text, so that no filter sees two texts and a text without words has values.
        """
        values, where = [], []
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for w, bias in zip(self.filters, self.bias, strict=True):
            width = len(w)
            spaced = np.zeros((rows.shape[1], len(rows) + (len(bounds) - 1) * width), np.int64)
            spaced[:, np.arange(len(rows)) + of * width] = rows.T
            starts = bounds[:-1] + np.arange(len(bounds) - 1) * width
            part = self.table @ np.concatenate(list(w), 1)  # what each feature adds at each place of the filters
            parts = part.take(spaced[0], 0)
            for more in spaced[1:]:
                parts += part.take(more, 0)
            got = parts[:, :FILTERS].copy()
            for j in range(1, width):
                got[: len(got) - j] += parts[j:, j * FILTERS : (j + 1) * FILTERS]
            ends = np.append(starts[1:], len(got))
            for j in range(1, width):  # these begin behind the first zero word and would see the next text
                got[ends - j] = 0
            values.append(np.maximum.reduceat(got, starts, axis=0) + bias)
            where.append((got, spaced, starts))
        return np.maximum(np.concatenate(values, 1), 0), where

    def of_rows(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The logits of texts whose embedding rows are known, about STEP_WORDS words at a time."""
        group = bounds[:-1] // STEP_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
        found = [self.pooled(rows[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0] @ self.out + self.out_bias for i, j in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate(found) if found else np.zeros(0)

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.of_rows(self.buckets(words), bounds)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1; the language's threshold is at 0.5."""
        words, bounds = read_words(texts)
        z = self.logits(words, bounds).astype(np.float64) - self.thresholds[languages(words, bounds)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray, prior: float, weight: float) -> float:
    """The cut of ascending logits with the least errors, the middle of the widest such gap; few rows keep near the prior's."""
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    best = np.flatnonzero(wrong == wrong.min())
    gaps = np.concatenate([[2.0], np.diff(z), [2.0]])[best]
    cut = cuts[best[np.argmax(gaps)]]
    n = clean.sum() + toxic.sum()
    return float((cut * n + prior * weight) / (n + weight))


def _cells(z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (language, cell of the logit, label), and how many texts each has."""
    at = np.floor((np.clip(z, -MOST_LOGIT, MOST_LOGIT) + MOST_LOGIT) / CELL).astype(np.int64)
    return np.unique((lang * (1 << 20) + at) * 2 + (y == 1), return_counts=True)


def _thresholds(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The threshold of each language by the texts in each cell."""

    def best(mine: np.ndarray, prior: float, weight: float) -> float:
        cell, at = np.unique(keys[mine] // 2 % (1 << 20), return_inverse=True)
        clean, toxic = (np.bincount(at, np.where(keys[mine] % 2 == label, n[mine], 0), len(cell)) for label in (0, 1))
        return _best_threshold((cell + 0.5) * CELL - MOST_LOGIT, clean, toxic, prior, weight)

    lang = keys // 2 >> 20
    whole = best(np.ones(len(keys), bool), 0.0, 0)
    return np.array([best(lang == k, whole, 100) if (lang == k).any() else whole for k in range(len(LANGUAGES))])


def gradients(net: Network, rows: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the texts' weighted mean logistic loss by table, filters, their biases and the output's weights; and by its bias."""
    values, where = net.pooled(rows, bounds)
    z = values @ net.out + net.out_bias
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
    grads = [np.zeros_like(p) for p in (net.table, *net.filters, *net.bias, net.out)]
    grads[-1] = values.T @ error
    at, by = [], []
    back = error[:, None] * net.out * (values > 0)
    for f, (got, spaced, starts) in enumerate(where):
        part = back[:, f * FILTERS : (f + 1) * FILTERS]
        grads[1 + len(WIDTHS) + f] = part.sum(0)
        ends = np.concatenate([starts[1:], [len(got)]])
        best = np.stack([x + got[x:y].argmax(0) for x, y in zip(starts, ends, strict=True)])
        for j in range(WIDTHS[f]):
            seen = spaced[:, np.minimum(best + j, len(got) - 1)]  # feature, text, filter
            grads[1 + f][j] += np.einsum("dc,dck->kc", part, net.table[seen].sum(0))
            change = part[:, :, None] * net.filters[f][j].T[None]
            at.append(seen.ravel())
            by.append(np.tile(change.reshape(-1, change.shape[2]), (len(seen), 1)))
    at, by = np.concatenate(at), np.concatenate(by)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    grads[0][at[order][first]] = np.add.reduceat(by[order], first, axis=0)
    return grads, float(error.sum())


#: The weights in training as one vector: table, filters, their biases, the output's weights and its bias.
_SHAPES = [(BUCKETS + 1, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (FILTERS * len(WIDTHS),), (1,)]
_SIZE = sum(int(np.prod(s)) for s in _SHAPES)


def _start(seed: int) -> np.ndarray:
    """What a round begins with: the weights, Adam's two moments of each, and the steps so far."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (BUCKETS + 1, DIM))
    table[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    out = np.abs(rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)))
    state = np.zeros(3 * _SIZE + 1, np.float32)
    state[:_SIZE] = np.concatenate([np.ravel(x) for x in (table, *filters, np.zeros(FILTERS * len(WIDTHS)), out, -1.0)])
    return state


def _network(known: np.ndarray, state: np.ndarray) -> Network:
    """The network of a state, whose arrays are views of it."""
    ends = np.cumsum([int(np.prod(s)) for s in _SHAPES])
    table, *rest, out, out_bias = (x.reshape(s) for x, s in zip(np.split(state[:_SIZE], ends[:-1]), _SHAPES, strict=True))
    return Network(known, table, rest[: len(WIDTHS)], rest[len(WIDTHS) :], out, float(out_bias[0]))


def descend(state: np.ndarray, rows: np.ndarray, lengths: np.ndarray, y: np.ndarray, share: float, rate: float, rng: np.random.Generator) -> None:
    """One pass of Adam over a part's texts in random order; changes the state. share: of label 1 in all parts."""
    weight = np.where(y == 1, 0.5 / max(share, 0.05), 0.5 / max(1 - share, 0.05)).astype(np.float32) ** 0.5
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    p, m, v = np.split(state[:-1], 3)
    net = _network(np.zeros(0, np.uint64), state)
    order = rng.permutation(len(y))
    for i in range(0, len(order), BATCH):
        mine = order[i : i + BATCH]
        b = np.concatenate([[0], np.cumsum(lengths[mine])])
        r = rows[np.repeat(bounds[mine] - b[:-1], lengths[mine]) + np.arange(b[-1])]
        r = np.where(rng.random((len(r), 1)) < DROP, 0, r)
        net.out_bias = float(p[-1])
        grads, by_bias = gradients(net, r, b, y[mine], weight[mine])
        grads[0][0] = 0
        g = np.concatenate([*(x.ravel() for x in grads), [by_bias]]).astype(np.float32)
        state[-1] += 1
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p[:-1] *= 1 - rate * DECAY
        p -= rate / (1 - 0.9 ** float(state[-1])) * m / (np.sqrt(v / (1 - 0.999 ** float(state[-1]))) + 1e-8)


def _rounds(part_rows: float) -> int:
    return int(np.clip(np.ceil(STEPS * BATCH / part_rows), LEAST_ROUNDS, MOST_ROUNDS))


def _once(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the texts, and in how many texts each is."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    keys = common.mix(words + of[:, None] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(words.ravel()[np.unique(keys, return_index=True)[1]], return_counts=True)


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


def _least(rows: int) -> float:
    return max(LEAST_TEXTS, LEAST_SHARE * rows)


def _one_sided(toxic: bool) -> Network:
    """What rows of one label only, or none, give: the same score for all texts."""
    net = _network(np.zeros(0, np.uint64), _start(0))
    net.out[:] = 0
    net.out_bias = 4.0 if toxic else -4.0
    return net


def train(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Network:
    """What `fit` does, for whole texts at hand with labels 0 and 1: they are one part, of which nothing is left out."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return _one_sided(len(y) > 0 and y[0] == 1)
    words, bounds = read_words(pa.array(texts, pa.string()))
    features, n = _once(words, bounds)
    state = _start(seed)
    net = _network(features[n >= _least(len(y))], state)
    rows, lengths, rounds = net.buckets(words), np.diff(bounds), _rounds(len(y))
    for i in range(rounds):
        descend(state, rows, lengths, y, float(y.mean()), RATE * (1 - i / rounds), np.random.default_rng([seed, i, 0]))
    net = _network(net.known, state)
    net.thresholds = _thresholds(*_cells(net.of_rows(rows, bounds), y, languages(words, bounds)))
    return net


def _known(rows: DataFrame, n: int) -> np.ndarray:
    """The features in enough of the n texts, sorted; what a task has counted is added up in a shuffle."""

    def batch(held: list) -> pa.RecordBatch:
        features, texts = _added(held)
        return pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(texts)], names=["feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for texts in common.steps(batches, "t"):
            held.append(_once(*read_words(texts["t"])))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_added(held)]
                if len(held[0][0]) > HELD // 2:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    found = common.map_texts(rows.select("t"), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= _least(n))
    return np.sort(found.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))


def _encoded(rows: DataFrame, known: np.ndarray, parts: int) -> DataFrame:
    """Each text's embedding rows, language and label, in files of a part each, in the order of hashes of ids."""
    shared = rows.sparkSession.sparkContext.broadcast(_network(known, _start(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "t"):
            words, bounds = read_words(batch["t"])
            found = shared.value.buckets(words).astype(np.uint16)
            data = pa.array([found[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["h"], batch["_y"], pa.array(languages(words, bounds).astype(np.int32)), data], names=["h", "_y", "lang", "rows"])

    found = common.map_texts(rows.select("h", "t", "_y"), run, "h long, _y int, lang int, rows binary").withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    return common.materialise(found.repartitionById(parts, "part").sortWithinPartitions("part", "h", "rows", "_y"), "toxicity-rows")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: its number, the embedding rows of its words, the texts' lengths, labels and languages."""
    for held in common.runs_of(batches, "part"):
        part, columns = held[0]["part"][0].as_py(), 1 + len(PREFIXES)
        data, at = zip(*(common.text_bytes(b["rows"]) for b in held), strict=True)
        lengths = np.concatenate([np.diff(x) for x in at]) // (2 * columns)
        y, lang = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("_y", "lang"))
        rows = np.concatenate(data).view(np.uint16).reshape(-1, columns)
        held.clear()  # a part is held once
        del data
        yield part, rows, lengths, y.astype(np.float32), lang


def _round(encoded: DataFrame, state: np.ndarray, share: float, rate: float, seed: list[int]) -> np.ndarray:
    """The state after every part has been passed over from this one: the mean of the parts' by their rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, lengths, y, _ in _parts(batches):
            mine = shared.value.copy()
            descend(mine, rows, lengths, y, share, rate, np.random.default_rng([*seed, part]))
            yield common.weights_in_blocks(mine, part, len(y))

    found = common.mean_of_parts(common.map_texts(encoded, run, common.BLOCKS))
    shared.destroy()
    return found


def _calibrated(encoded: DataFrame, net: Network) -> np.ndarray:
    """The thresholds by the logits of all labelled rows: the driver gets how many texts are in each cell."""
    shared = encoded.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_cells(shared.value.of_rows(rows, np.concatenate([[0], np.cumsum(lengths)])), y, lang) for _, rows, lengths, y, lang in _parts(batches)]
        if held:
            keys, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["cell", "n"])

    found = common.map_texts(encoded, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return _thresholds(found["cell"].to_numpy(), found["n"].to_numpy())


def score(docs: DataFrame, net, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text.

    Null and empty texts are scored as texts without words; very long ones are a step of their own, whole; repeated rows
    score alike; a tie with the threshold scores 0.5; a column of the name is replaced, others stay; an empty table gives no rows.
    """
    return common.score_texts(docs, net, text=text, name=name)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", fold: int = 5, held_out: int = 0, part_rows: int = PART_ROWS, seed: int = 5) -> Network:
    """Train on all labelled rows outside the held-out fold, about part_rows of them in a task; known features, weights
    and thresholds come from all of them. The driver holds the network, no rows.

    No labelled rows or an empty table give a network that finds no text toxic, rows of one label only one that scores all
    to that side. Null ids and labels are not used; an id with several labels has the smallest, one with several texts one
    of them; other columns are not read.
    """
    rows = common.materialise(common.all_labelled(docs, labels, label, common.remainder(F.col(doc_id), fold) != held_out, doc_id=doc_id, text=text), "toxicity-texts")
    n, low, high, toxic, size = rows.agg(F.count("*"), F.min("_y"), F.max("_y"), F.sum((F.col("_y") == 1).cast("long")), F.sum(F.octet_length("t"))).first()
    if not n or low == high:
        return _one_sided(n > 0 and low == 1)
    parts = int(np.ceil(max(n / part_rows, (size or 0) / PART_BYTES)))
    known = _known(rows, n)
    encoded = _encoded(rows, known, parts)
    state, rounds = _start(seed), _rounds(n / parts)
    for i in range(rounds):
        state = _round(encoded, state, toxic / n, RATE * (1 - i / rounds), [seed, i])
    net = _network(known, state)
    net.thresholds = _calibrated(encoded, net)
    return net
