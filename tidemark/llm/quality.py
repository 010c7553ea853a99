"""Quality by Bradley-Terry pairwise ranking.

Every text becomes a row of counts and ratios: letters' case, symbols, digits, word lengths, repeats of words and lines.
Each is cut at quantiles into bins, so that a weight for each bin can follow any shape. From labelled rows come
preference pairs, a good text over a bad one; the weights minimise the logistic loss on the pairs' feature differences,
which makes a text's score its Bradley-Terry strength. The quantile of the scores with the fewest labels on the wrong side is the
threshold, and strengths are squashed so that it lies at CUT. Cuts and threshold come from counts of all labelled rows; the weights
are learned in Spark tasks, each on its part of the rows, and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bins of a feature; steps of a part, pairs of a step, step size and penalty; rounds after which the parts' weights are averaged.
BINS = 12
STEPS, PAIRS, RATE, PENALTY, ROUNDS = 400, 4096, 0.5, 1e-4, 4
#: Labelled rows of a part, and rows of the rarer label that it has on average at least.
PART_ROWS, PART_RARE = 16_384, 64
#: Values of a feature are counted in cells by so many of their highest bits: sign, exponent and 10 bits; strengths in cells of this width.
CELL_BITS, CELL = 22, 1 / 256
#: The score of a text at the threshold.
CUT = 0.7

_UPPER = common.byte_class([(0x41, 0x5A)])
_LOWER = common.byte_class([(0x61, 0x7A), (0x80, 0xFF)])
_DIGIT = common.byte_class([(0x30, 0x39)])
_STOP = common.byte_class([(0x2C, 0x2C), (0x2E, 0x2E)])  # comma and full stop
_SHOUT = common.byte_class([(0x21, 0x21), (0x3F, 0x3F)])  # exclamation and question mark
_SPACE = ~common.SPACED_WORD
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _STOP | _SHOUT | _SPACE)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT, _SPACE, _SYMBOL])
_LINE = ~common.byte_class([(0x0A, 0x0A)])
NAMES = ("upper", "lower", "digit", "stop", "shout", "space", "symbol", "words", "word_length", "long_words", "distinct", "lines", "line_repeats", "line_words", "symbol_words", "upper_words", "top_word", "stutter")


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(total[at])


def _distinct(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of each text, and how often its commonest occurs."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(len(bounds) - 1, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(k))))
    return np.bincount(o[first], minlength=len(bounds) - 1), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each whole text; all zero where it is null or empty."""
    data, at = common.text_bytes(texts)
    size = np.maximum(np.diff(at), 1)
    shares = [_sums(c[data], at) / size for c in _CLASSES]
    start, end, bounds = common.find_words(data, at, common.SPACED_WORD)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    length = end - start
    words = common.word_hashes(data, start, end)
    again = np.zeros(len(words), bool)  # the same word as the one before
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][n > 0]] = False
    different, top = _distinct(words, bounds)
    l_start, l_end, l_bounds = common.find_words(data, at, _LINE)
    lines = np.diff(l_bounds)
    l_different, _ = _distinct(common.word_hashes(data, l_start, l_end), l_bounds)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    rows = [
        *shares, np.log1p(n), _sums(length, bounds) / some, _sums(length > 12, bounds) / some, different / some, np.log1p(lines), 1 - l_different / np.maximum(lines, 1), n / np.maximum(lines, 1),
        _sums(marks[end] > marks[start], bounds) / some, _sums(capitals[end] - capitals[start] > 1, bounds) / some, top / some, _sums(again, bounds) / some,
    ]
    return np.stack(rows, 1)


@dataclass
class Ranking:
    """Bin edges of each feature, a weight for each bin, and the strength at the threshold."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for f in range(rows.shape[1]):
            total += self.weights[f][np.searchsorted(self.edges[f], rows[:, f])]
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1; the threshold is at CUT."""
        z = self.strengths(features(texts)) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(values: np.ndarray, n: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The bin edges of a feature from ascending values and how many rows have each: a third of the cuts by all texts, the
    rest by the rarer label, so that its own range is resolved too."""
    few = BINS // 3
    at = lambda n, count: values[np.searchsorted(np.cumsum(n), np.linspace(0, 1, count + 2)[1:-1] * n.sum())]
    return np.sort(np.concatenate([at(n, few), at(rare, BINS - 1 - few)]))


def _bins(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The place of each feature's weight, for each row."""
    return np.stack([np.searchsorted(edges[f], rows[:, f]) + f * BINS for f in range(rows.shape[1])], 1)


def descend(state: np.ndarray, bins: np.ndarray, y: np.ndarray, steps: range, rng: np.random.Generator) -> None:
    """Steps of Adam on pairs of a part's good and bad rows, each row in turn; changes the state: weights and two moments."""
    w, m, v = np.split(state, 3)
    turns = lambda label: np.resize(rng.permutation(np.flatnonzero(y == label)), len(steps) * PAIRS)
    win, lose = turns(1), rng.permutation(turns(0))
    for i, step in enumerate(steps):
        a, b = bins[win[i * PAIRS : (i + 1) * PAIRS]], bins[lose[i * PAIRS : (i + 1) * PAIRS]]
        pull = 1 / (1 + np.exp(np.clip(w[a].sum(1) - w[b].sum(1), -30, 30))) / PAIRS  # of the loss -log P(win beats lose)
        pull = np.broadcast_to(pull[:, None], a.shape).ravel()
        g = np.bincount(b.ravel(), pull, len(w)) - np.bincount(a.ravel(), pull, len(w)) + PENALTY * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= RATE * (1 - (step + 1) / STEPS) * 0.2 * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)


def _threshold(z: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap of ascending strengths among those with the fewest labels on the wrong side."""
    wrong = np.concatenate([[0], np.cumsum(good)]) + bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    best = np.flatnonzero(wrong == wrong.min())
    gaps = np.concatenate([[2.0], np.diff(z), [2.0]])[best]
    q = best[np.argmax(gaps)]  # so many of the values lie below: the quantile
    return float((z[max(q - 1, 0)] + z[min(q, len(z) - 1)]) / 2)


def _one_sided(edges: np.ndarray, side: int) -> Ranking:
    """What no labelled rows (0) or rows of one label only give: all texts score CUT, or lie on that side."""
    return Ranking(edges, np.zeros((len(NAMES), BINS)), -4.0 * side)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 3) -> Ranking:
    """What `fit` does, for whole texts at hand with labels 0 and 1: they are one part, of which nothing is left out."""
    y = np.asarray(labels)
    if not len(y) or not (y == 1).any() or not (y == 0).any():
        return _one_sided(np.zeros((len(NAMES), BINS - 1)), 0 if not len(y) else 1 if (y == 1).any() else -1)
    rows = np.concatenate([features(pa.array(texts[i : i + 256], pa.string())) for i in range(0, len(texts), 256)])
    rare = y == int(2 * (y == 1).sum() < len(y))
    columns = [np.unique(x, return_inverse=True) for x in rows.T]
    model = Ranking(np.stack([_cuts(values, np.bincount(at), np.bincount(at, rare)) for values, at in columns]), np.zeros((len(NAMES), BINS)))
    state, bins = np.zeros(3 * len(NAMES) * BINS), _bins(rows, model.edges)
    for i in range(ROUNDS):
        descend(state, bins, y, range(i * STEPS // ROUNDS, (i + 1) * STEPS // ROUNDS), np.random.default_rng([seed, i, 0]))
    model.weights = state[: len(NAMES) * BINS].reshape(model.weights.shape)
    z, at = np.unique(model.strengths(rows), return_inverse=True)
    model.threshold = _threshold(z, *(np.bincount(at, y == label, len(z)) for label in (1, 0)))
    return model


def _featured(rows: DataFrame) -> DataFrame:
    """The features of each labelled text, 8 bytes each, instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "t"):
            data = [x.tobytes() for x in features(batch["t"]).astype(np.float64)]
            yield pa.RecordBatch.from_arrays([batch["h"], batch["_y"], pa.array(data, pa.binary())], names=["h", "_y", "x"])

    return common.materialise(common.map_texts(rows, run, "h long, _y int, x binary"), "quality-features")


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(NAMES))


def _edges(rows: DataFrame, rare: int) -> np.ndarray:
    """The bin edges by counts of all rows: the driver gets the cells of each feature's values, with the largest value of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, PART_ROWS):
            x, mine = _numbers(batch["x"]), batch["_y"].to_numpy() == rare
            for f in range(len(NAMES)):
                order = np.argsort(x[:, f], kind="stable")
                values = x[order, f]
                cell = values.view(np.int64) >> (64 - CELL_BITS)
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                last = np.append(first[1:], len(values)) - 1
                n, of_rare = np.diff(np.append(first, len(values))), np.add.reduceat(mine[order].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), f, np.int32)), pa.array(cell[first]), pa.array(values[last]), pa.array(n), pa.array(of_rare)], names=["f", "cell", "top", "n", "rare"])

    found = common.map_texts(rows, run, "f int, cell long, top double, n long, rare long").groupBy("f", "cell").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.sum("rare").alias("rare"))
    table = found.toArrow().sort_by([("f", "ascending"), ("cell", "ascending")])
    of, top, n, some = (table[c].to_numpy() for c in ("f", "top", "n", "rare"))
    return np.stack([_cuts(top[of == f], n[of == f], some[of == f]) for f in range(len(NAMES))])


def _round(binned: DataFrame, state: np.ndarray, steps: range, seed: list[int]) -> np.ndarray:
    """The state after every part has taken these steps from this one: the mean of the parts' by their rows. A part without
    rows of both labels has no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs_of(batches, "part"):
            y = np.concatenate([b["_y"].to_numpy() for b in part])
            if not (y == 1).any() or not (y == 0).any():
                continue
            bins = np.frombuffer(b"".join(x for b in part for x in b["x"].to_pylist()), np.uint8).reshape(len(y), -1).astype(np.int64)
            mine, number = state.copy(), part[0]["part"][0].as_py()
            descend(mine, bins, y, steps, np.random.default_rng([*seed, number]))
            yield common.weights_in_blocks(mine, number, len(y))

    return common.mean_of_parts(common.map_texts(binned, run, common.BLOCKS))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", fold: int = 4, held_out: int = 2, part_rows: int = PART_ROWS, seed: int = 3) -> Ranking:
    """Learn from all labelled rows outside the held-out fold, about part_rows of them in a task; cuts, weights and threshold
    come from all of them. The driver holds counts, no rows. Of labels so rare that a part would have few, parts are larger.

    No labelled rows or an empty table: every text scores CUT; rows of one label only put all texts on that side. Null ids and
    labels are not used; an id with several labels has the smallest, one with several texts one of them; other columns are not read.
    """
    rows = _featured(common.all_labelled(docs, labels, label, common.remainder(F.col(doc_id), fold) != held_out, doc_id=doc_id, text=text))
    n, good, bad = (x or 0 for x in rows.agg(F.count("*"), F.sum((F.col("_y") == 1).cast("long")), F.sum((F.col("_y") == 0).cast("long"))).first())
    if not good or not bad:
        return _one_sided(np.zeros((len(NAMES), BINS - 1)), 0 if not n else 1 if good else -1)
    model = Ranking(_edges(rows, int(good < bad)), np.zeros((len(NAMES), BINS)))
    parts = max(1, min(-(-n // part_rows), min(good, bad) // PART_RARE))
    edges = model.edges

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins(_numbers(batch["x"]), edges).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["h"], batch["_y"], pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "_y", "x"])

    binned = common.map_texts(rows, to_bins, "h long, _y int, x binary").withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    binned = common.materialise(binned.repartitionById(parts, "part").sortWithinPartitions("part", "h", "x", "_y"), "quality-bins")
    state = np.zeros(3 * len(NAMES) * BINS)
    for i in range(ROUNDS):
        state = _round(binned, state, range(i * STEPS // ROUNDS, (i + 1) * STEPS // ROUNDS), [seed, i])
    model.weights = weights = state[: len(NAMES) * BINS].reshape(model.weights.shape)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, PART_ROWS):
            bins = np.frombuffer(b"".join(batch["x"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(weights.ravel()[bins].sum(1) / CELL).astype(np.int64)), batch["_y"]], names=["cell", "_y"])

    found = common.map_texts(binned, cells, "cell long, _y int").groupBy("cell").agg(*(F.sum((F.col("_y") == x).cast("long")).alias(f"n{x}") for x in (1, 0))).toArrow().sort_by("cell")
    model.threshold = _threshold((found["cell"].to_numpy() + 0.5) * CELL, found["n1"].to_numpy(), found["n0"].to_numpy())
    return model


def score(docs: DataFrame, model: Ranking, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text.

    Null and empty texts are scored as texts without words; very long ones are a step of their own, whole; repeated rows
    score alike; a tie with the threshold scores CUT; a column of the name is replaced, others stay; an empty table gives no rows.
    """
    return common.score_texts(docs, model, text=text, name=name)
