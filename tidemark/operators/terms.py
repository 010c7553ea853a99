"""Large word lists looked for in texts as substrings, all in one pass: an Aho-Corasick automaton over bytes.

For a few words `functions.text.first_of` and `hits` are better: each word is its own `contains`, compiled with the plan. Their cost is
words times text, and the plan grows with the list; here the list goes to the tasks as arrays, and a text is walked once
whatever the number of words. The automaton's rows are complete (no failure link is followed while a text is walked), and many
stretches of text are walked side by side, each begun as far before its own part as the longest word is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text of a stretch, and of a step of many stretches.
STRETCH, STEP = 512, 1 << 20
#: Cells of an automaton's table at most: a list that needs more is dealt over several automata, and a text is walked once for each.
CELLS = 1 << 25
HITS = "array<struct<term:string,n:bigint,first:int>>"


@dataclass(frozen=True)
class Automaton:
    """classes: a byte's column. table[state, column]: the next state. own: the word that ends in a state, or -1. longer: the state of the
    longest word that ends here and is shorter, or 0."""

    classes: np.ndarray
    table: np.ndarray
    own: np.ndarray
    longer: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Automaton:
        """Of distinct words, none empty. States are numbered by depth, so a state's rows can be made from those of shorter ones."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        used = np.unique(flat)
        classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        classes[used] = np.arange(1, len(used) + 1)  # column 0: bytes of no word
        width = len(used) + 1
        rows, own, fail, longer = [np.zeros((1, width), np.int32)], [np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at, alive, depth, states = np.zeros(len(words), np.int64), np.arange(len(words)), 0, 1
        below = 0  # states above the last level
        while len(alive):
            step = at[alive] * width + classes[flat[start[alive] + depth]]
            found, of = np.unique(step, return_inverse=True)
            parent, column = found // width, found % width
            made = states + np.arange(len(found))
            level = rows[-1]
            # where the parent's longest proper suffix goes with this byte; of the root's children it is the root
            back = np.concatenate(rows)[fail[-1][parent - below], column] if depth else np.zeros(len(found), np.int64)
            level[parent - below, column] = made
            at[alive] = made[of]
            ends = sizes[alive] == depth + 1
            mine = np.full(len(found), -1)
            mine[at[alive[ends]] - states] = alive[ends]
            every, last = np.concatenate(own), np.concatenate(longer)
            rows = [np.concatenate(rows)]
            longer.append(np.where(every[back] >= 0, back, last[back]))
            own.append(mine)
            fail.append(back)
            rows.append(rows[0][back].copy())
            below, states, depth = states, states + len(found), depth + 1
            alive = alive[~ends]
        return cls(classes, np.concatenate(rows), np.concatenate(own), np.concatenate(longer), sizes)

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, first byte) of every occurrence, overlapping and nested ones too. at: where each text begins in data, and the end of the last."""
        reach = int(self.sizes.max(initial=1)) - 1
        length = np.diff(at)
        lanes = -(-length // STRETCH)
        of = np.repeat(np.arange(len(lanes)), lanes)
        part = at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        stop = np.minimum(part + STRETCH, at[of + 1])
        place = np.maximum(part - reach, at[of])
        state = np.zeros(len(of), np.int64)
        column = self.classes[data]
        ends = (self.own >= 0) | (self.longer > 0)
        texts, words, begins = [], [], []
        while len(place):
            state = self.table[state, column[place]].astype(np.int64)
            hit = np.flatnonzero(ends[state] & (place >= part))
            s, lane = state[hit], hit
            s = np.where(self.own[s] >= 0, s, self.longer[s])
            while len(s):
                word = self.own[s]
                texts.append(of[lane])
                words.append(word)
                begins.append(place[lane] - self.sizes[word] + 1 - at[of[lane]])
                s = self.longer[s]
                s, lane = s[s > 0], lane[s > 0]
            place = place + 1
            live = place < stop
            if not live.all():
                of, part, stop, place, state = of[live], part[live], stop[live], place[live], state[live]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(texts), join(words), join(begins)


def automata(words: list[str], cells: int = CELLS) -> list[tuple[int, Automaton]]:
    """One automaton, or several of at most about `cells` table cells, each with the place of its first word."""
    coded = [w.encode() for w in words]
    columns = len(set(b"".join(coded))) + 1
    found, part, states = [], 0, 0
    for i, w in enumerate(coded):
        if i > part and (states + len(w)) * columns > cells:
            found.append((part, Automaton.of(coded[part:i])))
            part, states = i, 0
        states += len(w)
    return [*found, (part, Automaton.of(coded[part:]))] if coded else []


def _steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def with_terms(df: DataFrame, column: str, terms: list[str], name: str = "terms", *, cells: int = CELLS) -> DataFrame:
    """Add the terms that a text contains, in the order of the list, each with how often it occurs (overlaps counted) and the character of its first
    occurrence, from 0.

    The same as a `contains` for each term: terms are substrings, whatever stands around them, and case counts. Of equal terms the first
    counts, empty ones never occur; null texts have null, texts without any an empty array. A list is a rule's or a
    vocabulary's: it goes to all tasks, an automaton of it takes at most 4 bytes times `cells`. A column of the name is replaced.
    """
    words = list(dict.fromkeys(t for t in terms if t))
    shared = df.sparkSession.sparkContext.broadcast((words, automata(words, cells)))
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T._parse_datatype_string(HITS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = shared.value
        spelled = pa.array(words, pa.string())
        for whole in batches:
            for batch in _steps(whole, column):
                texts = batch[column].cast(pa.large_string())
                filled = pc.fill_null(texts, "")
                _, offsets, raw = filled.buffers()
                at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
                data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
                at = at - at[0]
                found = [(t, w + first, b) for first, a in parts for t, w, b in [a.hits(data, at)]]
                text, word, begin = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or ((), (), ())))
                order = np.lexsort((begin, word, text))
                text, word, begin = text[order], word[order], begin[order]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])])) if len(text) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(text)))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                first = points[at[text[new]] + begin[new]] - points[at[text[new]]]
                lists = np.searchsorted(text[new], np.arange(batch.num_rows + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([spelled.take(pa.array(word[new])), pa.array(n, pa.int64()), pa.array(first, pa.int32())], ["term", "n", "first"])
                array = pa.ListArray.from_arrays(pa.array(lists), values, mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], array], names=schema.names)

    return df.mapInArrow(run, schema)


def term_list(df: DataFrame, column: str, most_bytes: int = 16 << 20) -> list[str]:
    """A column's distinct values, sorted, for a list of terms; more than most_bytes of them is an error, as the list goes to all tasks."""
    values = df.select(F.col(column).alias("t")).where("t <> ''").distinct()
    size = values.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes of terms; {most_bytes} are allowed")
    return [r["t"] for r in values.orderBy("t").toLocalIterator()]


def matched_rules(df: DataFrame, column: str, rules: list[tuple[str, str]], name: str = "rule", *, cells: int = CELLS) -> DataFrame:
    """Add the group of the first term, in the order of the rules (term, group), that a text contains; null if none."""
    groups: dict[str, str] = {}
    for term, group in rules:
        groups.setdefault(term, group)
    hit = with_terms(df.drop(name), column, list(groups), "_terms", cells=cells)
    table = df.sparkSession.createDataFrame(list(groups.items()), "_term string, _group string")
    named = hit.withColumn("_term", F.get("_terms", F.lit(0))["term"]).join(F.broadcast(table), "_term", "left")  # the list that the tasks hold already
    return named.withColumnRenamed("_group", name).drop("_term", "_terms")
