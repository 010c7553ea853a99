"""Byte-level BPE by dynamic programming over prefixes.

A token sequence is what the merges give exactly when each neighbouring pair is, so every prefix of a piece has one
valid last token: the token t that ends there and whose left neighbour, the last token of the prefix before t, may stand
beside it. The table of last tokens is the encoding: appending bytes only adds entries, an edit redoes the entries after
it, and following the table backwards spells the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Encoded pieces that a worker keeps, and pairs whose fit it keeps.
PIECES, PAIRS = 1 << 18, 1 << 18
#: Longer pieces are encoded but not kept.
KEPT_CHARS = 48
#: Characters of a text from which its pieces are not listed at once.
LONG = 1 << 22
#: White space as the tokenizer library's patterns know it (fixed values of Unicode).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str) -> regex.Pattern:
    """The pattern that cuts a text into pieces, with white space as above."""
    inside = regex.sub(r"\[([^\]]*)\\s", lambda m: f"[{m[1]}{SPACE}", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Vocabulary:
    """Tokens by rank; ids are ranks. `splits` has the two tokens that a token is merged from, `made` when (-1: a byte)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.left, self.right, self.made = (np.full(len(self.tokens), -1).tolist() for _ in range(3))
        self.reached = {}
        for token, i in ranks.items():
            if len(token) == 1:
                self.reached[token] = i
            elif len(parts := self._merged(token, i)) == 2:
                self.left[i], self.right[i], self.made[i] = ranks[parts[0]], ranks[parts[1]], i
                self.reached[token] = i
        self.longest = max(map(len, self.reached))
        self.fits: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    @classmethod
    def load(cls, lines: bytes, pattern: str) -> Vocabulary:
        """From the lines of a rank file: base64 of a token, its rank."""
        pairs = (x.split() for x in lines.splitlines() if x)
        return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def _merged(self, piece: bytes, below: int) -> list[bytes]:
        """The piece after all merges of a rank under `below`, the lowest and then leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side.

        Merges are undone from the last: whichever of the two tokens at the border was made later gives way to its part
        at the border, and no merge across the border may have come before the one just undone. Of two equal ranks the
        left one came first, so an undone merge on the right also loses to an equal one across.
        """
        limit, made = 1 << 60, self.made
        while True:
            if self.reached.get(self.tokens[a] + self.tokens[b], limit) < limit:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Add the last token of each longer prefix of the piece to those there; last[i] is for the prefix of i + 1 bytes."""
        get, fits, longest, tokens = self.reached.get, self.fits, self.longest, self.tokens
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = get(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start - 1] << 32 | token
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        ok = fits[pair] = self.fit(last[start - 1], token)
                    if ok:
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece[:80]!r}")
            last.append(token)
        return last

    def spell(self, last: list[int]) -> list[int]:
        """The tokens of a table, from its end back to its start."""
        found, end, tokens = [], len(last), self.tokens
        while end:
            found.append(last[end - 1])
            end -= len(tokens[last[end - 1]])
        return found[::-1]

    def piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.spell(self.extend(piece, []))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG:
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        out = bytearray()
        for m in self.split.finditer(text):  # no list of all pieces
            out += self.pieces[m[0]]
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Encoded pieces as they are met; the first PIECES short ones are kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.piece(piece.encode()), "<u4").tobytes()
        if len(self) < PIECES and len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids


class Encoding:
    """A text with its pieces and their tables, that can be appended to and edited without encoding all of it again."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.encoded = 0  # bytes that were looked at, over all calls
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]. Pieces before it stay (a piece looks two characters past its end at most); those
        after it are used again from the first one that begins where an old one began."""
        old_starts, old_tables, old = self.starts, self.tables, self.text
        self.text = old[:start] + new + old[end:]
        keep = 0
        ends = [*old_starts[1:], len(old)]
        while keep < len(ends) and ends[keep] + 2 <= start:
            keep += 1
        shift = len(new) - (end - start)
        after = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        self.starts, self.tables = old_starts[:keep], old_tables[:keep]
        at = old_starts[keep] if keep < len(old_starts) else len(old) if keep else 0
        for m in self.vocabulary.split.finditer(self.text, at):
            if m.start() >= start + len(new) and (i := after.get(m.start())) is not None:
                self.starts += [s + shift for s in old_starts[i:]]
                self.tables += old_tables[i:]
                return
            piece = m[0].encode()
            same = len(self.starts)
            known: list[int] = []
            if same < len(old_starts) and old_starts[same] == m.start():  # bytes that the old piece began with
                was = old[old_starts[same] : ends[same]].encode()
                common_ = next((i for i, (x, y) in enumerate(zip(was, piece, strict=False)) if x != y), min(len(was), len(piece)))
                known = old_tables[same][:common_]
            self.encoded += len(piece) - len(known)
            self.starts.append(m.start())
            self.tables.append(self.vocabulary.extend(piece, list(known)))

    def ids(self) -> list[int]:
        found = []
        bounds = [*self.starts, len(self.text)]
        for a, b, last in zip(bounds, bounds[1:], self.tables, strict=False):
            whole = self.vocabulary.ranks.get(self.text[a:b].encode())
            found += [whole] if whole is not None else self.vocabulary.spell(last)
        return found


_LOADED: dict[tuple[int, str], Vocabulary] = {}


def loaded(lines: bytes, pattern: str) -> Vocabulary:
    """One vocabulary in each worker process, with what it has kept."""
    key = hash(lines), pattern
    if key not in _LOADED:
        _LOADED[key] = Vocabulary.load(lines, pattern)
    return _LOADED[key]


def rank_lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ids (binary: little-endian unsigned 32-bit token ids) to every row; with `decoded` also the bytes they decode to.

    ranks is the path of a rank file that the driver can read. Null and empty texts have no ids; repeated rows are
    encoded alike; no special tokens. A very long text's pieces are never listed at once; an empty table gives no rows. A
    column of `docs` named as an added one is replaced.
    """
    lines = docs.sparkSession.sparkContext.broadcast(rank_lines(ranks))
    added = ["ids", "decoded"][: 1 + decoded]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(c, T.BinaryType()) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(lines.value, pattern)
        for batch in common.steps(batches, text):
            ids = [vocabulary.encode(t) if t else b"" for t in batch[text].to_pylist()]
            more = [pa.array(ids, pa.binary())] + ([pa.array([vocabulary.decode(x) for x in ids], pa.binary())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], *more], names=[f.name for f in kept] + added)

    return common.map_texts(docs, run, schema)


def digest(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: the count and hash of its ids, and the hash of what they decode to."""
    return encoded.select(
        F.col(doc_id),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
