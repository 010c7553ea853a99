"""A data source of a folder's batches: `register_batches`, as a table and as a stream.

Files whose names hold a batch, YYYY-NNN or an ISO date, are read record by record: XML records from start to end tag, or lines of text. A plain
file is dealt into byte ranges, and a record belongs to the range where it begins; a member of a ZIP archive and a gzip
file are one partition each, read as they are unpacked, so no task holds a file.

As a stream each batch that appears in the folder is read once. The offset is the newest batch seen and the batches before it
that were not there: a late one is read when it appears, and a query that starts again from its checkpoint reads none twice.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship

FORMAT = "register_batches"
SCHEMA = "batch_id string, file string, member string, at bigint, value string"
#: Bytes of a range, of a read, and of an Arrow batch, about.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 32 << 20, 1 << 20, 4 << 20


def week_of(name: str) -> str | None:
    """The batch of a file's name: YYYY-NNN, or that of the Friday on or before an ISO date; null if it has neither."""
    if m := re.search(r"\d{4}-\d{3}(?!\d)", name):
        return m[0]
    if m := re.search(r"(\d{4})-(\d{2})-(\d{2})", name):
        try:
            day = date(*map(int, m.groups()))
        except ValueError:
            return None
        friday = day - timedelta(days=(day.weekday() - 4) % 7)
        return f"{friday.year:04d}-{(friday.timetuple().tm_yday + 6) // 7:03d}"
    return None


def weeks_between(old: str, new: str) -> list[str]:
    """The batches after old and before new: a year has 52 Fridays, or 53."""
    found, (year, n) = [], (int(old[:4]), int(old[5:]))
    while True:
        first = date(year, 1, 1)
        fridays = (date(year, 12, 31) - (first + timedelta(days=(4 - first.weekday()) % 7))).days // 7 + 1
        year, n = (year, n + 1) if n < fridays else (year + 1, 1)
        batch = f"{year:04d}-{n:03d}"
        if batch >= new:
            return found
        found.append(batch)


@dataclass
class Part(InputPartition):
    """A range of a plain file, or a member (empty: the whole) of a packed one. tags: of records; none for lines."""

    batch: str
    path: str
    member: str
    start: int
    end: int
    tags: tuple[str, ...]


def plan(path: str, range_bytes: int, tags: tuple[str, ...]) -> list[Part]:
    """The partitions of all files with a batch in their name, by batch and name."""
    fs, top = pyarrow.fs.FileSystem.from_uri(path)
    parts: list[Part] = []
    for x in sorted(fs.get_file_info(pyarrow.fs.FileSelector(top)), key=lambda x: x.base_name):
        batch = week_of(x.base_name)
        if not x.is_file or batch is None:
            continue
        low = x.base_name.lower()
        own = tags if any(s in low for s in (".xml", ".zip")) else ()
        if low.endswith(".zip"):
            with fs.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                members = [m for m in z.infolist() if m.filename.lower().endswith((".xml", ".txt"))]
            parts += [Part(batch, x.path, m.filename, 0, m.file_size, tags if m.filename.lower().endswith(".xml") else ()) for m in members]
        elif low.endswith(".gz"):
            parts.append(Part(batch, x.path, "", 0, -1, own))
        else:
            parts += [Part(batch, x.path, "", a, min(x.size, a + range_bytes), own) for a in range(0, x.size, range_bytes)]
    return sorted(parts, key=lambda p: (p.batch, p.path, p.member, p.start))


def records(stream: io.IOBase, start: int, end: int | None, tags: tuple[str, ...]) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that begin from start on and before end; the stream stands at start. Holds one record and one read."""
    begin = re.compile(rb"<((?:[\w.-]+:)?(?:" + "|".join(map(re.escape, tags)).encode() + rb"))(?=[\s>/])") if tags else None
    held, at, more = b"", start, True
    looked = 0  # bytes of held in which no record's end is

    def fill() -> bool:
        nonlocal held
        new = stream.read(READ_BYTES)
        held += new
        return bool(new)

    while more or held:
        if begin is None:
            cut = held.find(b"\n", looked)
            if cut < 0 and more:
                looked = len(held)
                more = fill()
                continue
            if end is not None and at >= end or not held:
                return
            line, held = (held[:cut], held[cut + 1 :]) if cut >= 0 else (held, b"")
            yield at, line.rstrip(b"\r")
            at, looked = at + len(line) + (cut >= 0), 0
            continue
        first = begin.search(held)
        if first is None:
            if not more:
                return
            keep = min(len(held), 256)  # a start tag's name may be cut here
            if end is not None and at + len(held) - keep >= end:
                return
            held, at = held[len(held) - keep :], at + len(held) - keep
            more = fill()
            continue
        if end is not None and at + first.start() >= end:
            return
        held, at, looked = held[first.start() :], at + first.start(), 0
        last = re.compile(rb"</" + re.escape(first[1]) + rb"\s*>")
        while (found := last.search(held, looked)) is None and more:
            looked = max(0, len(held) - 256)
            more = fill()
        if found is None:  # the file ends within a record
            yield at, held
            return
        yield at, held[: found.end()]
        held, at = held[found.end() :], at + found.end()


def read_part(part: Part, encoding: str) -> Iterator[pa.RecordBatch]:
    fs, _ = pyarrow.fs.FileSystem.from_uri(part.path) if "://" in part.path else (pyarrow.fs.LocalFileSystem(), "")
    return _read(fs, part, encoding)


def _read(fs: pyarrow.fs.FileSystem, part: Part, encoding: str) -> Iterator[pa.RecordBatch]:
    names = ["batch_id", "file", "member", "at", "value"]
    with fs.open_input_file(part.path) as f:
        if part.member:
            stream, start, end = zipfile.ZipFile(f).open(part.member), 0, None
        elif part.path.lower().endswith(".gz"):
            stream, start, end = gzip.open(f), 0, None
        else:
            start, end = part.start, part.end
            if start and not part.tags:  # the line that begins before this range is the one before's
                f.seek(start - 1)
                while (piece := f.read(READ_BYTES)) and b"\n" not in piece:
                    start += len(piece)
                start += piece.find(b"\n") if piece else 0
            f.seek(start)
            stream = f
        rows, held = [], 0
        for at, value in records(stream, start, end, part.tags):
            rows.append((at, value.decode(encoding, "replace")))
            held += len(value)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays(_columns(part, rows), names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(part, rows), names=names)


def _columns(part: Part, rows: list[tuple[int, str]]) -> list[pa.Array]:
    same = lambda v: pa.array([v] * len(rows), pa.string())
    return [same(part.batch), same(posixpath.basename(part.path)), same(part.member or None), pa.array([a for a, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())]


class _Folder:
    def __init__(self, options: dict):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.range_bytes, self.tags = int(options.get("rangebytes", RANGE_BYTES)), tuple(json.loads(options.get("tags", "[]")))

    def parts(self) -> list[Part]:
        return plan(self.path, self.range_bytes, self.tags)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return _read(pyarrow.fs.FileSystem.from_uri(self.path)[0], part, self.encoding)


class BatchReader(_Folder, DataSourceReader):
    """All batches of the folder, or those of the option `batches`."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.batches = json.loads(options.get("batches", "null"))

    def partitions(self) -> list[Part]:
        return [p for p in self.parts() if self.batches is None or p.batch in self.batches]


class BatchStream(_Folder, DataSourceStreamReader):
    """Each batch once, when it appears. A batch is what is there of it then."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": "", "missing": []}

    def latestOffset(self) -> dict:  # noqa: N802
        there = {p.batch for p in self.parts()}
        if not there:
            return getattr(self, "_last", self.initialOffset())
        newest = max(there)
        gaps = weeks_between(min(there), newest)
        self._last = {"batch": newest, "missing": [b for b in gaps if b not in there]}
        return self._last

    def partitions(self, start: dict, end: dict) -> list[Part]:
        late = set(start["missing"]) - set(end["missing"])
        return [p for p in self.parts() if start["batch"] < p.batch <= end["batch"] and p.batch not in end["missing"] or p.batch in late]

    def commit(self, end: dict) -> None:
        pass


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> BatchStream:  # noqa: N802
        return BatchStream(dict(self.options))


def _options(spark: SparkSession, path: str, tags: tuple[str, ...], encoding: str, range_bytes: int) -> dict[str, str]:
    ship(spark)
    spark.dataSource.register(BatchSource)
    return {"path": path, "tags": json.dumps(tags), "encoding": encoding, "rangebytes": str(range_bytes)}


def read_records(spark: SparkSession, path: str, tags: tuple[str, ...] = (), *, batches: list[str] | None = None, encoding: str = "utf-8", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(batch_id, file, member, at, value): the records of a folder's batches, of all or of those named; at is where a record begins in its file or member."""
    options = _options(spark, path, tags, encoding, range_bytes) | ({"batches": json.dumps(batches)} if batches is not None else {})
    return spark.read.format(FORMAT).options(**options).load()


def stream_records(spark: SparkSession, path: str, tags: tuple[str, ...] = (), *, encoding: str = "utf-8", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same as a stream: a batch that appears is read once, whether it comes in turn or late."""
    return spark.readStream.format(FORMAT).options(**_options(spark, path, tags, encoding, range_bytes)).load()
