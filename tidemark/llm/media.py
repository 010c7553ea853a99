"""Media columns: a data source over directories of archives.

`archives` is a Spark data source. Its writer packs members into ZIP archives of bounded size, uncompressed as a whole
so that each member can be read by itself; each commit adds a manifest of its archives, and archives that the writer
began but that no manifest names are not read. Its reader plans partitions by byte ranges of the archives: a partition reads the members whose header lies in its range. Members
are read one by one from their offset and are tried again by themselves; they reach Spark as Arrow batches of bounded
size. The members here are PNG images: a payload's bytes are 8-bit samples, three a pixel, 64 pixels a row.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

FORMAT = "archives"
SCHEMA = "archive string, offset bigint, name string, meta string, content binary, error string"
#: Names of manifests and of archives that the writer makes.
MANIFEST, WRITTEN = "_MANIFEST-{}.json", re.compile(r"part-[0-9a-f]{32}-\d{5}\.zip")
#: Bytes of an archive, of a partition's range and of a batch, about; tries of a member.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 16 << 20, 4 << 20, 3
#: Bytes of a row of pixels, to a positive multiple of which a payload is filled up with spaces.
ROW = 192


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI (local, or whatever pyarrow knows), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path)


def _missing(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound


def manifests(fs: pyarrow.fs.FileSystem, top: str) -> dict[str, dict]:
    """The manifests that hold: {name: {files, replaces}} of all but those that another one replaces."""
    found = {}
    for x in fs.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True)):
        if re.fullmatch(MANIFEST.format(".*"), x.base_name):
            with fs.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {n for m in found.values() for n in m["replaces"]}
    return {n: m for n, m in found.items() if n not in gone}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))
        self.keep = options.get("onerror", "fail") == "keep"

    def partitions(self) -> list[Range]:
        fs, top = open_fs(self.path)
        files = [(posixpath.join(top, n), s) for m in manifests(fs, top).values() for n, s in m["files"]]
        files += [(x.path, x.size) for x in fs.get_file_info(pyarrow.fs.FileSelector(top)) if x.path.endswith(".zip") and not WRITTEN.fullmatch(x.base_name)]
        return [Range(p, a, min(a + self.range_bytes, size)) for p, size in sorted(files) for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = sorted((x for x in z.infolist() if partition.start <= x.header_offset < partition.end), key=lambda x: x.header_offset)
        rows, size = [], 0
        for m in members:
            content, error = self._member(fs, partition.path, m)
            rows.append((posixpath.basename(partition.path), m.header_offset, m.filename, m.comment.decode(), content, error))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _member(self, fs: pyarrow.fs.FileSystem, path: str, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member from its offset, by a handle of its own each time, until its checksum is right."""
        for n in range(self.tries):
            try:
                with fs.open_input_file(path) as f:
                    head = f.read_at(30, m.header_offset)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError("no member begins there")
                    skip = sum(struct.unpack("<HH", head[26:30]))
                    content = f.read_at(m.compress_size, m.header_offset + 30 + skip)
                if m.compress_type == zipfile.ZIP_DEFLATED:
                    content = zlib.decompress(content, -15)
                if len(content) != m.file_size or zlib.crc32(content) != m.CRC:
                    raise OSError("length or checksum differs")
                return content, None
            except (OSError, zlib.error) as e:
                error = f"{posixpath.basename(path)} at {m.header_offset}: {e}"
                if n + 1 < self.tries:
                    time.sleep(0.05 * 2**n)
        if not self.keep:
            raise OSError(error)
        return None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (name, meta, content), beside what is there or, to overwrite, in its place."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.archive_bytes = int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = open_fs(self.path)
        fs.create_dir(top)
        files: list[tuple[str, int]] = []
        own = uuid.uuid4().hex  # a second try of the task has names of its own
        out = z = None

        def close() -> None:
            z.close()
            name = f"part-{own}-{len(files):05d}.zip"
            with fs.open_output_stream(posixpath.join(top, name)) as f:
                f.write(out.getbuffer())
            files.append((name, out.getbuffer().nbytes))

        for batch in iterator:
            for name, meta, content in zip(*(batch[c].to_pylist() for c in ("name", "meta", "content")), strict=True):
                if z is None:
                    out = io.BytesIO()
                    z = zipfile.ZipFile(out, "w")
                info = zipfile.ZipInfo(name)
                info.comment = (meta or "").encode()
                z.writestr(info, content or b"")
                if out.tell() >= self.archive_bytes:
                    close()
                    out = z = None
        if z is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Put one manifest in place; only then is what it replaces removed. Files that others made are left alone."""
        fs, top = open_fs(self.path)
        fs.create_dir(top)
        old = manifests(fs, top) if self.overwrite else {}
        own = uuid.uuid4().hex
        with fs.open_output_stream(posixpath.join(top, f"_{own}")) as f:
            f.write(json.dumps({"files": sorted(x for m in messages if m for x in m.files), "replaces": sorted(old)}).encode())
        fs.move(posixpath.join(top, f"_{own}"), posixpath.join(top, MANIFEST.format(own)))
        for name in [n for m in old.values() for n, _ in m["files"]]:
            if not _missing(fs, posixpath.join(top, name)):
                fs.delete_file(posixpath.join(top, name))

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = open_fs(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            if not _missing(fs, posixpath.join(top, name)):
                fs.delete_file(posixpath.join(top, name))


class ArchiveSource(DataSource):
    """format("archives"): options path, rangeBytes, tries, onError (fail or keep), archiveBytes; Spark hands them over in lower case."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def write_archives(members: DataFrame, path: str, *, mode: str = "append", **options: str) -> None:
    """Write rows (name, meta, content) as archives under a folder, beside what it holds (append) or in its place (overwrite)."""
    members.sparkSession.dataSource.register(ArchiveSource)
    members.select("name", "meta", "content").write.format(FORMAT).mode(mode).options(**options).save(path)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An RGB image of the payload, a row for each ROW bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)  # each row's first byte says: not filtered
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW // 3, len(samples), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The samples of an image that encode_png made, (height, width, 3)."""
    at, body, shape = 8, [], (0, 0)
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            w, h, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 2, 0, 0, 0]:
                raise ValueError("not an 8-bit RGB image")
            shape = (h, w)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], 3 * shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not read")
    return lines[:, 1:].reshape(*shape, 3)


def pad(content: bytes) -> bytes:
    return content + b" " * (max(ROW, -(-len(content) // ROW) * ROW) - len(content))


def feature(samples: np.ndarray) -> str:
    """Height, each channel's mean and deviation, and 64 bits of which of 8 x 9 points is brighter than the one before."""
    h = len(samples)
    flat = samples.reshape(-1, 3)
    mean, deviation = flat.mean(0), flat.std(0)
    rows, columns = np.arange(8) * h // 8, np.arange(9) * samples.shape[1] // 9
    grey = samples[rows][:, columns].sum(2, dtype=np.int64)
    bits = np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()
    return f"h={h};mean={','.join(f'{x:.2f}' for x in mean)};std={','.join(f'{x:.2f}' for x in deviation)};dhash={bits}"


def store(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", **options: str) -> None:
    """Store each row's text as an image in archives under path, with its id and length beside it.

    A null text is an empty one, a null id is kept as null; repeated rows are stored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in common.steps(batches, text, BATCH_BYTES):
            content = [(t or "").encode() for t in batch[text].to_pylist()]
            meta = [json.dumps({"id": i, "bytes": len(c)}) for i, c in zip(batch["id"].to_pylist(), content, strict=True)]
            names = [f"{n + i:09d}.png" for i in range(len(content))]
            n += len(content)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(meta, pa.string()), pa.array([encode_png(pad(c)) for c in content], pa.binary())], names=["name", "meta", "content"])

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), text)
    write_archives(common.map_texts(rows, run, "name string, meta string, content binary"), path, **options)


def describe(members: DataFrame) -> DataFrame:
    """Each image's samples read back: (archive, offset, id, n_bytes, payload, media_bytes, media_sha256, feature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "content", BATCH_BYTES):
            meta = [json.loads(x) for x in batch["meta"].to_pylist()]
            images = batch["content"].to_pylist()
            samples = [decode_png(x) for x in images]
            columns = [
                batch["archive"], batch["offset"], pa.array([x["id"] for x in meta], pa.string()), pa.array([x["bytes"] for x in meta], pa.int64()), pa.array([x.tobytes() for x in samples], pa.binary()),
                pa.array([len(x) for x in images], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in images], pa.string()), pa.array([feature(x) for x in samples], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["archive", "offset", "id", "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])

    return common.map_texts(members, run, "archive string, offset bigint, id string, n_bytes bigint, payload binary, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the texts under the shared folder and read them back with features.

    Null texts are empty ones; repeated rows are stored each; a very long text is one member, whole; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    path = common.run_dir(docs.sparkSession, "media")
    store(docs, path, doc_id=doc_id, text=text)
    return describe(read_archives(docs.sparkSession, path)).withColumn("id", F.col("id").cast(docs.schema[doc_id].dataType))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(
        F.col("id").alias(doc_id),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
