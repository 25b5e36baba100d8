"""Media columns: payloads in archives, read by byte ranges and checked member by member.

``media_archive`` is a Spark data source over a folder of zip archives with
stored (already compressed) members. Each writing task makes one archive in the
shared folder and beside it an index of its members' offsets; a manifest written
on commit names those that count and where in the index each byte range begins.
Reading plans partitions by byte range, of which each reads its own lines of the
index only, streams payload batches through Arrow and tries each member again by
its own offset where a read fails.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from siftloom.llm.common import fresh_path, small_batches
from siftloom.session import ship

#: Samples of a row of an image; payloads are padded to a multiple of it.
WIDTH = 64
LEVEL = 6
#: Bytes of an archive that a reading task takes, and of the ranges that the manifest tells, of which it takes several.
SPLIT_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
BATCH_BYTES, BATCH_MEMBERS = 4 << 20, 256
ATTEMPTS = 3
MANIFEST, INDEX = "_manifest.json", ".index"
SCHEMA = "member string, archive string, offset bigint, payload binary, error string"


# -- images ---------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """The bytes and as many 0 bytes as make a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The padded bytes as 8-bit grey samples of a PNG image, with their length before padding as a text entry."""
    payload = padded(data)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Samples and length before padding. Raises ValueError for what :func:`to_png` does not make, or damage."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, found = 8, {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's sum differs")
        found[kind] = found.get(kind, b"") + data
        at += n + 12
    width, height, *how = struct.unpack(">IIBBBBB", found[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8)
    if how != [8, 0, 0, 0, 0] or len(rows) != height * (width + 1):
        raise ValueError("not 8-bit grey samples")
    rows = rows.reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not handled")
    return rows[:, 1:].tobytes(), int(found[b"tEXt"].partition(b"\0")[2])


def features(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and an 8 by 8 average hash."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    first = np.arange(8) * len(x) // 8
    blocks = np.stack([x[a : max(b, a + 1)].mean(0) for a, b in zip(first, [*first[1:], len(x)], strict=True)]).reshape(8, 8, 8).mean(2)
    mean = x.mean(dtype=np.float64)
    bits = np.packbits(blocks.ravel() > mean).tobytes().hex()
    return f"{len(x)}:{mean:.4f}:{x.std(dtype=np.float64):.4f}:{bits}"


# -- archives -------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass
class Range(InputPartition):
    """Members of an archive that bytes [start, end) of its index name."""

    archive: str
    start: int
    end: int


@dataclass
class Member:
    """Where an archive holds a member, with the sum of its bytes."""

    name: str
    offset: int
    size: int
    crc: int


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    members: int
    ranges: list[tuple[int, int]]


class MediaArchive(DataSource):
    """Options: path; splitbytes, what a reading task takes; rangebytes, at which a writer tells where its index stands."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema.fieldNames(), int(self.options.get("rangebytes", RANGE_BYTES)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path.rstrip("/"), split

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        found: list[InputPartition] = []
        for a in archives:
            # ranges are [offset in the archive, offset in the index], the last one the ends
            starts, last = a["ranges"][:-1], a["ranges"][-1][1]
            taken = [i for i, (at, _) in enumerate(starts) if not i or at // self.split > starts[i - 1][0] // self.split]
            found += [Range(f"{self.path}/{a['archive']}", starts[i][1], starts[j][1] if j is not None else last) for i, j in zip(taken, [*taken[1:], None], strict=True)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        rows: list[tuple] = []
        size = 0
        with Archive(partition.archive) as archive:
            for member in archive.members(partition.start, partition.end):
                payload, error = archive.member(member)
                rows.append((member.name, partition.archive, member.offset, payload, error))
                size += len(payload or b"")
                if size >= BATCH_BYTES or len(rows) >= BATCH_MEMBERS:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "archive", "offset", "payload", "error"])


class Archive:
    """An archive whose members are read by offset, each with its own attempts."""

    def __init__(self, uri: str):
        self.files, self.path = _open(uri)
        self.file: pa.NativeFile | None = None

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_: object) -> None:
        if self.file is not None:
            self.file.close()

    def opened(self) -> pa.NativeFile:
        if self.file is None or self.file.closed:
            self.file = self.files.open_input_file(self.path)
        return self.file

    def members(self, start: int, end: int) -> list[Member]:
        """The members that bytes [start, end) of the index name."""
        with self.files.open_input_file(self.path + INDEX) as f:
            f.seek(start)
            return [Member(*json.loads(line)) for line in f.read(end - start).splitlines()]

    def member(self, told: Member) -> tuple[bytes | None, str | None]:
        """The member's bytes, or null and what went wrong at the last attempt."""
        error = ""
        for attempt in range(ATTEMPTS):
            try:
                return self._read(told), None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                if self.file is not None:
                    self.file.close()
                time.sleep(0.05 * attempt)
        return None, error

    def _read(self, told: Member) -> bytes:
        file = self.opened()
        file.seek(told.offset)
        head = file.read(30)
        name, extra = struct.unpack_from("<HH", head, 26)
        file.seek(told.offset + 30 + name + extra)
        data = file.read(told.size)
        if head[:4] != b"PK\3\4" or len(data) != told.size or zlib.crc32(data) != told.crc:
            raise ValueError(f"damaged member at {told.offset}")
        return data


class ArchiveWriter(DataSourceArrowWriter):
    """Takes the columns member and payload."""

    def __init__(self, path: str, names: list[str], step: int):
        if not {"member", "payload"} <= set(names):
            raise ValueError("media_archive takes the columns member and payload")
        self.path, self.step = path.rstrip("/"), step

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name, members, at = f"{uuid.uuid4().hex}.zip", 0, 0
        ranges: list[tuple[int, int]] = []
        with files.open_output_stream(f"{root}/{name}") as out, files.open_output_stream(f"{root}/{name}{INDEX}") as index:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for batch in iterator:
                    for member, payload in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                        info = zipfile.ZipInfo(member)
                        z.writestr(info, payload)
                        if not ranges or info.header_offset // self.step > ranges[-1][0] // self.step:
                            ranges.append((info.header_offset, at))
                        line = json.dumps([member, info.header_offset, info.compress_size, info.CRC]).encode() + b"\n"
                        index.write(line)
                        at += len(line)
                        members += 1
            ranges.append((out.tell(), at))
        if not members:
            files.delete_file(f"{root}/{name}")
            files.delete_file(f"{root}/{name}{INDEX}")
        return Written(name if members else None, members, ranges)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        told = [{"archive": m.archive, "members": m.members, "ranges": m.ranges} for m in messages if m is not None and m.archive]
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m is not None and m.archive:
                files.delete_file(f"{root}/{m.archive}")
                files.delete_file(f"{root}/{m.archive}{INDEX}")


# -- operators ------------------------------------------------------------


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> None:
    """Write each whole text (null: empty) as an image into archives under ``path``; members are named by number and id."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            names = []
            for i in batch.column("doc_id").to_pylist():
                names.append(f"{nth}/" + ("" if i is None else f"{i}.png"))
                nth += 1
            media = [to_png(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["member", "payload"])

    rows.mapInArrow(run, "member string, payload binary").write.format("media_archive").option("rangebytes", range_bytes).mode("append").save(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The members of the archives under ``path``; ``error`` tells what could not be read, with a null payload."""
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


def media_features(media: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row for each member: doc_id and what its image holds; all but doc_id and error are null where reading or decoding failed."""
    rows = media.select("member", "payload", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for member, stored, error in zip(*(batch.column(c).to_pylist() for c in ("member", "payload", "error")), strict=True):
                named = member.partition("/")[2]
                doc_id = named.removesuffix(".png") if named else None
                try:
                    if stored is None:
                        raise ValueError(error)
                    payload, n = from_png(stored)
                    found.append((doc_id, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), sha256(stored).hexdigest(), features(payload), None))
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    found.append((doc_id, None, None, None, None, None, None, None, str(e)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], _NAMES)

    out = rows.mapInArrow(run, ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in zip(_NAMES, _TYPES, strict=True)))
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image, reads the archives back: a row for each row of ``docs``, as :func:`media_features` has it.

    Null texts are stored as empty ones, which are one row of zeros. Equal texts
    give equal stored bytes. Rows with null or repeated ids keep their own member.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    store_texts(docs, path, id_col, text_col)
    return media_features(read_media(spark, path), docs.select(id_col).dtypes[0][1])
