"""Media columns (operator 7): payloads stored as grey images in archives, read back by a Spark data source.

An archive (``part-*.mar``) is its members' bytes, then a directory with one entry of fixed width per member, then a
footer. Entries are in the order of their members, so a byte range of the archive is found in the directory by
bisection. Planning reads nothing of an archive: ranges follow from its size, and a task reads the footer itself.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import byte_slices, new_path, open_fs, table, text_of

WIDTH = 64
ENTRY = "<qBQQQI"  # id, id is there, offset, length, payload bytes without padding, CRC-32 of the member
FOOTER = "<8sQQ"  # magic, members, where the directory begins
MAGIC = b"MEDARCH1"
ENTRY_BYTES, FOOTER_BYTES = struct.calcsize(ENTRY), struct.calcsize(FOOTER)
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
PNG = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, 64 a row; the same bytes for the same payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(data: bytes) -> bytes:
    """The samples of an image that to_image() made."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, rows = 8, [], 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", part)[1]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, sum of samples, count of padding-like zeros and a histogram of eight ranges, all integers."""
    a = np.frombuffer(payload, np.uint8)
    counts = np.bincount(a, minlength=256)
    total = int((counts * np.arange(256)).sum())
    return f"rows={len(a) // WIDTH};sum={total};zeros={counts[0]};hist=" + ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes every row's payload into archives under path, a URI all executors reach; returns the number of members.

    An archive gets its name when it is whole, and a task that runs again makes the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        k = total = at = 0
        out, entries, temp = None, [], ""

        def close() -> None:
            nonlocal out, entries, k, at, total
            out.write(b"".join(entries) + struct.pack(FOOTER, MAGIC, len(entries), at))
            out.close()
            fs.move(temp, f"{root}/part-{pid:06d}-{k:04d}.mar")
            k, total, out, entries, at = k + 1, total + len(entries), None, [], 0

        for batch in batches:
            for part in byte_slices(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), text_of(part), strict=True):
                    if out is None:
                        temp = f"{root}/_tmp-{pid:06d}-{attempt}"
                        out = fs.open_output_stream(temp)
                    raw = text.encode()
                    data = to_image(pad(raw))
                    out.write(data)
                    entries.append(struct.pack(ENTRY, key or 0, key is not None, at, len(data), len(raw), zlib.crc32(data)))
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    return docs.select(docs[id_col].cast("long"), docs[text_col].alias("text")).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


class ArchiveRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int):
        self.archive, self.first, self.last = archive, first, last


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the archives, from their listed sizes alone; members belong to the range in which they begin."""
        fs, root = open_fs(self.path)
        found: list[InputPartition] = []
        for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if info.path.endswith(".mar"):
                found += [ArchiveRange(info.path, a, a + self.range) for a in range(0, info.size, self.range)]
        return found or [ArchiveRange("", 0, 0)]

    @staticmethod
    def _footer(f, size: int) -> tuple[bytes, int, int]:
        f.seek(size - FOOTER_BYTES)
        magic, n, at = struct.unpack(FOOTER, f.read(FOOTER_BYTES))
        if magic != MAGIC or at + n * ENTRY_BYTES + FOOTER_BYTES != size:
            raise ValueError("not a whole archive")
        return magic, n, at

    @staticmethod
    def _member(fs, name: str, f, offset: int, length: int, crc: int):
        """One member by its offset. After a fault the archive is opened anew for this member only."""
        for left in range(TRIES - 1, -1, -1):
            try:
                f = f or fs.open_input_file(name)
                f.seek(offset)
                data = f.read(length)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data, f
                raise OSError(f"{name}: the member at {offset} is damaged")
            except OSError:
                f = None
                if not left:
                    raise
                time.sleep(0.1 * (TRIES - left))

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = open_fs(self.path)
        name = partition.archive
        f = fs.open_input_file(name)
        _, n, start = self._footer(f, f.size())

        def entry(i: int) -> tuple:
            f.seek(start + i * ENTRY_BYTES)
            return struct.unpack(ENTRY, f.read(ENTRY_BYTES))

        def first_from(offset: int) -> int:
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if entry(mid)[2] < offset else (low, mid)
            return low

        low, high = first_from(partition.first), first_from(partition.last)
        f.seek(start + low * ENTRY_BYTES)
        entries = list(struct.iter_unpack(ENTRY, f.read((high - low) * ENTRY_BYTES)))
        rows, held = [], 0
        for key, there, offset, length, raw, crc in entries:
            data, f = self._member(fs, name, f, offset, length, crc)
            rows.append((key if there else None, raw, data))
            held += length
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "n_bytes", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("path", uri)``: id, n_bytes, media of every member."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(json.loads(json.dumps(dict(self.options))))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", path).load()


def media_features(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's payload under path, reads it back and returns its digests and features, one row per row of docs.

    Null and empty texts: 64 zero bytes, n_bytes 0. Null ids and repeated rows are members like others; equal texts have
    equal values. An empty table makes no archive and gives no rows.
    """
    write_archives(docs, path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                media = media.as_py()
                payload = from_image(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), *cols], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read_archives(docs.sparkSession, path).mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"), new_path(spark, "media"))
