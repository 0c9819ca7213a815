"""WARC (operator 8): Zstandard archives with a dictionary in a leading skippable frame and one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, if_small, materialize, new_path, open_fs, table

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16_384, 64, 4_096
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 16
LONGEST_RECORD = 1 << 31
"""What a binary value of a column may hold."""
CRLF = b"\r\n"
REVISITS = 1 << 19
"""Pages whose roles are broadcast, of some 80 bytes each; more of them meet the pages by a shuffle."""
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LENGTH = "WARC-Payload-Length"
"""A field of our own: the bytes of the payload, which a revisit doesn't hold."""
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str | None) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = HTTP + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": _safe(url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        LENGTH: str(len(payload)),
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; ValueError where headers, lengths or digests don't hold."""
    head, sep, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.lower() in found:
            raise ValueError(f"bad header {name[:40]!r}")
        found[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in found:
            raise ValueError(f"no {name}")
    n = found["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != CRLF + CRLF:
        raise ValueError("Content-Length differs from the block's length")
    block = rest[:-4]
    if found.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block's digest differs")
    _, end, payload = block.partition(CRLF + CRLF)
    if not end:
        raise ValueError("no HTTP head")
    if found["warc-type"] == "response":
        if found.get("warc-payload-digest", f"sha1:{digest(payload)}") != f"sha1:{digest(payload)}":
            raise ValueError("the payload's digest differs")
        if found.get(LENGTH.lower(), str(len(payload))) != str(len(payload)):
            raise ValueError("the payload's length differs")
    elif payload:
        raise ValueError("a revisit with a payload")
    return {"headers": found, "payload": payload}


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive; the leading skippable frame's dictionary serves them all."""
    head = stream.read(8)
    if not head:
        return
    magic, n = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("no leading skippable frame")
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("the dictionary is cut short")
    if data[:4] == b"\x28\xb5\x2f\xfd":  # itself compressed
        data = zstandard.ZstdDecompressor().decompress(data)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    rest, size, parts, one = b"", 0, [], None
    while True:
        chunk = rest or stream.read(READ_BYTES)
        rest = b""
        if not chunk:
            break
        one = one or context.decompressobj()
        parts.append(one.decompress(chunk))
        size += len(parts[-1])
        if size > LONGEST_RECORD:
            raise ValueError("a record beyond the longest allowed")
        if one.eof:
            rest = one.unused_data
            yield b"".join(parts)
            parts, one, size = [], None, 0
    if one is not None:
        raise ValueError("the last frame is cut short")


def _dictionary(samples: list[bytes]) -> bytes:
    """Of the first records of an archive; none where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str) -> int:
    """pages: page_id, url, html, refers_to, revisit. Returns the number of records. Whole archives only get their name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        total, k = 0, 0
        out, size, context, waiting, temp = None, 0, None, [], ""

        def begin() -> None:
            nonlocal out, size, context, temp
            temp = f"{root}/_tmp-{pid:06d}-{attempt}"
            out, size = fs.open_output_stream(temp, compression=None), 0
            data = _dictionary([x[:SAMPLE_BYTES] for x in waiting])
            out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            context = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None)

        def flush() -> None:
            nonlocal out, size, k
            if out is None:
                begin()
            for x in waiting:
                frame = context.compress(x)
                out.write(frame)
                size += len(frame)
            waiting.clear()

        def close() -> None:
            nonlocal out, k
            out.close()
            fs.move(temp, f"{root}/part-{pid:06d}-{k:04d}.warc.zst")
            out, k = None, k + 1

        for batch in batches:
            for part in byte_slices(batch, "html"):
                for x in part.to_pylist():
                    waiting.append(record(x["page_id"], x["url"], (x["html"] or "").encode(), x["refers_to"], x["revisit"]))
                    total += 1
                    if out is not None or len(waiting) >= SAMPLES:
                        flush()
                        if size >= ARCHIVE_BYTES:
                            close()
        if waiting:
            flush()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    return pages.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload.

    A revisit has no payload; its payload_bytes are those that its header tells, null where it tells none. A record that
    doesn't hold raises ValueError. Archives are listed and dealt to tasks by their sizes; a folder without any gives no rows.
    """
    _, root = open_fs(path)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(name[name.index(root) :], compression=None) as stream:
                    for raw in frames(stream):
                        one = parse(raw)
                        head = one["headers"]
                        payload = one["payload"] if head["warc-type"] == "response" else None
                        rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:"), _page(head.get("warc-refers-to")), int(head[LENGTH.lower()]) if payload is None and LENGTH.lower() in head else None if payload is None else len(payload), payload))
                        held += len(raw)
                        if held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under path and returns what is read back, one row per page.

    Of the records with equal payloads of at least ``least`` bytes, those with the smallest page_id are responses and the
    others revisit that one. Null html is an empty payload. Rows with a null page_id are responses, unless another page
    has their payload; repeated rows with the smallest page_id are responses all. An empty table gives no rows, and other
    columns aren't read.

    Roles are settled on ids and digests. The pages meet only those that are to be revisits, by id and digest, so a
    payload that many pages have is no hot key; the archives are read once.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    small = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least).select("page_id", "sha1")
    first = small.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").select("sha1", "refers_to")
    again = small.join(first, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = if_small(materialize(again.select(F.col("page_id").alias("of"), F.col("sha1").alias("has"), "refers_to"), "revisits"), REVISITS)
    marked = pages.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha1") == F.col("has")), "left")
    write_archives(marked.withColumn("revisit", F.col("refers_to").isNotNull()), path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
