"""Packing (operator 10): bounded-space online packing into sequences of a fixed length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, table, text_of
from .tokens import encoder, tokenizer_path

WIDTH, OPEN, LEAST_PIECE, FAN, END_ID = 2048, 64, 16, 8, 1
MERGED = 1 << 29
"""Sequence numbers are (partition << 32) + a count; those of merged leftovers begin at partition MERGED."""
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """At most ``most`` open windows. A piece goes where it fits best; where none fits, the fullest is emitted.

    ``least``: the fullest window's gap is filled from the piece if it is that long or longer, so at most least-1
    ids of padding remain in an emitted window.
    """

    def __init__(self, width: int, most: int, least: int, emit):
        self.width, self.most, self.least, self.emit = width, most, least, emit
        self.gaps: list[tuple[int, int]] = []  # (gap, window number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def _open(self, piece: tuple, n: int) -> None:
        self.made += 1
        self.held[self.made] = [piece]
        if n < self.width:
            bisect.insort(self.gaps, (self.width - n, self.made))
        else:
            self.emit(self.held.pop(self.made))

    def put(self, doc, start: int, ids: memoryview, total: int) -> None:
        """ids: bytes of at most ``width`` ids that begin at ``start`` of their document."""
        n = len(ids) // 4
        at = bisect.bisect_left(self.gaps, (n, 0))
        if at < len(self.gaps):
            gap, k = self.gaps.pop(at)
            self.held[k].append((doc, start, ids, total))
            if gap > n:
                bisect.insort(self.gaps, (gap - n, k))
            else:
                self.emit(self.held.pop(k))
            return
        if len(self.held) >= self.most:
            gap, k = self.gaps.pop(0)
            if gap >= self.least:
                self.held[k].append((doc, start, ids[: 4 * gap], total))
                ids, start, n = ids[4 * gap :], start + gap, n - gap
            self.emit(self.held.pop(k))
        self._open((doc, start, ids, total), n)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, width: int = WIDTH, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone. Each partition packs what it reads with
    ``open_windows`` windows; what is left open goes, FAN partitions together, into full sequences cut freely.
    Repeated rows are packed again each time; null ids are kept. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    kind = dict(docs.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")
    id_type = docs.select(id_col).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover", "ids"]
    types = [arrow_id, *[pa.int64()] * 6, pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pid = encoder(path, core=True), TaskContext.get().partitionId()
        rows: list[tuple] = []
        count = 0

        def emit(window: list) -> None:
            nonlocal count
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, (pid << 32) + count, at, None, None))
                at += n
            count += 1

        windows = Windows(width, open_windows, LEAST_PIECE, emit)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                for doc, ids in zip(part.column(0).to_pylist(), tok.ids(text_of(part)), strict=True):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for start in range(0, total, width):
                        # a copy of the last piece, so that a window doesn't keep a long document alive
                        piece = ids[4 * start : 4 * (start + width)]
                        windows.put(doc, start, piece if total <= width else memoryview(bytes(piece)), total)
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows.clear()
        for k, (_, number) in enumerate(windows.gaps):
            for doc, start, ids, total in windows.held[number]:
                rows.append((doc, start, len(ids) // 4, None, total, None, None, (pid << 12) + k, bytes(ids)))
        if rows:
            yield batch_of(rows)

    def merge(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in types[:7]], names=names[:7])
        t = t.sort_by([("leftover", "ascending"), (id_col, "ascending"), ("start", "ascending")])
        group = (t.column("leftover")[0].as_py() >> 12) // FAN
        rows, count, at = [], 0, 0
        for doc, start, total, ids in zip(*(t.column(x).to_pylist() for x in (id_col, "start", "doc_tokens", "ids")), strict=True):
            ids = memoryview(ids)
            while len(ids):
                n = min(len(ids) // 4, width - at)
                rows.append((doc, start, n, zlib.crc32(ids[: 4 * n]), total, ((MERGED + group) << 32) + count, at))
                ids, start, at = ids[4 * n :], start + n, at + n
                if at == width:
                    count, at = count + 1, 0
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=False)], names=names[:7])

    first = docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {PIECE}, leftover long, ids binary")
    first = materialize(first, "packing")
    left = first.where("leftover is not null").groupBy(F.expr(f"shiftright(leftover, 12) div {FAN}")).applyInArrow(merge, f"`{id_col}` {kind}, {PIECE}")
    return first.where("leftover is null").drop("leftover", "ids").unionByName(left)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
