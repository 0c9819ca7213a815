"""Keeping a vector index in step with the graph: markers of changed files in, documents out, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export, incremental
from ..operators.reads import symbol_records
from ..operators.resolve import document_hash
from ..sources.index import VectorIndex, encode_chunks

VERSION = "1"


def documents(g, sources: DataFrame, model: str, revision: str, limit: int = export.LIMIT) -> DataFrame:
    """Chunks of every indexable symbol: header and lines of its file. sources: (file_id, text).

    Columns: symbol_id, file_id, document_hash, model_revision, document_version, chunk_index, chunk_count, chunk.
    """
    s = symbol_records(g).where("indexable")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    head = export.document_header(s)
    src = s.select("id", "file_id", "start_line", "end_line").join(sources.select(F.col("file_id").alias("s_file"), "text"), F.col("file_id") == F.col("s_file"), "left")
    body = F.when(F.col("start_line").isNull() | (F.col("start_line") < 1), "").otherwise(F.array_join(F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)).cast("int")), "\n"))
    made = export.chunks(head.join(src.select("id", body.alias("source")), "id"), limit)
    whole = made.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"]).alias("texts")).select("id", document_hash(VERSION, model, revision, F.col("texts")).alias("document_hash"))
    files = s.select("id", "file_id")
    return made.join(whole, "id").join(files, "id").select(F.col("id").alias("symbol_id"), "file_id", "document_hash", F.lit(revision).alias("model_revision"), F.lit(VERSION).alias("document_version"), "chunk_index", "chunk_count", "chunk")


def reconcile(desired: DataFrame, index: VectorIndex, encode: Callable, dirty: DataFrame | None = None) -> dict:
    """One step: what differs between desired chunks and the index, in the files of dirty (file_id) or all, is made equal.

    Returns counts by action. Nothing is written where nothing differs, and a step that breaks off leaves the old generation.
    """
    from ..operators.traverse import cut

    want = desired if dirty is None else desired.join(dirty.select("file_id").distinct(), "file_id", "left_semi")
    have = index.indexed()
    have = have if dirty is None else have.join(dirty.select("file_id").distinct(), "file_id", "left_semi")
    want = cut(want)
    facts = want.groupBy("symbol_id", "document_hash", "model_revision").agg(F.max("chunk_count").alias("chunk_count"))
    none = index.spark.createDataFrame([], "symbol_id string, status string")
    plan = cut(incremental.reconcile_plan(facts, have.select("symbol_id", "document_hash", "model_revision", "chunk_count"), none))
    counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
    if set(counts) - {"unchanged"}:
        added = encode_chunks(want.join(plan.where("action = 'upsert'").select("symbol_id"), "symbol_id", "left_semi"), encode)
        index.replace(added, plan.where("action = 'delete'").select("symbol_id"))
    return counts


def follow(markers: DataFrame, desired: Callable[[], DataFrame], index: VectorIndex, encode: Callable, checkpoint: str):
    """A stream of markers (file_id) that keeps the index in step; each micro-batch's files are reconciled once.

    A batch that runs again finds nothing to do for what it had already written.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            reconcile(desired(), index, encode, batch.select("file_id"))

    return markers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def coverage(desired: DataFrame, index: VectorIndex) -> DataFrame:
    """One row: symbols desired and indexed as desired, and the share in percent with two digits."""
    d = desired.select("symbol_id", "document_hash").distinct()
    i = index.indexed().select("symbol_id", F.col("document_hash").alias("have"))
    j = d.join(i, "symbol_id", "left")
    n, ok = F.count("*"), F.count_if(F.col("document_hash") == F.col("have"))
    return j.agg(n.alias("desired"), ok.alias("indexed"), F.when(n == 0, 100.0).otherwise(F.round(10000 * ok / n) / 100).alias("coverage"))


class Limiter:
    """How many requests may run at once: one after backpressure for a while, then again all after some successes."""

    def __init__(self, most: int, cooldown_ms: int = 2_000, needed: int = 3):
        self.most, self.cooldown, self.needed = max(1, most), cooldown_ms, needed
        self.allowed, self.until, self.good = self.most, 0, 0

    def told(self, status: int, now: int) -> int:
        if status in (429, 503):
            self.allowed, self.until, self.good = 1, now + self.cooldown, 0
        elif now >= self.until and self.allowed < self.most:
            self.good += 1
            if self.good >= self.needed:
                self.allowed = self.most
        return self.allowed
