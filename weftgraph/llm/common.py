"""Helpers shared by the training-data operators: the shared folder, durable cuts of lineage, byte-balanced batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
"""Text bytes that one inner batch of an Arrow function holds; a longer text is a batch of its own."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where there is one machine, may go without that setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch():
    """Within it materialize() notes its tables; forget() of what it gives removes those noted so far but the ones named."""

    class Made(list):
        def forget(self, *but: str) -> None:
            for path in [x for x in self if x not in but]:
                fs, root = open_fs(path)
                fs.delete_dir(root)
                self.remove(path)

    made = Made()
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back: lineage ends there, and a lost executor loses nothing.

    A table is the caller's: what reads it may be asked for at any time, so nothing removes it but scratch().forget().
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    for made in _scopes:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1 << 21


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has no more rows than ``most``, 16 MB a number.

    Beyond that the join is by a shuffle of both sides, as Spark plans it.
    """
    return F.broadcast(df) if df.count() <= most else df


BATCH_ROWS = 1_024


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most BATCH_ROWS rows where the session has no setting of its own.

    A batch is held as a whole on both sides of the pipe, and the default of 10,000 whole texts is 33 MB of ordinary ones.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of ``column`` each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def text_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def per_slice(docs: DataFrame, text_col: str, make) -> DataFrame:
    """docs with every column, each byte-balanced run of rows passed through a function of a record batch.

    make() is called once per task and returns that function; it returns a batch of the same columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for part in byte_slices(batch, text_col):
                yield change(part)

    return docs.mapInArrow(run, docs.schema)


def sample_texts(df: DataFrame, text_col: str, most: int, pieces: list[Column], group: Column | None = None, groups: int = 256) -> list[Row]:
    """Of the distinct texts of each group about ``most``, chosen by a hash of the text: rows (group, mark, *pieces).

    A group with no more distinct texts than that gives all of them, and none has a row twice, however often its texts
    repeat. Only the ``groups`` with the most distinct texts are taken; never more than 2 x most x groups rows come to the
    driver. Rows without a text or group are passed over. pieces: columns of the text alone.
    """
    mark = F.xxhash64(text_col)
    texts = df.where(F.col(text_col).isNotNull()).withColumn("group", F.lit("") if group is None else group).where("group is not null")
    sizes = texts.groupBy("group").agg(F.approx_count_distinct(mark, 0.02).alias("n")).orderBy(F.desc("n"), "group").limit(groups).collect()
    if not sizes:
        return []
    shares = {r.group: 1.1 * most / max(1, r.n) for r in sizes}
    chance = F.shiftrightunsigned(mark, 11).cast("double") / float(1 << 53)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("group")]
    # the hash comes first, as a group may be dear to tell
    picked = texts.where(chance < max(shares.values())).where(chance < F.coalesce(share, F.lit(0.0)))
    picked = picked.select("group", mark.alias("mark"), *pieces).dropDuplicates(["group", "mark"])
    return picked.orderBy("group", "mark").limit(2 * most * len(sizes)).collect()
