"""The queue and the windows on a stream against the same in batch."""

import pytest
from pyspark.sql import functions as F

from weftgraph.plans.q_incremental import _job_events
from weftgraph.plans.binding import Graph
from weftgraph.streaming import jobs, windows


def test_transitions():
    j = jobs.Job()
    j.apply("complete", 0)
    assert j.superseded == 1
    j.apply("enqueue", 0)
    j.apply("lease", 1)
    j.apply("lease", 2)
    assert j.status == "leased" and j.lease_until == 1 + jobs.LEASE_MS
    j.apply("retry", 5)
    assert (j.status, j.attempts, j.available_at) == ("pending", 1, 5 + 2 * jobs.BASE_MS)
    j.apply("lease", 6)
    assert j.status == "pending"  # not yet available
    j.apply("lease", 10_000)
    j.apply("complete", 10_000 + jobs.LEASE_MS)  # the lease has run out
    assert j.status == "pending" and j.superseded == 2
    for _ in range(9):
        j.status, j.lease_until = "leased", 1 << 60
        j.apply("retry", 20_000)
        if j.status == "failed":
            break
    assert j.attempts == jobs.MOST_ATTEMPTS


@pytest.fixture
def source(spark, data, tmp_path):
    ev = _job_events(Graph(spark, data)).orderBy("ts_ms")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))


def test_queue_stream_equals_batch(spark, data, source, tmp_path):
    q = jobs.stream(source).writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sorted(map(tuple, jobs.fold(_job_events(Graph(spark, data))).collect()))
    assert sorted(map(tuple, spark.table("jobs").collect())) == want


def test_tumbling_stream(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(s, "ts", "1 day", "event_type").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(e, "ts", "1 day", "event_type").collect()))


def test_coalescing_and_owners():
    j = jobs.Job()
    j.apply("enqueue", 0, "upsert", "h1")
    j.apply("lease", 1, owner="a")
    j.apply("enqueue", 2, "upsert", "h1")  # the same work joins the lease
    assert j.status == "leased" and j.owner == "a"
    for event in ("renew", "accept", "complete", "retry"):
        j.apply(event, 3, owner="b")
    assert (j.status, j.accepted_at, j.attempts, j.lease_until, j.superseded) == ("leased", None, 0, 1 + jobs.LEASE_MS, 1)
    j.apply("accept", 4, owner="a")
    assert j.accepted_at == 4
    j.apply("enqueue", 5, "upsert", "h2")  # other work takes the lease away
    assert (j.status, j.owner, j.accepted_at, j.lease_until, j.document_hash, j.attempts) == ("pending", None, None, 0, "h2", 0)
    j.apply("complete", 6, owner="a")
    assert j.status == "pending" and j.superseded == 2
    j.apply("lease", 7, owner="b")
    j.apply("complete", 8, owner="b")
    assert j.status == "none" and j.operation is None and j.completed == 1


def test_fold_without_told_columns(spark):
    rows = [(1, "enqueue", 0, 0), (1, "lease", 1, 1), (1, "enqueue", 2, 2), (1, "complete", 3, 3), (None, "enqueue", 0, 4)]
    made = {r.key: r for r in jobs.fold(spark.createDataFrame(rows, "key int, event string, ts_ms long, seq long")).collect()}
    assert made[1].status == "none" and made[1].completed == 1 and made[None].status == "pending" and made[1].owner is None
