"""Bookkeeping operators on small rows that meet each rule, against plain Python."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import ledger as L
from weftgraph.operators import retrieve as R


def enc(v, how=""):
    sized = lambda b: struct.pack(">i", len(b)) + b
    if v is None or isinstance(v, bool):
        return bytes([0 if v is None else 2 if v else 1])
    if isinstance(v, int):
        return b"\x06" + sized(str(v).encode())
    if isinstance(v, float):
        return b"\x08" + struct.pack(">d", v)
    if isinstance(v, str):
        return (b"\x04" if how == "keyword" else b"\x03") + sized(v.encode())
    if how == "set":
        return b"\x0c" + struct.pack(">i", len(v)) + b"".join(sized(x) for x in sorted(map(enc, v)))
    return b"\x0d" + struct.pack(">i", len(v)) + b"".join(map(enc, v))


def test_canonical_bytes(spark):
    rows = [(1, "zoë", ":fn", 2.5, True, ["b", "aa"], ["b", "aa", ""]), (2, None, None, None, None, None, None), (3, "", ":x/y", -0.0, False, [], []), (-4, "a\n", ":k", 1e300, False, [None, "x"], ["y"])]
    df = spark.createDataFrame(rows, "n long, s string, k string, d double, b boolean, seq array<string>, bag array<string>")
    names, how = {f":{c}": c for c in df.columns}, {"k": "keyword", "bag": "set"}
    made = df.select("n", L.canonical(df, names, how).alias("raw"), L.canonical_hash(L.canonical(df, names, how)).alias("h")).collect()
    for got, row in zip(made, rows, strict=True):
        items = sorted((enc(f":{c}", "keyword"), enc(v, how.get(c, ""))) for c, v in zip(df.columns, row, strict=True))
        raw = b"\x0b" + struct.pack(">i", len(items)) + b"".join(struct.pack(">i", len(k)) + k + v for k, v in items)
        assert bytes(got.raw) == raw
        assert got.h == "sha256:" + hashlib.sha256(struct.pack(">ii", 1, 1) + raw).hexdigest()
    with pytest.raises(ValueError):
        L.canonical(df.select(F.col("n").cast("timestamp").alias("t")), {":t": "t"})


def test_weighted_batches(spark):
    rows = [("a", i, w) for i, w in enumerate([5, 50, 6, 200, 1, 1, 1, 1])] + [(None, 0, 3), ("b", 0, 61), ("b", 1, 61)]
    df = spark.createDataFrame(rows, "g string, at int, weight long")
    got = {(r.g, r.at): r.batch for r in L.weighted_batches(df, "g", ["at"], 3, 60).collect()}
    assert [got["a", i] for i in range(8)] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert got[None, 0] == 0 and (got["b", 0], got["b", 1]) == (0, 1)
    assert L.weighted_batches(df.limit(0), "g", ["at"], 3, 60).count() == 0


def test_watermarks(spark):
    s = "provider string, seq long, state string, last_success_at long, last_error_at long, last_error string, graph_revision string, index_generation string"
    rows = [("p", 1, "failed", None, 10, "x" * 3000, "r1", None), ("p", 2, "ready", 20, None, None, None, "g"), ("q", 1, "failed", None, 5, "one", None, None), ("q", 2, "degraded", None, None, "two", None, None)]
    got = {r.provider: r for r in L.watermarks(spark.createDataFrame(rows, s)).collect()}
    assert (got["p"].state, got["p"].last_error, got["p"].last_error_at, got["p"].graph_revision, got["p"].index_generation) == ("ready", None, None, "r1", "g")
    assert (got["q"].last_error, got["q"].last_error_at) == ("two", 5)
    first = L.watermarks(spark.createDataFrame(rows[:1], s)).first()
    assert len(first.last_error) == L.MOST_ERROR and first.last_error_at == 10


def test_queue_of_nothing(spark):
    jobs = spark.createDataFrame([], "status string, operation string, updated_at long, accepted_at long")
    ids = spark.createDataFrame([], "symbol_id string")
    row = L.queue_counts(spark.createDataFrame([], "id string, indexable boolean"), ids, jobs, ids).first().asDict()
    assert row.pop("oldest_pending_at") is None and set(row.values()) == {0}
    assert tuple(L.pending_operations(jobs).first()) == (0, 0, False)


def test_visible(spark):
    s = "symbol_id string, h string"
    want = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", None), ("d", "1")], s)
    shown = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("b", "9"), ("c", None), ("d", "1"), ("d", "1"), ("x", "1")], s)
    got = {r.symbol_id: (r.visible, r.covered) for r in L.visible(shown, want, ["symbol_id", "h"]).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, True), "d": (False, True)}
    assert {r.visible for r in L.visible(shown.limit(0), want, ["symbol_id", "h"]).collect()} == {False}


def test_safely_rerank(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pre_rank int")
    turned = lambda df: df.withColumn("final_rank", 3 - F.col("pre_rank"))

    def broken(df):
        raise RuntimeError("gone")

    def late(df):
        raise TimeoutError("late")

    order = lambda df: [r.id for r in df.orderBy("final_rank").collect()]
    made, told = R.safely_rerank(c, turned)
    assert order(made) == ["b", "a"] and told["reordered"]
    for provider, status, reason in ((None, "unavailable", "not-configured"), (broken, "failed", "provider-error"), (late, "timed-out", "provider-error"), (lambda df: turned(df).limit(1), "failed", "identity-mismatch")):
        made, told = R.safely_rerank(c, provider)
        assert order(made) == ["a", "b"] and (told["status"], told["reason"], told["reordered"]) == (status, reason, False)


def test_sql_of_a_store(spark, tmp_path, data):
    from weftgraph.plans.binding import Graph
    from weftgraph.sources.store import Store

    made = Store(spark, f"file://{tmp_path}/s").write(Graph(spark, data).tables(), check=False)
    assert made.sql("select count(*) n from {symbols} where kind = :kind", {"kind": "namespace"}).first().n == 25
