"""Audits and differences over whole tables: they agree with plain joins, and what they read holds no ids on disk."""

import time

import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.operators import narrow
from weftgraph.operators.incremental import replace_files, snapshot_difference
from weftgraph.plans.binding import Graph, lean_graph


@pytest.mark.parametrize("name", list(schema.SCHEMAS))
def test_lean_tables(spark, data, name):
    plain, lean = Graph(spark, data).tables()[name], lean_graph(spark, data).tables()[name]
    assert plain.dtypes == lean.dtypes
    assert plain.exceptAll(lean).isEmpty() and lean.exceptAll(plain).isEmpty()


def test_packed_loses_nothing(spark):
    h = "0123456789abcdef" * 2
    ids = [None, "", "a", h, "x:" + h, "y:" + h, "x:" + h.upper(), "X:" + h, "x:" + h + "\n", "x:" + h[:-1] + "g", "é:" + h, h[:31], "x" + h[1:] + "\1", "\0", "\1"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "id string").select(narrow.packed(F.col("id"))).collect()]
    assert got[0] is None and len({bytes(x) for x in got[1:]}) == len(ids) - 1
    assert len(got[4]) == 19


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_violations_of_each_rule(spark, data, few, monkeypatch):
    monkeypatch.setattr(narrow, "FEW", few)
    t = {k: v.limit(40).localCheckpoint() for k, v in Graph(spark, data).tables().items()}
    t["topics"] = t["topics"].unionByName(t["topics"])
    t["edges"] = t["edges"].withColumn("to_id", F.when(F.col("line") % 2 == 0, F.col("to_id")))
    got = {(r.table, r.rule, r.id) for r in schema.violations(t).collect()}
    want = set()
    for name, column, targets in schema.FOREIGN_KEYS:
        ids = {r.id for x in targets for r in t[x].collect()}
        want |= {(name, f"missing {column}", r.id) for r in t[name].collect() if r[column] not in ids}
    for name, df in t.items():
        ids = [r.id for r in df.collect()]
        want |= {(name, "repeated id", x) for x in ids if ids.count(x) > 1}
    assert {x[1] for x in want} >= {"repeated id", "missing to_id", "missing symbol_id"}
    assert {x for x in got if "unknown" not in x[1]} == want


def test_steps_remove_their_shuffles(spark):
    """A step leaves no shuffle files behind, and the session's setting is as it was."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum("shuffle_" in files.getAllFiles().apply(k).getName() for k in range(files.getAllFiles().size()))
    before, setting = count(), spark.conf.get(narrow.CLEANUP, None)
    narrow.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    left = time.time() + 10
    while count() > before and time.time() < left:
        time.sleep(0.1)
    assert count() <= before
    assert spark.conf.get(narrow.CLEANUP, None) == setting


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_difference_of_odd_rows(spark, few, monkeypatch):
    """Repeated ids and nulls differ as a join of all rows says, and equal rows aren't joined."""
    monkeypatch.setattr(narrow, "FEW", few)
    schema_ = "id string, x string, y long"
    old = spark.createDataFrame([("a", "1", 1), ("b", None, 1), ("c", "1", 1), ("c", "2", 1), ("d", "1", None), ("e", "1", 1), ("e", "1", 1)], schema_)
    new = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("c", "2", 1), ("e", "1", 1), ("f", None, None)], schema_)
    got = sorted((r.id, r.change) for r in snapshot_difference(old, new).collect())
    assert got == [("b", "changed"), ("c", "changed"), ("c", "changed"), ("d", "only-old"), ("f", "only-new")]
    assert snapshot_difference(old.where("id = 'a'"), new.where("id = 'a'")).isEmpty()


def test_replaced_edges_stay_without_repeats(spark, data):
    t = lean_graph(spark, data).tables()
    f = t["files"].where("modified_at = 1")
    new = {k: v.limit(0) for k, v in t.items()} | {"files": f, "symbols": narrow.within(t["symbols"], "file_id", narrow.values(f))}
    out = replace_files(t, new, ("symbols", "edges"))
    assert sorted(out) == ["edges", "symbols"]
    assert out["symbols"].count() == t["symbols"].count()
    gone = new["symbols"].select(F.col("id").alias("from_id"))
    assert out["edges"].count() == t["edges"].join(gone, "from_id", "left_anti").count()
