import json

import pytest

from tests.test_lisp import A, B, C
from weftgraph.engine import Engine
from weftgraph.operators import packets
from weftgraph.streaming import worker


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in {"src/shop/core.clj": A, "src/shop/db.clj": B, "src/ui/events.cljc": C, "test/shop/core_test.clj": "(ns shop.core-test (:require [shop.core :as c]))\n(deftest runs (c/run 1))\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    e.root = str(root)
    assert e.analyze(e.root)["files"] == 4
    return e


def test_unchanged_analysis_writes_nothing(engine):
    before = engine.graph.manifest["generation"]
    engine.analyze(engine.root)
    assert engine.graph.manifest["generation"] == before
    assert engine.analyze(engine.root, check_only=True)["files"] == 4


def test_queries(engine):
    assert {r.qualified_name for r in engine.callers("shop.core/run").collect()} == {"shop.core/later", "shop.core-test/runs"}
    assert "shop.core/helper" in {r.qualified_name for r in engine.callees("shop.core/run", True).collect()}
    assert engine.find_symbol("run")["matches"] and "shop.core/helper" in engine.find_symbol("helpr")["suggestions"]
    with pytest.raises(ValueError, match="helper"):
        engine.callers("helpr")
    assert engine.trace("shop.core/user", depth=1).truncated_by_depth
    assert {r.qualified_name for r in engine.topic("dispatchers", ":ui.events/add").collect()} == {"ui.events/click"}
    assert engine.stats().count() > 8 and "Entry points" in engine.summary()


def test_index_and_search(engine):
    first = engine.sync()
    assert first["upsert"] == engine.graph.symbols.where("indexable").count()
    generation = engine.index.generation
    assert set(engine.sync()) == {"unchanged"} and engine.index.generation == generation
    assert engine.status()["coverage"] == 100.0
    top = engine.search("shop.core/run").first()
    assert top.qualified_name == "shop.core/run" and top.is_exact
    roles = [r.role for r in engine.search("run shop core").collect()]
    assert roles == sorted(roles, key=lambda r: r != "production")
    assert engine.search("run", mode="fts").count() and engine.search("run", mode="vector").count()
    removed = engine.index.indexed().limit(1).collect()
    engine.index.replace(engine.index.documents().limit(0), engine.spark.createDataFrame([(removed[0].symbol_id,)], "symbol_id string"))
    assert engine.status()["coverage"] < 100.0
    assert engine.sync(engine.graph.files.selectExpr("id as file_id"))["upsert"] == 1


def test_follow_markers(engine, spark, tmp_path):
    spark.createDataFrame([(r.id,) for r in engine.graph.files.collect()], "file_id string").write.parquet(str(tmp_path / "in"))
    other = Engine(spark, f"file://{tmp_path}/other")
    other.store.write(engine.graph.tables())
    s = spark.readStream.schema("file_id string").parquet(str(tmp_path / "in"))
    q = worker.follow(s, other.desired, other.index, other.encode, str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and other.status()["coverage"] == 100.0


def test_context(engine):
    p = engine.context(symbol="shop.core/run", max_tokens=4000)
    assert p["symbols"][0]["name"] == "shop.core/run" and p["tokens"] <= 4000 and any(r["kind"] == "calls" for r in p["relationships"])
    small = engine.context(symbol="shop.core/run", max_tokens=300)
    assert len(small["symbols"]) < len(p["symbols"]) and small["truncated"] and small["tokens"] <= 300
    with pytest.raises(ValueError, match="takes"):
        engine.context(symbol="shop.core/run", max_tokens=10)
    text = packets.markdown(p)
    assert "## Symbols" in text and "shop.core/run calls" in text
    assert engine.context(intent="how does run save an order")["symbols"]
    plan = engine.plan("list all available modes")
    assert plan["shape"] == "set" and len(plan["seeds"]) <= 4


def test_export(engine, tmp_path, spark):
    engine.export(f"file://{tmp_path}/out", "jsonl")
    rows = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert any(r.get("qualified_name") == "shop.core/run" for r in rows)


def test_limiter():
    x = worker.Limiter(8)
    assert x.told(200, 0) == 8 and x.told(429, 10) == 1 and x.told(200, 100) == 1
    assert [x.told(200, 3000 + i) for i in range(3)] == [1, 1, 8]
