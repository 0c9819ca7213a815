import json

import pytest
from pyspark.sql import functions as F

from weftgraph.plans.binding import Graph
from weftgraph.sources import corpora, files, store


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    for name, body in {"src/a.clj": b"(ns a)", "src/b.cljs": b"\xff\xfe bad", "src/c.bin.clj": b"x\0y", "src/big.clj": b"x" * 3000, "vendor/d.clj": b"1", "README.md": b"#", "deps.edn": b"{}", "src/target/e.clj": b"2"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return str(root)


def test_discover(spark, project):
    found = files.decoded(files.discover(files.listing(spark, project), exclude=["vendor", "target"], max_bytes=2000))
    rows = {r.path: r for r in found.collect()}
    assert {k: r.skipped for k, r in rows.items()} == {"src/a.clj": None, "src/b.cljs": None, "src/c.bin.clj": "binary-file", "src/big.clj": "file-too-large", "vendor/d.clj": "excluded", "README.md": "unsupported", "deps.edn": None, "src/target/e.clj": "excluded"}
    assert rows["src/b.cljs"].malformed and not rows["src/a.clj"].malformed and rows["src/b.cljs"].text.startswith("�")
    assert rows["deps.edn"].language == "edn"


def test_byte_ranges(spark):
    r = spark.createDataFrame([("aé🙂b",)], "s string").select(files.extract_bytes(F.col("s"), F.lit(1), F.lit(7)).alias("x"), files.byte_offset(F.col("s"), F.lit(3)).alias("n")).first()
    assert (r.x, r.n) == ("é🙂", 7)


def test_store(spark, data, tmp_path):
    g = Graph(spark, data)
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.state() == "empty"
    with pytest.raises(ValueError):
        s.latest()
    first = s.write(g.tables())
    assert s.state() == "ready" and first.files.count() == 25
    broken = dict(first.tables())
    broken["files"] = broken["files"].limit(3)
    with pytest.raises(ValueError, match="missing file_id"):
        s.write(broken)
    assert s.latest().manifest == first.manifest
    after = s.delete_files(first.files.where("modified_at < 2"))
    assert after.files.count() == 23 and s.latest().manifest["generation"] == after.manifest["generation"] and first.files.count() == 25
    copy = s.compact_copy(f"file://{tmp_path}/copy", 1)
    assert copy.manifest["counts"] == after.manifest["counts"]
    assert s.cleanup(1) == [first.manifest["generation"]]


def test_corpora(spark, tmp_path):
    old = [{"id": "q1", "language": "clj", "query_type": "lookup", "query": "x", "relevance": {"a/b": 2, "a/c": 1}, "hard_negatives": ["a/z"]}]
    new = [{"id": "q2", "domain": "d", "query": "y", "relevance": [{"qualified_name": "a/b", "kind": "function", "grade": 1}], "hard_negatives": [{"qualified_name": "a/z"}]}]
    for n, x in (("old", old), ("new", new)):
        (tmp_path / f"{n}.json").write_text(json.dumps(x))
    rows = {r.id: r for r in corpora.read(spark, f"{tmp_path}/*.json").collect()}
    assert sorted((x.qualified_name, x.grade) for x in rows["q1"].relevance) == [("a/b", 2), ("a/c", 1)] and rows["q1"].hard_negatives[0].qualified_name == "a/z"
    assert rows["q2"].relevance[0].kind == "function"
    symbols = spark.createDataFrame([("s1", "a/b", "clj", "f", "function"), ("s2", "a/b", "cljs", "f", "type"), ("s3", "a/c", "clj", "f", "function")], "id string, qualified_name string, platform string, file string, kind string")
    status = {(r.query_id, r.qualified_name): r.status for r in corpora.resolve(corpora.read(spark, f"{tmp_path}/*.json"), symbols).collect()}
    assert status == {("q1", "a/b"): "ambiguous", ("q1", "a/c"): "ok", ("q2", "a/b"): "ok"}
