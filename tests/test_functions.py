"""Functions and operators on small hand-made rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import text as X
from weftgraph.operators import evaluate, export, incremental, resolve, retrieve, traverse
from weftgraph.plans.binding import Graph


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "words"), [("parseHTTPBody2", "parse http body2"), ("swap!", "swap"), ("a-b/c", "a b c"), ("", ""), ("X", "x")])
def test_normalized_identifier(spark, raw, words):
    assert one(spark, X.normalized_identifier(F.lit(raw))) == words


def test_grams(spark):
    assert sorted(one(spark, X.grams(F.lit("aB")))) == ["a", "ab", "b"]
    assert one(spark, X.grams(F.lit(None).cast("string"))) == []


def test_terms(spark):
    assert one(spark, X.terms(F.lit("Which queries use the glass boxes?"))) == sorted({"queries", "query", "use", "glass", "boxes", "boxe"})


def test_globs():
    p = re.compile(X.glob_pattern("src/**/test_*.py"))
    assert p.match("src/a/b/test_x.py") and p.match("src/test_x.py") and not p.match("src/a/test_x/y.py")
    assert re.match(X.glob_pattern("a?c"), "abc") and not re.match(X.glob_pattern("a?c"), "a/c")


def test_paths(spark):
    assert one(spark, X.normalized_path(F.lit("a/./b/../c"))) == "a/c"
    assert one(spark, X.source_role(F.lit("src\\Vendor\\x.clj"))) == "vendor"
    assert one(spark, X.source_role(F.lit(None).cast("string"))) == "unknown"


def test_typo_limit(spark):
    assert [one(spark, X.typo_limit(F.lit(n))) for n in (1, 8, 11, 40)] == [2, 3, 4, 5]


def test_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "a", 2)], "query_id int, id string, rank int")
    jud = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "x", -1)], "query_id int, id string, grade int")
    rows = {r.query_id: r for r in evaluate.ranked_metrics(res, jud).collect()}
    assert rows[1].mrr == 1.0 and rows[1].ndcg == 1.0 and rows[1].hard_negative_first == 0
    assert rows[2].mrr == 0.5 and rows[2].hard_negative_first == 1


def test_chunk_limits():
    made = export.chunk("Name: x", "line of text\n" * 2000, limit=1000, overlap=2)
    assert len(made) > 1 and all(len(c.encode()) <= 1000 for c in made) and made[0].count("Chunk: 1/") == 1
    assert export.chunk("h", "") == ["h" + export.SEPARATOR]
    assert all(len(c.encode()) <= 800 for c in export.chunk("é" * 5000, "ü" * 9000, limit=800))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\né", max_size=30), max_size=40), st.integers(200, 900))
def test_chunks_cover_source(lines, limit):
    source = "\n".join(lines)
    made = export.chunk("head", source, limit=limit, overlap=0)
    assert "".join(c.split(export.SEPARATOR, 1)[1] for c in made) == source


def test_reconcile_truth_table(spark):
    rows = "symbol_id string, document_hash string, model_revision string, chunk_count int"
    d = spark.createDataFrame([("same", "h", "r", 1), ("pend", "h", "r", 1), ("diff", "h2", "r", 1), ("fail", "h2", "r", 1), ("new", "h", "r", 1)], rows)
    i = spark.createDataFrame([("same", "h", "r", 1), ("pend", "h", "r", 1), ("diff", "h", "r", 1), ("fail", "h", "r", 1), ("gone", "h", "r", 1)], rows)
    p = spark.createDataFrame([("pend", "pending"), ("fail", "failed"), ("only", "pending")], "symbol_id string, status string")
    assert dict(incremental.reconcile_plan(d, i, p).collect()) == {"same": "unchanged", "pend": "cancel", "diff": "upsert", "fail": "failed", "new": "upsert", "gone": "delete", "only": "cancel"}


def test_canonical_conflict(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    assert resolve.canonical(rows).count() == 2
    with pytest.raises(ValueError):
        resolve.canonical(rows.union(spark.createDataFrame([("b", 3)], "id string, v int")))


def test_resolve(spark):
    use = spark.createDataFrame([(1, "p", "n", "a"), (2, "p", "n", "b"), (3, "p", "n", "z"), (4, "p", "out", "a")], "usage_id int, platform string, ns string, name string")
    defs = spark.createDataFrame([("p", "n", "a", "s1"), ("p", "n", "b", "s2"), ("p", "n", "b", "s3")], "platform string, ns string, name string, symbol_id string")
    assert {r.usage_id: (r.classification, r.target) for r in resolve.resolve(use, defs, defs).collect()} == {1: ("exact", "s1"), 2: ("ambiguous", None), 3: ("unresolved", None), 4: ("external", None)}


class Tiny:
    """A cycle a -> b -> c -> a with d off c, and e apart."""

    def __init__(self, spark):
        self.spark = spark
        self.symbols = spark.createDataFrame([(x, x, f"ns/{x}", "function", "f1" if x < "c" else "f2") for x in "abcde"], "id string, name string, qualified_name string, kind string, file_id string")
        self.topics = spark.createDataFrame([], "id string, kind string, key string, platform string")
        pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
        self.edges = spark.createDataFrame([(f"{x}{y}", "calls", x, y, "symbol", y, "exact", 1.0, "t", None) for x, y in pairs], schema.SCHEMAS["edges"])


def test_trace(spark):
    g = Tiny(spark)
    src = g.symbols.where("id = 'a'")
    t = traverse.trace(g, src)
    assert [(r.id, r.depth) for r in t.results.orderBy("depth", "id").collect()] == [("b", 1), ("c", 2), ("d", 3)] and not t.truncated_by_depth and not t.truncated_by_limit
    t = traverse.trace(g, src, depth=2)
    assert t.truncated_by_depth and not t.truncated_by_limit
    t = traverse.trace(g, src, limit=2)
    assert t.results.count() == 2 and t.truncated_by_limit
    with pytest.raises(ValueError):
        traverse.trace(g, src, depth=0)
    with pytest.raises(ValueError):
        traverse.trace(g, g.symbols.where("id = 'nobody'"))


def test_traverse(spark):
    g = Tiny(spark)
    out = traverse.traverse(g, ["a"], depth=2, max_nodes=10)
    assert {n[0] for n in out["nodes"]} == {"a", "b", "c", "d"} and out["nodes"][0][:2] == ("a", 0.0)
    assert traverse.traverse(g, ["a"], depth=1, max_nodes=10)["truncated"]


def test_fuse_exact_first(spark):
    lex = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "id string, score double")
    sem = spark.createDataFrame([("b", 9.0), ("c", 1.0)], "id string, score double")
    out = retrieve.fuse(lex, sem, spark.createDataFrame([("c",)], "id string"))
    assert [r.id for r in out.orderBy("fused_rank").collect()] == ["c", "b", "a"]


def test_fresh_rejects_all_when_project_is_dirty(spark):
    c = spark.createDataFrame([("s", "f", "h", "r")], "symbol_id string, file_id string, document_hash string, model_revision string")
    none = spark.createDataFrame([], "symbol_id string")
    dirty = spark.createDataFrame([("project:x",)], "file_id string")
    assert retrieve.fresh(c, c, none, dirty.limit(0)).count() == 1
    assert retrieve.fresh(c, c, none, dirty).count() == 0


def test_schema_of_binding(spark, data):
    g = Graph(spark, data)
    for name, df in g.tables().items():
        want = {f.name for f in schema.struct_type(name)}
        assert want == set(df.columns), name
