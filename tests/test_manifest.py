"""Observations kept between analyses."""

import hashlib

from weftgraph.sources.lisp import observe
from weftgraph.sources.manifest import Observations


def test_only_changed_files_are_read(spark, tmp_path):
    texts = {"a.clj": "(ns a) (defn f [] 1)", "b.clj": "(ns b) (defn g [] 2)", "empty.clj": "", "gone.clj": "(ns gone)"}
    uri = f"file://{tmp_path}/o"

    def files():
        rows = [(p, t, hashlib.sha256(t.encode()).hexdigest()) for p, t in texts.items()]
        return spark.createDataFrame(rows, "path string, text string, content_hash string")

    read = []

    def watched(df):
        read.append(sorted(r.path for r in df.select("path").collect()))
        return observe(df)

    def run(reader="1"):
        got = Observations(spark, uri, reader).observed(files(), watched)
        assert sorted(map(str, got.collect())) == sorted(map(str, observe(files().select("path", "text")).collect()))
        return read[-1]

    assert run() == sorted(texts)
    assert run() == []
    texts["b.clj"] = "(ns b) (defn h [] 3)"
    del texts["gone.clj"]
    texts["new.clj"] = "(ns new)"
    assert tuple(Observations(spark, uri).reused(files()).first()) == (2, 2)
    assert run() == ["b.clj", "new.clj"]
    assert run(reader="2") == sorted(texts)  # another reader knows nothing
    assert len([p for p in (tmp_path / "o").iterdir() if p.is_dir()]) <= 2
    (tmp_path / "o" / "index.json").write_text("{")
    assert Observations(spark, uri, "2").active() is None and run(reader="2") == sorted(texts)
