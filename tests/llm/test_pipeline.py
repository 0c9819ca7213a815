import random

import pyarrow.fs

import corpus_pipeline
from weftgraph.llm import common, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    words = [w for r in rows[:50] for w in r[1].split()]
    rng = random.Random(1)
    extra = [(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, rows[0][1], "en", "s", 5)]
    extra += [(9010 + i, " ".join(rng.sample(words, 80) + [b.text] + rng.sample(words, 80)), "en", "s", 9) for i, b in enumerate(benchmark)]
    extra += [(9020, " ".join(rng.sample(words, 60)) + " write to und.34@mail7.example.com", "en", "s", 9)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows + extra, docs.select(COLUMNS).schema).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    sf = str(tmp_path / "sf")
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in at.collect()}
        if name != "packing":
            assert at.columns == COLUMNS
    assert not {9001, 9002} & kept["language_id"] and len(kept["language_id"]) >= len(rows)
    assert 9003 not in kept["simhash_dedup"] and 9003 in kept["language_id"]
    assert {9010, 9011, 9012} <= kept["simhash_dedup"] and not {9010, 9011, 9012} & kept["decontamination"]
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "pii")).collect()]
    assert not any(pii.base_spans(t) for t in texts) and any("[EMAIL]" in t for t in texts)
    assert kept["packing"] == kept["pii"]


def test_run(spark, data):
    folder = common.open_fs(common.shared_dir(spark))
    folder[0].create_dir(folder[1], recursive=True)
    held = lambda: {x.path for x in folder[0].get_file_info(pyarrow.fs.FileSelector(folder[1]))}
    before = held()
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert [x.rsplit("/", 1)[-1].split("-")[0] for x in held() - before] == ["packing"]


def test_stages_on_no_rows_and_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, none in ((empty, True), (odd, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            assert (out.count() == 0) == none


def test_queries_are_registered():
    import re

    import __spark_entry__ as e

    names = list(e.queries())
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")}) == list(range(1, 11)) and "pipeline" in names
