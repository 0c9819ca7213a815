import math
import re
import zlib
from collections import Counter

import numpy as np

from weftgraph.llm import langid, lm, rnn


def test_crc(spark, documents):
    rows = documents.select("doc_id", langid.remainder(documents.doc_id, 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_language_held_out_accuracy(spark, data):
    rows = langid.op3_language_id(spark, data).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    model = langid.learn(odd)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {2, 3, 6, 8}
    assert rows[5].lang_pred in ("en", "de", "fr")
    assert langid.identify(empty, model).count() == 0
    none = langid.learn(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_known(odd, none).collect()} == {1, None, 4, 5, 7, 9}


def test_positions_agree_with_pooling():
    model = langid.train([("en", b"the and of to in that is was"), ("fr", b"les des est une dans que pas")] * 8, steps=60)
    text = "the and of that " * 60 + "les des est une " * 60
    labels = model.label_positions(text)
    assert len(labels) == len(text.encode())
    assert Counter(labels[:700])["en"] > 500 and Counter(labels[-700:])["fr"] > 500
    assert model.predict(["the and of"])[0][0] == "en"


def numeric(f, w, eps=1e-3):
    g = np.zeros_like(w)
    for i in np.ndindex(*w.shape):
        old = w[i]
        w[i] = old + eps
        up = f()
        w[i] = old - eps
        g[i] = (up - f()) / (2 * eps)
        w[i] = old
    return g


def test_gru_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in rnn.gru_weights(rng, 4, 3, "g").items()}
    x = rng.integers(0, 4, (5, 2))
    r = rng.normal(size=(3, 2))

    def loss():
        h = np.zeros((3, 2))
        for t in range(5):
            h, _ = rnn.gru_step(w, "g", x[t], h)
        return float((h * r).sum())

    h, saved = np.zeros((3, 2)), []
    for t in range(5):
        h, s = rnn.gru_step(w, "g", x[t], h)
        saved.append(s)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    back = r.copy()
    for s in reversed(saved):
        back = rnn.gru_back(w, "g", back, s, grads)
    for k in w:
        assert np.allclose(grads[k], numeric(loss, w[k]), atol=1e-3), k


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in rnn.lstm_weights(rng, 4, 3, "l").items()}
    x = rng.integers(0, 4, (5, 2))
    r = rng.normal(size=(3, 2))

    def loss():
        h = c = np.zeros((3, 2))
        for t in range(5):
            h, c, _ = rnn.lstm_step(w, "l", x[t], h, c)
        return float((h * r).sum())

    h = c = np.zeros((3, 2))
    saved = []
    for t in range(5):
        h, c, s = rnn.lstm_step(w, "l", x[t], h, c)
        saved.append(s)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    dh, dc = r.copy(), np.zeros((3, 2))
    for s in reversed(saved):
        dh, dc = rnn.lstm_back(w, "l", dh, dc, s, grads)
    for k in w:
        assert np.allclose(grads[k], numeric(loss, w[k]), atol=1e-3), k


def tok(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def brute(rows, training):
    c = Counter(w for t in training for w in tok(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows}


def test_lm_scores(spark, data, documents, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 50)  # so that most words go through the join
    rows = lm.op5_lm_score(spark, data).collect()
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(docs, [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    assert len(rows) == len(docs)
    for r in rows:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_lm_beats_its_base_on_held_out(spark, data):
    rows = [r for r in lm.op5_lm_score(spark, data).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_is_a_distribution():
    x = lm.Lexicon([(b"", 50), (b"a", 30), (b"b", 20)], 110, 7)
    net = lm.Network.new(x)
    h = np.random.default_rng(0).normal(size=(lm.HIDDEN, 1)).astype(np.float32)
    logp = [net.outputs(h, np.array([i]))[0][0] for i in range(x.size + 1)]
    assert math.isclose(sum(math.exp(p) for p in logp), 1.0, rel_tol=1e-5)


def test_lm_scores_do_not_depend_on_partitions(spark, documents):
    docs = documents.select("doc_id", "text").limit(120)
    one, two = ({r.doc_id: r.score for r in lm.score_texts(docs.repartition(n, "text"), docs.repartition(n)).collect()} for n in (2, 5))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-4) for k in one)


def test_lm_words_beyond_the_longest(spark):
    long = "x" * (lm.LONGEST_HOT + 1)
    docs = spark.createDataFrame([(1, f"{long} a b"), (2, f"{long} {long} a")], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.score_texts(docs, docs).collect()}
    want = brute([(1, f"{long} a b"), (2, f"{long} {long} a")], [f"{long} a b", f"{long} {long} a"])
    assert all((rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == want[i][:3] and math.isclose(rows[i].base_score, want[i][3], rel_tol=1e-9) for i in want)


def test_lm_odd_rows(odd, empty):
    rows = lm.score_texts(odd, odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.score_texts(empty, odd).count() == 0
    rows = lm.score_texts(odd, empty).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def test_state_is_carried_over_windows(monkeypatch):
    x = lm.Lexicon([(b"", 50), (b"a", 30), (b"b", 20)], 110, 7)
    net = lm.Network.new(x)
    rng = np.random.default_rng(4)
    docs = [(rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 4, n).astype(np.int32)) for n in (300, 5, 70, 1)]
    whole = net.score(docs)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(whole, net.score(docs), rtol=1e-4)


def test_lm_trains_over_every_word(monkeypatch):
    monkeypatch.setattr(lm, "REFINE_LANES", 3)
    net = lm.Network.new(lm.Lexicon([(b"", 50), (b"a", 30), (b"b", 20)], 110, 7))
    rng = np.random.default_rng(6)
    docs = [(rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 4, n).astype(np.int32)) for n in (5, 300, 1, 70, 32, 64, 2, 2, 150)]
    windows, real = [], lm.Network.learn_window
    monkeypatch.setattr(lm.Network, "learn_window", lambda self, ins, outs, first, h, adam, rate: windows.append((ins, outs, first, h)) or real(self, ins, outs, first, h, adam, rate))
    before = net.w["gx"].copy()
    assert net.learn_all(iter(docs), 0.002) == sum(len(b) for _, b in docs)
    taught = Counter((a, b) for ins, outs, _, _ in windows for a, b in zip(ins[outs >= 0].tolist(), outs[outs >= 0].tolist(), strict=True))
    assert taught == Counter((a, b) for x, y in docs for a, b in zip(x.tolist(), y.tolist(), strict=True))
    assert sum(int(first.sum()) for _, _, first, _ in windows) == len(docs)
    assert all(np.abs(h).sum() > 0 for *_, h in windows[1:]) and not np.array_equal(before, net.w["gx"])


def test_lm_pieces_have_no_false_ends(monkeypatch):
    net = lm.Network.new(lm.Lexicon([(b"", 50), (b"a", 30), (b"b", 20)], 110, 7))
    taught = []
    real = lm.Network.outputs
    monkeypatch.setattr(lm.Network, "outputs", lambda self, hidden, target, grads=None: taught.extend(target.tolist()) or real(self, hidden, target, grads))
    net.train([("a b a b", False, False)])
    assert 0 not in taught and len(taught) == lm.MOST_EPOCHS
    net.train([("a b", True, True)])
    assert taught.count(0) == lm.MOST_EPOCHS


def test_language_of_repeated_texts(spark):
    texts = [("en", f"the people of the land said number {i} and that was it") for i in range(5)] + [("fr", f"les gens de la maison ont dit {i} et que dans une") for i in range(5)]
    rows = spark.range(60_000).selectExpr(f"element_at(array({', '.join(repr(x) for x, _ in texts)}), int(id % 10) + 1) lang", f"element_at(array({', '.join(repr(x) for _, x in texts)}), int(id % 10) + 1) text")
    model = langid.learn(rows)
    assert model.languages == ["en", "fr"] and model.predict(["the people of the land"])[0][0] == "en"


def test_sample_is_bounded_and_whole_for_few(spark):
    from pyspark.sql import functions as F

    from weftgraph.llm.common import sample_texts

    df = spark.range(40_000).selectExpr("if(id < 30000, 'same', concat('text ', id)) text", "if(id % 1000 = 0, 'few', 'many') kind")
    rows = sample_texts(df, "text", 100, [F.length("text").alias("n")], F.col("kind"))
    found = Counter(r.group for r in rows)
    assert found["few"] == 11 and 60 <= found["many"] <= 200 and len({(r.group, r.mark) for r in rows}) == len(rows)
    assert sample_texts(df.where("false"), "text", 100, []) == []
