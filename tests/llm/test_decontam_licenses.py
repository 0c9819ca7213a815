import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import decontam, licenses


def slow_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return int(h.max())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=14))
def test_alignment(a, b):
    score, low, high = decontam.smith_waterman(np.array(a, np.int64), np.array(b, np.int64))
    assert score == slow_score(a, b) and 0 <= low <= high <= len(b)
    if score:
        assert slow_score(a, b[low:high]) == score


def planted(documents, benchmark):
    rng = random.Random(0)
    vocabulary = [w for r in documents.limit(80).collect() for w in r.text.split()]
    rows, truth = [], {}
    for k, item in enumerate(benchmark.collect()):
        words = item.text.split()
        edited = [rng.choice(vocabulary) if rng.random() < 0.12 else w for w in words if rng.random() > 0.04]
        for case, passage in ((0, words), (1, edited), (2, [w.upper() for w in words])):
            key = 1000 + 3 * k + case
            rows.append((key, " ".join(rng.sample(vocabulary, 150) + passage + rng.sample(vocabulary, 150))))
            truth[key] = item.item_id
    return rows, truth


def test_planted_leaks(spark, data, documents):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    rows, truth = planted(documents, benchmark)
    clean = [(i, " ".join(random.Random(i).sample([w for x in rows[:30] for w in x[1].split()], 400))) for i in range(60)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()}
    exact = {(k, v) for k, v in truth.items() if (k - 1000) % 3 != 1}
    edited = {(k, v) for k, v in truth.items() if (k - 1000) % 3 == 1}
    assert exact <= found and len(edited & found) >= 0.9 * len(edited)
    assert not any(i < 1000 for i, _ in found)
    left = {r.doc_id for r in decontam.drop_leaks(docs, benchmark).collect()}
    assert left == {i for i, _ in rows + clean} - {i for i, _ in found}


def test_recall_against_all_pairs(spark, data, documents):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    rng = random.Random(3)
    vocabulary = [w for r in documents.limit(80).collect() for w in r.text.split()]
    rows = [(r.doc_id, r.text) for r in documents.where("n_chars < 3000").limit(60).collect()]
    for k, item in enumerate(benchmark.collect()):
        for case, share in enumerate((0.1, 0.2, 0.3)):  # of the words changed
            passage = [rng.choice(vocabulary) if rng.random() < share else w for w in item.text.split()]
            rows.append((10_000 + 3 * k + case, " ".join(rng.sample(vocabulary, 40) + passage + rng.sample(vocabulary, 40))))
        half = item.text.split()
        rows.append((20_000 + k, " ".join(rng.sample(vocabulary, 60) + half[: len(half) * 2 // 3])))
    items = [(r.item_id, decontam.words(r.text)) for r in benchmark.collect()]
    want = {}
    for i, text in rows:
        text_words = decontam.words(text)
        for item, own in items:
            number = {w: k for k, w in enumerate(dict.fromkeys(own))}
            score = decontam.smith_waterman(np.array([number[w] for w in own]), np.array([number.get(w, -1) for w in text_words]))[0]
            if score >= decontam.LEAST_SCORE * decontam.MATCH * len(own):
                want[i, item] = score / (decontam.MATCH * len(own))
    found = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert len(want) > 60 and found.keys() <= want.keys() and len(found) >= 0.97 * len(want)
    assert sum(abs(found[k] - want[k]) < 1e-9 for k in found) >= 0.97 * len(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB_1é İΣσ\n.中\u0300²", max_size=12), max_size=5))
def test_word_hashes(texts):
    hashes, owner = decontam.word_hashes(texts)
    own = [(i, w) for i, t in enumerate(texts) for w in decontam.words(t)]
    assert owner.tolist() == [i for i, _ in own]
    named = {}
    for (_, w), h in zip(own, hashes.tolist(), strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    for n in (1, 2, 3):
        code, of, place = decontam.grams(hashes, owner, n)
        want = [(i, k) for i, t in enumerate(texts) for k in range(len(decontam.words(t)) - n + 1)]
        assert list(zip(of.tolist(), place.tolist(), strict=True)) == want and len(code) == len(want)


def test_seeds_are_rare(spark, data, documents):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    items = benchmark.selectExpr("item_id", "text item_text", "item_id item")
    seeds = decontam.choose_seeds(documents.selectExpr("text", "xxhash64(text) mark"), items).collect()
    grams = sum(max(1, len(decontam.words(r.text)) - 2) for r in benchmark.collect())
    assert 0.2 * grams < len(seeds) < 0.7 * grams and {r.item for r in seeds} == {r.item_id for r in benchmark.collect()}


def test_ids_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([("a-1", text), (None, "none of these words but some are here now")], "item_id string, text string")
    docs = spark.createDataFrame([("x", f"so {text} so"), ("x", f"so {text} so"), (None, "and none of these words but some are here now and")], "doc_id string, text string")
    assert sorted((str(r.doc_id), str(r.item_id), r.start_word, r.end_word) for r in decontam.find_leaks(docs, items).collect()) == [("None", "None", 1, 10), ("x", "a-1", 1, 11), ("x", "a-1", 1, 11)]
    assert decontam.drop_leaks(docs, items).count() == 0


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "der die das und ist nicht ein Haus"), (2, None), (3, ""), (4, "mail"), (None, "x"), (5, "souris sont")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, items).collect()}
    assert found == {(None, 1), (7, 4), (9, 5)}
    assert decontam.find_leaks(empty, items).count() == 0 and decontam.find_leaks(odd, items.limit(0)).count() == 0
    assert decontam.drop_leaks(odd, items).columns == odd.columns and decontam.drop_leaks(odd, items.limit(0)).count() == odd.count()
    assert decontam.drop_leaks(empty, items).count() == 0 and {2, 3} <= {r.doc_id for r in decontam.drop_leaks(odd, items).collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_patience_of_equal_lists():
    a = list("abcabcabd")
    assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


@pytest.mark.parametrize(("text", "names"), [
    ("Some words. Released under the MIT License. More", ["MIT"]),
    ("RELEASED, under the\nmit license", ["MIT"]),
    ("this WORK is now licensed under the GNU General Public License, version 3 indeed", ["GPL-3.0"]),
    ("licensed under the Apache License, Version 2.0. and Licensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
    ("Released under the BSD License.", []),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY 2.5.", []),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("This work is licensed under the GNU General Public License, version 2.1.", []),
    ("This work is licensed under the GNU Library General Public License, version 2.", []),
    ("Licensed under the Artistic License, Version 2.0.", ["Artistic-2.0"]),
    ("Licensed under the Artistic License, Version 1.0.", []),
    ("Licensed under the Educational Community License, Version 2.0.", []),
    ("This program is made available under the terms of the Eclipse Public License, Version 2.0.", ["EPL-2.0"]),
    ("This program is made available under the terms of the Eclipse Public License, Version 1.0.", []),
    ("a license to kill under the sun", []),
    ("", []),
])
def test_scan(text, names):
    assert [x[0] for x in licenses.Scanner().scan(text)] == names


@pytest.mark.parametrize(("name", "text"), [x[:2] for x in licenses.FULL])
def test_whole_texts(name, text):
    rng = random.Random(name)
    around = [f"w{i}" for i in range(300)]
    edited = [w if rng.random() > 0.04 or w.lower().strip(",.") in ("apache", "2.0", "substantial", "portions") else "changed" for w in text.split()]
    for passage in (text.split(), [w.upper() for w in text.split()], edited):
        found = licenses.Scanner().scan(" ".join(around + passage + around))
        if passage is not edited or name != "BSD-4-Clause" or found:
            assert [x[0] for x in found] == [name] or passage is edited and not found, (name, found)
            assert all(290 <= x[2] <= 330 for x in found)
    assert [x[0] for x in licenses.Scanner().scan(" ".join([*text.split(), *around, *text.split()]))] == [name] * 2


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_against_brute_force():
    rng = random.Random(2)
    for name, text, _ in licenses.FULL:
        a = licenses.words(text)
        b = [w if rng.random() > 0.08 else rng.choice(a) for w in a if rng.random() > 0.03]
        found = len(licenses.patience(a, b))
        assert 0.97 * common(a, b) <= found <= common(a, b), name


def test_long_texts_of_licence_words_are_linear():
    began = time.perf_counter()
    found = licenses.Scanner().scan("Released under the MIT License. " * 8_000)
    assert len(found) == 8_000 and time.perf_counter() - began < 20


def test_scan_finds_every_line(documents):
    lines = ["released under the mit license", "licensed under the apache license", "gnu general public license", "licensed under cc by-nc 4.0"]
    want = sum(r.text.lower().count(x) for r in documents.collect() for x in lines)
    assert licenses.scan_licenses(documents).count() == want


def test_scan_of_odd_rows(odd, empty):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0
    line = odd.selectExpr("if(doc_id in (1, 4) or doc_id is null, concat(text, ' Released under the MIT License.'), text) text", "doc_id", "'clash' as license", "'clash' as coverage")
    rows = licenses.scan_licenses(line).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "4", "None"] and {r.license for r in rows} == {"MIT"}
