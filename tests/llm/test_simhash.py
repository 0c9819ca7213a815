import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import simhash
from weftgraph.llm.components import components


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text("aB c\tdÉ\x85\x1c\n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("n", "bases"), [(2, 1), (60, 4), (900, 30), (700, 700)])
def test_index_is_exact(n, bases):
    rng = np.random.default_rng(n)
    c = rng.integers(0, 1 << 63, bases, dtype=np.uint64)[rng.integers(0, bases, n)]
    for _ in range(4):
        m = rng.random(n) < 0.6
        c[m] ^= np.uint64(1) << rng.integers(0, 64, m.sum()).astype(np.uint64)
    c = np.unique(c)
    a, b = simhash.forest(c[:, None], 4)
    assert len(a) < len(c)
    near = np.argwhere(np.triu(np.bitwise_count(c[:, None] ^ c[None, :]) <= 4, 1))
    assert groups(zip(a, b), range(len(c))) == groups(near, range(len(c)))


def test_wide_index_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (20, 8), dtype=np.uint64)
    c = base[rng.integers(0, 20, 400)]
    c ^= rng.integers(0, 1 << 63, c.shape, dtype=np.uint64) & rng.integers(0, 1 << 63, c.shape, dtype=np.uint64) & rng.integers(0, 1 << 63, c.shape, dtype=np.uint64)
    a, b = simhash.forest(c, 100)
    near = np.argwhere(np.triu(np.bitwise_count(c[:, None] ^ c[None, :]).sum(axis=2) <= 100, 1))
    assert groups(zip(a, b), range(400)) == groups(near, range(400))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = groups(edges, {x for e in edges for x in e})
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_near_duplicates_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    for i, (_, text) in enumerate(list(rows)):
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A B"), (2004, " ")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: slow(t or "") for i, t in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = groups(pairs, fp)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert {2, 3, 6} <= zero and {r.component_id for r in rows if r.doc_id in (2, 3, 6)} == {2}
    assert simhash.near_duplicates(empty).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_keep_one(spark, odd, empty, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x) == [1, 2, 4, 5, 7, 8, 9] and None in ids
    assert simhash.keep_one(empty).count() == 0
    base = [(r.doc_id, r.text) for r in documents.where("n_chars > 800").limit(40).collect()]
    seen, rows = set(), []
    for i, t in base:
        if t not in seen:
            seen.add(t)
            words = t.split(" ")
            words[len(words) // 2] = "changed"
            rows += [(i, t), (10_000 + i, t)]
            if jaccard(t, " ".join(words)) >= 0.88:
                rows.append((20_000 + i, " ".join(words)))
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) > 100 and not any(10_000 <= i for i in left)


def test_unlike_documents_stay(spark, documents):
    texts = {}
    for r in documents.collect():
        texts.setdefault(r.text, r.doc_id)
    rows = [(i, t) for t, i in texts.items() if len(t) > 300]
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = [(i, t) for i, t in rows if i not in left]
    assert all(max(jaccard(t, u) for j, u in rows if j != i) > 0.6 for i, t in gone)


@pytest.mark.parametrize("block", [simhash.BLOCK, 2])
def test_links_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    texts = []
    for n in (8, 9, 10, 12, 15, 20, 60, 240):  # a text, the same less or with some words at its end, or with one changed
        for _ in range(12):
            base = words(n)
            shingles = n - 4
            texts += [base, [*base, *words(max(1, round(shingles * rng.uniform(0.12, 0.4))))], base[: 4 + max(1, round(shingles * rng.uniform(0.7, 0.9)))]]
            at = rng.randrange(n)
            texts.append([*base[:at], "changed", *base[at + 1 :]])
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    close = [(4 * k + i, 4 * k + j) for k in range(len(rows) // 4) for i in range(4) for j in range(i + 1, 4)]
    near = [(a, b) for a, b in close if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    border = [p for p in close if 0.75 <= jaccard(rows[p[0]][1], rows[p[1]][1]) <= 0.85]
    assert len(border) > 40 and any(p in near for p in border) and any(p not in near for p in border)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(near, range(len(rows)))


def test_rows_that_share_an_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, one), (5, one), (5, two), (5, two)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, one), (5, two)]


def test_no_text_goes_with_another_of_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (5, a), (6, b), (7, c), (None, c), (None, a + " more")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b), (7, c)]


def test_ids_missing(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    kept = simhash.keep_one(spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(None, a), (None, b)]


def test_recall_near_the_border(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    while len(pairs) < 300:  # copies of 30 to 400 words with words changed, of similarity 0.80 to 0.88
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.randrange(1, 1 + max(1, len(copy) // 40))):
            copy[at] = "changed"
        if 0.8 <= jaccard(" ".join(words), " ".join(copy)) <= 0.88:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.98 * len(pairs)


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # each a copy with two or three words changed; many are only similar by way of others
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 4)):
            words[at] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    near = [(a, b) for a in range(150) for b in range(a + 1, 150) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(near, range(150))
