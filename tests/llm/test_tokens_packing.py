import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_counts(odd, empty, library):
    rows = tokens.count_tokens(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512)
    assert tokens.count_tokens(empty).count() == 0


def test_ids_are_those_of_whole_texts(library):
    own = tokens.Encoder(tokens.tokenizer_path())
    assert own.cuts
    rng = random.Random(1)
    marks = " \n\t  ab1'.,stéß中\x85\x1c🙂\u2003"
    texts = ["", " ", *["".join(rng.choice(marks) for _ in range(80)) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(2000)]]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}\n{chr(c)}  x" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.ids(texts) == want and own.lengths(texts) == [len(x) // 4 for x in want]
    assert own.ids(texts[::-1]) == want[::-1]  # now from what is kept
    fast = tokens.Encoder(tokens.tokenizer_path(), core=True)
    assert fast.core is not None and fast.ids(texts) == want


def test_little_is_kept(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    own = tokens.Encoder(tokens.tokenizer_path())
    texts = [f"word{i} and {'x' * (i % 90)} end" for i in range(400)]
    for at in range(0, 400, 10):
        assert own.lengths(texts[at : at + 10]) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts[at : at + 10]]
        assert len(own.kept) <= 50 and max(map(len, own.kept)) <= tokens.LONGEST_CACHED


def test_long_runs_of_blanks(library):
    own, fast = (tokens.encoder(tokens.tokenizer_path(), core) for core in (False, True))
    for text in (" " * 3_000_000 + "x", "\n" * 1_200_000 + "a b", "word " * 300_000, "a  b " * 100_000, "y" * 500_000, "some words, and  double blanks\n and lines <|endoftext|> " * 5000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.lengths([text]) == [len(ids)] and fast.ids([text]) == [np.array(ids, "<u4").tobytes()]
        parts = list(tokens.cut(text))
        assert "".join(parts) == text and (max(map(len, parts)) <= tokens.LONG or " a" not in text)


def test_batches_are_balanced_by_bytes():
    runs = list(tokens.batches_of(["ä" * 10] * 100 + ["x" * 500], 100))
    assert sum(map(len, runs)) == 101 and all(sum(len(x.encode()) for x in r) <= 100 or len(r) == 1 for r in runs) and len(runs) == 21


def test_other_files_take_whole_texts():
    own = tokens.encoder(tokens.tokenizer_path("word_bpe_49k.json"))
    assert not own.cuts and own.lengths(["Hello there", ""])[1] == 0


def check(rows, ids):
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= packing.WIDTH
    for doc, found in pieces.items():
        if doc not in ids:
            continue
        at = 0
        for start, n, crc, total in sorted(found):
            assert start == at and total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids[doc])
    return seqs


def test_packing(documents, library):
    rows = packing.pack(documents.repartition(3)).collect()
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in documents.collect()}
    seqs = check(rows, ids)
    padded = sum(packing.WIDTH - sum(n for _, n in s) for s in seqs.values())
    assert padded < 0.02 * sum(map(len, ids.values()))
    assert sorted({r.doc_id for r in rows}) == sorted(ids)


def test_packing_of_odd_rows(odd, empty, library):
    rows = packing.pack(odd.where("doc_id is null or doc_id <> 1")).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.collect()}
    check(rows, ids)
    assert {r.doc_id for r in rows} == set(ids) - {1}
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd.where("doc_id = 1")).count() == 2
