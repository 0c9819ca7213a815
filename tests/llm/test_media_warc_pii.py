import base64
import hashlib
import io
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import common, media, pii, rnn, warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=700))
def test_image_round_trip(raw):
    p = media.pad(raw)
    assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(raw) and media.from_image(media.to_image(p)) == p


def test_media(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    rows = media.media_features(odd, common.new_path(spark, "media")).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        p = media.pad(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_image(p)).hexdigest()
        assert r.media_bytes == len(media.to_image(p)) and r.feature == media.feature(p)
    assert media.media_features(empty, common.new_path(spark, "media")).count() == 0


def test_a_retry_that_succeeds(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    (tmp_path / "x").write_bytes(b"..member..")
    opened = []

    class Flaky:
        """Fails at the first read, then gives a damaged one, then the right one."""

        def open_input_file(self, name):
            opened.append(name)
            f = open(name, "rb")
            real = f.read
            if len(opened) == 1:
                f = type("F", (), {"seek": f.seek, "read": lambda self, n: (_ for _ in ()).throw(OSError("lost"))})()
            elif len(opened) == 2:
                f = type("F", (), {"seek": f.seek, "read": lambda self, n: b"x" * len(real(n))})()
            return f

    data, _ = media.MediaReader._member(Flaky(), str(tmp_path / "x"), None, 2, 6, zlib.crc32(b"member"))
    assert data == b"member" and len(opened) == 3


def test_ranges_give_every_member_once(spark, odd, monkeypatch):
    path = common.new_path(spark, "media")
    n = media.write_archives(odd, path)
    for size in (70, 1000, 1 << 20):
        spark.dataSource.register(media.MediaArchives)
        found = spark.read.format("media_archives").option("path", path).option("rangeBytes", str(size)).load() if size > 70 else media.read_archives(spark, path)
        assert found.count() == n


def test_damaged_member_is_told(spark, odd):
    path = common.new_path(spark, "media")
    assert media.write_archives(odd, path) == odd.count()
    fs, root = common.open_fs(path)
    name = next(x.path for x in fs.get_file_info(media.pyarrow.fs.FileSelector(root)) if x.path.endswith(".mar"))
    raw = bytearray(fs.open_input_file(name).read())
    raw[40] ^= 1
    with fs.open_output_stream(name) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, path).collect()


PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "solo"), (7, "u", "<p>one</p>"), (8, "u", "WARC/1.1\r\n\r\nnested")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' as sha1", "1 as refers_to", "'x' as payload_digest")
    rows = {r.page_id: r for r in warc.round_trip(pages, common.new_path(spark, "warc")).collect()}
    assert len(rows) == len(PAGES)
    for i, _, html in PAGES:
        b = (html or "").encode()
        assert rows[i].payload_bytes == len(b) and rows[i].payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert {i: r.refers_to for i, r in rows.items() if r.record_type == "revisit"} == {2: 1, 7: 1, 4: 3}
    assert warc.round_trip(pages.limit(0), common.new_path(spark, "warc")).count() == 0
    assert all(r.record_type == "response" for r in warc.round_trip(pages, common.new_path(spark, "warc"), least=100).collect())


def test_a_page_with_many_copies(spark, empty):
    pages = spark.range(400).selectExpr("if(id % 50 = 7, null, id) page_id", "concat('u', id) url", "if(id % 3 = 0, 'hot page', concat('page ', id)) html", "'x' sha1", "'x' refers_to")
    rows = warc.round_trip(pages, common.new_path(spark, "warc")).collect()
    hot = [r for r in rows if r.payload_digest == base64.b32encode(hashlib.sha1(b"hot page").digest()).decode()]
    assert len(rows) == 400 and len(hot) == 134 and [r.page_id for r in hot if r.record_type == "response"] == [0]
    assert all(r.refers_to == 0 and r.payload_bytes == 8 for r in hot if r.record_type == "revisit")
    assert warc.round_trip(pages.limit(0), common.new_path(spark, "warc")).count() == 0


def test_warc_over_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in warc.op8_warc(spark, data).collect()}
    first = {}
    for r in sorted(pages.collect(), key=lambda r: r.page_id):
        first.setdefault(r.html, r.page_id)
        b = r.html.encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].refers_to) == (len(b), None if first[r.html] == r.page_id else first[r.html])


def test_warc_validation():
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"Content-Length: ", b"Content-Length: 1"), good.replace(b"payload", b"paylaod"), b"HTTP/1.1 200" + good[8:], good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_frames_validation():
    import zstandard

    frame = zstandard.ZstdCompressor().compress(b"hello" * 100)
    head = struct.pack("<II", warc.SKIPPABLE, 0)
    assert list(warc.frames(io.BytesIO(head + frame + frame))) == [b"hello" * 100] * 2
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(frame)))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(head + frame[:-3])))
    samples = [(f"<html><title>{i}</title><p>" + "common words here " * 40 + "</p></html>").encode() for i in range(64)]
    d = warc._dictionary(samples)
    assert d
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    for stored in (d, zstandard.ZstdCompressor().compress(d)):
        raw = struct.pack("<II", warc.SKIPPABLE, len(stored)) + stored + b"".join(c.compress(x) for x in samples)
        assert list(warc.frames(io.BytesIO(raw))) == samples


def slow_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text("a.@1 2-+%é)03", max_size=45))
def test_base_spans(t):
    assert pii.base_spans(t) == slow_spans(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.co", "1.2.3.256", "9.9.9.9.9", "+1 (555) 123-4567", "x", "0" * 25, "+12"]), max_size=6), st.sampled_from(["", " ", "@", "."]))
def test_base_spans_of_joined_parts(parts, sep):
    t = sep.join(parts)
    assert pii.base_spans(t) == slow_spans(t)


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "@" * 300_000, "1 " * 150_000):
        pii.base_spans(t)


def test_op9(spark, data, documents):
    rows = {r.doc_id: r for r in pii.op9_pii(spark, data).collect()}
    for d in documents.collect():
        spans = slow_spans(d.text)
        r = rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",") if r.spans else [])


def test_tagger_adds_other_writings(documents):
    rng = np.random.default_rng(0)
    spans = {"email": "der.{}@mail7.example.com", "ip": "93.14.{}.7", "phone": "+1 (0{}) 555-7713"}
    texts = [r.text for r in documents.collect()]
    sample = [t[max(0, p - 200) : p + 300] for t in texts for p in [max(0, len(t) // 2)]]
    sample += [s[:100] + " " + v.format(i) + " " + s[100:200] for i, s in enumerate(sample[:150], 10) for v in spans.values() if i < 90]
    tagger = pii.train(sample, steps=160)
    hits = 0
    for i in range(30):
        text = f"the people said {40 + i}.{i}.9[.]77 wasn't it"
        text = f"It was on the land of those {['email', 'phone'][i % 2]} "
        new = pii.rewritten(rng, *[("email", f"und.{i}@mail3.example.com"), ("phone", f"+1 (2{i + 10}) 555-1234")][i % 2])
        whole = text + new + " from the house that is there"
        if any(s[1] < len(text) + len(new) and s[2] > len(text) for s in slow_spans(whole)):
            continue
        hits += any((a, b) == (len(text), len(text) + len(new)) for _, a, b in tagger.find([whole])[0][1])
    assert hits >= 8
    clean = ["The people of this land go to the house and stay, 12 of them in 1999."] * 5
    assert all(not whole for _, whole in tagger.find(clean))


def best_path(tr, scores, begins=True, ends=True):
    """Plain Viterbi over one sequence (steps, 3)."""
    best = [float(scores[0][k]) + (-1e4 * (k == pii.IN) if begins else float(tr[pii.OUT, k])) for k in range(3)]
    back = []
    for row in scores[1:]:
        step = [max(range(3), key=lambda i, k=k: best[i] + tr[i, k]) for k in range(3)]
        best = [best[step[k]] + tr[step[k], k] + row[k] for k in range(3)]
        back.append(step)
    if not ends:
        best = [best[k] + tr[k, pii.OUT] for k in range(3)]
    path = [max(range(3), key=best.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger({"tr": rng.normal(size=(3, 3)).astype(np.float32)})
    sizes = np.array([6, 1, 9, 3, 6])
    scores = rng.normal(size=(25, 3)).astype(np.float32)
    begins, ends = np.array([True, False, True, False, False]), np.array([True, False, False, True, False])
    tags = np.split(tagger.decode(scores, sizes, begins, ends), np.cumsum(sizes)[:-1])
    for got, rows, x, y in zip(tags, np.split(scores, np.cumsum(sizes)[:-1]), begins, ends, strict=True):
        assert got.tolist() == best_path(tagger.w["tr"], rows, x, y)


@pytest.mark.parametrize("lean", [0, 1, 4])
def test_windows_are_reconciled_over_the_whole_text(lean):
    rng = np.random.default_rng(lean)
    w = pii.lstm_weights(rng, pii.SYMBOLS, pii.HIDDEN, "f") | pii.lstm_weights(rng, pii.SYMBOLS, pii.HIDDEN, "b")
    w |= {"o": rng.normal(0, 2, (3, 2 * pii.HIDDEN)).astype(np.float32), "c": np.array([[lean], [0], [0]], np.float32), "tr": rng.normal(0, 0.5, (3, 3)).astype(np.float32)}
    tagger = pii.Tagger(w)
    texts = ["".join(rng.choice(list("ab 1@.x"), n)) for n in (700, 1, 0, 209, 208, 5)]
    for text, got in zip(texts, tagger.tags(texts), strict=True):
        if text:
            symbols = pii.symbols_of(text)
            _, start, low, high = rnn.windows(np.array([len(text)]), pii.CORE, pii.CONTEXT)
            e = tagger.emissions(*rnn.framed(symbols, start, low, high, pii.CORE, pii.CONTEXT, pii.PAD))[pii.CONTEXT : pii.CONTEXT + pii.CORE]
            assert got.tolist() == best_path(w["tr"], e.transpose(2, 0, 1).reshape(-1, 3)[: len(text)])


def test_long_written_addresses_count():
    host = ".".join(["part"] * 40)
    assert pii.kind_of(f"name [at] {host}") == "email" and len(host) > 120
    assert pii.kind_of(" " * 100_000 + "x") is None


def test_many_spans_are_linear(documents):
    tagger = pii.train([r.text for r in documents.limit(50).collect()], steps=20)
    text = "a.b@example.com 10.2.3.4 and " * 20_000
    began = time.perf_counter()
    base, whole = tagger.find([text])[0]
    assert len(base) == 40_000 and len(whole) >= 40_000 and time.perf_counter() - began < 60


def test_crf_gradient():
    rng = np.random.default_rng(2)
    w = pii.lstm_weights(rng, pii.SYMBOLS, pii.HIDDEN, "f") | pii.lstm_weights(rng, pii.SYMBOLS, pii.HIDDEN, "b")
    w |= {"o": rng.normal(0, 0.3, (3, 2 * pii.HIDDEN)), "c": np.zeros((3, 1)), "tr": rng.normal(size=(3, 3))}
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, y = rng.integers(97, 101, (5, 2)), rng.integers(0, 3, (5, 2))
    inside = np.ones((5, 2), bool)

    def loss():
        from itertools import product

        s = pii.Tagger(w).emissions(x, inside).astype(np.float64)
        total = 0.0
        for k in range(2):
            value = lambda p, k=k: sum(s[t, p[t], k] for t in range(5)) + sum(w["tr"][p[t - 1], p[t]] for t in range(1, 5))
            total += np.log(sum(np.exp(value(p)) for p in product(range(3), repeat=5))) - value(tuple(y[:, k]))
        return total / (2 * 8)

    g = pii._gradient(w, x, y, inside)
    for k in ("tr", "c", "o"):
        for i in list(np.ndindex(*w[k].shape))[:9]:
            old = w[k][i]
            w[k][i] = old + 1e-2
            up = loss()
            w[k][i] = old - 1e-2
            slope = (up - loss()) / 2e-2
            w[k][i] = old
            assert abs(slope - g[k][i]) < 2e-3, (k, i)


def test_windows_join_up(documents, monkeypatch):
    text = " ".join(r.text for r in documents.limit(4).collect())
    tagger = pii.train([text[:400]], steps=5)
    assert len(tagger.tags([text, "", "x"])[0]) == len(text)
    assert [len(t) for t in tagger.tags(["", ""])] == [0, 0]


def test_odd_rows(odd, empty):
    tagger = pii.learn(odd)
    rows = {r.doc_id: r for r in pii.find_personal_data(odd, tagger).collect()}
    assert rows[2].found == [] and [s.kind for s in rows[7].base] == ["email", "card"]
    out = pii.redact_texts(odd, tagger)
    assert out.columns == odd.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[2] == (None, None) and "[EMAIL]" in texts[7][0] and "[CARD]" in texts[7][0] and texts[7][1] == len(texts[7][0])
    assert pii.find_personal_data(empty, tagger).count() == 0 and pii.learn(empty).find(["a@b.co"])[0][0] == [("email", 0, 6)]


def test_redact():
    assert pii.redact("call +1 234 567 890 1 or a@b.co", [("phone", 5, 21), ("card", 6, 21), ("email", 25, 31)]) == "call [PHONE] or [EMAIL]"
    assert random.Random(0).random() and pii.redact("x", []) == "x"
