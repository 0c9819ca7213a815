"""PII (operator 9): patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans to theirs.

The network reads a text in overlapping windows, and each character gets its scores from the window in whose core it
lies, with context on either side. The scores of all windows are reconciled over the whole text by one Viterbi pass under
the CRF's transitions: characters whose score for "outside" is above all that transitions could make up for are outside
in the best sequence, and the runs between them are decoded exactly, however many windows they cross. Tags don't name a
kind; the kind of an added span is the one whose form it has once its writing is undone, and a span without one is let go.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, per_slice, sample_texts, table, text_of
from .rnn import F32, Adam, framed, lstm_back, lstm_step, lstm_weights, windows

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")

HIDDEN, CORE, CONTEXT, BATCH = 8, 208, 24, 1536
OUT, BEGIN, IN = range(3)
STEPS, SNIPPET, TRAIN_BATCH = 220, 96, 96
SAMPLE_DOCS = 2_048
"""Training takes snippets of about SAMPLE_DOCS distinct texts, chosen by a hash, half of them with what may be a span."""


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in a time that is linear in the text: each @ with what may stand before and after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns alone, by kind as in KINDS and then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# What a writer may put for a character of an address, and how it is undone.
AT = re.compile(r"\s{0,2}(?:\(at\)|\[at\]|\{at\})\s{0,2}|\s{1,2}at\s{1,2}", re.IGNORECASE)
DOT = re.compile(r"\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\))\s{0,2}|\s{1,2}dot\s{1,2}", re.IGNORECASE)


def kind_of(written: str) -> str | None:
    """The kind whose form a span has when its writing is undone."""
    plain = DOT.sub(".", AT.sub("@", written))
    if re.fullmatch(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+", plain):
        return "email"
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain) and all(int(x) <= 255 for x in plain.split(".")):
        return "ip"
    digits = DIGITS.sub("", written)
    if re.fullmatch(r"[0-9]{4}([\x20._/ -]+[0-9]{4}){3}", written) and luhn(digits):
        return "card"
    if re.fullmatch(r"(\+|00)?[\x20]?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-]+[0-9]{3,4}[\x20./-]+[0-9]{3,4}", written) and 9 <= len(digits) <= 15:
        return "phone"
    return None


def symbol_table() -> np.ndarray:
    """A symbol for each of 128 characters; letters fold case; 127 stands for any other letter, 126 for the rest."""
    table = np.arange(128)
    table[65:91] += 32
    return table


SYMBOLS, LETTER, OTHER, PAD = 129, 127, 126, 128


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = symbol_table()[np.minimum(points, 127)]
    return np.where(points < 127, low, np.where(points >= 0xC0, LETTER, OTHER)).astype(np.uint8)


class Tagger:
    """Weights: LSTM f and b, emissions o and c, transitions tr[from, to]."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def emissions(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(time, tag, window)."""
        w, steps, n = self.w, x.shape[0], x.shape[1]
        holes = [None if row.all() else row.astype(F32) for row in inside]
        h = c = np.zeros((HIDDEN, n), F32)
        ahead = np.empty((steps, HIDDEN, n), F32)
        for t in range(steps):
            h, c, _ = lstm_step(w, "f", x[t], h, c, holes[t])
            ahead[t] = h
        h = c = np.zeros((HIDDEN, n), F32)
        both = np.empty((2 * HIDDEN, n), F32)
        out = np.empty((steps, 3, n), F32)
        for t in range(steps - 1, -1, -1):
            h, c, _ = lstm_step(w, "b", x[t], h, c, holes[t])
            both[:HIDDEN], both[HIDDEN:] = ahead[t], h
            np.matmul(w["o"], both, out=out[t])
            out[t] += w["c"]
        return out

    def decode(self, scores: np.ndarray, sizes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best tags of runs that lie one after the other in scores (m, tag), by Viterbi over all runs side by side.

        begins, ends: whether a run is where its text begins or ends; before and after any other run all is outside.
        """
        tr, tags = self.w["tr"], np.empty(len(scores), np.int8)
        order = np.argsort(-sizes, kind="stable")
        sizes, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
        first = np.where(begins[order], np.array([[0], [0], [-1e4]], F32), tr[OUT][:, None])
        last = np.where(ends[order], F32(0), tr[:, OUT][:, None])
        best = scores[start].T + first
        back = []
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) + 1)] if len(sizes) else []  # runs longer than t
        for t in range(1, len(live) - 1):
            n = live[t]
            ways = best[:, None, :n] + tr[:, :, None]
            back.append(ways.argmax(axis=0).astype(np.int8))
            best[:, :n] = ways.max(axis=0) + scores[start[:n] + t].T
        tag = (best + last).argmax(axis=0)
        for t in range(len(live) - 2, -1, -1):
            n = live[t]
            tags[start[:n] + t] = tag[:n]
            if t:
                tag[:n] = np.take_along_axis(back[t - 1], tag[None, :n], axis=0)[0]
        return tags

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """A tag for each code point of each text: the best sequence over the whole text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        total = int(sizes.sum())
        joined = np.zeros(total, np.int8)
        if total:
            symbols = symbols_of("".join(texts))
            # Where OUT leads by this much, any run of other tags would lose more than its transitions can win.
            margin = 2 * float(self.w["tr"].max() - self.w["tr"].min())
            _, start, low, high = windows(sizes, CORE, CONTEXT)
            places, found = [], []
            for at in range(0, len(start), BATCH):
                part = slice(at, at + BATCH)
                x, inside = framed(symbols, start[part], low[part], high[part], CORE, CONTEXT, PAD)
                scores = self.emissions(x, inside)[CONTEXT : CONTEXT + CORE]
                open_ = inside[CONTEXT : CONTEXT + CORE] & (scores[:, OUT] - np.maximum(scores[:, BEGIN], scores[:, IN]) <= margin)
                t, window = np.nonzero(open_)
                places.append(start[part][window] + t)
                found.append(scores[t, :, window])
            place = np.concatenate(places)
            order = np.argsort(place)
            place, scores = place[order], np.concatenate(found)[order]
            if len(place):
                edges = np.concatenate([[0], np.cumsum(sizes)])
                text = np.searchsorted(edges, place, side="right")
                new = np.append(True, (np.diff(place) > 1) | (np.diff(text) > 0))
                at = np.flatnonzero(new)
                runs = np.diff(np.append(at, len(place)))
                joined[place] = self.decode(scores, runs, np.isin(place[at], edges), np.isin(place[at + runs - 1] + 1, edges))
        return np.split(joined, np.cumsum(sizes)[:-1])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Runs of tags over whole texts."""
        out = []
        for tags in self.tags(texts):
            on = tags != OUT
            if not on.any():
                out.append([])
                continue
            edge = np.flatnonzero(on & ((tags == BEGIN) | ~np.append(False, on[:-1])))
            stop = np.flatnonzero(on & ~np.append(on[1:], False)) + 1
            ends = np.minimum(stop[np.searchsorted(stop, edge, side="right")], np.append(edge[1:], len(tags)))
            out.append(list(zip(edge.tolist(), ends.tolist(), strict=True)))
        return out

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """Per text (base spans, all spans): added ones have a kind, touch no base span and no other added one."""
        out = []
        for text, found in zip(texts, self.spans(texts), strict=True):
            base = base_spans(text)
            whole, taken = list(base), _united(base)
            for a, b in found:
                while a < b and text[a].isspace():
                    a += 1
                while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                    b -= 1
                kind = kind_of(text[a:b]) if a < b else None
                at = bisect.bisect_left(taken[1], a + 1)  # the first taken stretch that ends after a
                if kind and (at == len(taken[0]) or taken[0][at] >= b):
                    whole.append((kind, a, b))
            whole.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
            out.append((base, whole))
        return out


def _united(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Where the union of spans begins and ends, stretch by stretch."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def rewritten(rng: np.random.Generator, kind: str, text: str) -> str:
    """A span in another writing, for training."""
    way = int(rng.integers(0, 3))
    if kind == "email":
        at = (" at ", " [at] ", " (at) ")[way]
        return text.replace("@", at).replace(".", (" dot ", " [dot] ", " (dot) ")[way]) if way < 2 else text.replace("@", at)
    if kind == "ip":
        return text.replace(".", ("[.]", "[dot]", "(.)")[way])
    digits = DIGITS.sub("", text)
    if kind == "card" and len(digits) == 16:
        return ("/", ".", "_")[way].join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[way]
    return text


def labelled(rng: np.random.Generator, text: str) -> tuple[str, np.ndarray]:
    """At most SNIPPET characters around a span of text, some spans in another writing, and a tag for each."""
    spans = base_spans(text)
    if not spans:
        at = int(rng.integers(0, max(1, len(text) - SNIPPET)))
        part = text[at : at + SNIPPET]
        return part, np.zeros(len(part), np.int8)
    parts, tags, last = [], [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < last:
            continue
        span = rewritten(rng, kind, text[a:b]) if rng.random() < 0.5 else text[a:b]
        parts += [text[last:a], span]
        tags += [np.zeros(a - last, np.int8), np.array([BEGIN] + [IN] * (len(span) - 1), np.int8)]
        last = b
    parts.append(text[last:])
    tags.append(np.zeros(len(text) - last, np.int8))
    whole, tag = "".join(parts), np.concatenate(tags)
    begins = np.flatnonzero(tag == BEGIN)
    at = max(0, int(rng.choice(begins)) - int(rng.integers(4, SNIPPET // 2)))
    return whole[at : at + SNIPPET], tag[at : at + SNIPPET]


def train(texts: list[str], steps: int = STEPS, seed: int = 11) -> Tagger:
    """By gradient of the CRF's log-likelihood, through time in both directions."""
    rng = np.random.default_rng(seed)
    w = lstm_weights(rng, SYMBOLS, HIDDEN, "f") | lstm_weights(rng, SYMBOLS, HIDDEN, "b")
    w |= {"o": rng.normal(0, 0.3, (3, 2 * HIDDEN)).astype(F32), "c": np.array([[2], [0], [0]], F32), "tr": np.zeros((3, 3), F32)}
    tagger = Tagger(w)
    if not texts:
        return tagger
    having = [x for x in texts if base_spans(x)] or texts
    adam = Adam(w)
    for step in range(steps):
        pick = [(having if i % 2 else texts)[int(rng.integers(0, len(having if i % 2 else texts)))] for i in range(TRAIN_BATCH)]
        rows = [labelled(rng, x) for x in pick]
        x = np.full((SNIPPET, len(rows)), PAD, np.int32)
        y = np.zeros((SNIPPET, len(rows)), np.int64)
        for k, (part, tags) in enumerate(rows):
            x[: len(part), k], y[: len(part), k] = symbols_of(part), tags
        adam.step(_gradient(w, x, y, x != PAD), 0.02 * (1 - step / steps) + 0.001)
    return tagger


def _gradient(w: dict, x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> dict:
    steps, n = x.shape
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    mask = inside.astype(F32)
    h = c = np.zeros((HIDDEN, n), F32)
    ahead, behind = [], []
    for t in range(steps):
        h, c, saved = lstm_step(w, "f", x[t], h, c, mask[t])
        ahead.append((h, saved))
    h = c = np.zeros((HIDDEN, n), F32)
    for t in range(steps - 1, -1, -1):
        h, c, saved = lstm_step(w, "b", x[t], h, c, mask[t])
        behind.append((h, saved))
    behind.reverse()
    both = [np.concatenate([ahead[t][0], behind[t][0]]) for t in range(steps)]
    scores = np.stack([w["o"] @ b + w["c"] for b in both])
    tr = w["tr"]

    def total(v: np.ndarray) -> np.ndarray:
        top = v.max(axis=0)
        return top + np.log(np.exp(v - top).sum(axis=0))

    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = total(alpha[t - 1][:, None] + tr[:, :, None]) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = total((tr[:, :, None] + (scores[t + 1] + beta[t + 1])[None]).transpose(1, 0, 2))
    z = total(alpha[-1])
    scale = F32(1 / (n * 8))
    d = np.exp(alpha + beta - z)
    d[np.arange(steps)[:, None], y, np.arange(n)[None, :]] -= 1
    d *= (mask * scale)[:, None, :]
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, None] + tr[:, :, None] + (scores[t] + beta[t])[None] - z)
        grads["tr"] += (pair * (mask[t] * scale)).sum(axis=2)
        np.subtract.at(grads["tr"], (y[t - 1], y[t]), mask[t] * scale)
    dh = []
    for t in range(steps):
        grads["o"] += d[t] @ both[t].T
        grads["c"] += d[t].sum(axis=1, keepdims=True)
        dh.append(w["o"].T @ d[t])
    up, uc = np.zeros((HIDDEN, n), F32), np.zeros((HIDDEN, n), F32)
    for t in range(steps - 1, -1, -1):
        up, uc = lstm_back(w, "f", up + dh[t][:HIDDEN], uc, ahead[t][1], grads)
    up, uc = np.zeros((HIDDEN, n), F32), np.zeros((HIDDEN, n), F32)
    for t in range(steps):
        up, uc = lstm_back(w, "b", up + dh[t][HIDDEN:], uc, behind[t][1], grads)
    return grads


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> Tagger:
    """A tagger of a sample: of about ``sample`` distinct texts 512 characters around a digit or @, or anywhere.

    Half of them have a digit or @ that may belong to a span, where there are as many. No more than twice the sample
    comes to the driver, however often texts repeat. Null and empty texts are passed over; with no texts nothing is added.
    """
    hint = F.regexp_instr(text_col, F.lit(r"[0-9]{9}|[0-9]\.[0-9]|@|\+[0-9]"))
    place = F.greatest(F.when(hint > 0, hint - 200).otherwise(F.pmod(F.xxhash64(text_col), F.greatest(F.length(text_col) - 512, F.lit(0)) + 1).cast("int")), F.lit(1))
    texts = docs.select(text_col).where(F.col(text_col) != "")
    rows = sample_texts(texts, text_col, sample // 2, [F.substring(text_col, place, F.lit(512)).alias("piece")], (hint > 0).cast("string"))
    return train(sorted(r.piece for r in rows))


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text, base and found: arrays of (kind, start, end) by kind and start.

    found holds base and what the tagger adds: spans of a kind's form that touch no base span. Spans of one kind don't
    overlap; spans of two kinds may. Null and empty texts have none, long ones are searched whole. Ids may be null or
    repeat, equal texts have equal spans, other columns aren't read, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(tagger.w)  # of fixed size
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(shared.value)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = own.find(text_of(part))
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in found], span) for i in (0, 1)]
                yield pa.record_batch([part.column(0), *lists], names=[id_col, "base", "found"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, base {spans}, found {spans}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] for each span; of overlapping spans the union goes."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact_texts(docs: DataFrame, tagger: Tagger, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with [KIND] for each span in its texts; length_col, where there is one, follows the text.

    Null texts stay null and empty ones empty, and a null length stays null. Repeated rows are changed alike, other columns
    stay as they are under any name, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger.w)

    def make():
        own = Tagger(shared.value)

        def change(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(text_col).to_pylist()
            new = [x if not found else redact(x, found) for x, (_, found) in zip(texts, own.find([x or "" for x in texts]), strict=True)]
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns[text_col] = pa.array(new, part.schema.field(text_col).type)
            if length_col in columns:
                lengths = [n if a is b or n is None else len(b) for n, a, b in zip(columns[length_col].to_pylist(), texts, new, strict=True)]
                columns[length_col] = pa.array(lengths, part.schema.field(length_col).type)
            return pa.record_batch(list(columns.values()), names=list(columns))

        return change

    return per_slice(docs, text_col, make)


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, learn(docs))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_added"))


