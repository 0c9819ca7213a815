"""Language ID (operator 3): a bidirectional gated recurrent network over bytes.

Every byte gets a distribution over the languages; a document's is their mean over all its bytes. Documents are read in
windows with context on either side, so a text of any length takes bounded memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, per_slice, sample_texts, table
from .rnn import F32, Adam, framed, gru_back, gru_step, gru_weights, softmax, windows

HIDDEN, CORE, CONTEXT, PAD, BATCH = 12, 224, 16, 256, 1536
PER_LANGUAGE, SNIPPET, STEPS = 1_024, 96, 260
"""Training takes snippets of SNIPPET bytes of about PER_LANGUAGE distinct texts of each language, chosen by a hash, and
STEPS batches."""
LANGUAGES = 256
"""The languages with the most distinct texts that are learned."""
UNKNOWN = "und"
LEAST_SCORE = 1.25
"""A language is taken to be found from this multiple of chance on, which is one part in as many as there are languages."""


class Model:
    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.w = languages, weights

    def _positions(self, x: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, distribution over languages) for each step, from the last to the first."""
        w, steps = self.w, x.shape[0]
        h = np.zeros((HIDDEN, x.shape[1]), F32)
        ahead = np.empty((steps, *h.shape), F32)
        holes = [None if row.all() else row.astype(F32) for row in inside]
        for t in range(steps):
            h, _ = gru_step(w, "f", x[t], h, holes[t])
            ahead[t] = h
        h = np.zeros_like(h)
        both = np.empty((2 * HIDDEN, x.shape[1]), F32)
        for t in range(steps - 1, -1, -1):
            h, _ = gru_step(w, "b", x[t], h, holes[t])
            both[:HIDDEN], both[HIDDEN:] = ahead[t], h
            yield t, softmax(w["o"] @ both + w["c"])

    def label_positions(self, text: str) -> list[str]:
        """A language for each byte of the text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw) or not self.languages:
            return [UNKNOWN] * len(raw)
        _, start, low, high = windows(np.array([len(raw)]), CORE, CONTEXT)
        x, inside = framed(raw, start, low, high, CORE, CONTEXT, PAD)
        best = np.zeros((CORE, len(start)), np.int64)
        for t, p in self._positions(x, inside):
            if CONTEXT <= t < CONTEXT + CORE:
                best[t - CONTEXT] = p.argmax(axis=0)
        return [self.languages[i] for i in best.T.ravel()[: len(raw)]]

    def pooled(self, texts: list[str]) -> np.ndarray:
        """(document, language): mean distribution over the bytes of each text; zero for empty ones."""
        raw = [x.encode() for x in texts]
        sizes = np.array([len(x) for x in raw])
        total = np.zeros((len(texts), len(self.languages)))
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        owner, start, low, high = windows(sizes, CORE, CONTEXT)
        for at in range(0, len(owner), BATCH):
            part = slice(at, at + BATCH)
            x, inside = framed(symbols, start[part], low[part], high[part], CORE, CONTEXT, PAD)
            sums = np.zeros((len(self.languages), x.shape[1]), F32)
            for t, p in self._positions(x, inside):
                if CONTEXT <= t < CONTEXT + CORE:
                    if not inside[t].all():
                        p *= inside[t]
                    sums += p
            np.add.at(total, owner[part], sums.T)
        return total / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) per text; ('und', 0.0) where there is no letter or nothing was learned."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        asked = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))] if self.languages else []
        if asked:
            p = self.pooled([texts[i] for i in asked])
            best = p.argmax(axis=1)
            for row, i in enumerate(asked):
                out[i] = (self.languages[best[row]], float(min(1.0, p[row, best[row]])))
        return out


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Model:
    """samples: (language, bytes), at most SNIPPET bytes each; by backpropagation through time, every byte a target."""
    languages = sorted({x for x, _ in samples})
    rng = np.random.default_rng(seed)
    n = len(languages)
    w = gru_weights(rng, PAD + 1, HIDDEN, "f") | gru_weights(rng, PAD + 1, HIDDEN, "b")
    w |= {"o": rng.normal(0, 0.3, (n, 2 * HIDDEN)).astype(F32), "c": np.zeros((n, 1), F32)}
    if n < 2:
        return Model(languages, w)
    x = np.full((len(samples), SNIPPET), PAD, np.int32)
    for row, (_, raw) in zip(x, samples, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    y = np.array([languages.index(k) for k, _ in samples])
    of = [np.flatnonzero(y == k) for k in range(n)]
    adam = Adam(w)
    for step in range(steps):
        pick = np.concatenate([rng.choice(k, max(1, 128 // n)) for k in of])  # as many of each language
        xb, yb = np.ascontiguousarray(x[pick].T), y[pick]
        mask = (xb != PAD).astype(F32)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        h = g = np.zeros((HIDDEN, len(pick)), F32)
        ahead, behind = [], []
        for t in range(SNIPPET):
            h, saved = gru_step(w, "f", xb[t], h, mask[t])
            ahead.append((h, saved))
        for t in range(SNIPPET - 1, -1, -1):
            g, saved = gru_step(w, "b", xb[t], g, mask[t])
            behind.append((g, saved))
        behind.reverse()
        target = np.zeros((n, len(pick)), F32)
        target[yb, np.arange(len(pick))] = 1
        dh, scale = [], F32(1 / max(1, mask.sum()))
        for t in range(SNIPPET):
            both = np.concatenate([ahead[t][0], behind[t][0]])
            d = (softmax(w["o"] @ both + w["c"]) - target) * mask[t] * scale
            grads["o"] += d @ both.T
            grads["c"] += d.sum(axis=1, keepdims=True)
            dh.append(w["o"].T @ d)
        back = np.zeros((HIDDEN, len(pick)), F32)
        for t in range(SNIPPET - 1, -1, -1):
            back = gru_back(w, "f", back + dh[t][:HIDDEN], ahead[t][1], grads)
        back = np.zeros((HIDDEN, len(pick)), F32)
        for t in range(SNIPPET):
            back = gru_back(w, "b", back + dh[t][HIDDEN:], behind[t][1], grads)
        adam.step(grads, 0.02 * (1 - step / steps) + 0.001)
    return Model(languages, w)


def remainder(id_col: Column, by: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % by


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows of docs with a language and a letter, from a snippet of about per_language texts of each.

    The sample is one of distinct texts, bounded by 2 x per_language x LANGUAGES snippets; it has all texts of a language
    with few. Null languages and texts are passed over; with no rows left the model knows no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(text_col), F.greatest(F.length(text_col) - SNIPPET, F.lit(0)) + 1).cast("int") + 1
    rows = sample_texts(known, text_col, per_language, [F.substring(text_col, place, F.lit(SNIPPET)).alias("piece")], F.col(lang_col).cast("string"), LANGUAGES)
    return train([(r.group, x) for r in rows if (x := r.piece.encode()[:SNIPPET])])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score. Null, empty and letterless texts: 'und', 0.

    Of equal probabilities the language first by name is told. Ids may be null or repeat, equal texts get equal results,
    other columns aren't read, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.w))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = own.predict(part.column("text").to_pylist())
                yield pa.record_batch([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and a language of at least ``least`` times chance.

    Where nothing or a single language was learned, for want of labels, a letter is enough. Null, empty and letterless
    texts go; each row is judged by its text alone, so repeated rows stay or go together. Any other column may be null
    or have any name. An empty table gives no rows.
    """
    least = min(0.9, least / max(1, len(model.languages)))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.w))

    def make():
        own = Model(*shared.value)

        def change(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(text_col).to_pylist()
            if len(own.languages) < 2:
                return part.filter(pa.array([bool(x) and any(map(str.isalpha, x)) for x in texts], pa.bool_()))
            return part.filter(pa.array([k != UNKNOWN and p >= least for k, p in own.predict(texts)], pa.bool_()))

        return change

    return per_slice(docs, text_col, make)


def held_out(key, by: int = 5, at: int = 0) -> bool:
    return zlib.crc32(str("" if key is None else key).encode()) % by == at


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(remainder(F.col("doc_id"), 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
