"""LM scoring (operator 5): a gated recurrent word model with a class-factored output, beside add-one unigram scores.

Words are counted over all training documents. The VOCABULARY most frequent ones have weights of their own, in classes of
about equal size by rank; all others make one more class, within which a word's probability is its add-one share of that
class's count. Counts of the HOT most frequent words travel with the scoring function, as that many words of bounded
length are a bound; every other word of a document meets its count in a join, where no word of ordinary length has more
than a HOT-th of all tokens.
The biases of the output, and with them its unigram distribution, are set from the counts of the whole corpus. The
weights are begun on pieces of about SAMPLE_DOCS documents chosen by a hash. Then shards of the training documents, dealt
by a hash of id and text, go on from there, each over every word of its documents by truncated backpropagation with the
state carried from window to window, and the shards' weights are averaged. The number of shards follows the number of
training tokens, so neither the scores nor what is learned depend on how the input is partitioned.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, sample_texts, table, text_of
from .langid import remainder
from .rnn import F32, Adam, add_columns, gru_back, gru_step, gru_weights, sigmoid

END = b""
HOT, LONGEST_HOT, VOCABULARY, CLASSES, SUFFIXES, HIDDEN = 131_072, 128, 1_024, 28, 256, 12
WINDOW, LANES = 64, 512
SAMPLE_DOCS, SNIPPET, EPOCHS, TRAIN_WINDOW, TRAIN_LANES = 2_048, 1_200, 3, 32, 128
LEAST_STEPS, MOST_EPOCHS = 300, 8
"""Where the sample is small it is gone through more often than EPOCHS times."""
FLUSH = 200_000
SHARD_TOKENS, REFINE_WINDOW, LONGEST_WINDOW, REFINE_LANES, PARTS, FAN = 1 << 22, 32, 256, 512, 16, 32
"""Tokens of a shard, words of a step (more where few documents are left) and documents side by side in it; how weights
are cut and averaged."""


def tokens(text: str) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space, then the end."""
    return [*text.encode().lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """docs: (text). (word, n), every word of every text; partitions combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for part in byte_slices(b, "text"):
                for text in text_of(part):
                    held.update(tokens(text))
                if len(held) >= FLUSH:
                    yield batch()
        yield batch()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_hot(counts: DataFrame, most: int = HOT) -> int:
    """The least count with which at most ``most`` words are hot, to within 3 percent; from a histogram of some hundred rows."""
    step = F.floor(F.log2("n") * 24)
    left = most
    least = 1
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        if r.words > left:
            break
        left, least = left - r.words, r.least
    else:
        return 1
    return least if left < most else (1 << 62)


class Lexicon:
    """Hot words by falling count, the first VOCABULARY of them with an id each; sums over the rest."""

    def __init__(self, hot: list[tuple[bytes, int]], n: int, v: int):
        self.code = {w: i for i, (w, _) in enumerate(hot)}
        self.counts = np.array([c for _, c in hot], np.float64)
        self.logs = np.log10(self.counts + 1)
        self.n, self.v = n, v
        self.size = min(VOCABULARY, len(hot))
        self.classes = min(CLASSES, max(1, self.size))
        self.bounds = [self.size * k // self.classes for k in range(self.classes + 1)]
        self.class_of = np.repeat(np.arange(self.classes), np.diff(self.bounds)) if self.size else np.zeros(0, np.int64)
        self.class_of = np.append(self.class_of, self.classes)  # of all other words
        own = int(self.counts[: self.size].sum())
        self.rest_n, self.rest_v = n - own, v - self.size
        self.symbols = self.size + SUFFIXES
        self.symbol_of = np.array([i if i < self.size else self._suffix(w) for i, (w, _) in enumerate(hot)] + [0], np.int32)

    def _suffix(self, word: bytes) -> int:
        return self.size + zlib.crc32(word[-3:]) % SUFFIXES

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per word its place among the hot ones, -1 for others, and its symbol: what the network reads.

        That is its place in the vocabulary, or for a word beyond that a bucket of its last letters.
        """
        place = np.fromiter(map(self.code.get, words, repeat(-1)), np.int32, len(words))
        symbols = self.symbol_of[place]
        for i in np.flatnonzero(place < 0).tolist():
            symbols[i] = self._suffix(words[i])
        return place, symbols

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the symbols of a document, its end among them: what is read before each, and target ids."""
        return np.append(self.read([END])[1], symbols[:-1]), np.minimum(symbols, self.size)


class Network:
    def __init__(self, lexicon: Lexicon, w: dict[str, np.ndarray]):
        self.x, self.w = lexicon, w

    @classmethod
    def new(cls, lexicon: Lexicon, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        w = gru_weights(rng, lexicon.symbols, HIDDEN, "g")
        w["k"] = rng.normal(0, 0.02, (lexicon.classes + 1, HIDDEN)).astype(F32)
        w["v"] = rng.normal(0, 0.02, (lexicon.size, HIDDEN)).astype(F32)
        counts = lexicon.counts[: lexicon.size] + 1
        share = np.array([counts[a:b].sum() for a, b in zip(lexicon.bounds, lexicon.bounds[1:], strict=False)] + [lexicon.rest_n + lexicon.rest_v + 1.0])
        w["kb"] = np.log(np.maximum(share, 1e-9) / share.sum()).astype(F32)[:, None]
        w["vb"] = np.log(counts / counts.sum()).astype(F32)[:, None] if lexicon.size else np.zeros((0, 1), F32)
        return cls(lexicon, w)

    def outputs(self, hidden: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """hidden (H, m), target (m): natural log probability of each target's class, times its own within it.

        With grads, adds the gradients of the mean loss and returns that of hidden too.
        """
        x, w = self.x, self.w
        m = len(target)
        kind = x.class_of[target]
        z = w["k"] @ hidden + w["kb"]
        z -= z.max(axis=0)
        e = np.exp(z)
        s = e.sum(axis=0)
        at = np.arange(m)
        out = z[kind, at] - np.log(s)
        dh = None
        if grads is not None:
            d = e / s
            d[kind, at] -= 1
            d /= m
            grads["k"] += d @ hidden.T
            grads["kb"] += d.sum(axis=1, keepdims=True)
            dh = w["k"].T @ d
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(x.classes + 1))
        for k in range(x.classes):
            own = order[cuts[k] : cuts[k + 1]]
            if not len(own):
                continue
            a, b = x.bounds[k], x.bounds[k + 1]
            h = hidden[:, own]
            z = w["v"][a:b] @ h + w["vb"][a:b]
            z -= z.max(axis=0)
            e = np.exp(z)
            s = e.sum(axis=0)
            i = target[own] - a
            out[own] += z[i, np.arange(len(own))] - np.log(s)
            if grads is not None:
                d = e / s
                d[i, np.arange(len(own))] -= 1
                d /= m
                grads["v"][a:b] += d @ h.T
                grads["vb"][a:b] += d.sum(axis=1, keepdims=True)
                dh[:, own] += w["v"][a:b].T @ d
        return out, dh

    def train(self, pieces: list[tuple[str, bool, bool]]) -> None:
        """Pieces of texts: whether the text begins and ends with them. Cut words and ends that aren't there are left out.

        Truncated backpropagation: the state goes on from window to window, the gradient doesn't.
        """
        x = self.x
        rows = []
        for text, begins, ends in pieces:
            words = [END, *tokens(text)]
            words = words[0 if begins else 2 : None if ends else -2]
            if len(words) > 1:
                symbols = x.read(words)[1]
                rows.append((symbols[:-1], np.minimum(symbols[1:], x.size)))
        rows.sort(key=lambda r: len(r[1]))
        adam = Adam(self.w)
        rng = np.random.default_rng(3)
        groups = [rows[i : i + TRAIN_LANES] for i in range(0, len(rows), TRAIN_LANES)]
        steps = sum(-(-len(g[-1][1]) // TRAIN_WINDOW) for g in groups)
        epochs = min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS // max(1, steps))))
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                group = groups[g]
                longest = len(group[-1][1])
                ins, outs = np.zeros((longest, len(group)), np.int64), np.full((longest, len(group)), -1)
                for k, (a, b) in enumerate(group):
                    ins[: len(a), k], outs[: len(b), k] = a, b
                h = np.zeros((HIDDEN, len(group)), F32)
                for t0 in range(0, longest, TRAIN_WINDOW):
                    xs, ys = ins[t0 : t0 + TRAIN_WINDOW], outs[t0 : t0 + TRAIN_WINDOW]
                    grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                    saved, states = [], []
                    for t in range(len(xs)):
                        h, s = gru_step(self.w, "g", xs[t], h)
                        saved.append(s)
                        states.append(h)
                    live = ys.ravel() >= 0
                    if not live.any():
                        break
                    flat = np.stack(states, axis=1).reshape(HIDDEN, -1)
                    _, d = self.outputs(np.ascontiguousarray(flat[:, live]), ys.ravel()[live], grads)
                    dflat = np.zeros_like(flat)
                    dflat[:, live] = d
                    dflat = dflat.reshape(HIDDEN, *xs.shape)
                    back = np.zeros_like(h)
                    for t in range(len(xs) - 1, -1, -1):
                        back = gru_back(self.w, "g", back + dflat[:, t], saved[t], grads)
                    adam.step(grads, 0.01 if epoch < epochs - 1 else 0.003)

    def learn_window(self, ins: np.ndarray, outs: np.ndarray, first: np.ndarray, h: np.ndarray, adam: Adam, rate: float) -> np.ndarray:
        """One step over a window (words, lanes) of symbols read and target ids, -1 for none; returns the state after it.

        Where first is set a document begins: there the state is 0 and no gradient passes.
        """
        w, steps, lanes = self.w, *ins.shape
        n = HIDDEN
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        begins = first.any(axis=1)
        read = np.take(w["gx"], ins.ravel(), axis=1).reshape(3 * n, steps, lanes)
        before, after = (np.empty((n, steps, lanes), F32) for _ in range(2))
        saved = []
        for t in range(steps):
            if begins[t]:
                h = h * ~first[t]
            before[:, t] = h
            g = w["gu"] @ h
            zr = sigmoid(read[: 2 * n, t] + g[: 2 * n])
            inner = g[2 * n :]
            inner += w["gn"]
            cand = np.tanh(read[2 * n :, t] + zr[n:] * inner)
            lead = h - cand
            h = cand + zr[:n] * lead
            after[:, t] = h
            saved.append((zr, inner, cand, lead))
        y = outs.ravel()
        live = y >= 0
        flat = after.reshape(n, -1)
        whole = live.all()
        _, d = self.outputs(flat if whole else np.ascontiguousarray(flat[:, live]), y if whole else y[live], grads)
        if not whole:
            d, of_live = np.zeros_like(flat), d
            d[:, live] = of_live
        d = d.reshape(n, steps, lanes)
        dx, dg = read, np.empty((3 * n, steps, lanes), F32)  # the gates' gradients by what was read, and by the state
        back = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            zr, inner, cand, lead = saved[t]
            z, r = zr[:n], zr[n:]
            dh = back + d[:, t]
            dz = dh * z
            dcand = (dh - dz) * (1 - cand * cand)
            dx[:n, t] = dz * (1 - z) * lead
            dr = dcand * r
            dx[n : 2 * n, t] = dr * (1 - r) * inner
            dx[2 * n :, t] = dcand
            step = dg[:, t]
            step[: 2 * n], step[2 * n :] = dx[: 2 * n, t], dr
            back = dz + w["gu"].T @ np.ascontiguousarray(step)
            if begins[t]:
                back *= ~first[t]
        dg = dg.reshape(3 * n, -1)
        grads["gn"] += dg[2 * n :].sum(axis=1, keepdims=True)
        grads["gu"] += dg @ before.reshape(n, -1).T
        add_columns(grads["gx"], ins.ravel(), dx.reshape(3 * n, -1))
        adam.step(grads, rate)
        return h

    def learn_all(self, docs: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
        """Steps over every word of docs, (symbols read, target ids); returns how many words there were.

        Documents run in lanes, one after another, and a lane takes the next one when it has come to an end.
        """
        adam, seen, more = Adam(self.w), 0, True
        lanes: list[list] = [[np.zeros(0, np.int32), np.zeros(0, np.int32), 0] for _ in range(REFINE_LANES)]
        h = np.zeros((HIDDEN, REFINE_LANES), F32)
        while True:
            width = min(LONGEST_WINDOW, max(REFINE_WINDOW, REFINE_WINDOW * REFINE_LANES // (2 * len(lanes))))
            ins, outs = np.zeros((width, len(lanes)), np.int64), np.full((width, len(lanes)), -1)
            first = np.zeros(ins.shape, bool)
            for k, lane in enumerate(lanes):
                at = 0
                while at < width:
                    if lane[2] == len(lane[1]):
                        doc = next(docs, None) if more else None
                        if doc is None:
                            more = False
                            break
                        lane[:] = *doc, 0
                        first[at, k] = True
                    n = min(width - at, len(lane[1]) - lane[2])
                    ins[at : at + n, k], outs[at : at + n, k] = (x[lane[2] : lane[2] + n] for x in lane[:2])
                    lane[2] += n
                    at += n
            live = outs >= 0
            if not live.any():
                return seen
            seen += int(live.sum())
            h = self.learn_window(ins, outs, first, h, adam, rate)
            left = [k for k, lane in enumerate(lanes) if more or lane[2] < len(lane[1])]
            if len(left) < len(lanes):
                lanes, h = [lanes[k] for k in left], np.ascontiguousarray(h[:, left])
            if not lanes:
                return seen

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """docs: (symbols read, target ids). Natural log probability of each, its words of the last class by class only.

        Documents run in lanes, one after another, longest first; states go on from window to window and begin anew at
        each document.
        """
        total = np.zeros(len(docs))
        sizes = [len(b) for _, b in docs]
        if not docs:
            return total
        lanes = max(1, min(LANES, sum(sizes) // max(sizes)))
        fill = [(0, k) for k in range(lanes)]
        plan: list[list[int]] = [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
            n, k = heapq.heappop(fill)
            plan[k].append(i)
            heapq.heappush(fill, (n + sizes[i], k))
        longest = max(n for n, _ in fill)
        ins = np.zeros((longest, lanes), np.int32)
        outs, owner = np.full((longest, lanes), -1, np.int32), np.zeros((longest, lanes), np.int32)
        first = np.zeros((longest, lanes), bool)
        for k, mine in enumerate(plan):
            at = 0
            for i in mine:
                n = sizes[i]
                ins[at : at + n, k], outs[at : at + n, k], owner[at : at + n, k] = docs[i][0], docs[i][1], i
                first[at, k] = True
                at += n
        h = np.zeros((HIDDEN, lanes), F32)
        for t0 in range(0, longest, WINDOW):
            part = slice(t0, t0 + WINDOW)
            steps = len(ins[part])
            states = np.empty((HIDDEN, steps, lanes), F32)
            for t in range(steps):
                if first[t0 + t].any():
                    h = h * ~first[t0 + t]
                h, _ = gru_step(self.w, "g", ins[t0 + t], h)
                states[:, t] = h
            y = outs[part].ravel()
            live = y >= 0
            flat = states.reshape(HIDDEN, -1)
            whole = live.all()
            logp, _ = self.outputs(flat if whole else np.ascontiguousarray(flat[:, live]), y if whole else y[live])
            total += np.bincount(owner[part].ravel()[live], weights=logp, minlength=len(docs))
        return total


def refine(network: Network, training: DataFrame, n: int) -> None:
    """Goes on training over every word of every training document (id, text), n tokens, and averages what shards learned.

    A shard begins with the same weights as any other and takes steps over its own documents, in the order of their
    hashes. The results, a megabyte each, are averaged by their words, FAN at a time, in parts by place.
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((network.x, network.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = shared.value
        net = Network(lex, {k: v.copy() for k, v in w.items()})

        def documents() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for part in byte_slices(batch, "text"):
                    for text in text_of(part):
                        yield lex.steps(lex.read(tokens(text))[1])

        seen = net.learn_all(documents(), 0.002)
        if seen:
            flat = np.concatenate([net.w[k].ravel() for k in sorted(net.w)])
            parts = [x.tobytes() for x in np.array_split(flat, PARTS)]
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int64()), pa.array([float(seen)] * PARTS), pa.array(parts, pa.binary())], names=["part", "who", "n", "v"])

    def mean(t: pa.Table) -> pa.Table:
        n, total = 0.0, None
        t = t.sort_by("who")
        for share, v in zip(t.column("n").to_pylist(), t.column("v").to_pylist(), strict=True):
            v = np.frombuffer(v, F32).astype(np.float64) * share
            total = v if total is None else total + v
            n += share
        return pa.table([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([t.column("who")[0].as_py() // FAN], pa.int64()), pa.array([n]), pa.array([(total / n).astype(F32).tobytes()], pa.binary())], names=["part", "who", "n", "v"])

    schema = "part int, who long, n double, v binary"
    mark = F.xxhash64("id", "text")
    shards = training.select("text", mark.alias("mark")).repartition(max(1, -(-n // SHARD_TOKENS)), "mark").sortWithinPartitions("mark")
    learned = materialize(shards.select("text").mapInArrow(run, schema), "weights")
    most = learned.agg(F.max("who")).first()[0]
    if most is None:
        return
    while True:
        learned = learned.groupBy("part", F.expr(f"who div {FAN}")).applyInArrow(mean, schema)
        most //= FAN
        if not most:
            break
    flat = np.concatenate([np.frombuffer(r.v, F32) for r in sorted(learned.collect(), key=lambda r: r.part)])  # PARTS rows
    at = 0
    for k in sorted(network.w):
        size = network.w[k].size
        network.w[k] = flat[at : at + size].reshape(network.w[k].shape).copy()
        at += size


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score, from the rows of training.

    Null and empty texts are the end alone. Repeated rows are scored each by itself, null ids too; other columns aren't
    read, and an empty table gives no rows. With no training documents every count is 0, and the scores are those of the
    add-one distribution over nothing but unknown words.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    training = training.select(training[id_col].alias("id"), training[text_col].alias("text"))
    counts = materialize(count_words(training).where("n > 0"), "words")
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    short = counts.where(F.length("word") <= LONGEST_HOT)
    hot = short.where(F.col("n") >= least_hot(short)).collect()
    lexicon = Lexicon(sorted(((bytes(r.word), r.n) for r in hot), key=lambda x: (-x[1], x[0])), n, v)
    network = Network.new(lexicon)
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1).cast("int") + 1
    pieces = [F.substring("text", place, F.lit(SNIPPET)).alias("piece"), (place == 1).alias("begins"), (place + SNIPPET > F.length("text")).alias("ends")]
    network.train(sorted((r.piece, r.begins, r.ends) for r in sample_texts(training, "text", sample, pieces)))
    refine(network, training, n)
    shared = spark.sparkContext.broadcast((lexicon, network.w))  # HOT short words and weights of fixed size
    log_rest = np.log(lexicon.rest_n + lexicon.rest_v + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = shared.value
        net = Network(lex, w)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, docs_, facts = [], [], []
            for part in byte_slices(batch, "text"):
                words_row, words_word, words_n = [], [], []
                for text in text_of(part):
                    words = tokens(text)
                    at, symbols = lex.read(words)
                    docs_.append(lex.steps(symbols))
                    hot = at[at >= 0]
                    logs = lex.logs[hot]
                    if len(hot) < len(at):
                        others = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                        words_row += [row] * len(others)
                        words_word += others.keys()
                        words_n += others.values()
                    facts.append((row, len(words), len(hot), float(logs.sum()), float(logs[hot >= lex.size].sum()), int((symbols >= lex.size).sum())))
                    row += 1
                keys += part.column(0).to_pylist()
                m = len(words_row)
                if m:
                    yield pa.record_batch([pa.nulls(m, batch.schema.field(0).type), pa.array(words_row, pa.int64()), pa.array(words_word, pa.binary()), pa.array(words_n, pa.int64()), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=names)
            if facts:
                logp = net.score(docs_)
                rows, sizes, known, base, rest, others = zip(*facts, strict=True)
                model = (logp + np.array(rest) * np.log(10) - np.array(others) * log_rest) / np.log(10)
                m = len(facts)
                yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(rows, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model)], names=names)

    names = ["id", "row", "word", "k", "n_tokens", "known", "base", "model"]
    parts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, row long, word binary, k long, n_tokens long, known long, base double, model double")
    parts = materialize(parts, "scores")
    met = parts.where("word is not null").select("row", "word", "k").join(counts, "word")
    more = met.groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    whole = parts.where("word is null").select("id", "row", "n_tokens", "known", "base", "model").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 7) == 2
    scored = score_texts(docs, docs.where(~held))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
