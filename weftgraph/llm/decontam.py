"""Benchmark decontamination (operator 6): rare n-gram seeds, then Smith-Waterman alignment over words.

The n-grams of the items are counted over all documents. Each stretch of an item gives its rarest n-gram as a seed, and
seeds join documents to items by hash; only the texts of documents that share seeds with an item are aligned with it.
Documents aren't shuffled but for those: filters of bounded size, one of all n-grams of the items and one of the seeds,
tell tasks which of a document's n-grams to hand on. Nothing of the benchmark's size comes to the driver.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, if_small, materialize, table, text_of

NGRAM, COMMON = 3, 8
STRETCHES, STRETCH = 16, 3
"""An item gives a seed for each STRETCH of its n-grams, or for a shorter one where that would be under STRETCHES seeds."""
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
"""Of the score of an item aligned with itself: about two thirds of its words in place, or half of it word for word."""
MOST_BITS = 1 << 27
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word numbers a with b: score, and where it begins and ends in b (end exclusive)."""
    n = len(b)
    slope = GAP * np.arange(n + 1)
    prev, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    at = np.arange(n + 1)
    for word in a:
        step = np.where(b == word, MATCH, MISMATCH)
        row, begin = prev + GAP, start.copy()
        diag = prev[:-1] + step
        better = diag >= row[1:]
        row[1:][better] = diag[better]
        begin[1:][better] = np.where(prev[:-1] > 0, start[:-1], at[:-1])[better]
        dead = row <= 0
        row[dead], begin[dead] = 0, at[dead]
        lifted = row - slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))  # where the horizontal run of gaps begins
        along = top + slope
        use = along > row
        begin = np.where(use, begin[source], begin)
        row = np.where(use, along, row)
        prev, start = row, begin
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j]), j)
    return best


BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of BASE and of its inverse, as many as the longest batch had characters


@functools.cache
def _word_characters() -> np.ndarray:
    """Which code points are matched by WORD."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each text, as words() cuts them, and the text's number; all texts are read as one array.

    A word's hash is a polynomial of its characters, so it is a difference of sums that run over the whole array.
    """
    low = [x.lower() for x in texts]
    whole = "\n".join(low)
    points = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
    edges = np.flatnonzero(np.diff(_word_characters()[points], prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    begins = np.cumsum([0, *(len(x) + 1 for x in low)])
    return (sums[end] - sums[start]) * _powers[1][start], np.searchsorted(begins, start, side="right") - 1


def grams(hashes: np.ndarray, owner: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, as signed longs, of each run of n words of one text, the text's number and the place in it."""
    m = max(0, len(hashes) - n + 1)
    code = np.full(m, n, np.uint64)
    for k in range(n):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(BASE) + hashes[k : k + m]
    code ^= code >> np.uint64(32)
    code = (code * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    whole = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
    of = owner[whole]
    return code[whole], of, whole - np.searchsorted(owner, of)


def _slots(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = grams.view(np.uint64)
    return x & np.uint64(bits - 1), (x >> np.uint64(36)) & np.uint64(bits - 1)


class Filter:
    """Of a table's grams two bits each, at most MOST_BITS in all: a gram that isn't there is let pass now and then."""

    def __init__(self, grams: DataFrame, n: int):
        self.bits = 1 << 16
        while self.bits < min(MOST_BITS, 32 * n):
            self.bits *= 2
        low = self.bits - 1
        slot = F.explode(F.array(F.col("gram").bitwiseAND(F.lit(low)), F.shiftrightunsigned("gram", 36).bitwiseAND(F.lit(low))))
        held = grams.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
        self.held = np.zeros(self.bits // 64, np.int64)
        self.held[held.column("at").to_numpy()] = held.column("bits").to_numpy()
        self.held = self.held.view(np.uint64)

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for slot in _slots(grams, self.bits):
            out &= (self.held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _item_grams(items: DataFrame) -> DataFrame:
    """items: (item, item_text). (item, gram, place, words) of every n-gram; an item of fewer words is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "item_text"):
                hashes, owner = word_hashes(text_of(part, "item_text"))
                size = np.bincount(owner, minlength=part.num_rows)
                for n in range(1, NGRAM + 1):
                    gram, of, place = grams(hashes, owner, n)
                    mine = np.minimum(size[of], NGRAM) == n
                    item = part.column("item").take(pa.array(of[mine]))
                    yield pa.record_batch([item, pa.array(gram[mine]), pa.array(place[mine]), pa.array(size[of[mine]])], names=["item", "gram", "place", "words"])

    return items.select("item", "item_text").mapInArrow(run, "item long, gram long, place long, words long")


def _gram_hits(texts: DataFrame, own: Filter, sizes: list[int], places: bool) -> DataFrame:
    """texts: (text, mark). The grams of every text that the filter lets pass: (mark, gram, at), or (gram, n) by batch."""
    shared = texts.sparkSession.sparkContext.broadcast(own)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            for part in byte_slices(batch, "text"):
                hashes, owner = word_hashes(text_of(part))
                for n in sizes:
                    gram, of, place = grams(hashes, owner, n)
                    kept = np.flatnonzero(mine.may_hold(gram))
                    if places:
                        mark = part.column("mark").take(pa.array(of[kept]))
                        yield pa.record_batch([mark, pa.array(gram[kept]), pa.array(place[kept])], names=["mark", "gram", "at"])
                    else:
                        gram, seen = np.unique(gram[kept], return_counts=True)
                        yield pa.record_batch([pa.array(gram), pa.array(seen)], names=["gram", "n"])

    return texts.select("text", "mark").mapInArrow(run, "mark long, gram long, at long" if places else "gram long, n long")


def choose_seeds(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item, gram, place, words, seeds): of each stretch of an item the n-gram that is rarest in all texts.

    One that the texts have over COMMON times as often as the item's median n-gram is none: a measure by the item itself,
    as a passage that leaks often makes all its n-grams frequent, and none of them common.
    """
    found = materialize(_item_grams(items), "grams")
    facts = found.agg(F.count("*").alias("n"), F.collect_set(F.least("words", F.lit(NGRAM))).alias("sizes")).first()
    counts = _gram_hits(texts, Filter(found, facts.n), sorted(facts.sizes), places=False).groupBy("gram").agg(F.sum("n").alias("n"))
    seen = materialize(found.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))), "seen")
    whole = seen.groupBy("item").agg(F.expr("percentile(n, 0.5)").alias("median"), F.count("*").alias("all"))
    run = F.greatest(F.lit(1), F.least(F.lit(STRETCH), F.floor(F.col("all") / STRETCHES)))
    best = seen.join(whole, "item").groupBy("item", F.floor(F.col("place") / run).alias("stretch")).agg(F.min(F.struct("n", "gram", "place")).alias("best"), F.first("median").alias("median"), F.first("words").alias("words"))
    best = best.where(F.col("best.n") <= COMMON * F.greatest("median", F.lit(1.0))).select("item", "best.gram", "best.place", "words")
    return materialize(best.join(best.groupBy("item").agg(F.count("*").alias("seeds")), "item"), "seeds")


def align(own: list[str], text_words: list[str], hits: list[tuple[int, int]], least: int) -> tuple[float, int, int]:
    """(score, first word, end) of the best alignment of an item with a text near hits: (place in the text, in the item).

    Hits on near diagonals make one passage, which counts if ``least`` places of the item are among them.
    """
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(own))}
    a = np.array([vocabulary[w] for w in own], np.int64)
    n, best = len(own), (0, 0, 0)
    found = sorted((at - place, place) for at, place in hits)
    k = 0
    while k < len(found):
        # later hits may belong to the next passage
        last = k
        while last + 1 < len(found) and found[last + 1][0] - found[last][0] <= max(2, n // 4):
            last += 1
        if len({p for _, p in found[k : last + 1]}) >= least:
            low, high = max(0, found[k][0] - n // 2), min(len(text_words), found[last][0] + n + n // 2)
            b = np.array([vocabulary.get(w, -1) for w in text_words[low:high]], np.int64)
            score, start, end = smith_waterman(a, b)
            best = max(best, (score, -(low + start), low + end))
        k = last + 1
    return best[0] / (MATCH * n), -best[1], best[2]


def _matches(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """texts: (text, mark). (mark, item_id, item, score, start_word, end_word) of every text and item that score enough."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text].alias("item_text")).where("item_text is not null").distinct()
    items = materialize(items.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "item_text")), "items")
    seeds = choose_seeds(texts, items)
    facts = seeds.agg(F.count("*").alias("n"), F.collect_set(F.least("words", F.lit(NGRAM))).alias("sizes")).first()
    hits = _gram_hits(texts, Filter(seeds, facts.n), sorted(facts.sizes), places=True).dropDuplicates(["mark", "gram", "at"])
    pairs = hits.join(seeds, "gram").groupBy("mark", "item").agg(F.collect_list(F.struct("at", "place")).alias("hits"), F.first("seeds").alias("seeds"))
    least = F.when(F.col("seeds") < 10, 1).otherwise(2)
    pairs = materialize(pairs.withColumn("least", least).where(F.size(F.array_distinct(F.col("hits.place"))) >= F.col("least")), "pairs")
    held = texts.join(if_small(materialize(pairs.select("mark").distinct(), "marks")), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text_words = None, []
        for batch in batches:
            rows = []
            for i, r in enumerate(batch.select(["mark", "hits", "least"]).to_pylist()):
                if r["mark"] != last:
                    last, text_words = r["mark"], words(batch.column("text")[i].as_py())
                score, a, b = align(words(batch.column("item_text")[i].as_py()), text_words, [(x["at"], x["place"]) for x in r["hits"]], r["least"])
                if score >= LEAST_SCORE:
                    rows.append((r["mark"], batch.column("item")[i].as_py(), score, a, b))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["mark", "item", "score", "start_word", "end_word"])

    met = pairs.join(held, "mark").join(items, "item").select("mark", "item", "text", "item_text", "hits", "least")
    met = met.repartition("mark", "item").sortWithinPartitions("mark")
    found = materialize(met.mapInArrow(run, "mark long, item long, score double, start_word long, end_word long"), "found")
    return found.join(items.select("item", "item_id"), "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs and item whose passage it holds: id, item_id, score (0.5 to 1), start_word, end_word.

    Of equally good alignments the first by start_word's end is told. Null and empty documents and items match nothing; ids
    of either table may be null and of any type; an item with several texts gives a row for each of them, and one that
    repeats counts once. Repeated documents are reported each time. Either table may be empty: no rows. Other columns
    aren't read.
    """
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("mark", F.xxhash64("text"))
    found = _matches(texts.select("text", "mark"), benchmark, item_col, item_text)
    return texts.select("id", "mark").join(found, "mark").select(F.col("id").alias(id_col), "item_id", "score", "start_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark: the documents find_leaks() names are gone.

    Rows are judged by their text alone, so repeated rows stay or go together; null and empty texts stay, an empty table
    gives no rows, and with an empty benchmark all rows stay.
    """
    mark = "__leak_mark"
    texts = docs.select(docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("mark"))
    gone = _matches(texts, benchmark, item_col, item_text).select(F.col("mark").alias(mark)).distinct()
    gone = if_small(materialize(gone, "gone"))
    return docs.withColumn(mark, F.xxhash64(text_col)).join(gone, mark, "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
