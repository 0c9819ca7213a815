"""SimHash near-dedup (operator 1): fingerprints linked through a Gray-order hierarchical index.

Links between fingerprints at ``distance`` or fewer differing bits are found bucket by bucket. With the 64 bits in s
segments, two such fingerprints agree in at least s - distance of them, so they meet in a bucket for each choice of
s - distance segments; five segments make 5 keys of about 13 bits, six make 15 keys of about 21. Buckets that hold more
than HOT fingerprints are dealt again by further bits in the same way. In a bucket the index prunes, and only the edges
of a spanning forest leave it, so a group of any number of copies emits fewer edges than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, if_small, materialize, table, text_of
from .components import components

SHINGLE, DISTANCE = 4, 4
HOT = 65_536
FANOUT, QUERIES, PAIRS = 16, 256, 1 << 21
"""Codes under a node; queries that go down together, fewer where they could meet more than PAIRS codes."""
AVERAGE_BUCKET = 4_096
FULL = (1 << 64) - 1
STAGE_SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 5
WIDE, CUT = 4, 64
"""Longs of a wide fingerprint, and the most bits in which two may differ to be counted: at a similarity of 0.8 two long
texts differ in 39 on average, and texts of five shingles in 48."""
BLOCK, BLOCK_BYTES = 8_192, 64 << 20
"""Nodes, and bytes of shingle sets, that a block of a bucket holds; a bucket beyond that is several tasks'."""
_draw = np.random.default_rng(42)
FLIP = _draw.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), np.uint32)
ODD = _draw.integers(0, 1 << 31, (BANDS * BAND_ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
TURN = _draw.integers(0, FULL, WIDE, np.uint64)
TIMES = _draw.integers(0, FULL >> 1, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, unsigned: a bit is 1 if set in over half of the shingles' XXH64 (seed 42); 0 for no words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = len(words) - shingle + 1
    hashes = b"".join([xxhash.xxh64_digest(joined[a : b - 1], 42) for a, b in zip(ends, ends[shingle:], strict=False)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = np.frombuffer(hashes, np.uint8, min(n - at, 1 << 16) * 8, at * 8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                fp = np.array([fingerprint(x, shingle) for x in text_of(part)], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The order of codes (n, words) in the Gray sequence of all their bits, the first word's highest bit first."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    odd = np.zeros(len(codes), bool)
    for k in range(codes.shape[1]):
        rank[odd, k] ^= np.uint64(FULL)
        odd ^= (np.bitwise_count(codes[:, k]) & 1).astype(bool)
    return np.lexsort(rank.T[::-1])


class GrayIndex:
    """Codes (n, words of 64 bits) in Gray order under nodes of FANOUT; a node holds the bits that all below it share.

    A query adds, level by level, its differences in those bits only that a node shares and its parent doesn't, and
    leaves a node once the sum is over the distance.
    """

    def __init__(self, codes: np.ndarray, label: np.ndarray | None = None):
        """label: of each code what tells its component, where some are joined already."""
        self.order = gray_order(codes)
        self.codes = codes[self.order]
        self.levels = []  # from the leaves up: (pattern, shared bits)
        pattern, shared = self.codes, np.full(codes.shape, FULL, np.uint64)
        self.levels.append((pattern, shared))
        while len(pattern) > FANOUT:
            starts = np.arange(0, len(pattern), FANOUT)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))), axis=0)
            differ = np.bitwise_or.reduceat((pattern ^ first) | ~shared, starts, axis=0)
            shared = ~differ
            pattern = pattern[starts] & shared
            self.levels.append((pattern, shared))
        self.label = np.arange(len(codes))
        if label is not None:
            _, first, of = np.unique(label[self.order], return_index=True, return_inverse=True)
            self.label = first[of]
        self.uniform: list[np.ndarray] = []
        self._summarise()

    def _summarise(self) -> None:
        """Per level each node's label, -1 where its members have different ones."""
        low = high = self.label
        self.uniform = [self.label]
        for pattern, _ in self.levels[1:]:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.uniform.append(np.where(low == high, low, -1))

    def _unite(self, u: np.ndarray, v: np.ndarray) -> None:
        changed = False
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            self.label = parent[self.label]
            changed = True
        if changed:
            self._summarise()

    def link(self, distance: int, accept=None) -> np.ndarray:
        """Joins all codes within the distance; per code in Gray order the place of its component's first member.

        accept: of pairs of places (in the order given) within the distance, those that count.
        """
        n = len(self.codes)
        top, step = len(self.levels) - 1, max(1, min(QUERIES, PAIRS // n))
        for q0 in range(0, n, step):
            q = np.arange(q0, min(q0 + step, n))
            query = np.repeat(q, len(self.levels[top][0]))
            node = np.tile(np.arange(len(self.levels[top][0])), len(q))
            spent = np.zeros(len(query), np.int32)
            above = None
            for level in range(top, -1, -1):
                pattern, shared = self.levels[level]
                fresh = shared[node] if above is None else shared[node] & ~above
                spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & fresh).sum(axis=1, dtype=np.int32)
                # a node whose members all are in the query's own component has no link to add; pairs are met once
                keep = (spent <= distance) & (self.uniform[level][node] != self.label[query]) & ((node + 1) * FANOUT**level > query + 1)
                query, node, spent = query[keep], node[keep], spent[keep]
                if not len(query) or not level:
                    break
                above_all = shared[node]
                below = len(self.levels[level - 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, spent, above = (np.repeat(x, FANOUT, axis=0) for x in (query, spent, above_all))
                there = child < below
                query, node, spent, above = query[there], child[there], spent[there], above[there]
            if len(query) and accept is not None:
                counts = accept(self.order[query], self.order[node])
                query, node = query[counts], node[counts]
            if len(query):
                self._unite(query, node)
        return self.label


def forest(codes: np.ndarray, distance: int, label: np.ndarray | None = None, accept=None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of edges of stars that join the codes (n, words) within the distance, and those joined before."""
    index = GrayIndex(codes, label)
    label = index.link(distance, accept)
    at = np.flatnonzero(label != np.arange(len(label)))
    return index.order[label[at]], index.order[at]


def _masks(choose: int, segments: int, within: int = FULL) -> list[int]:
    """The bits of ``within`` in segments; for each choice of ``choose`` segments their bits."""
    bits = [i for i in range(64) if within >> i & 1]
    cuts = [len(bits) * k // segments for k in range(segments + 1)]
    parts = [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(parts, choose)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, distance: int = DISTANCE, n: int | None = None) -> DataFrame:
    """nodes: distinct (fp). Edges (a, b) whose components are those of all pairs within the distance."""
    n = nodes.count() if n is None else n
    segments = distance + 1
    while segments < distance + 4 and n >> (64 * (segments - distance) // segments) > AVERAGE_BUCKET:
        segments += 1
    masks = _masks(segments - distance, segments)

    def keyed(df: DataFrame, options: list[int]) -> DataFrame:
        return df.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in options])).alias("k")).select("fp", "k.mask", "k.bits")

    dealt = keyed(nodes, masks)
    hot = materialize(dealt.groupBy("mask", "bits").count().where(F.col("count") > HOT).select("mask", "bits"), "hot")
    if not hot.isEmpty():
        cool = dealt.join(hot, ["mask", "bits"], "left_anti")
        warm = dealt.join(hot, ["mask", "bits"], "left_semi")
        parts = [keyed(warm.where(F.col("mask") == F.lit(_signed(m))), [m | x for x in _masks(1, distance + 1, FULL & ~m)]) for m in masks]
        dealt = cool.select("fp", "mask", "bits")
        for part in parts:
            dealt = dealt.unionByName(part)

    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp = rows.column("fp").to_numpy()
        a, b = forest(fp.view(np.uint64)[:, None], distance)
        return fp[a], fp[b]

    return per_bucket(dealt, ["mask", "bits"], solve)


def per_bucket(dealt: DataFrame, keys: list[str], solve, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The rows, edges (a, b) as a rule, that solve() makes of each bucket with two rows or more; a bucket is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the bucket that the last batch ended in

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(p.num_rows for p in parts) > 1:
                found = solve(pa.Table.from_batches(parts).combine_chunks())
                if len(found[0]):
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=list(names))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            turn = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                turn |= c[1:] != c[:-1]
            bounds = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                key = tuple(c[a] for c in cols)
                if held and last != key:
                    yield from done(held)
                    held = []
                last = key
                if b - a > 1 or b == batch.num_rows or held:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Null and empty texts have fingerprint zero, and link like others. A null id is passed over in component_id, which is
    null only where no id is in the component. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    label = components(links(nodes.select("fp"), distance))
    joined = nodes.join(label, F.col("fp") == F.col("node"))
    whole = joined.groupBy("label").agg(F.min("least").alias("component"))
    placed = joined.join(whole, "label").select("fp", "component")
    nodes = materialize(nodes.join(placed, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "placed")
    return marks.join(nodes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; texts of fewer words are one shingle, texts without words have none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    raw = b"".join([xxhash.xxh64_digest(joined[a : b - 1]) for a, b in zip(ends, ends[shingle:], strict=False)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of BANDS x BAND_ROWS orders of the shingles the least each: two sets agree in one with their Jaccard similarity."""
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1 << 11):
        np.minimum(least, ((short[at : at + (1 << 11)] ^ FLIP) * ODD).min(axis=1), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of BAND_ROWS least hashes; none for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for v in least_hashes(hashes).reshape(BANDS, BAND_ROWS).T:
        key = (key ^ v) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE longs: a bit is 1 if set in over half of the distinct shingles, each of which gives 64 bits to each long."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        bits = (hashes[at : at + (1 << 12), None] ^ TURN) * TIMES
        bits ^= bits >> np.uint64(32)
        ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes wanted (node, mark), from one text of each; texts: (text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = [shingles(x, shingle) for x in text_of(part)]
                yield pa.record_batch([part.column("mark"), pa.array([x.tobytes() for x in found], pa.binary())], names=["mark", "shingles"])

    wanted = materialize(wanted, "wanted")
    found = texts.join(if_small(wanted.select("mark")), "mark", "left_semi").select("mark", "text").mapInArrow(run, "mark long, shingles binary")
    found = found.groupBy("mark").agg(F.first("shingles").alias("shingles"))
    return materialize(found.join(wanted, "mark").select("node", "shingles"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, shingles) have that Jaccard similarity or more, counted exactly."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(met.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "verified")


CODES = [f"c{k}" for k in range(WIDE)]


def _codes(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in CODES], axis=1).view(np.uint64)


def _near(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over a block of a bucket, by wide fingerprints in Gray order."""
    node = rows.column("node").to_numpy()
    a, b = forest(_codes(rows), CUT)
    apart = node[a] != node[b]  # a pivot meets itself
    return np.minimum(node[a], node[b])[apart], np.maximum(node[a], node[b])[apart]


def _across(similarity: float):
    """Edges that join what isn't joined in a block of a bucket: near in Gray order, and similar by their sets of shingles.

    A pair counts in the first bucket that both have, so it is counted once.
    """

    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
        if (label == label[0]).all():
            return node[:0], node[:0]
        bucket = rows.column("bits")[0].as_py()
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(len(node), -1)
        whole = np.frombuffer(b"".join(rows.column("shingles").to_pylist()), np.uint64)
        words, of = np.unique(whole, return_inverse=True)
        ends = np.cumsum(n)
        own = [of[a:b] for a, b in zip(ends - n, ends, strict=True)]
        there = np.zeros(len(words), bool)

        def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            open_ = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9) & (node[x] != node[y])
            shared = bands[x] == bands[y]
            open_ &= bands[x, shared.argmax(axis=1)] == bucket
            at = np.flatnonzero(open_)
            out = np.zeros(len(x), bool)
            for part in np.split(at, np.flatnonzero(np.diff(x[at])) + 1) if len(at) else []:
                mine = own[x[part[0]]]
                there[mine] = True
                sizes = n[y[part]]
                shared = np.add.reduceat(there[np.concatenate([own[j] for j in y[part]])].astype(np.int32), np.cumsum(sizes) - sizes)
                there[mine] = False
                out[part] = shared >= similarity * (len(mine) + sizes - shared) - 1e-9
            return out

        a, b = forest(_codes(rows), CUT, label, accept)
        new = label[a] != label[b]
        return np.minimum(node[a], node[b])[new], np.maximum(node[a], node[b])[new]

    return solve


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """One row per row of docs: id, mark (a hash of the text), least: the smallest (id is null, id, mark) of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = [shingles(x, shingle) for x in text_of(part)]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
                codes = np.stack([wide_fingerprint(x) for x in found])
                yield pa.record_batch([part.column(0), part.column(2), pa.array(node), pa.array([len(x) for x in found], pa.int32()), *[pa.array(c) for c in codes.T], pa.array([band_keys(x).tobytes() for x in found], pa.binary())], names=["id", "mark", "node", "n", *CODES, "bands"])

    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("mark"))
    marks = materialize(texts.mapInArrow(run, "id long, mark long, node long, n int, " + ", ".join(f"{c} long" for c in CODES) + ", bands binary"), "marks")
    facts = ["n", *CODES, "bands"]
    first_id = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    nodes = materialize(marks.groupBy("node").agg(F.min(first_id).alias("least"), F.min("mark").alias("mark"), *[F.first(c).alias(c) for c in facts]), "nodes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("bands")]
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in bits])
            yield pa.record_batch([pa.array(node), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]))], names=["node", "bits"])

    dealt = nodes.select("node", "bands").mapInArrow(deal, "node long, bits long")
    sizes = materialize(dealt.groupBy("bits").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialize(dealt.join(sizes, "bits").join(nodes.drop("least"), "node"), "members")

    # candidates: in each block of a bucket a forest of near fingerprints; a bucket's smallest node is in all its blocks
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    split = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    columns = ["bits", "block", "node", *CODES]
    pivot = members.where(F.col("size") > BLOCK).groupBy("bits").agg(F.min(F.struct("node", *CODES)).alias("pivot"), F.first("size").alias("size"))
    pivot = pivot.select("bits", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "pivot.*")
    first = per_bucket(split.select(columns).unionByName(pivot.select(columns)), ["bits", "block"], _near).distinct()
    for x in "ab":
        first = first.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")), x)
    first = materialize(first.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9).select("a", "b"), "pairs")
    wanted = nodes.join(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "mark")
    edges = verified(first, _sets(texts, wanted, shingle), similarity)
    label = components(edges)

    # what a forest of candidates left apart: members of a bucket with another label than most of it meet all of its blocks
    members = members.where("size > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = members.groupBy("bits", "label").agg(F.count("*").alias("held"), F.sum("n").alias("words"))
    mixed = by_label.groupBy("bits").agg(F.count("*").alias("labels"), F.max(F.struct("held", "label")).alias("most"), F.sum("held").alias("total"), F.sum("words").alias("words")).where("labels > 1")
    parts = F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("words") * 8 / BLOCK_BYTES)).cast("int")
    mixed = mixed.select("bits", F.col("most.label").alias("common"), parts.alias("parts"))
    members = members.join(mixed, "bits")
    place = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = materialize(members.withColumn("block", F.explode(F.when(F.col("label") == F.col("common"), place).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))), "mixed")
    sets = _sets(texts, members.select("node", "mark").distinct(), shingle)
    more = per_bucket(members.select("bits", "block", "node", "label", "n", "bands", *CODES).join(sets, "node"), ["bits", "block"], _across(similarity))
    more = materialize(more.distinct(), "more")
    if not more.isEmpty():
        label = components(edges.unionByName(more))
    joined = nodes.select("node", "least").join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    placed = joined.join(joined.groupBy("label").agg(F.min("least").alias("first")), "label").select("node", F.col("first").alias("least"))
    return marks.select("id", "mark", "node").join(placed, "node").select("id", "mark", "least")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id (long), component_id, the smallest id reachable; null ids are passed over in it.

    Documents link where their sets of shingles have that Jaccard similarity, counted exactly; equal sets are one node, and
    texts without words (null, empty) are one node too. Candidates come from a Gray-order index over SimHash fingerprints
    of 256 bits, in buckets of documents that agree in all BAND_ROWS least hashes of one of BANDS bands: a pair at 0.8
    shares no bucket with a chance of 1e-4. What a first forest of candidates leaves apart is compared pair by pair.
    Other columns are not read; repeated rows stay; an empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col, shingle, similarity).select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, less the near-duplicates by similar_documents(): of each component the smallest id stays.

    A row without an id stays only where no row of its component has one. Rows that share an id are told apart by a hash
    of the text, so one that is in no other's component stays; of rows equal in id and text one stays. Texts without
    words (null, empty) are one component. An empty table gives no rows.
    """
    mark = "__simhash_mark"
    keyed = docs.withColumn(mark, F.xxhash64(text_col))
    found = _grouped(docs, id_col, text_col, STAGE_SHINGLE, SIMILARITY).select(F.col("id").alias("__simhash_key"), F.col("mark").alias(mark), (F.struct(F.col("id").isNull(), "id", "mark") == F.col("least")).alias("stays"))
    found = materialize(found, "similar")
    # so that the texts need no shuffle where few rows go
    same = lambda other: keyed[id_col].cast("long").eqNullSafe(other["__simhash_key"]) & (keyed[mark] == other["__other"])
    gone = materialize(found.where("not stays").select("__simhash_key", F.col(mark).alias("__other")).distinct(), "gone")
    again = materialize(found.where("stays").groupBy("__simhash_key", mark).count().where("count > 1").select("__simhash_key", F.col(mark).alias("__other")), "again")
    kept = keyed.join(if_small(gone), same(gone), "left_anti")
    if not again.isEmpty():
        kept = kept.join(if_small(again), same(again), "left_anti").unionByName(kept.join(if_small(again), same(again), "left_semi").dropDuplicates([id_col, mark]))
    return kept.select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
