"""Traversal: bounded breadth-first search, best-first expansion under costs, packets under a token budget, closures.

Frontiers and what has been visited are tables; a loop runs once a level and cuts its lineage in the shared folder.
"""

from __future__ import annotations

import heapq
import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CALL_KINDS

# What a step along an edge of each kind costs.
EDGE_COSTS = {"calls": 1.0, "macro-invokes": 1.0, "references": 1.0, "topic-registers": 0.5, "event-dispatches": 0.5, "subscribes": 0.5, "state-reads": 0.5, "state-writes": 0.5, "protocol-implements": 1.25, "implements": 1.25, "imports": 2.0, "contains": 0.25}
UNKNOWN_COST = 2.0
DEPTH, LIMIT = 4, 200


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df written to the shared folder and read back; options are the writer's."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def adjacent(g, frontier: DataFrame, directions: tuple[str, ...] = ("outgoing", "incoming"), kinds: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Exact neighbours of frontier (id) in one or both directions: (kind, from_id, to_id, edge_id, direction, line), in that order."""
    e = g.edges.where("resolution = 'exact'")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    f = frontier.select(F.col("id").alias("f_id")).distinct()
    legs = []
    for direction, own in (("outgoing", "from_id"), ("incoming", "to_id")):
        if direction in directions:
            legs.append(e.join(f, F.col(own) == F.col("f_id"), "left_semi").select("kind", "from_id", "to_id", F.col("id").alias("edge_id"), F.lit(direction).alias("direction"), F.coalesce("line", F.lit(1)).alias("line")))
    out = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    return out.orderBy("kind", "from_id", "to_id", "edge_id", "direction").limit(limit) if limit else out


@dataclass
class Trace:
    results: DataFrame
    truncated_by_depth: bool
    truncated_by_limit: bool


def trace(g, source: DataFrame, depth: int = DEPTH, limit: int = LIMIT, kinds: tuple[str, ...] = CALL_KINDS) -> Trace:
    """Callees of source (id), level by level, each once at its least depth; at most ``limit`` in (depth, name, id) order.

    What a level has beyond the limit is left out by qualified name and id. The sources themselves aren't results.
    """
    if depth < 1 or limit < 1:
        raise ValueError("depth and limit must be positive")
    calls = cut(g.edges.where(F.col("kind").isin(*kinds) & (F.col("to_type") == "symbol")).select("from_id", "to_id").distinct())
    names = g.symbols.select("id", "name", "qualified_name")
    frontier = cut(source.select("id").distinct())
    if frontier.isEmpty():
        raise ValueError("no such symbol")
    visited, found, count = frontier, None, 0

    def targets(front: DataFrame, seen: DataFrame) -> DataFrame:
        nxt = calls.join(front, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id")).distinct()
        return nxt.join(seen, "id", "left_anti")

    by_depth = by_limit = False
    for level in range(1, depth + 1):
        nxt = targets(frontier, visited).join(names, "id").orderBy("qualified_name", "id").limit(limit - count + 1)
        nxt = cut(nxt.withColumn("depth", F.lit(level)).withColumn("rn", F.row_number().over(Window.partitionBy("depth").orderBy("qualified_name", "id"))))  # of limit + 1 rows at most
        n = nxt.count()
        if not n:
            break
        over = n > limit - count
        nxt = nxt.where(F.col("rn") <= limit - count).drop("rn")
        found = nxt if found is None else found.unionByName(nxt)
        count += min(n, limit - count)
        visited = visited.unionByName(nxt.select("id"))
        frontier = nxt.select("id")
        if over:
            by_limit = True
            break
        if count == limit:
            deeper = not targets(frontier, visited).isEmpty()
            by_limit, by_depth = deeper, deeper and level == depth
            break
        if level == depth:
            by_depth = not targets(frontier, visited).isEmpty()
    if found is None:
        found = names.limit(0).withColumn("depth", F.lit(0))
    return Trace(found.select("id", "name", "qualified_name", "depth"), by_depth, by_limit)


def closure(calls: DataFrame, source: DataFrame, depth: int) -> DataFrame:
    """All reached from source (id) within depth steps, set by set: (id, depth), depth the least."""
    steps = cut(calls.select("from_id", "to_id").distinct())
    frontier = cut(source.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        nxt = steps.join(frontier.select("id"), F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def least_costs(g, source: DataFrame, depth: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, cost): the least cost from source (id) to each symbol or topic within depth outgoing steps."""
    e = g.edges if kinds is None else g.edges.where(F.col("kind").isin(*kinds))
    table = F.create_map(*[F.lit(x) for kv in EDGE_COSTS.items() for x in kv])
    e = cut(e.groupBy("from_id", "to_id").agg(F.min(F.coalesce(table[F.col("kind")], F.lit(UNKNOWN_COST))).alias("step")))
    best = cut(source.select("id").distinct().withColumn("cost", F.lit(0.0)))
    frontier = best
    for _ in range(depth):
        nxt = e.join(frontier, F.col("from_id") == F.col("id")).groupBy(F.col("to_id").alias("n_id")).agg(F.min(F.col("cost") + F.col("step")).alias("n_cost"))
        joined = nxt.join(best, F.col("n_id") == F.col("id"), "left").where("cost is null or n_cost < cost")
        frontier = cut(joined.select(F.col("n_id").alias("id"), F.col("n_cost").alias("cost")))
        if frontier.isEmpty():
            break
        best = cut(best.unionByName(frontier).groupBy("id").agg(F.min("cost").alias("cost")))
    return best


@dataclass(order=True)
class _Step:
    cost: float
    proximity: int
    name: str
    id: str
    depth: int = field(compare=False)
    path: tuple = field(compare=False)


TOGETHER = 64
"""Nodes whose neighbours are asked for in one job."""


def _neighbours(g, ids: list[str], kinds: tuple[str, ...] | None, most: int) -> dict[str, list]:
    """Of each id the first ``most`` exact neighbours, in the order of adjacent()."""
    e = g.edges.where("resolution = 'exact'")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    legs = [e.where(F.col(own).isin(*ids)).select(F.col(own).alias("of"), "kind", "from_id", "to_id", F.col("id").alias("edge_id"), F.lit(direction).alias("direction")) for direction, own in (("outgoing", "from_id"), ("incoming", "to_id"))]
    order = ["kind", "from_id", "to_id", "edge_id", "direction"]
    rows = legs[0].unionByName(legs[1]).withColumn("rn", F.row_number().over(Window.partitionBy("of").orderBy(*order))).where(F.col("rn") <= most)
    found: dict[str, list] = {i: [] for i in ids}
    for r in sorted(rows.collect(), key=lambda r: r.rn):  # at most ``most`` for each of TOGETHER nodes
        found[r["of"]].append(r)
    return found


def traverse(g, seeds: list[str], depth: int = 2, max_nodes: int = 100, kinds: tuple[str, ...] | None = None) -> dict:
    """Best-first expansion from seed ids by (cost, proximity to the first seed, qualified name, id).

    At most max_nodes nodes are settled. Neighbours are asked for by key, those of the best TOGETHER nodes that wait in one
    job, so there are about as many jobs as the result has times TOGETHER nodes; the order is decided here, over them.
    Returns {"nodes": [(id, cost, depth, path of edge ids)], "truncated": bool}. A namespace never opens what it contains.
    """
    info: dict[str, tuple] = {}

    def describe(ids: list[str]) -> None:
        ask = [i for i in ids if i not in info]
        if ask:
            for r in g.symbols.where(F.col("id").isin(*ask)).select("id", "qualified_name", "file_id", "kind").collect():
                info[r.id] = (r.qualified_name, r.file_id, r.kind)
            for r in g.topics.where(F.col("id").isin(*ask)).select("id", "key").collect():
                info[r.id] = (r.key, None, "topic")

    describe(seeds)
    focus = info.get(seeds[0], ("", None, "")) if seeds else ("", None, "")

    def proximity(i: str) -> int:
        name, file, kind = info[i]
        if kind == "topic" or file == focus[1]:
            return 0
        return 1 if name.split("/")[0] == focus[0].split("/")[0] else 2

    queue = [_Step(0.0, 0, info[s][0], s, 0, ()) for s in dict.fromkeys(seeds) if s in info]
    heapq.heapify(queue)
    settled: dict[str, _Step] = {}
    held: dict[str, list] = {}
    seen = {s.id for s in queue}
    by_depth = False
    while queue and len(settled) < max_nodes:
        at = heapq.heappop(queue)
        if at.id in settled:
            continue
        settled[at.id] = at
        if at.id not in held:
            ask = [at.id, *dict.fromkeys(s.id for s in heapq.nsmallest(4 * TOGETHER, queue) if s.id not in held and s.id != at.id)]
            held |= _neighbours(g, ask[:TOGETHER], kinds, max_nodes + 1)
        near = held[at.id][: 20 if at.depth == depth else max_nodes - len(settled) + 1]
        if at.depth == depth:
            by_depth |= any((r.to_id if r.direction == "outgoing" else r.from_id) not in seen for r in near)
            continue
        others = [(r, r.to_id if r.direction == "outgoing" else r.from_id) for r in near]
        others = [(r, o) for r, o in others if o not in settled and not (r.kind == "contains" and r.direction == "outgoing" and info[at.id][2] == "namespace")]
        describe([o for _, o in others])
        for r, o in others:
            if o in info:
                seen.add(o)
                heapq.heappush(queue, _Step(at.cost + EDGE_COSTS.get(r.kind, UNKNOWN_COST), proximity(o), info[o][0], o, at.depth + 1, (*at.path, r.edge_id)))
    return {"nodes": [(s.id, s.cost, s.depth, s.path) for s in settled.values()], "truncated": by_depth or any(s.id not in settled for s in queue)}


def topic_bridge(g) -> DataFrame:
    """(from_id, topic, to_id): who dispatches a topic and who registers or subscribes to it."""
    e = g.edges.where("to_type = 'topic'")
    out = e.where("kind = 'event-dispatches'").select("from_id", F.col("to_id").alias("topic"))
    into = e.where(F.col("kind").isin("topic-registers", "subscribes")).select(F.col("from_id").alias("to_id"), F.col("to_id").alias("topic"))
    return out.join(into, "topic").distinct()


def affected(references: DataFrame, exports: DataFrame, changed: DataFrame) -> DataFrame:
    """Files to analyse again: changed ones, and all that reference what an affected file exports, to a fixed point.

    references: (path, key); exports: (path, key); changed: (path).
    """
    depends = cut(references.join(exports.select(F.col("path").alias("home"), "key"), "key").where("path <> home").select("path", "home").distinct())
    front = cut(changed.select("path").distinct())
    seen = front
    while True:
        nxt = depends.join(front.select(F.col("path").alias("home")), "home", "left_semi").select("path").distinct()
        front = cut(nxt.join(seen, "path", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def largest_prefix(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked: (rank, text), a packet's items in order. Those whose running token estimate stays within the budget."""
    w = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.ceil(F.length("text") / 4)
    return ranked.withColumn("tokens", cost).withColumn("total", F.sum("tokens").over(w)).where(F.col("total") <= budget)
