"""Context packets: what a traversal settled, with its relationships and facts, as much as a token budget takes."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from .reads import aggregates_of, effects
from .traverse import traverse

TOKENS_PER_NODE = 8


def estimate(value) -> int:
    """A quarter of the characters of the JSON form, upwards."""
    return math.ceil(len(json.dumps(value, ensure_ascii=False, sort_keys=True)) / 4)


def _facts(g, nodes: list[tuple]) -> dict:
    """All that packets of a prefix of nodes may hold, read once."""
    ids = [n[0] for n in nodes]
    frame = g.spark.createDataFrame([(i,) for i in ids], "id string") if ids else g.spark.createDataFrame([], "id string")
    files = g.files.select(F.col("id").alias("f"), "path")
    symbols = {r.id: {"id": r.id, "name": r.qualified_name, "kind": r.kind, "file": r.path, "line": r.start_line, "signature": r.signature, "doc": r.doc} for r in g.symbols.join(F.broadcast(frame), "id").join(files, F.col("file_id") == F.col("f")).select("id", "qualified_name", "kind", "path", "start_line", "signature", "doc").collect()}
    topics = {r.id: {"id": r.id, "kind": r.kind, "key": r.key} for r in g.topics.join(F.broadcast(frame), "id").collect()}
    steps = sorted({e for n in nodes for e in n[3]})
    edges = {r.id: {"from": r.from_id, "to": r.to_id, "kind": r.kind} for r in g.edges.where(F.col("id").isin(*steps)).select("id", "from_id", "to_id", "kind").collect()} if steps else {}
    names = {s["name"]: i for i, s in symbols.items()}
    fx: dict = {}
    for r in effects(g, frame).select("qualified_name", "kind", "detail").distinct().collect():
        fx.setdefault(names.get(r.qualified_name), []).append({"kind": r.kind, "detail": r.detail})
    agg: dict = {}
    for r in aggregates_of(g, frame).collect():
        agg.setdefault(r.owner_id, []).append({"name": r.name, "completeness": r.completeness, "members": r.members})
    refs: dict = {}
    for r in g.references.join(F.broadcast(frame.withColumnRenamed("id", "i_id")), F.col("symbol_id") == F.col("i_id"), "left_semi").groupBy("symbol_id", "classification").count().collect():
        refs.setdefault(r.symbol_id, {})[r.classification] = r["count"]
    return {"symbols": symbols, "topics": topics, "edges": edges, "effects": fx, "aggregates": agg, "references": refs}


def packet_of(facts: dict, nodes: list[tuple], n: int, truncated: bool) -> dict:
    """The packet of the first n nodes: relationships whose ends both are in it, each edge once."""
    ids = [x[0] for x in nodes[:n]]
    inside = set(ids)
    steps = dict.fromkeys(e for x in nodes[:n] for e in x[3])
    total: dict = {}
    for i in ids:
        for k, v in facts["references"].get(i, {}).items():
            total[k] = total.get(k, 0) + v
    return {
        "symbols": [facts["symbols"][i] for i in ids if i in facts["symbols"]],
        "topics": [facts["topics"][i] for i in ids if i in facts["topics"]],
        "relationships": [facts["edges"][e] for e in steps if e in facts["edges"] and {facts["edges"][e]["from"], facts["edges"][e]["to"]} <= inside],
        "effects": [x for i in ids for x in sorted(facts["effects"].get(i, []), key=str)],
        "aggregates": [x for i in ids for x in sorted(facts["aggregates"].get(i, []), key=str)],
        "references": total,
        "truncated": truncated or n < len(nodes),
    }


def packet(g, seeds: list[str], max_tokens: int = 8000, depth: int = 2, kinds: tuple[str, ...] | None = None) -> dict:
    """The largest packet, by whole nodes in the order in which they settled, within the budget.

    ValueError where not even the first node fits, with the tokens that it takes.
    """
    out = traverse(g, seeds, depth, max(1, max_tokens // TOKENS_PER_NODE), kinds)
    nodes = out["nodes"]
    if not nodes:
        raise ValueError("no such symbol")
    facts = _facts(g, nodes)
    low, high = 0, len(nodes)
    while low < high:
        mid = (low + high + 1) // 2
        if estimate(packet_of(facts, nodes, mid, out["truncated"])) <= max_tokens:
            low = mid
        else:
            high = mid - 1
    if not low:
        raise ValueError(f"the smallest packet takes {estimate(packet_of(facts, nodes, 1, out['truncated']))} tokens")
    made = packet_of(facts, nodes, low, out["truncated"])
    return made | {"tokens": estimate(made), "budget": {"total": max_tokens, "symbols": max_tokens * 60 // 100, "relationships": max_tokens * 25 // 100, "facts": max_tokens * 10 // 100, "header": max_tokens * 5 // 100}}


def markdown(p: dict) -> str:
    """A packet as text, a section for each part."""

    def section(title: str, rows: list[str]) -> str:
        return f"## {title}\n" + ("\n".join(rows) if rows else "None")

    names = {s["id"]: s["name"] for s in p["symbols"]} | {t["id"]: t["key"] for t in p["topics"]}
    return "\n\n".join([
        "# Context",
        section("Symbols", [f"- {s['name']} ({s['kind']}) {s['file']}:{s['line'] or 1}" + (f" {s['signature']}" if s["signature"] else "") for s in p["symbols"]]),
        section("Topics", [f"- {t['kind']} {t['key']}" for t in p["topics"]]),
        section("Relationships", [f"- {names[r['from']]} {r['kind']} {names[r['to']]}" for r in p["relationships"]]),
        section("Effects", [f"- {e['kind']} {e['detail']}" for e in p["effects"]]),
        section("Aggregates", [f"- {a['name']} ({a['completeness']}): {a['members']}" for a in p["aggregates"]]),
        section("References without target", [f"- {k}: {v}" for k, v in sorted(p["references"].items())]),
        section("Truncated", ["yes"] if p["truncated"] else []),
    ])


