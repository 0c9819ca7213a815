"""The graph's data model: tables, closed sets of values, identities and what every snapshot must satisfy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"

# The closed sets of the data model.
SYMBOL_KINDS = ("namespace", "module", "function", "macro", "method", "variable", "constant", "type", "protocol", "record", "multimethod", "test")
EDGE_KINDS = ("contains", "calls", "macro-invokes", "references", "imports", "implements", "extends", "topic-registers", "event-dispatches", "subscribes", "state-reads", "state-writes", "protocol-implements")
REFERENCE_CLASSES = ("external", "dynamic", "ambiguous", "unresolved")
TOPIC_KINDS = ("event", "subscription", "effect", "coeffect", "state-key")
COMPLETENESS = ("complete-static", "complete-resolved", "partial-static", "dynamic", "unknown")
CALL_KINDS = ("calls", "macro-invokes")
ENTITY_TYPES = ("file", "symbol", "edge", "reference", "topic", "effect", "aggregate", "membership")

_RANGE = "start_line long, end_line long"
SCHEMAS: dict[str, str] = {
    "files": "id string not null, path string not null, language string not null, content_hash string not null, size long, modified_at long",
    "symbols": f"id string not null, name string not null, qualified_name string not null, kind string not null, file_id string not null, platform string, analyzer string, scope string, role string, indexable boolean, signature string, doc string, {_RANGE}",
    "edges": "id string not null, kind string not null, from_id string not null, to_id string not null, to_type string not null, target_text string, resolution string, confidence double, evidence string, line long",
    "references": "id string not null, symbol_id string not null, kind string not null, target_text string not null, classification string not null, evidence string, line long",
    "topics": "id string not null, kind string not null, key string not null, platform string",
    "effects": "id string not null, kind string not null, symbol_id string not null, detail string, confidence double, line long",
    "aggregates": f"id string not null, name string, kind string, owner_id string not null, file_id string not null, completeness string, member_count long, member_kind string, analyzer string, search_text string, {_RANGE}",
    "memberships": "id string not null, aggregate_id string not null, value string, value_kind string, ordinal long, evidence string",
}


def struct_type(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def digest_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the first 32 hex digits of the SHA-256 of the parts, an absent part as an empty one."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 32))


def content_hash(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


#: (table, column, tables one of which must have it as id)
FOREIGN_KEYS = (
    ("symbols", "file_id", ("files",)),
    ("edges", "from_id", ("symbols",)),
    ("edges", "to_id", ("symbols", "topics")),
    ("references", "symbol_id", ("symbols",)),
    ("effects", "symbol_id", ("symbols",)),
    ("aggregates", "owner_id", ("symbols",)),
    ("aggregates", "file_id", ("files",)),
    ("memberships", "aggregate_id", ("aggregates",)),
)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, id) for every row that breaks the model: a missing target, a repeated id, a value out of its set.

    A table's keys and the hashes of its ids are read in one step; whole ids are compared only of rows that these pick.
    """
    from .operators import narrow

    found = []

    def add(rows: DataFrame, name: str, rule: str) -> None:
        found.append(rows.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "id"))

    for name, df in tables.items():
        keys = [(column, reduce(DataFrame.unionByName, [tables[t].select("id") for t in targets])) for owner, column, targets in FOREIGN_KEYS if owner == name]
        strays, again = narrow.suspects(df, keys)
        for (column, _), stray in zip(keys, strays, strict=True):
            if stray is not None:
                add(narrow.settle(narrow.within(df, column, stray).select("id")), name, f"missing {column}")
        if again is not None:
            ids = narrow.hashed(df.select("id"), F.xxhash64("id"), again)
            add(narrow.settle(ids.groupBy("id").count().where("count > 1").select("id")), name, "repeated id")
    closed = (("symbols", "kind", SYMBOL_KINDS), ("edges", "kind", EDGE_KINDS), ("references", "classification", REFERENCE_CLASSES), ("topics", "kind", TOPIC_KINDS), ("aggregates", "completeness", COMPLETENESS))
    for name, column, values in closed:
        add(tables[name].where(~F.col(column).isin(*values)), name, f"unknown {column}")
    return reduce(DataFrame.unionByName, found)


def check(tables: dict[str, DataFrame]) -> None:
    """Raises ValueError with some of the violations, if there are any."""
    some = violations(tables).limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r.table}: {r.rule}: {r.id[:64]}" for r in some))
