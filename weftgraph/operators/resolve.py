"""Observations to entities: resolution joins, effective definitions, canonical rows, topics, literal aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import content_hash


def resolve(usages: DataFrame, definitions: DataFrame, known_namespaces: DataFrame) -> DataFrame:
    """usages (usage_id, platform, ns, name) against definitions (platform, ns, name, symbol_id).

    One definition makes an exact edge, several an ambiguous reference; none an external one where the namespace isn't of
    the project (known_namespaces: platform, ns), else an unresolved one. Returns (usage_id, classification, target).
    """
    d = definitions.groupBy("platform", "ns", "name").agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("target"))
    known = known_namespaces.select("platform", "ns").distinct().withColumn("known", F.lit(True))
    j = usages.join(d, ["platform", "ns", "name"], "left").join(known, ["platform", "ns"], "left")
    kind = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "unresolved").otherwise("external")
    return j.select("usage_id", kind.alias("classification"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def effective_definitions(observed: DataFrame) -> DataFrame:
    """observed (platform, file_id, ns, name, position, is_declare, symbol_id): of each name the last that isn't a declare."""
    real = ~F.col("is_declare")
    g = observed.groupBy("platform", "file_id", "ns", "name").agg(
        F.max_by("symbol_id", F.when(real, F.struct("position", "symbol_id"))).alias("symbol_id"), F.count("*").alias("observations"), F.count_if(F.col("is_declare")).alias("declarations"), F.count_if(real).alias("definitions")
    )
    return g.where("definitions > 0").drop("definitions")


def canonical(rows: DataFrame, key: str = "id") -> DataFrame:
    """Equal rows become one. ValueError where a key has different rows."""
    once = rows.distinct()
    clash = once.groupBy(key).count().where("count > 1").limit(3).collect()
    if clash:
        raise ValueError("different rows for " + ", ".join(str(r[0])[:256] for r in clash))
    return once


def conflicts(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.distinct().groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")


def topic_owners(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(topic, path): the least path among the files whose symbols use a topic."""
    s = symbols.select(F.col("id").alias("s_id"), "file_id")
    f = files.select(F.col("id").alias("f_id"), "path")
    return edges.where("to_type = 'topic'").join(s, F.col("from_id") == F.col("s_id")).join(f, F.col("file_id") == F.col("f_id")).groupBy(F.col("to_id").alias("topic")).agg(F.min("path").alias("path"))


def literal_summary(members: DataFrame) -> DataFrame:
    """members (aggregate_id, value_kind, literal): count, completeness and the kind they share, or mixed."""
    return members.groupBy("aggregate_id").agg(
        F.count("*").alias("member_count"),
        F.when(F.bool_and("literal"), "complete-static").otherwise("partial-static").alias("completeness"),
        F.when(F.min("value_kind") == F.max("value_kind"), F.min("value_kind")).otherwise("mixed").alias("member_kind"),
    )


def ordinals(members: DataFrame, kind: str, order: list) -> DataFrame:
    """0-based places of an aggregate's members: of a map by key text, of a set by value text, else as in the source."""
    from pyspark.sql import Window

    by = {"map": ["key"], "set": ["value"]}.get(kind, []) + order
    return members.withColumn("ordinal", F.row_number().over(Window.partitionBy("aggregate_id").orderBy(*by)) - 1)


def document_hash(version: str, model: str, revision: str, chunks: Column) -> Column:
    """SHA-256 over version, model, revision and all chunk texts, NUL between them."""
    head = F.array(F.lit(version), F.lit(model), F.lit(revision))
    return F.sha2(F.array_join(F.concat(head, chunks), "\x00"), 256)


def file_fingerprints(facts: DataFrame) -> DataFrame:
    """facts (file_id, fact): a hash of each file's facts in order, each once."""
    return facts.distinct().groupBy("file_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fact")), "\n"), 256).alias("fingerprint"))


def graph_revision(files: DataFrame) -> DataFrame:
    """One row: the hash of the hashes of all files by id. Files are hashed in 256 groups first, so no list is of all files."""
    groups = files.select(F.substring(F.sha2("id", 256), 1, 2).alias("grp"), F.concat_ws(":", "id", "content_hash").alias("row"))
    part = groups.groupBy("grp").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("h"))
    return part.agg(content_hash(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "grp", "h"))), "\n")).alias("revision"))
