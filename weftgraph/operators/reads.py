"""Relational reads of a graph: counts, lookups, relationships. Tables come from a graph object with the model's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, COMPLETENESS

CALL_LIMIT, UNRESOLVED_LIMIT, TOPIC_LIMIT = 100, 500, 200


def symbol_records(g) -> DataFrame:
    """Symbols with the path of their file."""
    f = g.files.select(F.col("id").alias("f_id"), F.col("path").alias("file"))
    return g.symbols.join(f, F.col("file_id") == F.col("f_id")).drop("f_id")


def entity_counts(g) -> DataFrame:
    """(entity, n) for every table."""
    parts = [df.select(F.lit(name).alias("entity")) for name, df in g.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity").agg(F.count("*").alias("n"))


def grouped_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def stats(g) -> DataFrame:
    """Totals and grouped counts in long form: (metric, value, n)."""
    total = entity_counts(g).select(F.lit("total").alias("metric"), F.col("entity").alias("value"), "n")
    for metric, df, column in (("language", g.files, "language"), ("symbol-kind", g.symbols, "kind"), ("edge-kind", g.edges, "kind"), ("classification", g.references, "classification")):
        total = total.unionByName(grouped_counts(df, column).select(F.lit(metric).alias("metric"), "value", "n"))
    return total


def graph_quality(g) -> DataFrame:
    """One row: exact edges, references and how many are of each class."""
    e = g.edges.where("resolution = 'exact'").select(F.lit("exact edge").alias("fact"))
    r = g.references.select(F.col("classification").alias("fact"))
    classes = [F.count_if(F.col("fact") == c).alias(c) for c in ("external", "dynamic", "ambiguous", "unresolved")]
    return e.unionByName(r).agg(F.count_if(F.col("fact") == "exact edge").alias("exact_edges"), F.count_if(F.col("fact") != "exact edge").alias("reference_count"), *classes)


def reference_summary(g, ids: DataFrame) -> DataFrame:
    """References of the symbols in ids (id) by class."""
    return g.references.join(ids.select(F.col("id").alias("s_id")), F.col("symbol_id") == F.col("s_id"), "left_semi").groupBy("classification").agg(F.count("*").alias("n"))


def exact_symbols(g, term: str, limit: int | None = None) -> DataFrame:
    """Symbols whose id, name or qualified name is the term, by qualified name and id."""
    found = symbol_records(g).where((F.col("id") == term) | (F.col("name") == term) | (F.col("qualified_name") == term)).orderBy("qualified_name", "id")
    return found.limit(limit) if limit else found


def symbol_at_point(g, path: str, line: int) -> DataFrame:
    """The smallest symbol of a file around a line: least lines, then the latest start, then id."""
    inside = symbol_records(g).where((F.col("file") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return inside.orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "id").limit(1)


def callers(g, target: DataFrame, limit: int = CALL_LIMIT, kinds=CALL_KINDS) -> DataFrame:
    """Who calls the symbols in target (id): distinct (name, qualified_name, file, line, edge_kind), by name and line."""
    e = g.edges.where(F.col("kind").isin(*kinds)).join(target.select(F.col("id").alias("t_id")), F.col("to_id") == F.col("t_id"))
    s = symbol_records(g).select(F.col("id").alias("s_id"), "name", "qualified_name", "file")
    out = e.join(s, F.col("from_id") == F.col("s_id")).select("name", "qualified_name", "file", F.coalesce("line", F.lit(1)).alias("line"), F.col("kind").alias("edge_kind")).distinct()
    return out.orderBy("name", "line", "qualified_name", "edge_kind").limit(limit)


def callees(g, source: DataFrame, include_external: bool = False, limit: int = CALL_LIMIT, kinds=CALL_KINDS) -> DataFrame:
    """Whom the symbols in source (id) call: symbols, and on demand external references, each leg limited by itself."""
    own = source.select(F.col("id").alias("q_id"))
    e = g.edges.where(F.col("kind").isin(*kinds)).join(own, F.col("from_id") == F.col("q_id"))
    s = symbol_records(g).select(F.col("id").alias("s_id"), "name", "qualified_name", "file")
    inside = e.join(s, F.col("to_id") == F.col("s_id")).select("name", "qualified_name", "file", F.coalesce("line", F.lit(1)).alias("line"), F.lit("exact").alias("classification")).distinct()
    inside = inside.orderBy("name", "line", "qualified_name").limit(limit)
    if not include_external:
        return inside
    r = g.references.where(F.col("kind").isin(*kinds) & (F.col("classification") == "external")).join(own, F.col("symbol_id") == F.col("q_id"))
    outside = r.select(F.col("target_text").alias("name"), F.col("target_text").alias("qualified_name"), F.lit(None).cast("string").alias("file"), F.coalesce("line", F.lit(1)).alias("line"), F.lit("external").alias("classification")).distinct()
    return inside.unionByName(outside.orderBy("name", "line").limit(limit))


def unresolved(g, file: str | None = None, platform: str | None = None, kind: str | None = None, classes: tuple[str, ...] = ("unresolved", "ambiguous"), limit: int = UNRESOLVED_LIMIT) -> DataFrame:
    """References of some classes with their owner and file, each filter only where it is given; by path, line and target."""
    s = symbol_records(g).select(F.col("id").alias("s_id"), F.col("qualified_name").alias("owner"), "file", "platform")
    r = g.references.where(F.col("classification").isin(*classes))
    if kind:
        r = r.where(F.col("kind") == kind)
    if platform:
        s = s.where(F.col("platform") == platform)
    if file:
        s = s.where(F.col("file") == file)
    out = r.join(s, F.col("symbol_id") == F.col("s_id")).select("file", F.coalesce("line", F.lit(1)).alias("line"), F.col("target_text").alias("target"), "classification", "owner").distinct()
    return out.orderBy("file", "line", "target", "owner", "classification").limit(limit)


def topic_relationships(g, topic: str, edge_kind: str | None = None, limit: int = TOPIC_LIMIT) -> DataFrame:
    """Who registers, dispatches, reads or writes a topic, named by id or key."""
    t = g.topics.where((F.col("id") == topic) | (F.col("key") == topic)).select(F.col("id").alias("t_id"), F.col("key").alias("topic"))
    e = g.edges.where("to_type = 'topic'")
    if edge_kind:
        e = e.where(F.col("kind") == edge_kind)
    s = symbol_records(g).select(F.col("id").alias("s_id"), "qualified_name", "file")
    out = e.join(t, F.col("to_id") == F.col("t_id")).join(s, F.col("from_id") == F.col("s_id"))
    out = out.select("topic", F.col("kind").alias("edge_kind"), "qualified_name", "file", F.coalesce("line", F.lit(1)).alias("line")).distinct()
    return out.orderBy("edge_kind", "qualified_name", "line").limit(limit)


def topics_used(g) -> DataFrame:
    """Every topic with the number of edges of each kind."""
    e = g.edges.where("to_type = 'topic'").groupBy("to_id", F.col("kind").alias("edge_kind")).agg(F.count("*").alias("n"))
    return g.topics.join(e, F.col("id") == F.col("to_id"), "left").select("key", "kind", "edge_kind", F.coalesce("n", F.lit(0)).alias("n"))


def effects(g, ids: DataFrame | None = None) -> DataFrame:
    """Effects with a line, with their symbol and file; of the symbols in ids (id) only, if given."""
    e = g.effects.where("line is not null")
    if ids is not None:
        e = e.join(ids.select(F.col("id").alias("i_id")), F.col("symbol_id") == F.col("i_id"), "left_semi")
    s = symbol_records(g).select(F.col("id").alias("s_id"), "qualified_name", "file")
    return e.join(s, F.col("symbol_id") == F.col("s_id")).select("qualified_name", "file", "kind", "detail", "confidence", "line")


def entry_points(g) -> DataFrame:
    """Functions and methods that no call reaches."""
    called = g.edges.where("kind = 'calls'").select(F.col("to_id").alias("c_id"))
    return symbol_records(g).where(F.col("kind").isin("function", "method")).join(called, F.col("id") == F.col("c_id"), "left_anti").select("id", "qualified_name", "file")


def orphan_topics(g) -> DataFrame:
    used = g.edges.where("to_type = 'topic'").select(F.col("to_id").alias("u_id"))
    return g.topics.join(used, F.col("id") == F.col("u_id"), "left_anti")


def aggregates_of(g, owners: DataFrame) -> DataFrame:
    """Aggregates of the owners (id) with their members in order, as one string of ordinal=value."""
    a = g.aggregates.join(owners.select(F.col("id").alias("o_id")), F.col("owner_id") == F.col("o_id"), "left_semi")
    m = g.memberships.join(a.select(F.col("id").alias("a_id")), F.col("aggregate_id") == F.col("a_id"), "left_semi")
    listed = m.groupBy("aggregate_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("members"))
    text = F.array_join(F.transform("members", lambda x: F.concat_ws("=", x["ordinal"].cast("string"), x["value"])), ",")
    return a.join(listed, F.col("id") == F.col("aggregate_id"), "left").select("id", "name", "owner_id", "completeness", "member_count", F.coalesce(text, F.lit("")).alias("members"))


def containers(g) -> DataFrame:
    """Namespaces and modules with what they contain, as one string by qualified name."""
    c = g.symbols.where(F.col("kind").isin("namespace", "module")).select(F.col("id").alias("c_id"), F.col("qualified_name").alias("container"))
    m = g.symbols.select(F.col("id").alias("m_id"), F.col("qualified_name").alias("member"))
    e = g.edges.where("kind = 'contains'").join(c, F.col("from_id") == F.col("c_id")).join(m, F.col("to_id") == F.col("m_id"))
    return e.groupBy("container").agg(F.count("*").alias("member_count"), F.concat_ws(",", F.array_sort(F.collect_list("member"))).alias("members")).withColumn("completeness", F.lit(COMPLETENESS[0]))


def relationships_of(g, ids: DataFrame) -> DataFrame:
    """Distinct (id, kind, target_text) of outgoing edges."""
    return g.edges.join(ids.select("id").withColumnRenamed("id", "i_id"), F.col("from_id") == F.col("i_id"), "left_semi").select(F.col("from_id").alias("id"), "kind", "target_text").distinct()


def exact_relationship_count(g, ids: DataFrame) -> DataFrame:
    """How many call edges have both ends among ids (id); 0 for fewer than two."""
    i = ids.select("id").distinct()
    e = g.edges.where(F.col("kind").isin(*CALL_KINDS)).join(i.withColumnRenamed("id", "x"), F.col("from_id") == F.col("x"), "left_semi").join(i.withColumnRenamed("id", "y"), F.col("to_id") == F.col("y"), "left_semi")
    return e.agg(F.countDistinct("id").alias("relationships"))


def owner_intervals(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (point_id, file_id, line) the smallest span (id, file_id, start_line, end_line) around it.

    Spans and points meet in buckets of lines, so a long file is no hot key; fewest lines win, then the latest start, id.
    """
    width = 64
    cut = spans.where("start_line is not null and end_line >= start_line").select(F.col("id").alias("owner"), "file_id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("bucket"))
    at = points.withColumn("bucket", F.floor(F.col("line") / width))
    met = at.join(cut, ["file_id", "bucket"]).where("line >= start_line and line <= end_line")
    best = F.min(F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("owner"))).alias("best")
    return met.groupBy("point_id").agg(best).select("point_id", F.col("best.owner").alias("owner"))


def null_safe_filter(column: str, value) -> Column:
    """(value is null or column = value), settled while the plan is built."""
    return F.lit(True) if value is None else F.col(column) == value


def rank(order: list[Column], partition: list[str] | None = None) -> Column:
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return F.row_number().over(w.orderBy(*order)).cast("long")
