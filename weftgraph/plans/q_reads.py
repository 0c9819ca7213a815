"""Registered queries: relational reads."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from .. import schema
from ..catalog import query
from ..operators import reads

RECORDS = "symbols s join (select id f_id, path as file from files) on s.file_id=f_id"


@query("g_entity_counts", "select * from (select 'files' entity, count(*) n from files union all select 'symbols', count(*) from symbols union all select 'edges', count(*) from edges union all select 'references', count(*) from refs union all select 'topics', count(*) from topics union all select 'effects', count(*) from effects union all select 'aggregates', count(*) from aggs union all select 'memberships', count(*) from memberships)")
def entity_counts(g):
    return reads.entity_counts(g)


@query("g_grouped_kind", "select kind as value, count(*) n from symbols group by 1")
def grouped_kind(g):
    return reads.grouped_counts(g.symbols, "kind")


@query("g_grouped_language", "select language as value, count(*) n from files group by 1")
def grouped_language(g):
    return reads.grouped_counts(g.files, "language")


@query("g_stats", "select 'total' metric, * from (select 'files' as value, count(*) n from files union all select 'symbols', count(*) from symbols union all select 'edges', count(*) from edges union all select 'references', count(*) from refs union all select 'topics', count(*) from topics union all select 'effects', count(*) from effects union all select 'aggregates', count(*) from aggs union all select 'memberships', count(*) from memberships) union all select 'language', language, count(*) from files group by 2 union all select 'symbol-kind', kind, count(*) from symbols group by 2 union all select 'edge-kind', kind, count(*) from edges group by 2 union all select 'classification', classification, count(*) from refs group by 2")
def stats(g):
    return reads.stats(g)


@query("g_quality", "select (select count(*) from edges where resolution='exact') exact_edges, count(*) reference_count, count(*) filter (classification='external') as \"external\", count(*) filter (classification='dynamic') as \"dynamic\", count(*) filter (classification='ambiguous') as ambiguous, count(*) filter (classification='unresolved') as unresolved from refs")
def quality(g):
    return reads.graph_quality(g)


@query("g_reference_summary", "select classification, count(*) n from refs where symbol_id in (select id from keyed where src='order' and key < 50) group by 1")
def reference_summary(g):
    return reads.reference_summary(g, g.orders.where("key < 50"))


@query("g_unresolved_count", "select count(*) n from refs where classification in ('unresolved','ambiguous')")
def unresolved_count(g):
    return g.references.agg(F.count_if(F.col("classification").isin("unresolved", "ambiguous")).alias("n"))


@query("g_exact_symbols", f"select s.id, name, qualified_name, kind, file from {RECORDS} where s.name='order-7' or s.qualified_name='order-7' or s.id='order-7'")
def exact_symbols(g):
    return reads.exact_symbols(g, "order-7").select("id", "name", "qualified_name", "kind", "file")


@query("g_symbol_at_point", f"select s.id, qualified_name, start_line, end_line from {RECORDS} where file=(select min(path) from files) and start_line<=28 and end_line>=28 order by end_line-start_line, start_line desc, s.id limit 1")
def symbol_at_point(g):
    path = g.files.agg(F.min("path")).first()[0]
    return reads.symbol_at_point(g, path, 28).select("id", "qualified_name", "start_line", "end_line")


@query("g_owner_interval", "select point_id, owner from (select r.l_orderkey||'-'||r.l_partkey||'-'||r.l_linenumber||'-'||r.n point_id, s.id owner, row_number() over (partition by r.l_orderkey, r.l_partkey, r.l_linenumber, r.n order by s.end_line-s.start_line, s.start_line desc, s.id) rn from (select l_orderkey, l_partkey, l_linenumber, l_suppkey n, l_orderkey % 400 as line, l_partkey % 25 as nk from (select distinct l_orderkey, l_partkey, l_linenumber, l_suppkey from lineitem)) r join nations on n_nationkey=nk join symbols s on s.file_id=nations.file_id and s.start_line<=r.line and s.end_line>=r.line) where rn=1")
def owner_interval(g):
    li = g.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").distinct()
    points = li.join(F.broadcast(g.nations), F.col("l_partkey") % 25 == F.col("n_nationkey")).select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").alias("point_id"), "file_id", (F.col("l_orderkey") % 400).alias("line"))
    return reads.owner_intervals(points, g.symbols)


@query("g_callers", "select distinct s.name, s.qualified_name, f.path as file, coalesce(e.line,1) as line, e.kind as edge_kind from keyed t join edges e on e.to_id=t.id and e.kind in ('calls','macro-invokes') join symbols s on s.id=e.from_id join files f on f.id=s.file_id where t.src='part' and t.key=1 order by name, line, qualified_name, edge_kind limit 100")
def callers(g):
    return reads.callers(g, g.parts.where("key = 1"))


@query("g_callees", "select distinct s.name, s.qualified_name, f.path as file, coalesce(e.line,1) as line, 'exact' as classification from keyed q join edges e on e.from_id=q.id and e.kind in ('calls','macro-invokes') join symbols s on s.id=e.to_id join files f on f.id=s.file_id where q.src='customer' and q.key<10 order by name, line, qualified_name limit 100")
def callees(g):
    return reads.callees(g, g.customers.where("key < 10"))


@query("g_callees_external", "+ q as (select id from keyed where src='order' and key<20) select * from (select distinct s.name, s.qualified_name, f.path as file, coalesce(e.line,1) as line, 'exact' as classification from q join edges e on e.from_id=q.id and e.kind in ('calls','macro-invokes') join symbols s on s.id=e.to_id join files f on f.id=s.file_id order by name, line, qualified_name limit 100) union all select * from (select distinct target_text as name, target_text as qualified_name, cast(null as varchar) as file, coalesce(line,1) as line, 'external' as classification from refs where classification='external' and symbol_id in (select id from q) order by name, line limit 100)")
def callees_external(g):
    return reads.callees(g, g.orders.where("key < 20"), include_external=True)


UNRESOLVED = "select distinct f.path as file, coalesce(r.line,1) as line, r.target_text as target, classification, s.qualified_name as owner from refs r join symbols s on s.id=r.symbol_id join files f on f.id=s.file_id where {} order by file, line, target, owner, classification limit 500"


@query("g_unresolved", UNRESOLVED.format("classification in ('unresolved','ambiguous')"))
def unresolved(g):
    return reads.unresolved(g)


@query("g_unresolved_filtered", UNRESOLVED.format("classification='dynamic' and s.platform='clj' and f.path=(select min(path) from files)"))
def unresolved_filtered(g):
    path = g.files.agg(F.min("path")).first()[0]
    return reads.unresolved(g, file=path, platform="clj", kind="calls", classes=("dynamic",))


@query("g_topics", "select t.key, t.kind, e.kind as edge_kind, count(e.id) n from topics t left join edges e on e.to_id=t.id group by 1,2,3")
def topics(g):
    return reads.topics_used(g)


TOPIC = "select distinct t.key as topic, e.kind as edge_kind, s.qualified_name, f.path as file, coalesce(e.line,1) as line from topics t join edges e on e.to_id=t.id join symbols s on s.id=e.from_id join files f on f.id=s.file_id where t.key='{}' {} order by edge_kind, qualified_name, line limit 200"


@query("g_topic_relationships", TOPIC.format("click", ""))
def topic_relationships(g):
    return reads.topic_relationships(g, "click")


@query("g_topic_dispatchers", TOPIC.format("purchase", "and e.kind='event-dispatches'"))
def topic_dispatchers(g):
    return reads.topic_relationships(g, "purchase", "event-dispatches")


@query("g_effects", "select qualified_name, f.path as file, e.kind, detail, confidence, line from effects e join symbols s on s.id=e.symbol_id join files f on f.id=s.file_id where line is not null")
def effects(g):
    return reads.effects(g)


@query("g_effects_selected", "select qualified_name, f.path as file, e.kind, detail, confidence, line from effects e join keyed s on s.id=e.symbol_id join files f on f.id=s.file_id where line is not null and s.src='customer' and s.key<25")
def effects_selected(g):
    return reads.effects(g, g.customers.where("key < 25"))


@query("g_entry_points", "select s.id, qualified_name, f.path as file from symbols s join files f on f.id=s.file_id where s.kind in ('function','method') and not exists (select 1 from edges e where e.kind='calls' and e.to_id=s.id)")
def entry_points(g):
    return reads.entry_points(g)


@query("g_orphan_topics", "select t.id, t.kind, t.key, t.platform from topics t where not exists (select 1 from edges e where e.to_id=t.id and e.kind='topic-registers')")
def orphan_topics(g):
    return reads.orphan_topics(SimpleNamespace(topics=g.topics, edges=g.edges.where("kind = 'topic-registers'")))


@query("g_fk_violations", "select 'edges' as \"table\", 'missing to_id' as rule, id from edges where right(id, 2) = '00' union all select 'symbols', 'missing file_id', id from symbols where right(id, 2) = '01' union all select 'aggregates', 'unknown completeness', id from aggs where right(id, 2) = '02'")
def fk_violations(g):
    """A share of the rows is broken before the audit: their targets are missing, or a value is out of its set."""
    t = g.lean().tables()
    bad = lambda column, end, value: F.when(F.col("id").endswith(end), value).otherwise(F.col(column))
    t["edges"] = t["edges"].withColumn("to_id", bad("to_id", "00", F.concat(F.lit("missing:"), "id")))
    t["symbols"] = t["symbols"].withColumn("file_id", bad("file_id", "01", F.lit("file:missing")))
    t["aggregates"] = t["aggregates"].withColumn("completeness", bad("completeness", "02", F.lit("no such value")))
    return schema.violations(t)


@query("g_bijection", "select coalesce(f.path, n.path) as path, case when f.path is null then 'extra' when n.path is null then 'missing' else 'duplicate' end as problem from (select path from files where modified_at % 5 <> 0) f full join (select path from files where modified_at % 3 <> 0) n on f.path=n.path where f.path is null or n.path is null")
def bijection(g):
    from ..operators.incremental import path_problems

    return path_problems(g.files.where("modified_at % 5 <> 0").select("path"), g.files.where("modified_at % 3 <> 0").select("path"))


@query("g_aggregates_nested", "select a.id, a.name, owner_id, completeness, member_count, coalesce(string_agg(ordinal||'='||value, ',' order by ordinal, value),'') as members from aggs a left join memberships m on m.aggregate_id=a.id group by 1,2,3,4,5")
def aggregates_nested(g):
    return reads.aggregates_of(g, g.orders)


@query("g_containers", "select c.qualified_name as container, count(*) as member_count, string_agg(m.qualified_name, ',' order by m.qualified_name) as members, 'complete-static' as completeness from symbols c join edges e on e.from_id=c.id and e.kind='contains' join symbols m on m.id=e.to_id where c.kind in ('namespace','module') group by 1")
def containers(g):
    return reads.containers(g)


@query("g_relationships", "select distinct from_id as id, kind, target_text from edges where from_id in (select id from keyed where src='customer')")
def relationships(g):
    return reads.relationships_of(g, g.customers)


@query("g_relationship_count", "+ i as (select id from keyed where src in ('customer','order')) select count(distinct id) relationships from edges where kind in ('calls','macro-invokes') and from_id in (select id from i) and to_id in (select id from i)")
def relationship_count(g):
    return reads.exact_relationship_count(g, g.customers.unionByName(g.orders))


@query("g_symbol_records", f"select s.id, name, qualified_name, kind, file, s.signature, s.doc from {RECORDS}")
def symbol_records(g):
    return reads.symbol_records(g).select("id", "name", "qualified_name", "kind", "file", "signature", "doc")
