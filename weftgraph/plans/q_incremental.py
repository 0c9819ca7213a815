"""Registered queries: resolution, identities, differences, queues, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..catalog import query
from ..operators import incremental as I
from ..operators import narrow
from ..operators import resolve as R
from ..streaming import jobs, windows

USE = "use as (select distinct l_orderkey||'-'||l_partkey usage_id, 'p'||l_linestatus platform, 'ns'||(l_partkey%20) ns, p_name as name from lineitem join part on p_partkey=l_partkey), defs as (select 'p'||(case when p_partkey%2=0 then 'O' else 'F' end) platform, 'ns'||(p_partkey%15) ns, p_name as name, p_partkey symbol_id from part), known as (select distinct platform, ns from defs)"


@query("i_resolve", f"+ {USE}, d as (select platform, ns, name, count(distinct symbol_id) n, min(symbol_id) target from defs group by 1,2,3) select usage_id, case when n=1 then 'exact' when n>1 then 'ambiguous' when known.ns is not null then 'unresolved' else 'external' end as classification, case when n=1 then target end as target from use left join d using (platform, ns, name) left join known using (platform, ns)")
def resolve(g):
    li = g.table("lineitem").join(g.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    use = li.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("usage_id"), F.concat(F.lit("p"), "l_linestatus").alias("platform"), F.concat(F.lit("ns"), F.col("l_partkey") % 20).alias("ns"), F.col("p_name").alias("name")).distinct()
    defs = g.table("part").select(F.concat(F.lit("p"), F.when(F.col("p_partkey") % 2 == 0, "O").otherwise("F")).alias("platform"), F.concat(F.lit("ns"), F.col("p_partkey") % 15).alias("ns"), F.col("p_name").alias("name"), F.col("p_partkey").alias("symbol_id"))
    return R.resolve(use, defs, defs)


@query("i_effective_defs", "select platform, file_id, ns, name, arg_max(symbol_id, pos) filter (not is_declare) as symbol_id, count(*) observations, count(*) filter (is_declare) declarations from (select 'clj' platform, o_custkey file_id, 'n'||(o_orderkey%3) ns, o_orderpriority as name, o_orderkey pos, o_orderstatus='O' is_declare, o_orderkey symbol_id from orders) group by 1,2,3,4 having count(*) filter (not is_declare) > 0")
def effective(g):
    o = g.table("orders")
    seen = o.select(F.lit("clj").alias("platform"), F.col("o_custkey").alias("file_id"), F.concat(F.lit("n"), F.col("o_orderkey") % 3).alias("ns"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "O").alias("is_declare"), F.col("o_orderkey").alias("symbol_id"))
    return R.effective_definitions(seen)


@query("i_canonical_conflicts", "select id, count(*) versions from (select distinct l_orderkey||'-'||l_linenumber id, l_partkey, l_suppkey from lineitem) group by 1 having count(*) > 1")
def conflicts(g):
    return R.conflicts(g.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", "l_suppkey"))


@query("i_canonical_dedup", "select distinct id, l_partkey, l_suppkey, l_quantity from (select l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber||'-'||l_quantity::int id, l_partkey, l_suppkey, l_quantity from lineitem)")
def canonical(g):
    return R.canonical(g.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int")).alias("id"), "l_partkey", "l_suppkey", "l_quantity"))


@query("i_topic_owner", "select e.to_id as topic, min(f.path) path from edges e join symbols s on s.id=e.from_id join files f on f.id=s.file_id where e.to_type='topic' group by 1")
def topic_owner(g):
    return R.topic_owners(g.edges, g.symbols, g.files)


@query("i_member_ordinals", "select l_orderkey aggregate_id, l_partkey::varchar as value, row_number() over (partition by l_orderkey order by l_partkey::varchar, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 ordinal from lineitem")
def member_ordinals(g):
    m = g.table("lineitem").select(F.col("l_orderkey").alias("aggregate_id"), F.col("l_partkey").cast("string").alias("value"), "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.ordinals(m, "set", ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select("aggregate_id", "value", F.col("ordinal").cast("long").alias("ordinal"))


@query("i_aggregate_summary", "select l_orderkey aggregate_id, count(*) member_count, case when bool_and(l_linestatus='F') then 'complete-static' else 'partial-static' end as completeness, case when count(distinct l_returnflag)=1 then min(l_returnflag) else 'mixed' end as member_kind from lineitem group by 1")
def aggregate_summary(g):
    return R.literal_summary(g.table("lineitem").select(F.col("l_orderkey").alias("aggregate_id"), F.col("l_returnflag").alias("value_kind"), (F.col("l_linestatus") == "F").alias("literal")))


@query("i_ids", "select id, kind, qualified_name from symbols")
def ids(g):
    return g.symbols.select("id", "kind", "qualified_name")


@query("i_graph_revision", "select 'sha256:'||sha256(string_agg(grp||':'||h, chr(10) order by grp||':'||h)) revision from (select substr(sha256(id),1,2) grp, sha256(string_agg(id||':'||content_hash, chr(10) order by id||':'||content_hash)) h from files group by 1)")
def revision(g):
    return R.graph_revision(g.files)


@query("i_file_fingerprint", "select file_id, sha256(string_agg(fact, chr(10) order by fact)) fingerprint from (select distinct file_id, id||'|'||kind||'|'||qualified_name fact from symbols) group by 1")
def fingerprint(g):
    return R.file_fingerprints(g.symbols.select("file_id", F.concat_ws("|", "id", "kind", "qualified_name").alias("fact")))


@query("i_document_hash", "select doc_id, sha256('v1'||chr(0)||'m'||chr(0)||'r1'||chr(0)||text||chr(0)||lang) hash from documents")
def document_hash(g):
    return g.table("documents").select("doc_id", R.document_hash("v1", "m", "r1", F.array("text", "lang")).alias("hash"))


@query("d_changed_files", "select coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'modified' end as change from (select path, content_hash from files where modified_at % 4 <> 1) o full join (select path, case when modified_at % 5 = 0 then 'sha256:new' else content_hash end content_hash from files where modified_at % 6 <> 1) n on o.path=n.path where o.path is null or n.path is null or o.content_hash <> n.content_hash")
def changed(g):
    old = g.files.where("modified_at % 4 <> 1")
    new = g.files.where("modified_at % 6 <> 1").withColumn("content_hash", F.when(F.col("modified_at") % 5 == 0, "sha256:new").otherwise(F.col("content_hash")))
    return I.changed_files(old, new)


RECON = "d as (select doc_id symbol_id, 'h'||(case when quality=1 then doc_id else doc_id+1 end) document_hash, 'r' model_revision, 1 chunk_count from labels where doc_id % 7 <> 0), i as (select doc_id symbol_id, 'h'||doc_id document_hash, 'r' model_revision, 1 chunk_count from labels where doc_id % 5 <> 0), p as (select doc_id symbol_id, case when doc_id % 2 = 0 then 'failed' else 'pending' end status from labels where toxic=1)"


@query("d_reconcile_plan", f"+ {RECON} select symbol_id, case when d.document_hash is not null and d.document_hash=i.document_hash then (case when status is null then 'unchanged' else 'cancel' end) when d.document_hash is not null then (case when status='failed' then 'failed' else 'upsert' end) when i.document_hash is not null then 'delete' else 'cancel' end as action from d full join i using (symbol_id) full join p using (symbol_id)")
def reconcile(g):
    labels = g.table("labels")
    doc = F.col("doc_id")
    common = [F.lit("r").alias("model_revision"), F.lit(1).alias("chunk_count")]
    d = labels.where("doc_id % 7 <> 0").select(doc.alias("symbol_id"), F.concat(F.lit("h"), F.when(F.col("quality") == 1, doc).otherwise(doc + 1)).alias("document_hash"), *common)
    i = labels.where("doc_id % 5 <> 0").select(doc.alias("symbol_id"), F.concat(F.lit("h"), doc).alias("document_hash"), *common)
    p = labels.where("toxic = 1").select(doc.alias("symbol_id"), F.when(doc % 2 == 0, "failed").otherwise("pending").alias("status"))
    return I.reconcile_plan(d, i, p)


@query("d_snapshot_diff", "select coalesce(o.o_orderkey, n.o_orderkey) as id, case when o.o_orderkey is null then 'only-new' when n.o_orderkey is null then 'only-old' else 'changed' end as change from (select * from orders where o_orderkey % 9 <> 0) o full join (select o_orderkey, o_custkey, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 0) n on o.o_orderkey=n.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.o_orderstatus <> n.o_orderstatus")
def snapshot_diff(g):
    o = g.table("orders").withColumnRenamed("o_orderkey", "id")
    new = o.where("id % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return I.snapshot_difference(o.where("id % 9 <> 0"), new)


GONE = "+ gone_files as (select id from files where modified_at < 3), gone as (select id from symbols where file_id in (select id from gone_files)) "


@query("d_cascade_delete", GONE + "select 'files' entity, count(*) n from files where id not in (select id from gone_files) union all select 'symbols', count(*) from symbols where id not in (select id from gone) union all select 'edges', count(*) from edges where from_id not in (select id from gone) and to_id not in (select id from gone) union all select 'references', count(*) from refs where symbol_id not in (select id from gone) union all select 'effects', count(*) from effects where symbol_id not in (select id from gone) union all select 'aggregates', count(*) from aggs where owner_id not in (select id from gone) union all select 'memberships', count(*) from memberships m join aggs a on a.id=m.aggregate_id where a.owner_id not in (select id from gone) union all select 'topics', count(distinct to_id) from edges where to_type='topic' and from_id not in (select id from gone)")
def cascade(g):
    from functools import reduce

    g = g.stored()
    left = I.delete_files(g.tables(), g.files.where("modified_at < 3"))
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.lit(name).alias("entity"), F.count("*").alias("n")) for name, df in left.items()])


@query("d_replace_identity", "select id, 'changed' as change from symbols where file_id in (select id from files where modified_at in (1, 2))")
def replace(g):
    """Some files' own facts again, but for their symbols' documentation: those symbols change, and no edge or other symbol."""
    g = g.lean()
    tables = g.tables()
    f = g.files.where("modified_at in (1, 2)")
    gone = narrow.values(narrow.within(tables["symbols"], "file_id", narrow.values(f)))
    new = {"files": f, "symbols": narrow.within(tables["symbols"], "id", gone).withColumn("doc", F.lit("written anew")), "topics": tables["topics"].limit(0)}
    new["edges"] = narrow.within(tables["edges"], "from_id", gone)
    for name, col in (("references", "symbol_id"), ("effects", "symbol_id"), ("aggregates", "owner_id")):
        new[name] = narrow.within(tables[name], col, gone)
    out = I.replace_files(tables, new, ("symbols", "edges"))
    return I.snapshot_difference(tables["symbols"], out["symbols"]).unionByName(I.snapshot_difference(tables["edges"], out["edges"]))


@query("d_violations", "select 'x' as \"table\", 'x' as rule, 'x' as id where false")
def violations(g):
    g = g.lean()
    return schema.violations(I.delete_files(g.tables(), g.files.where("modified_at < 3")))


EV = "select event_id, ts, user_id, event_type, value from events"


@query("s_debounce", f"select user_id, min(ts) as started, max(ts) + interval 6 hour as fires, count(*) changes from (select *, sum(new) over (partition by user_id order by ts, event_id) run from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 1 else 0 end as new from ({EV}))) group by user_id, run")
def debounce(g):
    e = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.bursts(e, "user_id", "ts", "6 hours").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("fires").cast("timestamp_ntz").alias("fires"), "changes")


@query("s_tumbling", "select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n from events group by 1,2")
def tumbling(g):
    e = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.tumbling(e, "ts", "1 hour", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("s_trailing_rate", "select event_id, least(samples, 8) samples, round(case when samples <= 8 then total else recent end, 4) total from (select event_id, count(*) over w samples, sum(value) over w total, sum(value) over r recent from events window w as (partition by user_id order by ts range between interval 2592000 second preceding and current row), r as (partition by user_id order by ts, event_id rows between 7 preceding and current row))")
def trailing_rate(g):
    e = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.trailing_rate(e, "user_id", "ts", "value", 2_592_000, 8).select("event_id", F.col("samples").cast("long").alias("samples"), F.round(F.col("rate") * 2_592_000, 4).alias("total"))


@query("s_polling_speed", "select event_id, round(greatest(0, (value - lag(value) over w) / nullif((epoch_us(ts) - epoch_us(lag(ts) over w))/1e6, 0)), 9) speed from events window w as (partition by user_id order by ts, event_id)")
def polling_speed(g):
    e = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.polling_speed(e, "user_id", "ts", "value").select("event_id", F.round("speed", 9).alias("speed"))


def _job_events(g):
    kind = F.create_map(*[F.lit(x) for kv in {"signup": "enqueue", "click": "lease", "purchase": "complete", "error": "retry", "view": "renew"}.items() for x in kv])
    e = g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = F.col("event_id")
    event = F.when(n % 9 == 0, "accept").otherwise(kind[F.col("event_type")])
    told = [F.when(n % 3 == 0, "delete").otherwise("upsert").alias("operation"), F.concat(F.lit("h"), n % 2).alias("document_hash"), F.concat(F.lit("w"), F.col("user_id") % 2).alias("owner")]
    return e.select(F.col("user_id").alias("key"), event.alias("event"), F.unix_millis("ts").alias("ts_ms"), n.alias("seq"), *told)


@query("s_job_state")
def job_state(g):
    return jobs.fold(_job_events(g))


@query("s_leases", "select id from (select o_orderkey id, case o_orderstatus when 'O' then 'pending' else 'leased' end status, o_custkey available_at from orders) where status='pending' and available_at <= 100 order by available_at, id limit 50")
def leases(g):
    o = g.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("leased").alias("status"), F.col("o_custkey").alias("available_at"))
    return jobs.lease(o, 100, 50).select("id")


@query("s_expired_leases", "select o_orderkey id, 'pending' as status from orders where o_orderstatus='F' and o_custkey <= 60")
def expired(g):
    o = g.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "leased").otherwise("pending").alias("status"), F.col("o_custkey").alias("lease_until"))
    return jobs.expired(o, 60).select("id", "status")


@query("s_ingestion_plan", "select step, outstanding, coalesce(last_value(mark ignore nulls) over (order by step rows unbounded preceding), 'steady') profile from (select event_id step, cast(abs(value)*20 as bigint) outstanding, case when cast(abs(value)*20 as bigint) > 2048 then 'cold' when cast(abs(value)*20 as bigint) <= 1024 then 'steady' end mark from (select event_id, floor(value) as value from events))")
def ingestion_plan(g):
    b = g.table("events").select(F.col("event_id").alias("step"), (F.abs(F.floor("value")) * 20).cast("long").alias("outstanding"))
    return jobs.ingestion_plan(b).select("step", "outstanding", "profile")


# Fixed values of the oracle: states by weight, as the operator's contract has them.
WEIGHTS = "(('unknown',0),('disabled',0),('healthy',1),('starting',2),('indexing',2),('degraded',3),('recovering',4),('stalled',5),('failed',6))"


@query("s_health", "select user_id, arg_max(state, (w, last)) worst, arg_max(n, (w, last)) components from (select user_id, state, count(*) n, max(event_id) last from (select user_id, event_id, case event_type when 'view' then 'healthy' when 'signup' then 'starting' when 'click' then 'indexing' when 'purchase' then 'recovering' else 'stalled' end state from events) group by 1, 2) join (select * from (values " + WEIGHTS[1:-1] + ") t(state, w)) using (state) group by 1")
def health(g):
    state = F.create_map(*[F.lit(x) for kv in {"view": "healthy", "signup": "starting", "click": "indexing", "purchase": "recovering", "error": "stalled"}.items() for x in kv])
    e = g.table("events").select("user_id", F.col("event_id").alias("component"), F.coalesce(state[F.col("event_type")], F.lit("stalled")).alias("state"))
    return jobs.health(e, "user_id")
