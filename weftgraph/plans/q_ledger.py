"""Registered queries: bookkeeping of the store and the queue, canonical bytes, merged channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evaluate as E
from ..operators import ledger as L
from ..operators import retrieve as R

JOBS = """jobs as (select doc_id, 's'||doc_id symbol_id, 'f'||(doc_id % 40) file_id, case when doc_id % 3 = 0 then 'delete' else 'upsert' end operation,
  case when toxic=1 then 'failed' when quality=1 then 'leased' else 'pending' end status, doc_id % 5 attempts, doc_id * 10 updated_at, case when doc_id % 4 = 0 then doc_id end accepted_at,
  case when toxic=1 then 'error '||doc_id end last_error from labels)"""
PATHS = "paths as (select 'f'||range id, 'src/'||range||'.clj' path from range(35))"


def _jobs(g):
    d = F.col("doc_id")
    return g.table("labels").select(
        F.concat(F.lit("s"), d).alias("symbol_id"), F.concat(F.lit("f"), d % 40).alias("file_id"), F.when(d % 3 == 0, "delete").otherwise("upsert").alias("operation"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "leased").otherwise("pending").alias("status"), (d % 5).alias("attempts"), (d * 10).alias("updated_at"),
        F.when(d % 4 == 0, d).alias("accepted_at"), F.when(F.col("toxic") == 1, F.concat(F.lit("error "), d)).alias("last_error"),
    )


def _paths(g):
    return g.spark.range(35).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("src/"), "id", F.lit(".clj")).alias("path"))


@query("s_queue_counts", f"""+ {JOBS} select (select count(*) from documents where lang='en') desired, (select count(*) from labels) indexed, (select count(*) from labels l join documents d on d.doc_id=l.doc_id where lang='en') indexed_current,
  count(*) filter (status='pending') pending, count(*) filter (status='leased') leased, count(*) filter (status='failed') failed, count(*) filter (status='leased' and accepted_at is not null) accepted,
  min(updated_at) filter (status='pending') oldest_pending_at, (select count(*) from paths) dirty from jobs""".replace("+ ", f"+ {PATHS}, ", 1))
def queue_counts(g):
    symbols = g.table("documents").select(F.concat(F.lit("s"), "doc_id").alias("id"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("indexable"))
    jobs = _jobs(g)
    return L.queue_counts(symbols, jobs.select("symbol_id"), jobs, _paths(g))


@query("s_pending_operations", f"""+ {JOBS}, n as (select count(*) filter (status='pending' and operation='upsert') upserts, count(*) filter (status='pending' and operation='delete') deletes from jobs)
  select upserts, deletes, upserts > 0 and upserts >= 0.8*(upserts+deletes) as upsert_dominated from n""")
def pending_operations(g):
    return L.pending_operations(_jobs(g))


@query("s_status_frequencies", f"+ {JOBS} select status as value, count(*) n from jobs group by 1")
def status_frequencies(g):
    return L.frequencies(_jobs(g), "status")


@query("s_failures", f"+ {JOBS}, {PATHS} select symbol_id, file_id, path as file, operation, attempts, updated_at as timestamp, last_error from jobs left join paths on id=file_id where status='failed'")
def failures(g):
    return L.failures(_jobs(g), _paths(g))


@query("s_dirty_details", f"+ {JOBS}, {PATHS} select file_id, path as file, operation, updated_at created_at, 'h'||attempts file_hash, accepted_at last_error_at, last_error from jobs left join paths on id=file_id")
def dirty(g):
    d = _jobs(g).select("file_id", "operation", F.col("updated_at").alias("created_at"), F.concat(F.lit("h"), "attempts").alias("file_hash"), F.col("accepted_at").alias("last_error_at"), "last_error")
    return L.dirty_details(d, _paths(g))


RECORDS = """recs as (select user_id provider, event_id seq, case event_type when 'error' then 'failed' when 'purchase' then 'ready' else 'indexing' end state, case when event_type='purchase' then event_id end last_success_at,
  case when event_type='error' then event_id end last_error_at, case when event_type in ('error','click') then repeat('e'||event_id||' ', 400) end last_error, case when event_type='signup' then 'r'||event_id end graph_revision, case when event_type='view' then event_id end index_generation from events)"""


@query("s_watermarks", f"""+ {RECORDS}, c as (select provider, coalesce(max(seq) filter (last_error is null), -1) cleared from recs group by 1)
  select r.provider, arg_max(state, seq) state, arg_max(last_success_at, seq) filter (last_success_at is not null) last_success_at, arg_max(last_error_at, seq) filter (last_error_at is not null and seq >= cleared) last_error_at,
  (select substr(x.last_error, 1, 2000) from recs x where x.provider=r.provider order by x.seq desc limit 1) last_error, arg_max(graph_revision, seq) filter (graph_revision is not null) graph_revision,
  arg_max(index_generation, seq) filter (index_generation is not null) index_generation from recs r join c on c.provider=r.provider group by r.provider""")
def watermarks(g):
    kind, seq = F.col("event_type"), F.col("event_id")
    recs = g.table("events").select(
        F.col("user_id").alias("provider"), seq.alias("seq"), F.when(kind == "error", "failed").when(kind == "purchase", "ready").otherwise("indexing").alias("state"), F.when(kind == "purchase", seq).alias("last_success_at"),
        F.when(kind == "error", seq).alias("last_error_at"), F.when(kind.isin("error", "click"), F.repeat(F.concat(F.lit("e"), seq, F.lit(" ")), 400)).alias("last_error"),
        F.when(kind == "signup", F.concat(F.lit("r"), seq)).alias("graph_revision"), F.when(kind == "view", seq).alias("index_generation"),
    )
    return L.watermarks(recs)


SHOWN = "want as (select l_orderkey symbol_id, l_linenumber chunk, l_partkey h from lineitem), have as (select l_orderkey symbol_id, l_linenumber chunk, case when l_orderkey % 7 = 0 and l_linenumber = 2 then null else l_partkey end h from lineitem where l_orderkey % 5 <> 0 or l_linenumber > 1 union all select l_orderkey, 99, 0 from lineitem where l_orderkey % 11 = 0 and l_linenumber = 1)"


@query("s_visible", f"""+ {SHOWN}, k as (select symbol_id, chunk, h, count(*) filter (d) nd, count(*) filter (not d) nh from (select *, true d from want union all select *, false from have) group by 1,2,3)
  select symbol_id, bool_and(nd>0 and nh>0) and sum(nd)=sum(nh) as visible, bool_and(nd=0 or nh>0) as covered from k group by 1 having sum(nd) > 0""")
def visible(g):
    li = g.table("lineitem")
    want = li.select(F.col("l_orderkey").alias("symbol_id"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").alias("h"))
    lost = (F.col("symbol_id") % 7 == 0) & (F.col("chunk") == 2)
    have = want.where("symbol_id % 5 <> 0 or chunk > 1").withColumn("h", F.when(~lost, F.col("h")))
    more = want.where("symbol_id % 11 = 0 and chunk = 1").select("symbol_id", F.lit(99).alias("chunk"), F.lit(0).cast("long").alias("h"))
    return L.visible(have.unionByName(more), want, ["symbol_id", "chunk", "h"])


TYPES = {"files": "file", "symbols": "symbol", "topics": "topic", "aggregates": "aggregate", "memberships": "membership", "edges": "edge", "references": "reference", "effects": "effect"}
VIEWS = {"references": "refs", "aggregates": "aggs"}
LAYER = "case type when 'file' then 0 when 'symbol' then 1 when 'topic' then 2 when 'aggregate' then 2 when 'membership' then 3 when 'edge' then 3 when 'reference' then 3 else 4 end"


@query("x_dependency_order", "+ e as (" + " union all ".join(f"select '{t}' as type, id from {VIEWS.get(n, n)}" for n, t in TYPES.items()) + f") select type, id, {LAYER} layer from e")
def dependency_order(g):
    tables = g.stored().tables()
    all_ = reduce(lambda a, b: a.unionByName(b), [tables[n].select(F.lit(t).alias("type"), "id") for n, t in TYPES.items()])
    return all_.withColumn("layer", L.layer(F.col("type")))


@query("x_identity_counts", " union all ".join(f"select '{n}/id' as attribute, count(id) n from {VIEWS.get(n, n)}" for n in TYPES))
def identity_counts(g):
    return L.identity_counts(g.stored().tables())


@query("x_messages", "select event_type, cast(floor(value) as bigint) % 10 code, count(*) as count, min(event_id) as first, list_sort(list(distinct 'p'||(user_id % 50))) paths from events group by 1,2")
def messages(g):
    m = g.table("events").select("event_type", (F.floor("value").cast("long") % 10).alias("code"), F.concat(F.lit("p"), F.col("user_id") % 50).alias("path"), F.col("event_id").alias("position"))
    return L.fold_messages(m, "event_type", "code")


@query("x_transaction_weight", "select doc_id, 1 + (case when lang is null then 0 else 1 end) + (case when text is null then 0 else greatest(1, ceil(length(text)/128.0)::bigint) end) + (case when text is null then 0 else greatest(1, len(string_split(text, ' '))) end) as weight from documents")
def transaction_weight(g):
    d = g.table("documents").select("doc_id", "lang", "text", F.split("text", " ").alias("words"))
    return d.select("doc_id", L.weight(d, ["doc_id", "lang", "text", "words"], ("text",)).alias("weight"))


@query("x_weighted_batches", """+ recursive_batches as (select l_orderkey, ordinal, cast(0 as bigint) batch, cast(1 as bigint) c, cast(l_quantity as bigint) w from members where ordinal=0
  union all select m.l_orderkey, m.ordinal, case when c >= 3 or w + cast(l_quantity as bigint) > 60 then batch + 1 else batch end, case when c >= 3 or w + cast(l_quantity as bigint) > 60 then 1 else c + 1 end,
  case when c >= 3 or w + cast(l_quantity as bigint) > 60 then cast(l_quantity as bigint) else w + cast(l_quantity as bigint) end from recursive_batches r join members m on m.l_orderkey=r.l_orderkey and m.ordinal=r.ordinal+1)
  select l_orderkey, ordinal, batch from recursive_batches""")
def weighted_batches(g):
    m = g.members.select("l_orderkey", "ordinal", F.col("l_quantity").cast("long").alias("weight"))
    return L.weighted_batches(m, "l_orderkey", ["ordinal"], 3, 60).select("l_orderkey", "ordinal", "batch")


STALE = "+ old as (select doc_id id, lang, source, string_split(text, ' ')[1:20] words from documents), new as (select id, case when id % 3 <> 0 then lang end lang, case when id % 4 <> 0 then source end source, words[1:10] words from old where id % 5 <> 0)"


@query("d_stale_attributes", f"""{STALE} select o.id, 'lang' as attribute, o.lang as value from old o join new n using (id) where o.lang is not null and n.lang is null union all select o.id, 'source', o.source from old o join new n using (id) where o.source is not null and n.source is null
  union all select distinct id, 'words', w from (select o.id, unnest(o.words) w, n.words nw from old o join new n using (id)) where not list_contains(coalesce(nw, []), w)""")
def stale(g):
    old = g.table("documents").select(F.col("doc_id").alias("id"), "lang", "source", F.slice(F.split("text", " "), 1, 20).alias("words"))
    new = old.where("id % 5 <> 0").select("id", F.when(F.col("id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("id") % 4 != 0, F.col("source")).alias("source"), F.slice("words", 1, 10).alias("words"))
    return L.stale_attributes(old, new, ["lang", "source", "words"])


def _hex(value: str, tag: str) -> str:
    return f"'{tag}'||printf('%08x', strlen({value}))||lower(hex({value}))"


def _key(name: str) -> str:
    raw = b"\x04" + len(name).to_bytes(4, "big") + name.encode()
    return f"'{(len(raw).to_bytes(4, 'big') + raw).hex()}'"


_FIELDS = [(":kind", _hex("':'||kind", "04")), (":name", _hex("name", "03")), (":grams", "'0c'||printf('%08x', len(parts))||list_aggregate(list_sort(list_transform(parts, lambda p: '03'||printf('%08x', strlen(p))||lower(hex(p)))), 'string_agg', '')"), (":start-line", "case when start_line is null then '00' else " + _hex("start_line::varchar", "06") + " end"), (":indexable?", "case when indexable then '02' else '01' end")]
_SIZED_SET = "'0c'||printf('%08x', len(parts))||coalesce(list_aggregate(list_transform(list_sort(list_transform(parts, lambda p: '03'||printf('%08x', strlen(p))||lower(hex(p)))), lambda e: printf('%08x', length(e)//2)||e), 'string_agg', ''), '')"
_ORDERED = sorted(((k, _SIZED_SET if k == ":grams" else v) for k, v in _FIELDS), key=lambda f: (len(f[0]), f[0]))


@query("i_canonical_hash", f"""+ s as (select *, list_distinct(string_split(name, '-')) parts from symbols)
  select id, 'sha256:'||sha256(unhex('0000000100000001'||'0b'||printf('%08x', {len(_ORDERED)})||{"||".join(f"{_key(k)}||({v})" for k, v in _ORDERED)})) as hash from s""")
def canonical_hash(g):
    s = g.symbols.withColumn("kind", F.concat(F.lit(":"), "kind")).withColumn("parts", F.array_distinct(F.split("name", "-")))
    row = L.canonical(s, {":kind": "kind", ":name": "name", ":grams": "parts", ":start-line": "start_line", ":indexable?": "indexable"}, {"kind": "keyword", "parts": "set"})
    return s.select("id", L.canonical_hash(row).alias("hash"))


CHANNELS = """a as (select doc_id id, row_number() over (order by n_chars desc, doc_id) as rank, source as file, ['lexical'] matched from documents order by rank limit 60),
  b as (select doc_id id, row_number() over (order by doc_id) as rank, case when doc_id % 2 = 0 then 'agg' end file, ['aggregate'] matched from documents where doc_id % 3 = 0 order by rank limit 60)"""


@query("r_channels", f"""+ {CHANNELS}, u as (select coalesce(a.id, b.id) id, row_number() over (order by a.rank nulls last, b.rank) as rank, coalesce(b.file, a.file) file, list_sort(list_distinct(list_concat(coalesce(a.matched, []), coalesce(b.matched, [])))) matched from a full join b on a.id=b.id)
  select * from u where rank <= 60""")
def channels(g):
    d = g.table("documents")
    lex = d.orderBy(F.desc("n_chars"), "doc_id").limit(60).select(F.col("doc_id").alias("id"), R._first([F.desc("n_chars"), "doc_id"]).alias("rank"), F.col("source").alias("file"), F.array(F.lit("lexical")).alias("matched"))
    agg = d.where("doc_id % 3 = 0").orderBy("doc_id").limit(60).select(F.col("doc_id").alias("id"), R._first(["doc_id"]).alias("rank"), F.when(F.col("doc_id") % 2 == 0, "agg").alias("file"), F.array(F.lit("aggregate")).alias("matched"))
    return R.union_channels(lex, agg, ("matched",), 60)


@query("r_candidate_text", """+ a as (select owner_id, a.name, kind, completeness, list(value order by ordinal) vs from aggs a left join memberships m on m.aggregate_id=a.id group by a.id, owner_id, a.name, kind, completeness)
  select s.id, concat_ws(' ', s.name, qualified_name, f.path, signature, doc)||coalesce(' '||a.name||' '||a.kind||' '||a.completeness||coalesce((select string_agg('', ' ')||' ' from (select unnest(list_filter(vs, lambda v: v is not null)) v) having count(*) > 0), '')||coalesce(' '||list_aggregate(list_filter(vs, lambda v: v is not null), 'string_agg', ' '), ''), '') as text
  from symbols s join files f on f.id=s.file_id left join a on a.owner_id=s.id""")
def candidate_text(g):
    m = g.memberships.groupBy("aggregate_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("m"))  # one aggregate's members
    members = F.transform(F.coalesce("m", F.array()), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x["value"].alias("value")))
    a = g.aggregates.join(m, F.col("id") == F.col("aggregate_id"), "left").select("owner_id", F.array(F.struct("name", "kind", "completeness", members.alias("members"))).alias("aggregates"))
    s = g.symbols.join(g.files.select(F.col("id").alias("f_id"), F.col("path").alias("file")), F.col("file_id") == F.col("f_id")).join(a, F.col("id") == F.col("owner_id"), "left")
    return s.select("id", R.candidate_text().alias("text"))


@query("r_permutation", "select 'same' as case_, true as valid union all select 'lost', false union all select 'twice', false")
def permutation(g):
    d = g.table("documents").select(F.col("doc_id").alias("id"))
    cases = {"same": d.orderBy(F.desc("id")), "lost": d.where("id <> 7"), "twice": d.unionByName(d.where("id = 7"))}
    return reduce(lambda a, b: a.unionByName(b), [R.valid_permutation(d, after).select(F.lit(name).alias("case_"), "valid") for name, after in cases.items()])


@query("e_aggregate_mode", """+ r as (select source repository, lang as split, quality::double quality, toxic::double toxic from labels l join documents d on d.doc_id=l.doc_id), per as (select repository, count(*) queries, avg(quality) quality, avg(toxic) toxic from r group by 1)
  select scope, value, queries, round(quality, 6) quality, round(toxic, 6) toxic from (select 'query-weighted' scope, '' as value, count(*) queries, avg(quality) quality, avg(toxic) toxic from r union all select 'macro', '', sum(queries)::bigint, avg(quality), avg(toxic) from per
  union all select 'repository', repository, queries, quality, toxic from per union all select 'split', split, count(*), avg(quality), avg(toxic) from r group by split)""")
def aggregate_mode(g):
    r = g.table("labels").join(g.table("documents").select("doc_id", F.col("source").alias("repository"), F.col("lang").alias("split")), "doc_id")
    return E.aggregate_mode(r, ["quality", "toxic"]).withColumn("quality", F.round("quality", 6)).withColumn("toxic", F.round("toxic", 6))


@query("s_stage_shares", "select l_returnflag, round(100.0*sum(l_linenumber)/sum(l_linenumber+l_partkey%7), 6) prepare, round(100.0*sum(l_partkey%7)/sum(l_linenumber+l_partkey%7), 6) submit from lineitem group by 1")
def stage_shares(g):
    li = g.table("lineitem").select("l_returnflag", F.col("l_linenumber").alias("prepare"), (F.col("l_partkey") % 7).alias("submit"))
    return E.stage_shares(li, ["prepare", "submit"], "l_returnflag").select("l_returnflag", F.round("prepare", 6).alias("prepare"), F.round("submit", 6).alias("submit"))
