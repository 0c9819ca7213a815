"""Registered queries: vectors, fusion, preference, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..functions import vectors as V
from ..operators import retrieve as R
from .q_text import SINGLE, WORDS

COS = "round(list_dot_product(q.e, c.e)/(sqrt(list_dot_product(q.e,q.e))*sqrt(list_dot_product(c.e,c.e))), 6)"
VEC = "vecs as (select vec_id, label, embedding::double[] e from embeddings), qs as (select label query_id, arg_min(e, vec_id) e from vecs group by 1)"


def _queries(g):
    return g.table("embeddings").groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))


@query("v_topk", f"+ {VEC} select query_id, id, round(score, 6) score, rank from (select query_id, vec_id id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from (select query_id, vec_id, {COS} score from qs q, vecs c)) where rank <= 10")
def topk(g):
    return V.top_k(_queries(g), g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"), 10)


@query("v_maxsim", "+ e as (select vec_id, embedding::double[] v from embeddings), docs as (select vec_id//4 doc, list(v order by vec_id) vs from e group by 1), q as (select list(v order by vec_id) qs from e where vec_id < 3) select doc, round(list_avg(list_transform(qs, lambda a: list_max(list_transform(vs, lambda b: list_dot_product(a, b))))), 6) score from docs, q order by score desc, doc limit 20")
def maxsim(g):
    e = g.table("embeddings")
    docs = e.groupBy((F.floor(F.col("vec_id") / 4)).cast("long").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    query = F.array(*[F.array(*[F.lit(x) for x in r.embedding]) for r in e.where("vec_id < 3").orderBy("vec_id").collect()])
    scored = docs.select("doc", F.round(V.max_sim(query, F.col("vs")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(20)


CHUNKS = "chunks as (select vec_id//3 symbol_id, vec_id%3 chunk_index, label, round(list_sum(embedding::double[]), 6) score from embeddings)"


def _chunks(g):
    e = g.table("embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return e.select(F.floor(F.col("vec_id") / 3).cast("long").alias("symbol_id"), (F.col("vec_id") % 3).alias("chunk_index"), "label", F.round(total, 6).alias("score"))


@query("v_collapse_chunks", f"+ {CHUNKS} select symbol_id, chunk_index, score from (select *, row_number() over (partition by symbol_id order by score desc, chunk_index) rn from chunks) where rn=1")
def collapse(g):
    return R.collapse_chunks(_chunks(g)).select("symbol_id", "chunk_index", "score")


@query("v_router_margin", f"+ {VEC}, ranked as (select vec_id question_id, query_id shape, {COS} score from qs q, vecs c where query_id < 3), l as (select *, row_number() over (partition by question_id order by score desc, shape) rn, score - lead(score) over (partition by question_id order by score desc, shape) margin from ranked) select question_id, shape as suggested, round(margin, 6) margin from l where rn=1")
def router_margin(g):
    met = V.scores(_queries(g).where("query_id < 3"), g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return R.shape_margin(met.select(F.col("id").alias("question_id"), F.col("query_id").alias("shape"), "score")).withColumn("margin", F.round("margin", 6))


LEX = "lex as (select doc_id id, n_chars::double score from documents order by score desc, id limit 100), sem as (select doc_id id, (strlen(text) - length(text))::double score from documents order by score desc, id limit 100)"
FUSE = LEX + ", lr as (select id, row_number() over (order by score desc, id) lexical_rank from lex), sr as (select id, row_number() over (order by score desc, id) semantic_rank from sem), fused as (select id, lexical_rank, semantic_rank, coalesce(1.0::double/(60+lexical_rank),0)+coalesce(1.0::double/(60+semantic_rank),0) score, id % 50 = 0 as is_exact from lr full join sr using (id)), ranked as (select *, row_number() over (order by is_exact desc, score desc, id) fused_rank from fused)"


def _fused(g):
    d = g.table("documents")
    lex = d.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    sem = d.select(F.col("doc_id").alias("id"), (F.octet_length("text") - F.length("text")).cast("double").alias("score"))
    return R.fuse(lex, sem, d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("id")))


@query("r_rrf", f"+ {FUSE} select id, lexical_rank, semantic_rank, concat_ws('+', case when lexical_rank is not null then 'lexical' end, case when semantic_rank is not null then 'semantic' end) matched_by, round(score, 9) score, is_exact, fused_rank from ranked")
def rrf(g):
    return _fused(g).withColumn("score", F.round("score", 9))


STATE = "indexed as (select doc_id symbol_id, case when quality=1 then 'h'||doc_id else 'old' end document_hash, 'r1' model_revision from labels), jobs as (select doc_id symbol_id from labels where toxic=1), dirty as (select 'f'||(doc_id % 40) file_id from labels where doc_id < 6)"


@query("r_hybrid_fresh", f"+ {STATE}, cand as (select doc_id symbol_id, 'f'||(doc_id % 40) file_id, 'h'||doc_id document_hash, 'r1' model_revision, n_chars score from documents) select c.symbol_id, c.file_id, c.score from cand c join indexed i on i.symbol_id=c.symbol_id and i.document_hash=c.document_hash and i.model_revision=c.model_revision where c.symbol_id not in (select symbol_id from jobs) and c.file_id not in (select file_id from dirty)")
def hybrid_fresh(g):
    labels = g.table("labels")
    cand = g.table("documents").select(F.col("doc_id").alias("symbol_id"), F.concat(F.lit("f"), F.col("doc_id") % 40).alias("file_id"), F.concat(F.lit("h"), F.col("doc_id")).alias("document_hash"), F.lit("r1").alias("model_revision"), F.col("n_chars").alias("score"))
    indexed = labels.select(F.col("doc_id").alias("symbol_id"), F.when(F.col("quality") == 1, F.concat(F.lit("h"), F.col("doc_id"))).otherwise("old").alias("document_hash"), F.lit("r1").alias("model_revision"))
    jobs = labels.where("toxic = 1").select(F.col("doc_id").alias("symbol_id"))
    dirty = labels.where("doc_id < 6").select(F.concat(F.lit("f"), F.col("doc_id") % 40).alias("file_id"))
    return R.fresh(cand, indexed, jobs, dirty).select("symbol_id", "file_id", "score")


@query("r_prefer", f"+ {FUSE}, roles as (select *, case id % 3 when 0 then 'production' when 1 then 'test' else 'vendor' end as role from ranked) select *, case when final_rank <> fused_rank then case when role='test' then 'test-preferred' else 'source-preference-demotion' end end ranking_reason from (select id, role, fused_rank, row_number() over (order by case when is_exact then 0 when role='test' then 1 else 2 end, fused_rank) final_rank from roles)")
def prefer(g):
    role = F.when(F.col("id") % 3 == 0, "production").when(F.col("id") % 3 == 1, "test").otherwise("vendor")
    return R.prefer(_fused(g).withColumn("role", role), "test").select("id", "role", "fused_rank", "final_rank", "ranking_reason")


RERANK = FUSE + ", m as (select id, cast((id * 7919) % 1009 as double) model_score from ranked where id % 4 <> 0), j as (select id, fused_rank pre_rank, model_score from ranked left join m using (id)), k as (select *, row_number() over (order by case when pre_rank<=50 and model_score is not null then 0 else 1 end, case when pre_rank<=50 and model_score is not null then -model_score end nulls first, pre_rank) learned_rank from j) select id, pre_rank, learned_rank, learned_rank<>pre_rank as would_reorder, {} as final_rank from k"


def _rerank(g, enforce):
    f = _fused(g)
    scores = f.where("id % 4 <> 0").select("id", ((F.col("id") * 7919) % 1009).cast("double").alias("model_score"))
    return R.rerank(f.select("id", F.col("fused_rank").alias("pre_rank")), scores, 50, enforce).select("id", "pre_rank", "learned_rank", "would_reorder", "final_rank")


@query("r_rerank_shadow", "+ " + RERANK.format("pre_rank"))
def rerank_shadow(g):
    return _rerank(g, False)


@query("r_rerank_enforce", "+ " + RERANK.format("learned_rank"))
def rerank_enforce(g):
    return _rerank(g, True)


QUALIFY = f"select id, len(list_intersect(list_distinct(list_concat(w, list_transform(w, lambda x: {SINGLE}))), ['order','open','complete','set']))::double + case when completeness in ('complete-static','complete-resolved') then 4.0 when completeness is not null then 0.5 else 0 end as intent_score, completeness in ('complete-static','complete-resolved') as qualified from (select id, completeness, {WORDS.replace('text', 'search_text')} w from aggs)"


@query("r_qualify", QUALIFY)
def qualify(g):
    c = g.aggregates.select("id", F.col("search_text").alias("text"), F.lit("method").alias("scope"), F.lit("method").alias("role"), "completeness")
    return R.qualify(c, "which order is open for the complete set", "set").select("id", "intent_score", "qualified")


@query("r_plan", "select question_id, shape, margin >= 0.02 and (case shape when 'lookup' then qualified=1 and relationships=0 when 'set' then complete_aggregates>0 or qualified>=2 else qualified>=2 and relationships>0 end) as accepted, case when qualified=0 then 'insufficient' when (case shape when 'lookup' then qualified=1 and relationships=0 when 'set' then complete_aggregates>0 or qualified>=2 else qualified>=2 and relationships>0 end) then 'supported' else 'unknown' end as answerability from (select o_orderkey question_id, case o_orderkey%3 when 0 then 'lookup' when 1 then 'set' else 'flow' end as shape, (o_orderkey%100)/1000.0::double as margin, o_orderkey%4 as qualified, o_orderkey%2 as complete_aggregates, o_orderkey%5 as relationships from orders)")
def plan(g):
    k = F.col("o_orderkey")
    shape = F.when(k % 3 == 0, "lookup").when(k % 3 == 1, "set").otherwise("flow")
    advice = g.table("orders").select(k.alias("question_id"), shape.alias("shape"), ((k % 100) / 1000.0).alias("margin"), (k % 4).alias("qualified"), (k % 2).alias("complete_aggregates"), (k % 5).alias("relationships"))
    return R.resolve_plan(advice).select("question_id", "shape", "accepted", "answerability")


@query("r_select_seeds", "+ c as (select id, file_id, row_number() over (order by qualified_name, id) as rank from keyed where src='customer' order by rank limit 100), f as (select id, rank, row_number() over (partition by file_id order by rank) n from c) select cast(row_number() over (order by rank) - 1 as integer) place, id from f where n=1 order by rank limit 4")
def seeds(g):
    from ..operators.reads import rank

    c = g.customers.orderBy("qualified_name", "id").limit(100).select("id", F.col("file_id").alias("file"), X.namespace_name(F.col("qualified_name")).alias("namespace"), rank([F.col("qualified_name"), F.col("id")]).alias("rank"))
    return g.spark.createDataFrame([(i, s) for i, s in enumerate(R.select_seeds(c, 4))], "place int, id string")
