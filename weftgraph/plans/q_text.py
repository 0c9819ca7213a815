"""Registered queries: identifiers, grams, full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import retrieve

NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
def all_grams() -> str:
    parts = [f"[lower({c})[i:i+{n - 1}] for i in range(1, length({c})-{n}+2)]" for c in ("name", "qualified_name") for n in (1, 2, 3)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"list_distinct({out})"


@query("t_normalized", "select distinct name, " + NORM.format("name") + " as words from symbols")
def normalized(g):
    return g.symbols.select("name", X.normalized_identifier(F.col("name")).alias("words")).distinct()


def _search_text(rows: str) -> str:
    """id and search_text of the symbols in rows."""
    columns = ("name", "qualified_name", "signature", "doc")
    spread = "[name, n1, qualified_name, n2, signature, n3, doc, n4]"
    words = ", ".join(NORM.format(c) + f" as n{i}" for i, c in enumerate(columns, 1))
    return f"select id, (select string_agg(v, chr(10) order by i) from (select v, min(i) i from (select unnest({spread}) v, generate_subscripts({spread},1) i) where v is not null and trim(v)<>'' group by v)) as search_text from (select id, {', '.join(columns)}, {words} from {rows})"


@query("t_search_text", _search_text("keyed where src in ('part','nation')"))
def search_text(g):
    s = g.parts.unionByName(g.namespaces)
    return s.select("id", X.search_text(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("doc")).alias("search_text"))


@query("t_grams_df", "select gram, count(*) n from (select id, unnest(" + all_grams() + ") gram from symbols) group by 1")
def grams_df(g):
    return retrieve.gram_table(g.symbols).groupBy("gram").agg(F.count("*").alias("n"))


OWN = "+ own as (select unnest({}) gram), g as (select id, name, qualified_name, unnest(" + all_grams() + ") gram from symbols where kind='function'), rare as (select gram, count(*) n from g where gram in (select gram from own) group by 1 order by n, gram limit 1)"


def gram_literals(term: str) -> str:
    low = term.lower()
    return str(sorted({low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}))


@query("t_rarest_gram", OWN.format(gram_literals("customer-17")) + " select gram, n from rare")
def rarest(g):
    return retrieve.rarest_gram(retrieve.gram_table(g.symbols.where("kind = 'function'")), "customer-17")


@query("t_rarest_gram_pool", OWN.format(gram_literals("customer#00017")) + " , pool as (select id, qualified_name from symbols where kind='function' and id in (select id from g where gram in (select gram from rare)) order by qualified_name, id limit 128) select p.id, p.qualified_name, count(distinct g.gram) overlap from pool p join g on g.id=p.id and g.gram in (select gram from own) group by 1,2")
def pool(g):
    return retrieve.lexical_pool(g.symbols.where("kind = 'function'"), "customer#00017").select("id", "qualified_name", F.col("overlap").cast("long").alias("overlap"))


SUGGEST = " , pool as (select id, name, qualified_name from symbols where kind='function' and id in (select id from g where gram in (select gram from rare)) order by qualified_name, id limit 128), d as (select id, qualified_name, levenshtein(lower(name),'{t}') distance from pool) select * from d where distance <= greatest(2, least(5, (length('{t}')+1)//3)) order by distance, qualified_name, id limit 8"


@query("t_suggestions", OWN.format(gram_literals("customer#00000012")) + SUGGEST.format(t="customer#00000012"))
def suggestions(g):
    return retrieve.suggestions(g.symbols.where("kind = 'function'"), "customer#00000012").withColumn("distance", F.col("distance").cast("long"))


WORDS = "list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
SINGLE = "case when length(x)>4 and suffix(x,'ies') then substr(x,1,length(x)-3)||'y' when length(x)>3 and suffix(x,'s') and not suffix(x,'ss') then substr(x,1,length(x)-1) else x end"


# Fixed values of the oracle: the words that carry no search term.
STOP = "a an and are before code does for from how in is it of or repository the to what where which with".split()


@query("t_terms", f"select item_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(w, list_transform(w, lambda x: {SINGLE}))), lambda x: not list_contains({STOP}, x))), ' ') terms from (select item_id, {WORDS} w from benchmark)")
def terms(g):
    return g.table("benchmark").select("item_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


BM25 = "words as (select id, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from ({0})), size as (select count(*) n, avg(len(w)) mean from words), hits as (select id, len(w) length, term, count(*) tf from (select id, w, unnest(w) term from words) where term in ({1}) group by 1,2,3), df as (select term, count(*) df from hits group by 1), scored as (select id, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(1-0.75+0.75*length/mean))) score from hits join df using (term), size group by 1)"


@query("t_bm25", "+ " + BM25.format("select doc_id id, text body from documents", "'license','the','token'") + " select id, round(score, 6) score from scored order by score desc, id limit 50")
def bm25(g):
    out = X.bm25(g.table("documents"), "doc_id", "text", ["license", "the", "token"]).withColumn("score", F.round("score", 6))
    return out.orderBy(F.desc("score"), "id").limit(50)


@query("t_postings", "select term, count(*) df, sum(tf)::bigint occurrences from (select doc_id, term, count(*) tf from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) term from documents) group by 1,2) group by 1")
def posting_counts(g):
    return X.postings(g.table("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


SUBSTRING = " , pool as (select id, name, qualified_name from symbols where id in (select id from g where gram in (select gram from rare)) order by qualified_name, id limit 128) select id, qualified_name, 'substring' as matched, 0.0::double as score from pool where contains(lower(name), '{t}') or contains(lower(qualified_name), '{t}')"


@query("t_symbols_substring", OWN.replace("where kind='function'", "").format(gram_literals("ustomer#0000")) + SUBSTRING.format(t="ustomer#0000"))
def symbols_substring(g):
    return retrieve.find_symbols(g, "ustomer#0000")


@query("t_symbols_rank", "+ texts as (" + _search_text("symbols") + "), " + BM25.format("select id, search_text body from texts", "'promo','steel'") + " select id, qualified_name, 'fts' as matched, round(score, 6) score from scored join symbols using (id) order by scored.score desc, qualified_name, id limit 128")
def symbols_rank(g):
    return retrieve.find_symbols(g, "promo steel").withColumn("score", F.round("score", 6))


@query("t_aggregate_fts", "+ " + BM25.format("select id, search_text body from aggs", "'complete','dynamic'") + " select a.owner_id, a.name, round(score,6) score from scored s join aggs a on a.id=s.id order by score desc, a.owner_id limit 32")
def aggregate_fts(g):
    hits = X.bm25(g.aggregates, "id", "search_text", ["complete", "dynamic"]).withColumnRenamed("id", "h_id").withColumn("score", F.round("score", 6))
    return g.aggregates.join(hits, F.col("id") == F.col("h_id")).select("owner_id", "name", "score").orderBy(F.desc("score"), "owner_id").limit(32)


@query("t_source_role", "select page_id, case when path is null or path='' then 'unknown' when list_has_any(seg, ['vendor','vendors','third_party','third-party','node_modules']) then 'vendor' when list_has_any(seg, ['generated','gen','autogen','autogenerated']) then 'generated' when list_has_any(seg, ['test','tests','spec','specs','__tests__']) or regexp_matches(path, '(?i)(?:^|/)(?:test|spec)[_-][^/]+\\.[^/]+$|(?:^|/)[^/]+(?:[_-](?:test|spec)|\\.(?:test|spec))\\.[^/]+$') then 'test' else 'production' end as role from (select page_id, lower(regexp_replace(url, '^https?://[^/]+/', '')) path, string_split(lower(regexp_replace(url, '^https?://[^/]+/', '')), '/') seg from pages)")
def source_role(g):
    return g.table("pages").select("page_id", X.source_role(F.regexp_replace("url", "^https?://[^/]+/", "")).alias("role"))


@query("t_query_shape", "select item_id, case when regexp_matches(text, '(?i)\\b(?:all|list|which|what)\\b.*\\b(?:apis|classes|components|endpoints|files|functions|handlers|implementations|modules|namespaces|routes|symbols|tests)\\b|\\b(?:modules|namespaces|components)\\s+(?:expose|implement|provide)\\b') then 'set' when regexp_matches(text, '(?i)\\b(?:before|after|flow|pipeline|responsible for|end[- ]to[- ]end|how.+(?:handled|processed|validated|sent|delivered|enforced))\\b') then 'flow' else 'lookup' end as shape from benchmark")
def query_shape(g):
    return g.table("benchmark").select("item_id", X.query_shape(F.col("text")).alias("shape"))


@query("t_normalized_path", "select page_id, path from (select page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '' and x <> '.'), '/') path from pages)")
def normalized_path(g):
    return g.table("pages").select("page_id", X.normalized_path(F.regexp_replace("url", "^https?://", "")).alias("path"))


@query("t_namespaces", "select id, case when contains(qualified_name,'/') then split_part(qualified_name,'/',1) end as namespace, cast(ceil(length(qualified_name)/4.0) as bigint) as tokens from symbols")
def namespaces(g):
    return g.symbols.select("id", X.namespace_name(F.col("qualified_name")).alias("namespace"), X.estimate_tokens(F.length("qualified_name")).alias("tokens"))


@query("t_byte_bucket", "select case when strlen(text) < 2048 then 'small' when strlen(text) < 8192 then 'medium' else 'large' end as bucket, count(*) n from documents group by 1")
def byte_bucket(g):
    return g.table("documents").groupBy(X.byte_bucket(F.octet_length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("t_backoff", "select o_orderkey, cast(least(60000, 1000 * power(2, least(o_orderkey % 30, 20))) as bigint) delay from orders")
def backoff(g):
    return g.table("orders").select("o_orderkey", X.backoff(1000, 60000, F.col("o_orderkey") % 30).alias("delay"))
