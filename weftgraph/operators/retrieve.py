"""Lexical and vector retrieval, fusion of their ranks, source preference and evidence for plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RRF = 60
SUGGESTIONS, POOL = 8, 128


def _first(order: list, *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long")


def gram_table(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", F.explode(X.grams(F.col("name"), F.col("qualified_name"))).alias("gram"))


def rarest_gram(grams: DataFrame, term: str) -> DataFrame:
    """The term's gram that the fewest symbols have: one row (gram, n), least by (n, gram)."""
    low = term.lower()
    own = sorted({low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)})
    return grams.where(F.col("gram").isin(*own)).groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").limit(1)


def lexical_pool(symbols: DataFrame, term: str, limit: int = POOL) -> DataFrame:
    """Symbols with the term's rarest gram, then by how many grams they share with it."""
    low = term.lower()
    own = sorted({low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)})
    g = gram_table(symbols)
    have = g.join(F.broadcast(rarest_gram(g, term).select("gram")), "gram", "left_semi").select("id")
    pool = symbols.join(have, "id", "left_semi").orderBy("qualified_name", "id").limit(limit)
    shared = F.size(F.array_intersect(X.grams(F.col("name"), F.col("qualified_name")), F.array(*[F.lit(x) for x in own])))
    return pool.withColumn("overlap", shared)


def suggestions(symbols: DataFrame, term: str, limit: int = SUGGESTIONS) -> DataFrame:
    """Symbols of the pool whose name is within the typo limit of the term, nearest first."""
    found = lexical_pool(symbols, term).withColumn("distance", F.levenshtein(F.lower("name"), F.lit(term.lower()))).where(F.col("distance") <= X.typo_limit(F.lit(len(term))))
    return found.orderBy("distance", "qualified_name", "id").limit(limit).select("id", "qualified_name", "distance")


def find_symbols(g, term: str, limit: int = POOL) -> DataFrame:
    """Exact matches and full-text hits in one list: (id, qualified_name, matched, score), exact first, then by score.

    Where there are none of either, symbols of the term's pool whose name or qualified name holds the term.
    """
    from .reads import symbol_records

    words = term_words(term)
    s = symbol_records(g).withColumn("search", X.search_text(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("doc")))
    hits = X.bm25(s, "id", "search", words).withColumnRenamed("id", "h_id")
    exact = (F.col("name") == term) | (F.col("qualified_name") == term) | (F.col("id") == term)
    found = s.join(hits, F.col("id") == F.col("h_id"), "left").where(exact | F.col("h_id").isNotNull())
    out = found.select("id", "qualified_name", F.when(exact, "exact").otherwise("fts").alias("matched"), F.coalesce("score", F.lit(0.0)).alias("score"))
    out = out.orderBy(F.when(F.col("matched") == "exact", 0).otherwise(2), F.desc("score"), "qualified_name", "id").limit(limit)
    if not out.isEmpty() or not term:
        return out
    low = term.lower()
    holds = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("qualified_name"), F.lit(low))
    pool = lexical_pool(s.select("id", "name", "qualified_name"), term, limit).where(holds)
    return pool.select("id", "qualified_name", F.lit("substring").alias("matched"), F.lit(0.0).alias("score")).orderBy("qualified_name", "id")


def term_words(term: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", term.lower()) if w]


def collapse_chunks(candidates: DataFrame) -> DataFrame:
    """Of each symbol_id the best chunk: most score, then the first chunk index."""
    return candidates.withColumn("rn", _first([F.desc("score"), "chunk_index"], "symbol_id")).where("rn = 1").drop("rn")


def fresh(candidates: DataFrame, indexed: DataFrame, jobs: DataFrame, dirty: DataFrame) -> DataFrame:
    """Vector hits (symbol_id, file_id, document_hash, model_revision) that agree with the index and wait for nothing.

    indexed: (symbol_id, document_hash, model_revision); jobs: (symbol_id); dirty: (file_id), 'project:*' for all.
    """
    i = indexed.select(F.col("symbol_id").alias("i_symbol"), F.col("document_hash").alias("i_hash"), F.col("model_revision").alias("i_model"))
    ok = candidates.join(i, (F.col("symbol_id") == F.col("i_symbol")) & (F.col("document_hash") == F.col("i_hash")) & (F.col("model_revision") == F.col("i_model"))).drop("i_symbol", "i_hash", "i_model")
    ok = ok.join(jobs.select("symbol_id").distinct(), "symbol_id", "left_anti").join(dirty.select("file_id").distinct(), "file_id", "left_anti")
    return ok.limit(0) if not dirty.where(F.col("file_id").startswith("project:")).isEmpty() else ok


def fuse(lexical: DataFrame, semantic: DataFrame, exact: DataFrame, limit: int = 100) -> DataFrame:
    """Reciprocal rank fusion. lexical, semantic: (id, score), of which the best ``limit`` count; exact: (id), which go first.

    Returns (id, lexical_rank, semantic_rank, matched_by, score, is_exact, fused_rank), score the sum of 1/(60 + rank). The
    legs are cut before they are ranked, each task keeping its best, so the ranks are those of a short list.
    """
    order = [F.desc("score"), "id"]
    lexical, semantic = (x.orderBy(*order).limit(limit) for x in (lexical, semantic))
    lex = lexical.select("id", _first(order).alias("lexical_rank"))
    sem = semantic.select("id", _first(order).alias("semantic_rank"))
    both = lex.join(sem, "id", "full_outer")
    legs = F.array(F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("semantic_rank").isNotNull(), "semantic"))
    both = both.withColumn("matched_by", F.array_join(F.array_compact(legs), "+"))
    score = F.coalesce(1 / (F.lit(RRF) + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(RRF) + F.col("semantic_rank")), F.lit(0.0))
    flags = both.withColumn("score", score).join(exact.select("id", F.lit(True).alias("is_exact")), "id", "left").withColumn("is_exact", F.coalesce("is_exact", F.lit(False)))
    return flags.withColumn("fused_rank", _first([F.desc("is_exact"), F.desc("score"), "id"]))


def prefer(fused: DataFrame, role: str) -> DataFrame:
    """(…, role, is_exact, fused_rank): exact ones keep their place, then the preferred role, then the rest; scores stay.

    A row whose rank changes has a reason. The rows are a fused list, which is bounded by its legs' limits.
    """
    ranked = fused.withColumn("final_rank", _first([F.when(F.col("is_exact"), 0).when(F.col("role") == role, 1).otherwise(2), "fused_rank"]))
    reason = F.when(F.col("role") == role, f"{role}-preferred").otherwise("source-preference-demotion")
    return ranked.withColumn("ranking_reason", F.when(F.col("final_rank") != F.col("fused_rank"), reason))


def rerank(ranked: DataFrame, scores: DataFrame, most: int = 50, enforce: bool = False) -> DataFrame:
    """The first ``most`` rows by a learned score (id, model_score); shadow mode only says where they would go."""
    j = ranked.join(scores, "id", "left")
    head = (F.col("pre_rank") <= most) & F.col("model_score").isNotNull()
    j = j.withColumn("learned_rank", _first([F.when(head, 0).otherwise(1), F.when(head, -F.col("model_score")), "pre_rank"]))
    return j.withColumn("would_reorder", F.col("learned_rank") != F.col("pre_rank")).withColumn("final_rank", F.col("learned_rank") if enforce else F.col("pre_rank"))


# Roles of symbols that stand for themselves.
CANONICAL_ROLES = ("definition", "macro", "protocol", "variable", "namespace", "module")


def qualify(candidates: DataFrame, question: str, shape: str) -> DataFrame:
    """candidates: (id, text, scope, role, completeness). Adds intent_score and qualified; the order isn't touched."""
    overlap = F.size(F.array_intersect(X.terms(F.col("text")), X.terms(F.lit(question))))
    complete = F.col("completeness").isin("complete-static", "complete-resolved")
    evidence = F.when(complete, 4.0).when(F.col("completeness").isNotNull() & F.lit(shape == "set"), 0.5).otherwise(0.0)
    canonical = F.col("scope").isin("top-level", "namespace", "module") & F.col("role").isin(*CANONICAL_ROLES)
    score = overlap + F.when(F.lit(shape == "set"), evidence).otherwise(0.0) + F.when(canonical, 1.0).otherwise(0.0)
    ok = F.coalesce(complete, F.lit(False)) if shape == "set" else canonical
    return candidates.withColumn("intent_score", score.cast("double")).withColumn("qualified", ok)


def resolve_plan(advice: DataFrame, least_margin: float = 0.02) -> DataFrame:
    """advice: (question_id, shape, margin, qualified, complete_aggregates, relationships). Adds accepted and answerability."""
    support = (
        F.when(F.col("shape") == "lookup", (F.col("qualified") == 1) & (F.col("relationships") == 0))
        .when(F.col("shape") == "set", (F.col("complete_aggregates") > 0) | (F.col("qualified") >= 2))
        .when(F.col("shape") == "flow", (F.col("qualified") >= 2) & (F.col("relationships") > 0))
        .otherwise(False)
    )
    sure = F.coalesce(F.col("margin") >= least_margin, F.lit(False))
    state = F.when(F.col("qualified") == 0, "insufficient").when(support, "supported").otherwise("unknown")
    return advice.withColumn("accepted", sure & support).withColumn("answerability", state)


def select_seeds(candidates: DataFrame, most: int, single: bool = False) -> list:
    """Diverse seeds from at most 100 ranked candidates (id, file, namespace, rank): each of a new file and namespace.

    With columns qualified and intent_score the pool is the qualified ones, or without any those of a positive score, or
    else all. single: the first candidate alone.
    """
    rows = candidates.orderBy("rank").limit(1 if single else 100).collect()  # the list is the bounded result of a ranking
    if not single and {"qualified", "intent_score"} <= set(candidates.columns):
        rows = [r for r in rows if r.qualified] or [r for r in rows if (r.intent_score or 0) > 0] or rows
    taken, files, spaces = [], set(), set()
    for row in rows:
        if row.file not in files and row.namespace not in spaces and len(taken) < most:
            taken.append(row.id)
            files.add(row.file)
            spaces.add(row.namespace)
    return taken


def shape_margin(scores: DataFrame) -> DataFrame:
    """scores: (question_id, shape, score). The best shape of each question and by how much it leads."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "shape")
    led = scores.withColumn("rn", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w))
    return led.where("rn = 1").select("question_id", F.col("shape").alias("suggested"), "margin")


def union_channels(symbols: DataFrame, aggregates: DataFrame, sets: tuple[str, ...], limit: int) -> DataFrame:
    """Two ranked lists (id, rank, …) of the same columns as one: those of the first in their order, then the rest.

    A row of both is one row: sets are united, any other column is the second list's unless that is null.
    """
    names = [c for c in symbols.columns if c not in ("id", "rank")]
    side = lambda df, p: df.select("id", *[F.col(c).alias(f"{p}{c}") for c in ("rank", *names)])
    both = side(symbols.orderBy("rank").limit(limit), "__a").join(side(aggregates.orderBy("rank").limit(limit), "__b"), "id", "full_outer")

    def merged(c: str) -> Column:
        a, b = F.col(f"__a{c}"), F.col(f"__b{c}")
        return F.coalesce(F.array_sort(F.array_union(a, b)), F.array_sort(b), F.array_sort(a)) if c in sets else F.coalesce(b, a)

    place = _first([F.col("__arank").asc_nulls_last(), F.col("__brank")])
    return both.select("id", place.alias("rank"), *[merged(c).alias(c) for c in names]).where(F.col("rank") <= limit)


def candidate_text(name: str = "name", aggregates: str = "aggregates") -> Column:
    """What a candidate says: its name, qualified name, file, signature and documentation, then of each of its aggregates
    (name, kind, completeness, members of key and value) all of these; what is null there leaves its place empty."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = F.array_compact(F.array(name, "qualified_name", "file", "signature", "doc"))

    def words(a: Column) -> Column:
        head = F.array(blank(a["name"]), F.coalesce(a["kind"], F.lit("")), F.coalesce(a["completeness"], F.lit("")))
        members = F.coalesce(a["members"], F.array())
        return F.concat(head, F.transform(members, lambda m: blank(m["key"])), F.transform(members, lambda m: blank(m["value"])))

    rest = F.flatten(F.transform(F.coalesce(F.col(aggregates), F.array()), words))
    return F.array_join(F.concat(own, rest), " ")


def valid_permutation(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (valid): whether after has the ids of before, each once."""
    side = lambda df, d: df.select("id", F.lit(d).alias("__d"))
    per = side(before, 1).unionByName(side(after, 0)).groupBy("id").agg(F.sum("__d").alias("b"), F.sum(1 - F.col("__d")).alias("a"))
    return per.agg(F.coalesce(F.bool_and((F.col("a") == 1) & (F.col("b") == 1)), F.lit(True)).alias("valid"))


def safely_rerank(candidates: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, dict]:
    """The provider's order of a ranked list (id, pre_rank, …), and where it comes from: it has to return the same ids with
    a final_rank. No provider, an error, or other ids: the old order, with the reason."""
    kept = candidates.withColumn("final_rank", F.col("pre_rank"))
    if provider is None:
        return kept, {"status": "unavailable", "reason": "not-configured", "reordered": False}
    try:
        made = provider(candidates)
        if not valid_permutation(candidates, made).first().valid:
            return kept, {"status": "failed", "reason": "identity-mismatch", "reordered": False}
        moved = not made.join(candidates.select("id", F.col("pre_rank").alias("__was")), "id").where("final_rank <> __was").isEmpty()
    except TimeoutError as e:
        return kept, {"status": "timed-out", "reason": "provider-error", "detail": str(e), "reordered": False}
    except Exception as e:  # whatever a provider raises must not lose the list
        return kept, {"status": "failed", "reason": "provider-error", "detail": str(e), "reordered": False}
    return made, {"status": "ready", "reason": None, "reordered": moved}
