"""One object for all that a user asks of a graph: analysis, queries, search, context, export and the vector index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import export, extract, packets, reads, retrieve, traverse
from .sources.index import VectorIndex, hashed_encoder
from .sources.manifest import Observations
from .sources.store import Store
from .streaming import worker

TOPIC_COMMANDS = {"registrations": "topic-registers", "dispatchers": "event-dispatches", "subscribers": "subscribes", "state_readers": "state-reads", "state_writers": "state-writes"}
# What a question of each shape sounds like.
SHAPES = {"lookup": "where is this defined what is this function", "set": "list all available options kinds which are supported", "flow": "how does it flow from one step to another what happens when"}


class Engine:
    def __init__(self, spark: SparkSession, uri: str, encode: Callable | None = None, model: str = "hashed", revision: str = "1"):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.store = Store(spark, f"{self.uri}/graph")
        self.index = VectorIndex(spark, f"{self.uri}/index")
        self.observations = Observations(spark, f"{self.uri}/observations")
        self.encode, self.model, self.revision = encode or hashed_encoder(), model, revision

    @property
    def graph(self):
        return self.store.latest()

    # analysis
    def analyze(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None, check_only: bool = False) -> dict:
        """Reads a project into a new generation and returns its counts; check_only writes nothing.

        Where no file changed since the last generation, that one stays; else only changed files are read again, and what
        was observed in the others is resolved anew with them.
        """
        found = extract.sources(self.spark, root, include, exclude)
        if check_only:
            return {name: df.count() for name, df in extract.materialize(found, extract.observed_of(found)).items()}
        if self.store.state() == "ready":
            from .operators.incremental import changed_files

            if changed_files(self.graph.files, extract.files_table(found)).isEmpty():
                return self.graph.manifest["counts"]
        return self.store.write(extract.materialize(found, extract.observed_of(found, self.observations))).manifest["counts"]

    # queries
    def stats(self) -> DataFrame:
        return reads.stats(self.graph)

    def quality(self) -> DataFrame:
        return reads.graph_quality(self.graph)

    def find_symbol(self, term: str) -> dict:
        """Matches, or the names that the term may have meant."""
        g = self.graph
        found = [r.asDict() for r in reads.exact_symbols(g, term, 100).select("id", "name", "qualified_name", "kind", "file").collect()]
        return {"matches": found, "suggestions": [] if found else [r.qualified_name for r in retrieve.suggestions(g.symbols, term).collect()]}

    def _one(self, term: str) -> DataFrame:
        found = reads.exact_symbols(self.graph, term).select("id")
        if found.isEmpty():
            raise ValueError(f"no symbol {term!r}; near are {self.find_symbol(term)['suggestions']}")
        return found

    def callers(self, term: str) -> DataFrame:
        return reads.callers(self.graph, self._one(term))

    def callees(self, term: str, include_external: bool = False) -> DataFrame:
        return reads.callees(self.graph, self._one(term), include_external)

    def trace(self, term: str, depth: int = traverse.DEPTH, limit: int = traverse.LIMIT) -> traverse.Trace:
        return traverse.trace(self.graph, self._one(term), depth, limit)

    def entry_points(self) -> DataFrame:
        return reads.entry_points(self.graph)

    def effects(self) -> DataFrame:
        return reads.effects(self.graph)

    def unresolved(self, **filters) -> DataFrame:
        return reads.unresolved(self.graph, **filters)

    def topics(self) -> DataFrame:
        return reads.topics_used(self.graph)

    def topic(self, command: str, topic: str) -> DataFrame:
        """command: registrations, dispatchers, subscribers, state_readers or state_writers."""
        return reads.topic_relationships(self.graph, topic, TOPIC_COMMANDS[command])

    # search
    def search(self, question: str, mode: str = "hybrid", limit: int = 50, preference: str = "auto") -> DataFrame:
        """Ranked symbols: mode fts, vector or hybrid; vectors that aren't fresh don't count. Exact matches go first.

        preference: production, test, none, or auto, which asks for tests if the question does.
        """
        g = self.graph
        lexical = retrieve.find_symbols(g, question, limit).select("id", F.col("score") + F.when(F.col("matched") == "exact", 1e6).otherwise(0.0)) if mode != "vector" else None
        lexical = self.spark.createDataFrame([], "id string, score double") if lexical is None else lexical.toDF("id", "score")
        hits = self.index.search(self.encode([question])[0].tolist(), 4 * limit) if mode != "fts" and self.index.generation else None
        if hits is None:
            semantic = self.spark.createDataFrame([], "id string, score double")
        else:
            current = self.desired().select("symbol_id", "document_hash", "model_revision").distinct()
            none = self.spark.createDataFrame([], "symbol_id string, file_id string")
            semantic = retrieve.collapse_chunks(retrieve.fresh(hits, current, none, none)).select(F.col("symbol_id").alias("id"), "score")
        fused = retrieve.fuse(lexical, semantic, reads.exact_symbols(g, question).select("id"))
        s = reads.symbol_records(g).select(F.col("id").alias("s_id"), "qualified_name", "file", "kind", "scope", F.col("role").alias("symbol_role"))
        out = fused.join(s, F.col("id") == F.col("s_id")).drop("s_id").withColumn("role", X.source_role(F.col("file")))
        wanted = preference if preference != "auto" else ("test" if {"test", "tests", "spec", "fixture"} & set(question.lower().split()) else "production")
        return retrieve.prefer(out, wanted).orderBy("final_rank").limit(limit)

    def plan(self, question: str, max_seeds: int = 4) -> dict:
        """The shape that a question seems to have, by how much, and the symbols to begin with."""
        vectors = self.encode([question, *SHAPES.values()])
        scores = {k: float(vectors[0] @ v) for k, v in zip(SHAPES, vectors[1:], strict=True)}
        order = sorted(scores, key=lambda k: (-scores[k], k))
        found = self.search(question).withColumn("namespace", X.namespace_name(F.col("qualified_name"))).withColumn("rank", F.col("final_rank"))
        seeds = retrieve.select_seeds(found, min(2, max_seeds) if order[0] == "flow" else max_seeds)
        return {"shape": order[0], "margin": scores[order[0]] - scores[order[1]], "scores": scores, "seeds": seeds}

    # context
    def context(self, symbol: str | None = None, intent: str | None = None, max_tokens: int = 8000, depth: int = 2) -> dict:
        """A packet around a symbol, or around what a question is about."""
        seeds = [r.id for r in self._one(symbol).orderBy("id").limit(16).collect()] if symbol else self.plan(intent or "")["seeds"]
        if not seeds:
            raise ValueError("nothing found for the question")
        return packets.packet(self.graph, seeds, max_tokens, depth)

    def export(self, path: str, kind: str = "jsonl") -> None:
        export.write(export.entities(self.graph), path, kind)

    def summary(self) -> str:
        return export.summary(self.graph).first().summary

    # the vector index
    def sources(self) -> DataFrame:
        """(file_id, text) as of the last analysis, where texts were kept; else empty texts."""
        try:
            return self.spark.read.schema("file_id string, text string").parquet(f"{self.uri}/sources")
        except Exception as e:  # no such folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.graph.files.select(F.col("id").alias("file_id"), F.lit(None).cast("string").alias("text"))

    def desired(self) -> DataFrame:
        return worker.documents(self.graph, self.sources(), self.model, self.revision)

    def sync(self, dirty: DataFrame | None = None) -> dict:
        """Makes the index what the graph asks for; returns counts by action."""
        return worker.reconcile(self.desired(), self.index, self.encode, dirty)

    def status(self) -> dict:
        c = worker.coverage(self.desired(), self.index).first()
        return {"graph": self.store.state(), "index": self.index.health(), "desired": c.desired, "indexed": c.indexed, "coverage": c.coverage}


def main(argv: list[str] | None = None) -> None:
    """``python -m weftgraph.engine STORE COMMAND [ARGUMENT…]``; rows are printed as JSON lines."""
    import sys

    args = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, args[0])
    name, rest = args[1].replace("-", "_"), args[2:]
    out = engine.topic(name, *rest) if name in TOPIC_COMMANDS else getattr(engine, name)(*rest)
    if isinstance(out, traverse.Trace):
        out = out.results
    if isinstance(out, DataFrame):
        for row in out.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    else:
        print(out if isinstance(out, str) else json.dumps(out, default=str))


if __name__ == "__main__":
    main()
