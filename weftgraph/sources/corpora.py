"""Evaluation corpora: queries with graded relevance and hard negatives, read from JSON in any of their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, domain string, language string, query_type string, query string, relevance array<struct<qualified_name:string,platform:string,file:string,kind:string,grade:int>>, hard_negatives array<struct<qualified_name:string,platform:string,file:string,kind:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per query. A relevance map of names to grades becomes a list of selectors, so both forms read alike."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("j"))
    lists = F.from_json("j", SCHEMA)
    maps = F.from_json("j", "relevance map<string,int>, hard_negatives array<string>")
    selector = "struct<qualified_name:string,platform:string,file:string,kind:string,grade:int>"
    by_map = F.transform(F.map_entries(maps["relevance"]), lambda e: F.struct(e["key"].alias("qualified_name"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("kind"), e["value"].alias("grade")))
    is_map = F.get_json_object("j", "$.relevance").startswith("{")
    plain = F.get_json_object("j", "$.hard_negatives[0].qualified_name").isNull() & F.get_json_object("j", "$.hard_negatives[0]").isNotNull()
    names = F.transform(maps["hard_negatives"], lambda x: F.struct(x.alias("qualified_name"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("kind")))
    c = raw.withColumn("c", lists)
    return c.select(
        "c.id", "c.domain", "c.language", "c.query_type", "c.query",
        F.when(is_map, by_map.cast(f"array<{selector}>")).otherwise(F.col("c.relevance")).alias("relevance"),
        F.when(plain, names).otherwise(F.col("c.hard_negatives")).alias("hard_negatives"),
    )


def resolve(corpus: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, qualified_name, matches, status) of each selector against symbols (id, qualified_name, platform, file, kind)."""
    s = corpus.select(F.col("id").alias("query_id"), F.explode("relevance").alias("r")).select("query_id", "r.*")
    t = symbols.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("q"), F.col("platform").alias("p"), F.col("file").alias("f"), F.col("kind").alias("k"))
    same = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    j = s.join(t, (F.col("qualified_name") == F.col("q")) & same("platform", "p") & same("file", "f") & same("kind", "k"), "left")
    n = j.groupBy("query_id", "qualified_name", "grade").agg(F.count("symbol_id").alias("matches"))
    return n.withColumn("status", F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous").otherwise("ok"))
