"""Source files of a project as a table: discovery with typed reasons for what is left out, decoding, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, and data files that are known by their whole path.
LANGUAGES = {"clj": "clojure", "cljs": "clojurescript", "cljc": "clojure-common", "janet": "janet"}
DATA_FILES = ("deps.edn", "bb.edn", "shadow-cljs.edn", "project.edn")
MAX_BYTES = 1 << 20
BINARY_WINDOW = 8192


def language_for_path(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.isin(*DATA_FILES), "edn").otherwise(table[F.regexp_extract(path, r"\.([^./]+)$", 1)])


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern leaves out its own path, all below it, or, without a slash, every path with such a segment."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip("/")
        out = out | (path == p) | path.startswith(p + "/")
        if "/" not in p:
            out = out | F.array_contains(F.split(path, "/"), p)
    return out


def included(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(not prefixes)
    for p in prefixes:
        p = p.strip("/")
        out = out | (path == p) | path.startswith(p + "/")
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified_at, content) of every file under root, read by Spark's binary source."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = F.length(F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))) + 1
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), "%20", " ")
    return df.select(F.substring(plain, start + 1, F.length(plain)).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), "content")


def discover(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files: (path, size, content). Adds language and skipped: null for files to analyse, else why not."""
    lang = language_for_path(F.col("path"))
    binary = F.instr(F.hex(F.substring("content", 1, BINARY_WINDOW)), "00") > 0
    exact = F.expr(f"position(x'00' in substring(content, 1, {BINARY_WINDOW}))") > 0
    why = (
        F.when(~included(F.col("path"), include or []), "not-included")
        .when(excluded(F.col("path"), exclude or []), "excluded")
        .when(lang.isNull(), "unsupported")
        .when(F.col("size") > max_bytes, "file-too-large")
        .when(binary & exact, "binary-file")
    )
    return files.withColumn("language", lang).withColumn("skipped", why)


def decoded(files: DataFrame) -> DataFrame:
    """Adds text and malformed: bad bytes become U+FFFD, and malformed tells of them."""
    text = F.col("content").cast("string")
    return files.withColumn("malformed", ~F.is_valid_utf8(text)).withColumn("text", F.make_valid_utf8(text)).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))


def extract_bytes(source: Column, start: Column, end: Column) -> Column:
    """The half-open byte range of a text, as text."""
    return F.decode(F.substring(F.encode(source, "UTF-8"), start + 1, end - start), "UTF-8")


def byte_offset(source: Column, characters: Column) -> Column:
    """How many bytes the first characters take."""
    return F.octet_length(F.substring(source, F.lit(1), characters))
