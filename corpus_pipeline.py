"""From raw documents to packed sequences: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes any table with the columns of documents: nulls in each of them, empty and very long texts, ties and
repeated rows, further columns under any name, and no rows at all, which gives no rows. All but the last keep the columns
as they are. What each does with the odd ones is told at the operator that it calls, and in short here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, langid, packing, pii, simhash
from weftgraph.llm.common import materialize, scratch, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that the model finds, go: null, empty and blank texts among them.

    Where nothing can be learned, as no row has a language, a letter is enough. Repeated rows stay or go together.
    """
    small_batches(spark)
    model = langid.learn(docs.where(langid.remainder(F.col("doc_id"), 5) != 0))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, one without an id only where none has one.

    Rows equal in id and text become one; rows that share an id with different texts are told apart. Texts without words are
    one group.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none, and an empty benchmark none to hold."""
    small_batches(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars follows; null and empty texts stay as they are."""
    small_batches(spark)
    return pii.redact_texts(docs, pii.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048; a null or empty text is its end alone, and repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again; a stage's working tables go once it is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch() as made:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            made.forget(made[-1])
    return docs


ORACLE_SQL = None
