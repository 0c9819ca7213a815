"""Vector functions as expressions of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def max_sim(query: Column, doc: Column) -> Column:
    """Mean over the query's vectors of the best dot product with one of the document's."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(query)


def collected(queries: DataFrame, most: int = 4_096) -> tuple[list, np.ndarray]:
    """A stated query set (query_id, query: vector) as ids and a matrix; ValueError beyond ``most`` rows, which are to be asked in blocks."""
    rows = queries.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries; ask them in blocks")
    rows.sort(key=lambda r: r.query_id)
    return [r.query_id for r in rows], np.array([r.query for r in rows], np.float64)


def scores(queries: DataFrame, corpus: DataFrame, digits: int = 6, k: int | None = None) -> DataFrame:
    """(query_id, id, score): cosines of a stated query set with all of corpus (id, embedding), rounded.

    The corpus stays where it is and meets the queries as matrices, batch by batch; with k a batch keeps its k best of
    each query. Rows without a vector are passed over; a vector of zeros scores 0.
    """
    ids, q = collected(queries)
    kinds = dict(corpus.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(ids) else q

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["embedding"].notna()]
            if not len(f) or not ids:
                continue
            m = np.stack(f["embedding"].to_numpy()).astype(np.float64)
            s = np.round(q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T, digits)
            key = f["id"].to_numpy()
            for row, name in zip(s, ids, strict=True):
                at = np.lexsort((key, -row))[:k] if k else np.arange(len(key))
                yield pd.DataFrame({"query_id": [name] * len(at), "id": key[at], "score": row[at]})

    return corpus.select("id", "embedding").mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best of corpus for each of a stated query set, with their rank; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores(queries, corpus, k=k).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
