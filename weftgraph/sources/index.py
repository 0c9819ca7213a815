"""A vector index as tables: documents with chunk vectors and what they were made of, and jobs and markers beside them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot

CHUNKS = "symbol_id string, file_id string, document_hash string, model_revision string, document_version string, chunk_index int, chunk_count int, vector array<float>"


def hashed_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A plain encoder to run without a model: words hashed into signed places, of length one. Any function of texts may take its place."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                row[h % dimension] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out

    return encode


def encode_chunks(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "chunk") -> DataFrame:
    """chunks with a vector for each text, encoded batch by batch; null texts count as empty."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*[f for f in chunks.schema if f.name != text], StructField("vector", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f.drop(columns=[text])
            out["vector"] = list(encode(f[text].fillna("").tolist())) if len(f) else []
            yield out

    return chunks.mapInPandas(run, schema)


class VectorIndex:
    """Chunks under a URI, one folder of Parquet for each generation; the pointer file is replaced last."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.root, recursive=True)

    @property
    def generation(self) -> int:
        info = self.fs.get_file_info(f"{self.root}/CURRENT")
        if info.type != pyarrow.fs.FileType.File:
            return 0
        with self.fs.open_input_stream(info.path) as f:
            return int(f.read())

    def documents(self) -> DataFrame:
        n = self.generation
        return self.spark.read.schema(CHUNKS).parquet(f"{self.uri}/{n}") if n else self.spark.createDataFrame([], CHUNKS)

    def indexed(self) -> DataFrame:
        """(symbol_id, file_id, document_hash, model_revision, chunk_count), one row each."""
        return self.documents().groupBy("symbol_id", "file_id", "document_hash", "model_revision").agg(F.max("chunk_count").alias("chunk_count"))

    def replace(self, added: DataFrame, removed: DataFrame) -> int:
        """A generation without the symbols of added and removed (symbol_id), and with added's chunks. Returns its number."""
        gone = removed.select("symbol_id").unionByName(added.select("symbol_id")).distinct()
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        n = self.generation + 1
        self.documents().join(gone, "symbol_id", "left_anti").select(*names).unionByName(added.select(*names)).write.mode("overwrite").parquet(f"{self.uri}/{n}")
        with self.fs.open_output_stream(f"{self.root}/CURRENT.tmp") as f:
            f.write(str(n).encode())
        self.fs.move(f"{self.root}/CURRENT.tmp", f"{self.root}/CURRENT")
        return n

    def search(self, vector: list[float], k: int = 50) -> DataFrame:
        """The k best chunks by dot product, ties by symbol and chunk. Each partition keeps k before they meet."""
        q = F.array(*[F.lit(float(x)) for x in vector])
        return self.documents().withColumn("score", dot(F.col("vector"), q)).drop("vector").orderBy(F.desc("score"), "symbol_id", "chunk_index").limit(k)

    def health(self) -> dict:
        d = self.documents().agg(F.countDistinct("symbol_id").alias("documents"), F.count("*").alias("chunks")).first()
        return {"state": "ready" if self.generation else "empty", "generation": self.generation, "documents": d.documents, "chunks": d.chunks}
