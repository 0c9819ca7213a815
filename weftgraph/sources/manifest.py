"""What was observed in which version of a file, kept between analyses so that only changed files are read again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


class Observations:
    """A folder of observations by path and content hash. An index, written last, names the tables that hold; one of another
    format or reader, or with a table missing, counts as none."""

    def __init__(self, spark: SparkSession, uri: str, reader: str = "1"):
        self.spark, self.uri, self.reader = spark, uri.rstrip("/"), reader
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.uri)

    def _index(self) -> dict | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/index.json") as f:
                index = json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return None
        if not isinstance(index, dict) or (index.get("format"), index.get("reader")) != (FORMAT, self.reader):
            return None
        whole = all(self.fs.get_file_info(f"{self.root}/{index['name']}/{t}/_SUCCESS").type == pyarrow.fs.FileType.File for t in ("files", "observed"))
        return index if whole else None

    def active(self) -> tuple[DataFrame, DataFrame] | None:
        """(files (path, content_hash), observed) of the last analysis, or None."""
        index = self._index()
        return index and tuple(self.spark.read.parquet(f"{self.uri}/{index['name']}/{t}") for t in ("files", "observed"))

    def observed(self, files: DataFrame, observe: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Observations of files (path, text, content_hash); those of a known path and hash are not read again.

        The result is the new state: it is written, then the index, and the state before is removed. Repeated paths are one
        file. A step that breaks off leaves the old state.
        """
        now = files.select("path", "content_hash").distinct()
        known = self.active()
        if known:
            same = known[0].join(now, ["path", "content_hash"], "left_semi").select("path").distinct()
            kept = known[1].join(same, "path", "left_semi")
            found = kept.unionByName(observe(files.join(same, "path", "left_anti").select("path", "text")))
        else:
            found = observe(files.select("path", "text"))
        before, name = self._index(), f"state-{uuid.uuid4().hex}"
        now.write.parquet(f"{self.uri}/{name}/files")
        found.write.parquet(f"{self.uri}/{name}/observed")
        with self.fs.open_output_stream(f"{self.root}/index.json") as f:
            f.write(json.dumps({"format": FORMAT, "reader": self.reader, "name": name}).encode())
        if before:
            self.fs.delete_dir(f"{self.root}/{before['name']}")
        return self.spark.read.parquet(f"{self.uri}/{name}/observed")

    def reused(self, files: DataFrame) -> DataFrame:
        """(reused, changed): how many of files (path, content_hash) are known as they are, and how many are not."""
        known = self.active()
        if not known:
            return files.agg(F.lit(0).cast("long").alias("reused"), F.count("*").alias("changed"))
        k = known[0].select("path", "content_hash", F.lit(True).alias("known"))
        return files.select("path", "content_hash").join(k, ["path", "content_hash"], "left").agg(F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("changed"))
