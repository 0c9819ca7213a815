"""A store of graph generations: each a folder of Parquet tables whose manifest is written last and names what is whole."""

from __future__ import annotations

import json
import time
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from .. import schema

FORMAT = 1
TABLES = ("files", "symbols", "edges", "references", "topics", "effects", "aggregates", "memberships")


class Snapshot:
    """The tables of one generation; reads see these files whatever is written later."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.schema(schema.struct_type(name)).parquet(f"{self.path}/{name}")
            setattr(self, name, df)
            return df
        raise AttributeError(name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """A question of one's own: SQL that names tables as ``{symbols}`` and values as ``:name``."""
        return self.spark.sql(text, args=args or {}, **self.tables())


class Store:
    """Generations under a URI. ``state()`` is empty, ready or incompatible; a generation without manifest doesn't exist."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.root, recursive=True)

    def _manifests(self) -> list[dict]:
        found = []
        for d in self.fs.get_file_info(pyarrow.fs.FileSelector(self.root)):
            if d.type == pyarrow.fs.FileType.Directory and self.fs.get_file_info(f"{d.path}/manifest.json").type == pyarrow.fs.FileType.File:
                with self.fs.open_input_stream(f"{d.path}/manifest.json") as f:
                    found.append(json.loads(f.read()))
        return sorted(found, key=lambda m: (m["created_at"], m["generation"]))

    def state(self) -> str:
        last = self._manifests()[-1:]
        return "empty" if not last else "ready" if last[0]["format"] == FORMAT else "incompatible"

    def write(self, tables: dict[str, DataFrame], check: bool = True) -> Snapshot:
        """A new generation of the whole graph. Rows that break the model raise ValueError, and nothing is published."""
        name = f"gen-{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.uri}/{name}"
        for t in TABLES:
            tables[t].select(*schema.struct_type(t).fieldNames()).write.parquet(f"{path}/{t}")
        made = Snapshot(self.spark, path, {})
        if check:
            schema.check(made.tables())
        manifest = {"format": FORMAT, "generation": name, "created_at": int(time.time() * 1000), "counts": {t: getattr(made, t).count() for t in TABLES}}
        with self.fs.open_output_stream(f"{self.root}/{name}/manifest.json") as f:
            f.write(json.dumps(manifest).encode())
        made.manifest = manifest
        return made

    def latest(self) -> Snapshot:
        last = self._manifests()[-1:]
        if not last or last[0]["format"] != FORMAT:
            raise ValueError(f"the store is {self.state()}")
        return Snapshot(self.spark, f"{self.uri}/{last[0]['generation']}", last[0])

    def replace_files(self, new: dict[str, DataFrame]) -> Snapshot:
        """A generation in which the new tables' files have the new facts."""
        from ..operators.incremental import replace_files

        return self.write(replace_files(self.latest().tables(), new))

    def delete_files(self, paths: DataFrame) -> Snapshot:
        from ..operators.incremental import delete_files

        return self.write(delete_files(self.latest().tables(), paths))

    def compact_copy(self, uri: str, partitions: int = 8) -> Snapshot:
        """The latest generation with fewer files in another store; counts must agree."""
        last = self.latest()
        made = Store(self.spark, uri).write({t: df.coalesce(partitions) for t, df in last.tables().items()}, check=False)
        if made.manifest["counts"] != last.manifest["counts"]:
            raise ValueError("counts differ after the copy")
        return made

    def cleanup(self, keep: int = 2) -> list[str]:
        """Removes all but the newest generations; returns the names of those removed."""
        gone = [m["generation"] for m in self._manifests()[:-keep]]
        for name in gone:
            self.fs.delete_file(f"{self.root}/{name}/manifest.json")  # first, so that a half-removed one doesn't count
            self.fs.delete_dir(f"{self.root}/{name}")
        return gone
